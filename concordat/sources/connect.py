"""One door to all stores: ``open_store`` picks a reader by URL."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from concordat.errors import Refusal, Refused, ToolkitError
from concordat.sources import sqlite
from concordat.sources.urls import PostgresConfig, SqliteConfig, parse_database_url, runtime_database_url


@dataclass(frozen=True)
class Store:
    """``table(name)`` gives a frame of loose cells for SQLite and of typed columns otherwise."""

    spark: SparkSession
    config: SqliteConfig | PostgresConfig

    def table(self, name: str, **options: str) -> DataFrame:
        if isinstance(self.config, SqliteConfig):
            return sqlite.read_table(self.spark, self.config.path, name)
        return self.spark.read.format("jdbc").options(**self.config.jdbc, dbtable=name, **options).load()

    def query(self, text: str) -> DataFrame:
        if isinstance(self.config, SqliteConfig):
            raise ToolkitError("INVALID_OPTIONS", "queries go to strict stores only")
        return self.spark.read.format("jdbc").options(**self.config.jdbc, query=text).load()

    def health(self) -> dict:
        if isinstance(self.config, SqliteConfig):
            return sqlite.health(self.config.path)
        try:
            return {"ok": self.query("select 1 as one").first()["one"] == 1}
        except Exception:
            return {"ok": False}


def open_store(spark: SparkSession, url: str) -> Store:
    return Store(spark, parse_database_url(url))


def open_store_from_environment(spark: SparkSession, env: Mapping[str, str], purpose: str = "runtime", pooling: str = "required") -> Store:
    """The store of a runtime process: through its pool by default, which direct work has to decline."""
    return open_store(spark, runtime_database_url(env, purpose, pooling))


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise Refused(Refusal("source-read-failed", name)) from None
        raise


def ledger_ids(spark: SparkSession, statement: str, **frames: DataFrame) -> DataFrame:
    """Migration ids of a statement that returns ``id``."""
    return spark.sql(statement, **frames).select("id").distinct()


def tls_options(sslmode: str, ca_file: str | None = None) -> dict[str, str]:
    """JDBC options of a TLS mode. Verification needs a CA file that reads as PEM."""
    if sslmode.startswith("verify-") and not ca_file:
        raise Refused(Refusal("tls-ca-missing"))
    if ca_file:
        try:
            with open(ca_file, encoding="ascii") as f:
                if "-----BEGIN CERTIFICATE-----" not in f.read():
                    raise ValueError
        except (OSError, ValueError):
            raise Refused(Refusal("tls-ca-unreadable")) from None
    return {"sslmode": sslmode} | ({"sslrootcert": ca_file} if ca_file else {})
