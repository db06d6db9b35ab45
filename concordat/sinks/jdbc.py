"""Strict tables into a database over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordat.errors import Refusal, Refused
from concordat.manifest import Manifest, TableSpec
from concordat.sources.urls import PostgresConfig


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def load(df: DataFrame, table: TableSpec, config: PostgresConfig, schema: str = "public", batch_rows: int = 10_000, truncate: bool = False) -> None:
    """Append the written columns, in batches and one connection a partition; with ``truncate`` the table
    is emptied first and keeps its definition."""
    if isinstance(batch_rows, bool) or not isinstance(batch_rows, int) or batch_rows < 1:
        raise Refused(Refusal("invalid-option", None, None, "batch_rows"))
    names = [c.name for c in table.written]
    options = config.jdbc | {"dbtable": f"{quoted(schema)}.{quoted(table.name)}", "batchsize": str(batch_rows), "isolationLevel": "READ_COMMITTED", "stringtype": "unspecified"}
    if truncate:
        options["truncate"] = "true"
    try:
        df.select(*names).write.format("jdbc").options(**options).mode("overwrite" if truncate else "append").save()
    except Exception:  # driver text may hold values or the URL
        raise Refused(Refusal("load-failed", table.name)) from None


def restart_statements(sequences: list[dict]) -> list[str]:
    """What makes each planned sequence go on after the load."""
    out = []
    for s in sequences:
        schema, _, name = s["object"].partition(".")
        end = "" if s["restart_with"] is None else f" with {int(s['restart_with'])}"
        out.append(f"alter sequence {quoted(schema)}.{quoted(name)} restart{end}")
    return out


def constraint_statements(foreign_keys: list[dict]) -> tuple[list[str], list[str]]:
    """Statements that drop the keys before a load and add them again after it, in both orders by name."""
    drop, add = [], []
    for fk in sorted(foreign_keys, key=lambda k: (k["table_schema"], k["table"], k["name"])):
        head = f"alter table {quoted(fk['table_schema'])}.{quoted(fk['table'])}"
        drop.append(f"{head} drop constraint {quoted(fk['name'])}")
        add.append(f"{head} add constraint {quoted(fk['name'])} {fk['definition']}")
    return drop, add


def read_one(spark: SparkSession, table: TableSpec, config: PostgresConfig, schema: str = "public", partitions: int | None = None) -> DataFrame:
    """A table as a frame; JSON, exact numerics and UUIDs come as text so that no digit is lost. The table is
    read by ranges of its pages, one query each, so that no connection carries all of it."""
    as_text = {"decimal-as-string", "json-text", "uuid-text"}
    columns = ", ".join(f"{quoted(c.name)}::text as {quoted(c.name)}" if c.codec in as_text else quoted(c.name) for c in table.columns)
    source = f"{quoted(schema)}.{quoted(table.name)}"
    n = partitions or spark.sparkContext.defaultParallelism
    size = f"(select pg_catalog.pg_relation_size({literal(source)}::regclass) / current_setting('block_size')::bigint as pages) s"
    pages = int(spark.read.format("jdbc").options(**config.jdbc, dbtable=size).load().first()["pages"])
    predicates = page_ranges(pages, n)
    relation = f"(select {columns}, ctid from {source}) t"
    frame = spark.read.jdbc(config.jdbc["url"], relation, predicates=predicates, properties={k: v for k, v in config.jdbc.items() if k != "url"})
    return frame.drop("ctid")


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def page_ranges(pages: int, n: int) -> list[str]:
    """Conditions that cut a table into at most ``n`` runs of pages; the last one is open, for rows that came since."""
    step = max(1, -(-pages // max(1, n)))
    starts = list(range(0, max(pages, 1), step))
    ends = [*starts[1:], None]
    return [f"ctid >= '({a},0)'::tid" + ("" if b is None else f" and ctid < '({b},0)'::tid") for a, b in zip(starts, ends)]


def read_all(spark: SparkSession, manifest: Manifest, config: PostgresConfig, schema: str = "public") -> dict[str, DataFrame]:
    """The manifest's tables as frames."""
    return {t.name: read_one(spark, t, config, schema) for t in manifest.tables.values()}
