"""Running an application's own tests against both kinds of stores.

``each_store`` runs a test once for every dialect asked for: a throwaway SQLite file, and a throwaway database on a
strict server that is running. A strict store that is asked for and cannot be had fails its tests and never skips
them: a dialect that is skipped is how two stores drift apart.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from concordat.errors import ToolkitError
from concordat.sinks.database import JdbcSession
from concordat.sinks.jdbc import quoted
from concordat.sources.connect import Store, open_store
from concordat.sources.urls import PostgresConfig, parse_database_url

DIALECTS = ("sqlite", "postgres")
WHICH, SERVER = "CONCORDAT_TEST_DIALECTS", "CONCORDAT_TEST_SERVER_URL"


def dialects_from_env(env: Mapping[str, str] | None = None) -> tuple[str, ...]:
    """``sqlite``, ``postgres`` or ``both``, which is the default; anything else is an error, so that a slip of the
    pen drops no dialect."""
    given = (os.environ if env is None else env).get(WHICH, "").strip() or "both"
    if given == "both":
        return DIALECTS
    if given not in DIALECTS:
        raise ToolkitError("INVALID_OPTIONS", f"{WHICH} must be sqlite, postgres or both")
    return (given,)


@dataclass
class TestStore:
    __test__ = False  # not a test of its own

    dialect: str
    url: str
    opened: list[Store] = field(default_factory=list)

    def open(self, spark: SparkSession) -> Store:
        self.opened.append(open_store(spark, self.url))
        return self.opened[-1]


def _url(config: PostgresConfig) -> str:
    from urllib.parse import quote

    auth = ":".join(quote(x, safe="") for x in (config.user, config.password) if x)
    host = f"[{config.host}]" if ":" in config.host else config.host
    return f"postgres://{auth}{'@' * bool(auth)}{host}:{config.port}/{quote(config.database, safe='')}?sslmode={config.sslmode}"


@contextmanager
def test_database(spark: SparkSession, server_url: str, connect: Callable[..., JdbcSession] = JdbcSession.to) -> Iterator[str]:
    """A database of its own on a server, dropped afterwards, as a URL."""
    server = parse_database_url(server_url)
    if not isinstance(server, PostgresConfig):
        raise ToolkitError("INVALID_OPTIONS", f"{SERVER} must be the URL of a PostgreSQL server")
    name = f"concordat_test_{uuid.uuid4().hex}"

    def alone(sql: str) -> None:
        session = connect(spark, server)
        try:
            session.execute("commit")  # such statements stand outside any transaction
            session.execute(sql)
        finally:
            session.close()

    alone(f"create database {quoted(name)}")
    try:
        yield _url(replace(server, database=name))
    finally:
        alone(f"drop database if exists {quoted(name)} with (force)")


test_database.__test__ = False


@contextmanager
def open_test_store(dialect: str, spark: SparkSession | None = None, env: Mapping[str, str] | None = None) -> Iterator[TestStore]:
    if dialect == "sqlite":
        with tempfile.TemporaryDirectory(prefix="concordat-test-") as folder:
            yield TestStore(dialect, f"file:{folder}/test.db")
        return
    url = (os.environ if env is None else env).get(SERVER)
    if not url or spark is None:
        raise ToolkitError("INVALID_OPTIONS", f"tests of the strict store need {SERVER} and a session")
    with test_database(spark, url) as made:
        yield TestStore(dialect, made)


def each_store(*dialects: str, env: Mapping[str, str] | None = None):
    """A decorator for pytest: the test gets ``store`` once for each dialect that is wanted and asked for. With a
    ``spark`` fixture the strict store can be opened too."""
    import functools
    import inspect

    import pytest

    wanted = [d for d in (dialects or DIALECTS) if d in dialects_from_env(env)]

    def over(test: Callable) -> Callable:
        @functools.wraps(test)
        def run(*args, dialect: str, **given):
            with open_test_store(dialect, given.get("spark"), env) as store:
                return test(*args, store=store, **given)

        names = [p for n, p in inspect.signature(test).parameters.items() if n != "store"]
        run.__signature__ = inspect.Signature([*names, inspect.Parameter("dialect", inspect.Parameter.KEYWORD_ONLY)])
        return pytest.mark.parametrize("dialect", wanted)(run)

    return over
