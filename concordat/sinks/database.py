"""Publishing a move in a database: executors load and verify tables aside, one transaction puts them in place.

Executors cannot share a transaction. So every table is loaded in parallel into a schema of its own run,
read back and verified there, and only then one session of the driver takes the locks, looks at the
target again under them, empties it if that is allowed, drops the keys of copied tables, moves the
verified rows inside the server, adds the keys again and compares them, restarts sequences, proves that
both tables hold the same rows, writes the receipt and commits. Whatever fails before that commit leaves
the target as it was; a commit whose answer is lost is looked up by its transaction number.
"""

from __future__ import annotations

import contextlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import SparkSession

from concordat.errors import OutcomeError, Refusal, Refused
from concordat.manifest import Manifest
from concordat.operators.constraints import FIELDS, KEY
from concordat.operators.gate import RECEIPT_COLUMNS, RECEIPT_TABLE
from concordat.sinks.jdbc import constraint_statements, quoted, restart_statements
from concordat.sources.urls import PostgresConfig


class Session(Protocol):
    """One connection in one transaction at a time."""

    def execute(self, sql: str) -> None: ...
    def query(self, sql: str) -> list[tuple]: ...
    def commit(self) -> None: ...
    def rollback(self) -> None: ...
    def close(self) -> None: ...


class SessionError(Exception):
    """A failed statement: its SQL state and nothing of its text, which may hold values."""

    def __init__(self, state: str | None):
        super().__init__(f"SQL state {state}")
        self.state = state


class JdbcSession:
    """A session through the JVM's own driver manager."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None, driver: str | None = None):
        jvm = spark._jvm
        given = jvm.java.util.Properties()
        for k, v in (properties or {}).items():
            given.setProperty(k, v)
        if driver:
            jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(driver).getDeclaredConstructor(None).newInstance(None)
        self._connection = self._guarded(lambda: jvm.java.sql.DriverManager.getConnection(url, given))
        self._guarded(lambda: self._connection.setAutoCommit(False))

    @classmethod
    def to(cls, spark: SparkSession, config: PostgresConfig) -> JdbcSession:
        options = config.jdbc
        try:
            return cls(spark, options["url"], {k: options[k] for k in ("user", "password") if k in options})
        except SessionError:
            raise Refused(Refusal("target-connect-failed")) from None

    @staticmethod
    def _guarded(call: Callable):
        try:
            return call()
        except Exception as e:
            java = getattr(e, "java_exception", None)
            state = None
            with contextlib.suppress(Exception):
                state = java.getSQLState()
            raise SessionError(state) from None

    def execute(self, sql: str) -> None:
        def run() -> None:
            statement = self._connection.createStatement()
            try:
                statement.execute(sql)
            finally:
                statement.close()

        self._guarded(run)

    def query(self, sql: str) -> list[tuple]:
        def run() -> list[tuple]:
            statement = self._connection.createStatement()
            try:
                found = statement.executeQuery(sql)
                n = found.getMetaData().getColumnCount()
                rows = []
                while found.next():
                    rows.append(tuple(found.getString(k + 1) for k in range(n)))
                return rows
            finally:
                statement.close()

        return self._guarded(run)

    def commit(self) -> None:
        self._guarded(self._connection.commit)

    def rollback(self) -> None:
        self._guarded(self._connection.rollback)

    def close(self) -> None:
        with contextlib.suppress(Exception):
            self._connection.close()


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qualified(schema: str, name: str) -> str:
    return f"{quoted(schema)}.{quoted(name)}"


@dataclass(frozen=True)
class Publication:
    """What the transaction needs to know. ``schema`` is the target's, ``aside`` the one the tables are in."""

    run_id: str
    started: str
    manifest: Manifest
    per_table: dict[str, dict]
    foreign_keys: list[dict]
    sequences: list[dict]
    locks: list[tuple[str, str]]
    aside: str
    schema: str = "public"
    truncate: bool = False
    lock_timeout_ms: int = 10_000


def aside_schema(run_id: str) -> str:
    return f"concordat_run_{run_id.replace('-', '')}"


def create_aside(session: Session, manifest: Manifest, aside: str, schema: str = "public") -> None:
    """Empty tables like the target's for the executors to load; constraints come with the target's own."""
    session.execute(f"create schema {quoted(aside)}")
    for t in manifest.tables:
        session.execute(f"create unlogged table {qualified(aside, t)} (like {qualified(schema, t)} including generated)")
    session.commit()


def drop_aside(session: Session, aside: str) -> None:
    with contextlib.suppress(SessionError):
        session.rollback()
        session.execute(f"drop schema if exists {quoted(aside)} cascade")
        session.commit()


def moving_statements(p: Publication) -> list[str]:
    """Rows of the written columns from the tables aside, generated ones being the server's to fill."""
    out = []
    for t in p.manifest.tables.values():
        names = ", ".join(quoted(c.name) for c in t.written)
        out.append(f"insert into {qualified(p.schema, t.name)} ({names}) overriding system value select {names} from {qualified(p.aside, t.name)}")
    return out


def proof_query(p: Publication, table: str) -> str:
    """How many rows one of the two tables has and the other has not, copies counted."""
    names = ", ".join(quoted(c.name) + "::text" for c in p.manifest.tables[table].written)
    a, b = (f"select {names} from {qualified(s, table)}" for s in (p.schema, p.aside))
    return f"select count(*) from (({a} except all {b}) union all ({b} except all {a})) d"


def receipt_statements(p: Publication) -> list[str]:
    schema, _, name = RECEIPT_TABLE.partition(".")
    columns = ", ".join(f"{quoted(n)} {kind}{' primary key' if n == 'run_id' else ' not null'}" for n, kind in RECEIPT_COLUMNS.items())
    values = ", ".join(literal(v) for v in (p.run_id, p.started, p.manifest.sha256, json.dumps(p.per_table, sort_keys=True)))
    return [
        f"create schema if not exists {quoted(schema)}",
        f"create table if not exists {qualified(schema, name)} ({columns})",
        f"lock table {qualified(schema, name)} in access exclusive mode",
        f"insert into {qualified(schema, name)} ({', '.join(map(quoted, RECEIPT_COLUMNS))}) values ({values})",
    ]


def _restored(before: list[dict], after: list[dict]) -> None:
    def by_key(keys: list[dict]) -> dict[tuple, dict]:
        return {tuple(k[f] for f in KEY): k for k in keys}

    was, now = by_key(before), by_key(after)
    for key, fk in was.items():
        if key not in now or any(now[key].get(f) != fk.get(f) for f in FIELDS):
            raise Refused(Refusal("foreign-keys-changed", key[1], None, key[2]))
    if was.keys() != now.keys():
        raise Refused(Refusal("foreign-keys-changed"))


def publish(
    session: Session,
    p: Publication,
    *,
    inspect: Callable[[Session], list[Refusal]],
    keys_now: Callable[[Session], list[dict]],
    receipt_sound: Callable[[Session], bool],
    again: Callable[[], Session],
    dry_run: bool = False,
    before_commit: Callable[[Session], None] | None = None,
    poll_seconds: float = 30.0,
) -> dict | None:
    """The one transaction. ``inspect`` repeats the preflight under the locks, ``keys_now`` reads the copied
    tables' keys, ``receipt_sound`` judges the receipt table, and ``again`` opens another session if this one is lost.
    Returns the transaction's number and whether its commit was acknowledged; None for a dry run."""
    try:
        session.execute(f"set local lock_timeout = '{int(p.lock_timeout_ms)}ms'")
        session.execute("set local statement_timeout = 0")
        session.execute("set local row_security = off")
        if p.locks:
            session.execute(f"lock table {', '.join(qualified(*x) for x in sorted(p.locks))} in access exclusive mode")
        found = inspect(session)
        if found:
            raise Refused(found[0])
        if p.truncate:
            session.execute(f"truncate {', '.join(qualified(p.schema, t) for t in p.manifest.tables)} restrict")
        drop, add = constraint_statements(p.foreign_keys)
        for sql in drop:
            session.execute(sql)
        for sql, t in zip(moving_statements(p), p.manifest.tables):
            try:
                session.execute(sql)
            except SessionError as e:
                raise (e if e.state == LOCK_TIMEOUT else Refused(Refusal("load-failed", t))) from None
        for sql in add:
            session.execute(sql)
        _restored(p.foreign_keys, keys_now(session))
        for sql in restart_statements(p.sequences):
            session.execute(sql)
        for t in p.manifest.tables:
            if int(session.query(proof_query(p, t))[0][0]):
                raise Refused(Refusal("verification-mismatch", t))
        *before, insert = receipt_statements(p)
        for sql in before:
            session.execute(sql)
        if not receipt_sound(session):
            raise Refused(Refusal("receipt-table-invalid", RECEIPT_TABLE))
        session.execute(insert)
        if before_commit:
            before_commit(session)
        if dry_run:
            session.rollback()
            return None
        number = session.query("select pg_catalog.txid_current()::text")[0][0]
    except SessionError as e:
        with contextlib.suppress(SessionError):
            session.rollback()
        raise Refused(Refusal("lock-timeout" if e.state == LOCK_TIMEOUT else "execute-failed")) from None
    except BaseException:
        with contextlib.suppress(SessionError):
            session.rollback()
        raise
    try:
        session.commit()
        return {"transaction": number, "acknowledged": True}
    except SessionError:  # no error is proof of anything: the transaction's own status decides
        outcome = commit_outcome(session, again, number, poll_seconds)
    if outcome == "committed":
        return {"transaction": number, "acknowledged": False}
    raise OutcomeError(outcome, p.run_id) from None


LOCK_TIMEOUT = "55P03"


def commit_outcome(session: Session, again: Callable[[], Session], number: str, poll_seconds: float, pause: float = 0.25) -> str:
    """``committed``, ``aborted`` or ``unknown``: asked on the session that is there, then on new ones until time is up."""
    question = f"select pg_catalog.txid_status({int(number)}::bigint)"
    ends, asked = time.monotonic() + poll_seconds, session
    while True:
        try:
            status = asked.query(question)[0][0]
            if status in ("committed", "aborted"):
                return status
            if status is None:
                return "unknown"
        except (SessionError, Refused):
            asked.close()
            with contextlib.suppress(SessionError, Refused):
                asked = again()
        if time.monotonic() >= ends:
            return "unknown"
        time.sleep(pause)
