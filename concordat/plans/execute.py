"""Loading a strict target from a loose snapshot, and verifying every row before publication."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.errors import OutcomeError, Refusal, Refused, to_refusal
from concordat.functions import codecs
from concordat.manifest import Manifest, TableSpec
from concordat.operators import catalog, gate, keys, reconcile
from concordat.plans import target as target_facts
from concordat.plans.plan import Options, Plan, Target, build_plan, duration, source_tables, whole
from concordat.sinks import database, jdbc
from concordat.sinks.staged import Receipt, StagedFolder, write_receipt
from concordat.sources.urls import PostgresConfig


@dataclass
class Hooks:
    """Seams for tests and progress. Those of a table get its name and may return another frame;
    ``after_outcome`` runs when the outcome is known, whatever it is, and cannot change it."""

    after_load: Callable[[str, DataFrame], DataFrame] | None = None
    before_verify: Callable[[str, DataFrame], DataFrame] | None = None
    before_commit: Callable[[], None] | None = None
    after_outcome: Callable[[str], None] | None = None
    on_progress: Callable[[str, str], None] | None = None

    def told(self, step: str, table: str) -> None:
        if self.on_progress:
            self.on_progress(step, table)

    def ended(self, outcome: str) -> None:
        if self.after_outcome:
            with contextlib.suppress(Exception):
                self.after_outcome(outcome)


@dataclass
class Result:
    outcome: str
    run_id: str
    tables: list[dict] = field(default_factory=list)
    totals: dict = field(default_factory=dict)
    plan: Plan | None = None
    receipt: Receipt | None = None
    commit: dict | None = None


def strict_frame(loose: DataFrame, table: TableSpec) -> DataFrame:
    """The written columns of a loose table in their strict types."""
    return loose.select(*[codecs.to_strict(c, F.col(c.name)).alias(c.name) for c in table.written])


def execute_into(
    spark: SparkSession,
    snapshot_path: str,
    manifest: Manifest,
    config: PostgresConfig,
    options: Options = Options(),
    *,
    dry_run: bool = False,
    snapshot_sha256: str | None = None,
    lock_timeout_ms: int = 10_000,
    commit_poll_seconds: float = 30.0,
    hooks: Hooks = Hooks(),
    open_session: Callable[[], database.Session] | None = None,
    load: Callable[..., None] = jdbc.load,
    read_back: Callable[..., DataFrame] = jdbc.read_one,
) -> Result:
    """Plan, load aside in parallel, verify there, and publish in one transaction of the target database. A dry
    run rolls that transaction back. The last arguments are seams: how sessions are opened, and how
    executors write and read a table."""
    whole("lock_timeout_ms", lock_timeout_ms)
    duration("commit_poll_seconds", commit_poll_seconds)
    run_id, started, began = str(uuid.uuid4()), datetime.now(UTC).isoformat(), time.monotonic()
    opened = open_session or (lambda: database.JdbcSession.to(spark, config))
    session, aside = opened(), database.aside_schema(run_id)
    outcome, created = "failed", False
    try:

        def look(at: database.Session) -> Plan:
            facts = target_facts.read_target(spark, config.host, config.port, manifest.tables, target_facts.session_reader(spark, at))
            return build_plan(spark, snapshot_path, manifest, facts, options, {"sha256": snapshot_sha256})

        session.execute("set transaction isolation level repeatable read, read only")
        plan = look(session)
        session.rollback()
        if not plan.ok:
            raise Refused(plan.refusals[0])
        result = Result("dry-run" if dry_run else "committed", run_id, plan=plan)
        database.create_aside(session, manifest, aside)
        created = True
        sources = source_tables(spark, snapshot_path, manifest)
        for name, spec in manifest.tables.items():
            hooks.told("load", name)
            t0 = time.monotonic()
            frame = strict_frame(sources[name], spec)
            load(hooks.after_load(name, frame) if hooks.after_load else frame, spec, config, aside)
            t1 = time.monotonic()
            hooks.told("verify", name)
            loaded = read_back(spark, spec, config, aside)
            receipt = reconcile.verified(sources[name], hooks.before_verify(name, loaded) if hooks.before_verify else loaded, spec)
            result.tables.append({"table": name, **receipt, "load_seconds": t1 - t0, "verify_seconds": time.monotonic() - t1, "rows_per_second": receipt["rows"] / max(t1 - t0, 1e-9)})
        per_table = {t["table"]: {"rows": t["rows"], "sha256": t["sha256"]} for t in result.tables}
        locks = {("public", t) for t in manifest.tables} | {(fk[s], fk[t]) for fk in plan.foreign_keys + plan.incoming_references for s, t in (("table_schema", "table"), ("ref_schema", "ref_table"))}
        emptied = any(t["will_truncate"] for t in plan.tables)
        publication = database.Publication(run_id, started, manifest, per_table, plan.foreign_keys, plan.sequences, sorted(locks), aside, truncate=emptied, lock_timeout_ms=lock_timeout_ms)

        def read_facts(at: database.Session) -> catalog.Catalog:
            read = target_facts.session_reader(spark, at)
            return target_facts.read_catalog(read, target_facts.read_identity(read), manifest.tables)

        def keys_now(at: database.Session) -> list[dict]:
            return [k for k in (r.asDict() for r in catalog.foreign_keys(read_facts(at)).collect()) if k["table"] in manifest.tables and k["table_schema"] == "public"]

        def receipt_sound(at: database.Session) -> bool:
            facts = {"receipt": catalog.receipt(read_facts(at))}
            return gate.evaluate(spark, facts, manifest).filter("code in ('receipt-table-invalid', 'no-create-privilege')").isEmpty()

        done = database.publish(
            session,
            publication,
            inspect=lambda at: look(at).refusals,
            keys_now=keys_now,
            receipt_sound=receipt_sound,
            again=opened,
            dry_run=dry_run,
            before_commit=(lambda at: hooks.before_commit()) if hooks.before_commit else None,
            poll_seconds=commit_poll_seconds,
        )
        outcome = result.outcome
        result.commit = done
        result.totals = {"rows": sum(t["rows"] for t in result.tables), "seconds": time.monotonic() - began}
        result.receipt = Receipt(run_id, started, manifest.sha256, per_table, snapshot_sha256)
        return result
    except OutcomeError as e:
        outcome = e.outcome
        raise
    except Refused:
        raise
    except Exception as e:
        raise Refused(to_refusal(e, "execute-failed")) from None
    finally:
        if created and outcome != "unknown":  # what is aside may be the only proof of what was to be published
            database.drop_aside(session, aside)
        session.close()
        hooks.ended(outcome)


def execute(
    spark: SparkSession,
    snapshot_path: str,
    manifest: Manifest,
    target: Target,
    folder: str,
    options: Options = Options(),
    *,
    dry_run: bool = False,
    snapshot_sha256: str | None = None,
    receipt_path: str | None = None,
    hooks: Hooks = Hooks(),
) -> Result:
    """Plan, load into a staged folder, read back, verify, publish. A dry run stops before publication; any
    failure leaves the target as it was."""
    run_id, started = str(uuid.uuid4()), datetime.now(UTC).isoformat()
    plan = build_plan(spark, snapshot_path, manifest, target, options, {"sha256": snapshot_sha256})
    if not plan.ok:
        raise Refused(plan.refusals[0])
    staged = StagedFolder(spark, folder)
    sources = source_tables(spark, snapshot_path, manifest)
    result = Result("dry-run" if dry_run else "committed", run_id, plan=plan)
    began, outcome = time.monotonic(), "failed"
    try:
        for name, spec in manifest.tables.items():
            hooks.told("load", name)
            t0 = time.monotonic()
            frame = strict_frame(sources[name], spec)
            path = staged.write(hooks.after_load(name, frame) if hooks.after_load else frame, name)
            t1 = time.monotonic()
            hooks.told("verify", name)
            loaded = spark.read.parquet(path)
            receipt = reconcile.verified(sources[name], hooks.before_verify(name, loaded) if hooks.before_verify else loaded, spec)
            t2 = time.monotonic()
            result.tables.append({"table": name, **receipt, "load_seconds": t1 - t0, "verify_seconds": t2 - t1, "rows_per_second": receipt["rows"] / max(t1 - t0, 1e-9)})
        for fk in plan.foreign_keys:
            if fk["ref_table"] in manifest.tables:
                child, parent = (spark.read.parquet(f"{staged.staged}/{t}.parquet") for t in (fk["table"], fk["ref_table"]))
                if keys.orphan_count(child, parent, fk["columns"], fk["ref_columns"]).first()["orphans"]:
                    raise Refused(Refusal("foreign-keys-changed", fk["table"], None, fk["name"]))
        result.totals = {"rows": sum(t["rows"] for t in result.tables), "seconds": time.monotonic() - began}
        result.receipt = Receipt(run_id, started, manifest.sha256, {t["table"]: {"rows": t["rows"], "sha256": t["sha256"]} for t in result.tables}, snapshot_sha256)
        if dry_run:
            staged.abort()
            outcome = "dry-run"
            return result
        if hooks.before_commit:
            hooks.before_commit()
        staged.commit(run_id, options.truncate)
        outcome = "committed"
        if receipt_path:
            write_receipt(result.receipt, receipt_path)
        return result
    except OutcomeError as e:
        outcome = e.outcome
        if outcome != "unknown":
            staged.abort()
        raise
    except Refused:
        staged.abort()
        raise
    except Exception as e:
        staged.abort()
        raise Refused(to_refusal(e, "execute-failed")) from None
    finally:
        hooks.ended(outcome)
