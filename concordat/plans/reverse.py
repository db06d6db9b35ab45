"""The way back: strict tables into a fresh SQLite file, verified by the same comparison."""

from __future__ import annotations

import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from concordat.errors import Refusal, Refused
from concordat.manifest import Manifest
from concordat.operators import gate, reconcile, validation
from concordat.plans.plan import Target, sides_of
from concordat.sinks import sqlite_file
from concordat.sinks.staged import SIDECARS, Receipt, publish_file, write_receipt
from concordat.sources import sqlite
from concordat.sources.snapshot import file_sha256


@dataclass
class ReverseResult:
    outcome: str
    run_id: str
    path: str | None = None
    tables: list[dict] = field(default_factory=list)
    sequences: list[dict] = field(default_factory=list)
    totals: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    receipt_path: str | None = None


@dataclass
class ReverseHooks:
    """Seams for tests and progress: what is loaded of a table may be replaced, the work file may be touched
    before it is verified or put in place."""

    before_load: Callable[[str, DataFrame], DataFrame] | None = None
    before_verify: Callable[[str], None] | None = None
    before_publish: Callable[[str], None] | None = None
    on_progress: Callable[[str, str], None] | None = None

    def told(self, step: str, table: str) -> None:
        if self.on_progress:
            self.on_progress(step, table)


def _judge(spark: SparkSession, manifest: Manifest, target: Target, work: str) -> None:
    if target.in_recovery:
        raise Refused(Refusal("source-in-recovery"))
    issues = validation.validate(spark, manifest, validation.sides_frame(spark, sides_of(work, target))).collect()
    if issues:
        i = issues[0]
        raise Refused(Refusal("manifest-invalid", i["table"], i["column"], f"{i['side']}:{i['code']}"))
    shape = gate.in_order(gate.evaluate(spark, target.facts, manifest, shape_only=True, owned=False, skipped_may_refer=True)).collect()
    if shape:
        raise Refused(Refusal(*(shape[0][k] for k in ("code", "table", "column", "object"))))
    filled = sqlite_file.template_rows(work, manifest)
    if filled:
        raise Refused(filled[0])


def reverse(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    manifest: Manifest,
    source: Target,
    template: str,
    path: str,
    *,
    sequences: dict[str, dict] | None = None,
    dry_run: bool = False,
    receipt_path: str | None = None,
    work_dir: str | None = None,
    hooks: ReverseHooks = ReverseHooks(),
) -> ReverseResult:
    """Write ``path`` from strict tables. The file appears under its name only when all of it is verified."""
    run_id, started = str(uuid.uuid4()), datetime.now(UTC).isoformat()
    if any(os.path.lexists(path + s) for s in ("", *SIDECARS)):
        raise Refused(Refusal("sqlite-target-exists"))
    folder = tempfile.mkdtemp(prefix="reverse-", dir=work_dir or os.path.dirname(os.path.abspath(path)))
    work = os.path.join(folder, "work.db")
    result = ReverseResult("dry-run" if dry_run else "written", run_id)
    began = time.monotonic()
    try:
        sqlite_file.copy_template(template, work)
        _judge(spark, manifest, source, work)
        loaded: dict[str, float] = {}
        db = sqlite.connect(work, readonly=False)
        db.isolation_level = None
        try:
            db.execute("pragma foreign_keys = off")
            db.execute("begin immediate")
            for name, spec in manifest.tables.items():
                hooks.told("load", name)
                t0 = time.monotonic()
                sqlite_file.load_table(db, hooks.before_load(name, tables[name]) if hooks.before_load else tables[name], spec)
                loaded[name] = time.monotonic() - t0
            found = sqlite_file.audit(db)
            if found:
                raise Refused(found[0])
            result.sequences = sqlite_file.set_high_waters(db, manifest, sequences or {})
            db.execute("commit")
        finally:
            db.close()
        if hooks.before_verify:
            hooks.before_verify(work)
        for name, spec in manifest.tables.items():
            hooks.told("verify", name)
            t0 = time.monotonic()
            receipt = reconcile.verified(sqlite.read_table(spark, work, name), tables[name], spec)
            result.tables.append({"table": name, **receipt, "load_seconds": loaded[name], "verify_seconds": time.monotonic() - t0})
        result.totals = {"rows": sum(t["rows"] for t in result.tables), "seconds": time.monotonic() - began}
        if dry_run:
            return result
        if hooks.before_publish:
            hooks.before_publish(work)
        sha = file_sha256(work)
        publish_file(work, path)
        result.path = path
        if receipt_path:
            try:
                write_receipt(Receipt(run_id, started, manifest.sha256, {t["table"]: {"rows": t["rows"], "sha256": t["sha256"]} for t in result.tables}, sha), receipt_path)
                result.receipt_path = receipt_path
            except OSError:  # the file is published: from here on failures are warnings
                result.warnings.append("receipt-not-written")
        return result
    finally:
        shutil.rmtree(folder, ignore_errors=True)
