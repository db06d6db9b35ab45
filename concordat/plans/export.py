"""Exporting an application's strict store to a SQLite file that its own code can open."""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from concordat.errors import Refusal, Refused
from concordat.manifest import Manifest, parse_manifest
from concordat.plans.plan import Target
from concordat.plans.reverse import ReverseResult, reverse
from concordat.sources.sqlite import connect, quoted


@dataclass
class ExportApp:
    """What an application brings: its manifest, its empty file, the migrations its code defines and, if it
    likes, a first open of the result."""

    manifest: dict
    build_template: Callable[[str], None]
    expected_ids: Iterable[str]
    skip_tables: dict[str, str] = field(default_factory=dict)
    smoke: Callable[[str], None] | None = None
    ledger_query: str | None = None  # the strict store's applied migrations as ``id``

    def reverse_manifest(self) -> Manifest:
        """The manifest with the app's further tables declared as skipped."""
        tables = dict(self.manifest["tables"]) | {t: {"copy": False, "reason": r} for t, r in self.skip_tables.items()}
        return parse_manifest(dict(self.manifest) | {"tables": tables})


def build_template(app: ExportApp, path: str) -> list[str]:
    """The app's file without rows in copied tables; a migration may have seeded some. Returns the tables
    that had any."""
    app.build_template(path)
    db = sqlite3.connect(path)
    try:
        has_sequences = db.execute("select 1 from sqlite_master where name = 'sqlite_sequence'").fetchone()
        emptied = []
        for name in app.reverse_manifest().tables:
            if db.execute(f"delete from {quoted(name)}").rowcount:
                emptied.append(name)
                if has_sequences:
                    db.execute("delete from sqlite_sequence where name = ?", (name,))
        db.commit()
        return emptied
    finally:
        db.close()


def ledger_difference(have: DataFrame, want: DataFrame) -> DataFrame:
    """``(id, side)``: ``missing`` from the store or ``extra`` in it."""
    from pyspark.sql import functions as F

    missing = want.select("id").subtract(have.select("id")).withColumn("side", F.lit("missing"))
    extra = have.select("id").subtract(want.select("id")).withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def check_ledger(spark: SparkSession, have: DataFrame, expected: Iterable[str]) -> None:
    want = spark.createDataFrame([(i,) for i in expected], "id string")
    found = ledger_difference(have, want).orderBy("id").collect()
    if found:
        missing, extra = ([r["id"] for r in found if r["side"] == side] for side in ("missing", "extra"))
        raise Refused(Refusal("ledger-mismatch"), f"ledger-mismatch: missing from the store [{', '.join(missing)}]; unknown to this code [{', '.join(extra)}]")


def export(spark: SparkSession, app: ExportApp, tables: dict[str, DataFrame], ledger: DataFrame, source: Target, path: str, **options) -> ReverseResult:
    """Ledger first, then template, reverse move, and a first open on a copy of what was published."""
    check_ledger(spark, ledger, app.expected_ids)
    folder = tempfile.mkdtemp(prefix="export-", dir=os.path.dirname(os.path.abspath(path)))
    try:
        template = os.path.join(folder, "template.db")
        emptied = build_template(app, template)
        result = reverse(spark, tables, app.reverse_manifest(), source, template, path, **options)
        result.warnings += [f"template-rows-removed {t}" for t in emptied]
        if app.smoke and result.path:
            copy = os.path.join(folder, "smoke.db")
            shutil.copyfile(result.path, copy)
            try:
                app.smoke(copy)
                connect(copy).close()
            except Exception:
                result.warnings.append("smoke-failed")
        return result
    finally:
        shutil.rmtree(folder, ignore_errors=True)
