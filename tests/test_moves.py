"""A loose file to strict tables and back, with faults on the way."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from concordat.errors import Refused
from concordat.manifest import parse_manifest
from concordat.operators import gate
from concordat.plans import render
from concordat.plans.execute import Hooks, execute
from concordat.plans.export import ExportApp, export
from concordat.plans.plan import Options, Target, build_plan
from concordat.plans.reverse import reverse

MANIFEST = {
    "version": 1,
    "tables": {
        "people": {"columns": {"id": {"codec": "integer", "nullable": False}, "name": {"codec": "text", "nullable": False}, "score": {"codec": "real", "nullable": True}, "seen": {"codec": "timestamp-epoch-ms", "nullable": True, "preserveInteger": False}, "ok": {"codec": "boolean", "nullable": False}, "doc": {"codec": "json-text", "nullable": True, "pgType": "jsonb"}}, "primaryKey": ["id"]},
        "pets": {"columns": {"id": {"codec": "integer", "nullable": False}, "owner": {"codec": "integer", "nullable": True}}, "primaryKey": ["id"]},
        "ledger": {"copy": False, "reason": "migrations"},
    },
}
DDL = """
create table people (id integer primary key autoincrement, name text not null, score real, seen integer, ok integer not null, doc text);
create table pets (id integer primary key, owner integer references people(id));
create table ledger (id text primary key);
"""
TYPES = {"people": ["bigint", "text", "double precision", "timestamp with time zone", "boolean", "jsonb"], "pets": ["bigint", "integer"], "ledger": ["text"]}


def make(path, extra=()):
    db = sqlite3.connect(path)
    db.executescript(DDL)
    nasty = "tab\t nl\n \\N \\. ü 😀"
    db.executemany("insert into people values (?, ?, ?, ?, ?, ?)", [(1, nasty, 0.1, 1709280000123, 1, '{"b": 1.50, "a": 9007199254740993}'), (2, "", None, None, 0, None), (9, "Ä", -1.5e300, 0, 1, "[]")])
    db.execute("delete from people where id = 9")
    db.executemany("insert into pets values (?, ?)", [(1, 1), (2, None)])
    for statement in extra:
        db.execute(statement)
    db.commit()
    db.close()
    return path


def target(spark, **more):
    names = {"people": ["id", "name", "score", "seen", "ok", "doc"], "pets": ["id", "owner"], "ledger": ["id"]}
    columns = [(t, c, k, False, None) for t, cs in names.items() for c, k in zip(cs, TYPES[t])]
    facts = {
        "tables": gate.frame(spark, "tables", [("people", 1, "r", False, False, False, False, True), ("pets", 2, "r", False, False, False, False, True)]),
        "primary_keys": gate.frame(spark, "primary_keys", [("people", ["id"]), ("pets", ["id"])]),
        "receipt": gate.frame(spark, "receipt", [(False, None, None, None, None, None, None, None, None, True)]),
        "sequence_refs": spark.createDataFrame([(10, "public", "people_id_seq", 1, 1, 1, (1 << 63) - 1, False, "owner", 1, "id")], "sequence_oid bigint, schema string, name string, start bigint, increment bigint, min bigint, max bigint, cycles boolean, kind string, table_oid bigint, column string"),
    }
    keys = [{"name": "pets_owner_fk", "table": "pets", "ref_table": "people", "columns": ["owner"], "ref_columns": ["id"]}]
    return Target("h", 5432, "d", "7", columns, facts, keys, **more)


CONFIRMED = Options(confirm_production="h:5432/d")


def codes(plan):
    return [r.code for r in plan.refusals]


def test_plan_and_move(spark, tmp_path):
    path, manifest = make(str(tmp_path / "a.db")), parse_manifest(MANIFEST)
    plan = build_plan(spark, path, manifest, target(spark), CONFIRMED)
    assert plan.ok, plan.refusals
    assert plan.sequences[0]["restart_with"] == 10
    assert "plan OK" in render.plan_text(plan) and json.loads(render.to_json(plan))["sequences"][0]["max"] == str((1 << 63) - 1)
    folder, receipt = str(tmp_path / "out"), str(tmp_path / "receipt.json")
    dry = execute(spark, path, manifest, target(spark), folder, CONFIRMED, dry_run=True)
    assert dry.outcome == "dry-run" and not os.path.exists(folder)
    done = execute(spark, path, manifest, target(spark), folder, CONFIRMED, receipt_path=receipt)
    assert done.outcome == "committed" and "COMMITTED" in render.result_text(done)
    assert spark.read.parquet(f"{folder}/people.parquet").count() == 2
    assert json.load(open(receipt))["per_table"]["people"]["rows"] == 2
    with pytest.raises(Refused, match="target-not-empty"):
        execute(spark, path, manifest, target(spark), folder, CONFIRMED)
    assert spark.read.parquet(f"{folder}/pets.parquet").count() == 2

    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in manifest.tables}
    template = str(tmp_path / "template.db")
    db = sqlite3.connect(template)
    db.executescript(DDL)
    db.close()
    again = str(tmp_path / "again.db")
    given = {"people": {"last_value": 41, "called": True, "increment": 1}}
    result = reverse(spark, tables, manifest, target(spark), template, again, sequences=given, receipt_path=str(tmp_path / "r2.json"))
    assert result.sequences == [{"table": "people", "seq": 41}] and "WRITTEN" in render.reverse_text(result)
    a, b = (sqlite3.connect(p).execute("select id, name, score, seen, ok from people order by id").fetchall() for p in (path, again))
    assert a == b
    assert [t["sha256"] for t in result.tables] == [t["sha256"] for t in done.tables]
    with pytest.raises(Refused, match="sqlite-target-exists"):
        reverse(spark, tables, manifest, target(spark), template, again)


def test_every_refusal_is_reported(spark, tmp_path):
    path = make(str(tmp_path / "a.db"), ["insert into pets values (3, 99)", "update people set name = 'a' || char(0) where id = 1", "update people set ok = 2 where id = 2", "insert into pets values (4, 3000000000)"])
    found = build_plan(spark, path, parse_manifest(MANIFEST), target(spark), Options())
    assert codes(found) == ["source-nul-in-text", "production-unconfirmed", "integer-width", "orphan-foreign-keys", "codec-invalid"]
    assert str(found.refusals[3]) == "orphan-foreign-keys pets (pets_owner_fk -> people, 2 rows)"


def test_standby_and_invalid_manifest_stop_early(spark, tmp_path):
    path, manifest = make(str(tmp_path / "a.db"), ["create table stray (a)"]), parse_manifest(MANIFEST)
    assert codes(build_plan(spark, path, manifest, target(spark, in_recovery=True), CONFIRMED)) == ["target-in-recovery"]
    found = build_plan(spark, path, manifest, target(spark), CONFIRMED)
    assert [(r.code, r.table, r.object) for r in found.refusals] == [("manifest-invalid", "stray", "sqlite:undeclared-table")]


def test_tampered_load_is_never_published(spark, tmp_path):
    path, folder = make(str(tmp_path / "a.db")), str(tmp_path / "out")
    for change, column in ((lambda t, df: df.withColumn("name", F.upper("name")) if t == "people" else df, ".name"), (lambda t, df: df.limit(1), ""), (lambda t, df: df.union(df), ".id")):
        with pytest.raises(Refused, match=f"verification-mismatch people{column}"):
            execute(spark, path, parse_manifest(MANIFEST), target(spark), folder, CONFIRMED, hooks=Hooks(after_load=change))
        assert not os.path.exists(folder) and not [f for f in os.listdir(tmp_path) if "staged" in f]


def test_export_checks_the_ledger(spark, tmp_path):
    path, manifest, folder = make(str(tmp_path / "a.db")), parse_manifest(MANIFEST), str(tmp_path / "out")
    execute(spark, path, manifest, target(spark), folder, CONFIRMED)
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in manifest.tables}

    def template(p):
        db = sqlite3.connect(p)
        db.executescript(DDL + "insert into pets values (77, null);")
        db.close()

    app = ExportApp(MANIFEST, template, ["m1", "m2"], smoke=lambda p: sqlite3.connect(p).execute("select 1"))
    have = spark.createDataFrame([("m1",), ("m3",)], "id string")
    with pytest.raises(Refused, match=r"missing from the store \[m2\]; unknown to this code \[m3\]"):
        export(spark, app, tables, have, target(spark), str(tmp_path / "x.db"))
    result = export(spark, app, tables, spark.createDataFrame([("m1",), ("m2",)], "id string"), target(spark), str(tmp_path / "x.db"))
    assert result.warnings == ["template-rows-removed pets"] and os.path.exists(str(tmp_path / "x.db"))
