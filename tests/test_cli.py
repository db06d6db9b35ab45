"""Command lines, applications with migrations, and the public names."""

import json
import os
import sqlite3
import stat

import pytest

import concordat
from concordat import testing
from concordat.errors import OutcomeError, Refused, ToolkitError
from concordat.operators import gate
from concordat.plans import apps, cli
from concordat.plans.execute import execute
from concordat.plans.plan import Options, Target
from concordat.plans.reverse import ReverseResult
from concordat.manifest import parse_manifest

TABLES = {
    "notes": {"columns": {"id": {"codec": "integer", "nullable": False}, "body": {"codec": "text", "nullable": True}}, "primaryKey": ["id"]},
    "moves": {"copy": False, "reason": "ledger"},
}
DDL = "create table notes (id integer primary key, body text); create table moves (id text primary key);"
COLUMNS = [["notes", "id", "bigint", False, None], ["notes", "body", "text", False, None], ["moves", "id", "text", False, None]]


class Heard:
    def __init__(self):
        self.out, self.err = [], []

    @property
    def io(self):
        return {"say": self.out.append, "warn": self.err.append}


@pytest.fixture
def place(tmp_path):
    db = sqlite3.connect(str(tmp_path / "a.db"))
    db.executescript(DDL + "insert into notes values (1, 'x'), (2, null);")
    db.close()
    db = sqlite3.connect(str(tmp_path / "empty.db"))
    db.executescript(DDL)
    db.close()
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "tables": TABLES}))
    (tmp_path / "t.json").write_text(json.dumps({"host": "h", "port": 1, "database": "d", "system_identifier": "7", "columns": COLUMNS}))
    return tmp_path


def base(place, *more):
    return ["--manifest", str(place / "m.json"), "--writers-stopped", "--work-dir", str(place), "--confirm-production", "h:1/d", *more]


def facts(spark):
    return {
        "tables": gate.frame(spark, "tables", [("notes", 1, "r", False, False, False, False, True)]),
        "primary_keys": gate.frame(spark, "primary_keys", [("notes", ["id"])]),
        "receipt": gate.frame(spark, "receipt", [(False, None, None, None, None, None, None, None, None, True)]),
    }


def test_wrong_use_is_told_from_refusals(spark, place):
    heard = Heard()
    run = lambda argv, **env: cli.main(argv, spark, env, **heard.io)
    source, recorded = ["--source", str(place / "a.db")], ["--strict-facts", str(place / "t.json")]
    assert run([]) == 2 and run(["nonsense"]) == 2 and run(["plan"]) == 2
    assert run(["execute", *source, *base(place, *recorded)]) == 2  # recorded facts need a folder
    assert run(["plan", *source, *base(place)]) == 1 and heard.err[-1] == "REFUSED target-url-missing"
    assert run(["plan", *source, *base(place)], CONCORDAT_TARGET_URL="mysql://u:pw@h/d") == 1 and heard.err[-1] == "REFUSED target-url-invalid"
    assert run(["plan", *source, *base(place, "--json")], CONCORDAT_TARGET_URL="file:x.db") == 1
    assert json.loads(heard.err[-1])["refusals"][0]["code"] == "target-not-postgres"
    assert run(["plan", *source, *base(place)], CONCORDAT_TARGET_URL="postgres://u:pw@127.0.0.1:1/d") == 1 and heard.err[-1] == "REFUSED target-connect-failed"
    assert run(["dry-run", *source, *base(place, "--commit-poll-seconds", "nan")]) == 1 and "invalid-option" in heard.err[-1]
    back = ["reverse", "--to-sqlite", str(place / "b.db"), "--sqlite-template", str(place / "empty.db"), *base(place)]
    for url, code in ((None, "source-url-missing"), ("no url", "source-url-invalid"), ("sqlite:x", "source-not-postgres")):
        assert cli.main(back, spark, {"CONCORDAT_SOURCE_URL": url} if url else {}, **heard.io) == 1 and heard.err[-1] == f"REFUSED {code}"
    (place / "bad.json").write_text("{")
    assert run(["plan", *source, "--manifest", str(place / "bad.json"), *recorded]) == 1 and heard.err[-1] == "REFUSED manifest-invalid"
    assert not any("pw" in x for x in heard.err)


def test_there_and_back(spark, place, monkeypatch):
    heard, folder = Heard(), str(place / "out")
    monkeypatch.setattr(cli, "_recorded_target", lambda path: Target("h", 1, "d", "7", [tuple(c) for c in COLUMNS], facts(spark)))
    there = ["--source", str(place / "a.db"), *base(place, "--strict-facts", "x", "--folder", folder)]
    assert cli.main(["plan", *there], spark, {}, **heard.io) == 0 and "plan OK" in heard.out[-1]
    assert cli.main(["dry-run", *there], spark, {}, **heard.io) == 0 and not os.path.exists(folder)
    assert cli.main(["execute", *there], spark, {}, **heard.io) == 0 and "COMMITTED" in heard.out[-1] and heard.err[-1] == "verify notes"
    back = ["reverse", "--to-sqlite", str(place / "b.db"), "--sqlite-template", str(place / "empty.db"), *base(place, "--strict-facts", "x", "--folder", folder)]
    assert cli.main([*back, "--dry-run"], spark, {}, **heard.io) == 0 and not os.path.exists(place / "b.db")
    assert cli.main([*back, "--receipt", str(place / "no" / "such" / "folder")], spark, {}, **heard.io) == 3 and "receipt-not-written" in heard.err[-1]
    assert sqlite3.connect(place / "b.db").execute("select * from notes order by id").fetchall() == [(1, "x"), (2, None)]
    assert cli.main(back, spark, {}, **heard.io) == 1 and heard.err[-1] == "REFUSED sqlite-target-exists"
    for outcome, code in (("aborted", 4), ("unknown", 5)):

        def lost(*args, outcome=outcome, **more):
            raise OutcomeError(outcome, "r")

        assert cli.main(back, spark, {}, **heard.io, run_reverse=lost) == code
    warned = cli.main(back, spark, {}, **heard.io, run_reverse=lambda *a, **k: ReverseResult("written", "r", "p", totals={"rows": 0, "seconds": 0.0}, warnings=["smoke-failed"]))
    assert warned == 3


def test_pool(tmp_path):
    heard = Heard()
    config = {"serverConnectionBudget": 20, "databases": [{"name": "app", "urlEnv": "APP_URL", "poolSize": 4, "reservePoolSize": 1}]}
    (tmp_path / "p.json").write_text(json.dumps(config))
    env = {"APP_URL": "postgres://u:pw@db:5432/app?sslmode=require"}
    argv = ["pool", "plan", "--config", str(tmp_path / "p.json")]
    assert cli.main(argv, None, env, **heard.io) == 0 and json.loads(heard.out[-1]) == {"status": "validated", "databases": 1, "server_connection_cap": 5}
    folder = str(tmp_path / "pool")
    render = ["pool", "render", *argv[2:]]
    assert cli.main(render, None, env, **heard.io) == 2
    assert cli.main([*render, "--output-dir", folder], None, env, **heard.io) == 0
    assert sorted(os.listdir(folder)) == ["pgbouncer.ini", "runtime.json", "users.txt"] and stat.S_IMODE(os.stat(f"{folder}/users.txt").st_mode) == 0o600
    assert cli.main([*render, "--output-dir", folder], None, env, **heard.io) == 1  # never over what is there
    assert cli.main(argv, None, {}, **heard.io) == 1
    (tmp_path / "p.json").write_text(json.dumps(config | {"surprise": 1}))
    assert cli.main(argv, None, env, **heard.io) == 1 and not any("pw" in x for x in heard.out + heard.err)


def journal(folder, statements):
    os.makedirs(folder / "meta")
    entries = [{"tag": f"000{k}_x", "when": 1_900_000_000_000 + k} for k in range(len(statements))]
    (folder / "meta" / "_journal.json").write_text(json.dumps({"entries": entries}))
    for e, text in zip(entries, statements):
        (folder / f"{e['tag']}.sql").write_text(text)


def test_apps(tmp_path):
    journal(tmp_path / "lite", ["create table notes (id integer primary key, body text);", "create table moves (id text primary key);\n--> statement-breakpoint\ninsert into notes values (1, 'seed');"])
    journal(tmp_path / "strict", ["", ""])
    app = apps.journal_app({"version": 1, "tables": TABLES}, str(tmp_path / "lite"), str(tmp_path / "strict"))
    assert list(app.expected_ids) == ["1900000000000", "1900000000001"] and "created_at::text" in app.ledger_query
    heard = Heard()
    made = str(tmp_path / "template.db")
    assert cli.export_main(["sqlite-template", made], app, None, {}, **heard.io) == 0 and json.loads(heard.out[-1])["template_rows_cleared"] == ["notes"]
    db = sqlite3.connect(made)
    assert db.execute("select count(*) from notes").fetchone() == (0,) and db.execute("select created_at from __drizzle_migrations order by id").fetchall() == [(1900000000000,), (1900000000001,)]
    assert cli.export_main(["sqlite-template", made], app, None, {}, **heard.io) == 1 and "sqlite-target-exists" in heard.err[-1]

    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\n[ \"$1 $2 $3\" = 'migrate deploy --schema' ] || exit 1\necho trouble >&2\n[ -e \"$4\" ] || exit 1\n: > \"${DATABASE_URL#file:}\"\n")
    tool.chmod(0o755)
    for name in ("b", "a", "no_sql"):
        os.makedirs(tmp_path / "folders" / name)
    for name in ("b", "a"):
        (tmp_path / "folders" / name / "migration.sql").write_text("")
    other = apps.folder_app({"version": 1, "tables": TABLES}, str(tmp_path / "schema"), str(tmp_path / "folders"), binary=str(tool))
    assert list(other.expected_ids) == ["a", "b"] and other.skip_tables.keys() == {"_prisma_migrations"}
    with pytest.raises(ToolkitError, match="trouble"):
        other.build_template(str(tmp_path / "t2.db"))
    (tmp_path / "schema").write_text("")
    other.build_template(str(tmp_path / "t2.db"))
    assert os.path.exists(tmp_path / "t2.db")
    with pytest.raises(ToolkitError, match="not found"):
        apps.folder_app({}, str(tmp_path / "schema"), str(tmp_path / "folders")).build_template("x")


def test_export_command(spark, place):
    heard, folder = Heard(), str(place / "out")
    manifest = parse_manifest({"version": 1, "tables": TABLES})
    target = Target("h", 1, "d", "7", [tuple(c) for c in COLUMNS], facts(spark))
    execute(spark, str(place / "a.db"), manifest, target, folder, Options(confirm_production="h:1/d"))

    def template(path):
        db = sqlite3.connect(path)
        db.executescript(DDL)
        db.close()

    app = concordat.ExportApp({"version": 1, "tables": TABLES}, template, ["m1"])
    ids = ["m1"]

    def connect(spark, config, manifest):
        return {"notes": spark.read.parquet(f"{folder}/notes.parquet")}, spark.createDataFrame([(i,) for i in ids], "id string"), target

    run = lambda *argv, **more: cli.export_main(list(argv), app, spark, more.pop("env", {"DATABASE_URL": "postgres://u:pw@h:1/d?schema=public"}), **heard.io, connect=connect, **more)
    out = str(place / "x.db")
    assert run("export-sqlite") == 2 and run("other", out) == 2
    assert run("export-sqlite", out) == 1 and json.loads(heard.err[-1])["refusal"]["code"] == "writers-not-stopped"
    assert run("export-sqlite", out, "--writers-stopped", env={}) == 1 and "source-url-missing" in heard.err[-1]
    (place / "env").write_text("DATABASE_URL='postgres://u:pw@h:1/d?sslmode=verify-full'\n")
    assert run("export-sqlite", out, "--writers-stopped", "--env-file", str(place / "env"), ca_variable="CA", env={"CA": "x"}) == 1 and "tls-ca-missing" in heard.err[-1]
    assert run("export-sqlite", out, "--writers-stopped", "--dry-run") == 0 and json.loads(heard.out[-1])["outcome"] == "dry-run"
    assert run("export-sqlite", out, "--writers-stopped") == 0 and json.loads(heard.out[-1])["rows"] == 2 and os.path.exists(out)
    ids.append("m2")
    assert run("export-sqlite", str(place / "y.db"), "--writers-stopped") == 1 and json.loads(heard.err[-1])["refusal"]["code"] == "ledger-mismatch"
    assert not any("pw" in x for x in heard.out + heard.err)


@testing.each_store("sqlite", env={})
def test_each_store(store, spark):
    path = store.url.removeprefix("file:")
    sqlite3.connect(path).executescript(DDL + "insert into notes values (1, 'x');")
    assert store.dialect == "sqlite" and store.open(spark).table("notes").count() == 1


def test_dialects(spark):
    assert testing.dialects_from_env({}) == testing.DIALECTS and testing.dialects_from_env({testing.WHICH: " postgres "}) == ("postgres",)
    with pytest.raises(ToolkitError):
        testing.dialects_from_env({testing.WHICH: "sqlight"})
    with pytest.raises(ToolkitError), testing.open_test_store("postgres", spark, {}):
        pass
    said = []

    class Told:
        execute = staticmethod(said.append)
        close = staticmethod(lambda: said.append("close"))

    with testing.test_database(spark, "postgres://u:p%40@h:1/admin", lambda spark, config: Told()) as url:
        name = concordat.parse_database_url(url).database
        assert name.startswith("concordat_test_") and concordat.parse_database_url(url).password == "p@"
    assert said == ["commit", f'create database "{name}"', "close", "commit", f'drop database if exists "{name}" with (force)', "close"]


def test_public_names():
    for name in concordat.__all__:
        assert getattr(concordat, name) is not None
    with pytest.raises(AttributeError):
        concordat.nothing
    assert issubclass(concordat.Refused, concordat.ToolkitError) and Refused is concordat.Refused
