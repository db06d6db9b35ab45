"""Operators against hand-worked cases; whole-table ones run against DuckDB in test_queries."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from concordat import fixtures
from concordat.errors import ALL_CODES, Refusal, Refused, ToolkitError, to_refusal
from concordat.functions import cells, expressions
from concordat.functions.encoding import encode_row, load_text
from concordat.manifest import parse_manifest
from concordat.operators import keys, profile, reconcile
from concordat.operators.topology import Entry, is_production
from concordat.plans import pooling
from concordat.sources import sqlite, urls
from concordat.sources.connect import open_store
from concordat.sources.snapshot import take_snapshot


def test_refusal_texts():
    assert len(ALL_CODES) == 77
    assert str(Refusal("codec-lossy", "t", "c", "x")) == "codec-lossy t.c (x)"
    assert to_refusal(ValueError("secret")).code == "preflight-failed"
    with pytest.raises(ValueError):
        Refusal("no-such-code")


@pytest.mark.parametrize(
    "bad",
    [
        {},
        {"version": 2, "tables": {}},
        {"version": 1, "tables": {"t": {"columns": {"a": {"codec": "text"}}, "primaryKey": ["a"]}}},
        {"version": 1, "tables": {"t": {"columns": {"a": {"codec": "text", "nullable": True}}, "primaryKey": ["a"]}}},
        {"version": 1, "tables": {"t": {"columns": {"a": {"codec": "nope", "nullable": False}}, "primaryKey": ["a"]}}},
        {"version": 1, "tables": {"t": {"columns": {"a": {"codec": "text", "nullable": False, "x": 1}}, "primaryKey": ["a"]}}},
        {"version": 1, "tables": {"t": {"columns": {"a": {"codec": "timestamp-epoch-s", "nullable": False, "acceptSqliteDatetimeText": True}}, "primaryKey": ["a"]}}},
        {"version": 1, "tables": {"t": {"columns": {"a": {"codec": "json-text", "nullable": False, "preserveText": True, "pgType": "jsonb"}}, "primaryKey": ["a"]}}},
        {"version": 1, "tables": {"t": {"copy": False, "reason": ""}}},
    ],
)
def test_manifest_refuses(bad):
    with pytest.raises(ToolkitError) as e:
        parse_manifest(bad)
    assert e.value.code == "INVALID_MANIFEST"


def test_manifest_takes_odd_names():
    m = parse_manifest({"version": 1, "tables": {"__proto__": {"columns": {"constructor": {"codec": "text", "nullable": False}}, "primaryKey": ["constructor"]}, "log": {"copy": False, "reason": "r"}}})
    assert list(m.tables) == ["__proto__"] and m.skipped == {"log": "r"}


def test_row_encoding_keeps_fields_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, ""), ("", None)], "a string, b string")
    rows = [bytes(r[0]) for r in df.select(encode_row([F.col("a"), F.col("b")])).collect()]
    assert len(set(rows)) == 4
    assert rows[0] == b"\x01\x00\x00\x00\x02ab\x01\x00\x00\x00\x01c"


def test_load_text(spark):
    hostile = 'a\tb\nc\rd\\N \\. "ü😀'
    df = spark.createDataFrame([(hostile, True, bytearray(b"\x00\xff"), None)], "s string, b boolean, x binary, n string")
    row = df.select(load_text(F.col("s"), "string"), load_text(F.col("b"), "boolean"), load_text(F.col("x"), "binary"), load_text(F.col("n"), "string")).first()
    assert list(row) == ['a\\tb\\nc\\rd\\\\N \\\\. "ü😀', "t", "\\\\x00ff", "\\N"]


def test_orphans(spark):
    parent = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    child = spark.createDataFrame([(1, 2), (2, 1), (1, None), (None, 7)], "x int, y int")
    assert keys.orphan_count(child, parent, ["x", "y"], ["a", "b"]).first().orphans == 1


def test_limits(spark):
    table = parse_manifest({"version": 1, "tables": {"t": {"columns": {"id": {"codec": "integer", "nullable": False}, "s": {"codec": "text", "nullable": True}}, "primaryKey": ["id"]}}}).tables["t"]
    rows = [(("integer", 2**31, None, None), ("text", None, None, bytearray("ééééééé".encode()))), (("text", None, None, bytearray(b"-32769")), ("text", None, None, bytearray(b"abcdef"))), (("text", None, None, bytearray(b"12abc")), ("text", None, None, bytearray(b"abcde")))]
    df = spark.createDataFrame(rows, f"id {cells.CELL}, s {cells.CELL}")
    found = profile.limit_refusals(df, table, {"id": "integer", "s": "character varying"}, {"s": 5})
    assert [r.object for r in found] == ["integer, max 2147483648", "max 5 chars, 2 rows over, longest 7"]


def test_differences_with_duplicate_and_null(spark):
    a = spark.createDataFrame([("1", None), ("2", "x"), ("3", "y")], "k string, v string")
    b = spark.createDataFrame([("1", ""), ("2", "x"), ("4", "y")], "k string, v string")
    found = {(r.k, r.kind, r.column) for r in reconcile.differences(a, b, ["k"]).collect()}
    assert found == {("1", "changed", "v"), ("3", "missing", None), ("4", "extra", None)}


def test_topology():
    listed = [Entry("h", 1, "9", "d", False)]
    assert not is_production("h", 1, "9", "d", listed)
    assert is_production("h", 1, "8", "d", listed) and is_production("h", 1, "9", "d", None)


def test_schema_text():
    text = expressions.grouped("f('(' , (a))x")
    assert str(text[text.group()]) == "'(' , (a)" and str(text) == "f('(' , (a))x" and str(expressions.grouped("a (b")) == "a (b"
    assert expressions.check_text("CHECK (((a) or (b)))") == "(a) or (b)" and expressions.check_text("CHECK ((k > 3)) NOT VALID") == "k > 3"
    assert [str(p) for p in expressions.grouped("a, f(b, c), 'd,e'").parts()] == ["a", " f(b, c)", " 'd,e'"]
    assert expressions.index_signature("create index i on t (lower(nick) ASC, b desc, \"asc\") where x in ('(', \"w\")", True) == ("index", "unique (lowernick, bdesc, asc) where xin'',w")
    assert expressions.index_signature("create index broken on t", False) is None
    assert expressions.index_signature('CREATE UNIQUE INDEX i ON t ("A" asc, b)', True) == ("unique", "a,b")
    assert expressions.index_signature("CREATE INDEX i ON public.t USING gin (lower(a)) WHERE (b > 0)", False) == ("index", "gin (lowera) where b>0")
    assert expressions.check_signatures("create table t (a int check (a > 0), check ((b <> 'x)')))") == {"a>0": "a > 0", "b<>'x'": "b <> 'x)'"}


@pytest.mark.parametrize(
    "url,want",
    [
        ("file:./app.db", "sqlite:./app.db"),
        ("sqlite:///abs/app.db", "sqlite:/abs/app.db"),
        ("postgres://u:p%40@h/db?sslmode=require", "postgres://u:***@h:5432/db?sslmode=require"),
        ("postgresql://[::1]:6000/db", "postgres://[::1]:6000/db?sslmode=disable"),
    ],
)
def test_urls(url, want):
    assert urls.describe(urls.parse_database_url(url)) == want


@pytest.mark.parametrize("url", ["", "nothing", "file://host/x", "file:a?b", "mysql://h/d", "postgres://h/", "postgres://h/d?x=1", "postgres://h/d?sslmode=maybe", "postgres://u@h/d?user=v", "postgres://h/a%2Fb", "postgres://h:99999/d"])
def test_bad_urls_say_nothing_secret(url):
    with pytest.raises(ToolkitError) as e:
        urls.parse_database_url(url)
    assert e.value.code == "INVALID_DATABASE_URL" and "99999" not in str(e.value)


def test_redaction_of_broken_urls():
    assert urls.describe("postgres://u:se@cret@host:x/db?password=p") == "postgres://***@host:x"
    assert urls.describe("garbage") == "<unparseable DATABASE_URL>"


def test_pooled_urls():
    env = {"DATABASE_URL": "postgres://u:p@h/d", "POOLED_DATABASE_URL": "postgres://u:p@127.0.0.1:6432/d?pgbouncer=true"}
    assert urls.runtime_database_url(env) == env["POOLED_DATABASE_URL"]
    assert urls.runtime_database_url(env, purpose="migration") == env["DATABASE_URL"]
    with pytest.raises(ToolkitError):
        urls.runtime_database_url(env | {"POOLED_DATABASE_URL": "postgres://u:q@h/d"})
    files = pooling.render_pool([pooling.PooledDatabase("d", "postgres://u:p@h/d")], 7)
    assert files.server_connection_cap == 7 and "max_db_connections=7" in files.config and files.auth == '"u" "p"\n'
    with pytest.raises(ToolkitError):
        pooling.render_pool([pooling.PooledDatabase("d", "postgres://u:p@h/d")], 6)


def test_sqlite_source_reads_storage_classes(spark, tmp_path):
    path = str(tmp_path / "a.db")
    db = sqlite3.connect(path)
    db.execute("create table t (id integer primary key, v)")
    db.executemany("insert into t values (?, ?)", [(1, 5), (2, 2.5), (3, "x"), (4, b"\x00"), (5, None)])
    db.execute("insert into t values (6, cast(x'ff' as text))")
    db.commit()
    db.close()
    df = sqlite.read_table(spark, path, "t", rows_per_partition=2)
    assert df.rdd.getNumPartitions() == 3
    rows = {r.id.i: r.v for r in df.collect()}
    assert [rows[k].cls for k in range(1, 7)] == ["integer", "real", "text", "blob", "null", "text"]
    assert bytes(rows[6].raw) == b"\xff"
    assert profile.scan_profile(df).first().bad_utf8_v
    assert open_store(spark, f"file:{path}").table("t").count() == 6
    assert sqlite.health(path) == {"ok": True} and sqlite.health(path + "x") == {"ok": False}


def test_snapshot(tmp_path):
    path = str(tmp_path / "live.db")
    with pytest.raises(Refused, match="live-database-missing"):
        take_snapshot(path, writers_stopped=True)
    db = sqlite3.connect(path)
    db.execute("create table t (a)")
    db.commit()
    with pytest.raises(Refused, match="writers-not-stopped"):
        take_snapshot(path, writers_stopped=False)
    shot = take_snapshot(path, writers_stopped=True)
    assert os.path.exists(shot.path) and len(shot.sha256) == 64
    shot.dispose()
    db.execute("begin immediate")
    with pytest.raises(Refused, match="live-(writer-active|checkpoint-blocked)"):
        take_snapshot(path, writers_stopped=True)
    db.close()


def test_fixture_manifests_parse():
    assert set(fixtures.GATE_MANIFEST.tables) == {"a", "b", "items", "parent"}


def test_scrubbing_and_env_files(tmp_path):
    url = "postgres://u:p%40ss@h/d"
    assert urls.scrubbed(f"cannot reach {url} with p@ss or p%40ss; mysql://a:b@c", url) == "cannot reach [redacted] with [redacted] or [redacted]; mysql://[redacted]@c"
    assert urls.export_source_url("postgres://h/d?schema=public&sslmode=require&pgbouncer=true") == "postgres://h/d?sslmode=require"
    assert urls.export_source_url("file:a.db") == "file:a.db"
    with pytest.raises(Refused):
        urls.export_source_url("postgres://h/d?schema=other")
    path = tmp_path / ".env"
    path.write_text("# no\nA=1\nexport B='x & y' # z\nC = plain # note\nD=\n")
    assert urls.read_env_file(str(path)) == {"A": "1", "B": "x & y", "C": "plain", "D": ""}


def test_jdbc_statements():
    from concordat.sinks import jdbc

    assert jdbc.restart_statements([{"object": 'public.a"b', "restart_with": 6}, {"object": "public.c", "restart_with": None}]) == ['alter sequence "public"."a""b" restart with 6', 'alter sequence "public"."c" restart']
    drop, add = jdbc.constraint_statements([{"table_schema": "public", "table": "t", "name": "fk", "definition": "FOREIGN KEY (a) REFERENCES p(id)"}])
    assert drop == ['alter table "public"."t" drop constraint "fk"'] and add[0].endswith('add constraint "fk" FOREIGN KEY (a) REFERENCES p(id)')


def test_schema_comparison_of_a_real_file(spark, tmp_path):
    from concordat.operators.schema_diff import compare, strict_model

    path = str(tmp_path / "s.db")
    db = sqlite3.connect(path)
    db.executescript("create table users (id integer primary key, name text not null, age integer check (age > 0), unique (name)); create unique index live on users (lower(name)) where age > 1;")
    db.close()
    columns = [("users", "id", "bigint", True, False), ("users", "name", "text", True, False), ("users", "age", "integer", False, False)]
    indexes = [("users", "users_name_key", "CREATE UNIQUE INDEX users_name_key ON public.users USING btree (name)", True), ("users", "live", "CREATE UNIQUE INDEX live ON public.users USING btree (lower(name)) WHERE (age > 1)", True)]
    strict = strict_model(columns, [("users", ["id"])], indexes, [("users", "CHECK ((age > 0))")])
    assert compare(spark, sqlite.schema_model(path) + strict) == ([], "schemas match (0 allowed differences)")
    worse = strict_model(columns[:2], [("users", ["id"])], indexes[:1], [])
    left, report = compare(spark, sqlite.schema_model(path) + worse, [("check", None, None)])
    assert [d["kind"] for d in left] == ["column-missing", "index"] and report.startswith("schemas differ: 2 differences")


def test_scratch_tables_go_with_their_step(spark):
    import os

    from concordat.sources.scratch import Scratch, one_step

    at = lambda s: s.path("t").removeprefix("file://")
    outer = Scratch(spark, "outer")
    with one_step():
        inner = Scratch(spark, "inner")
        kept = outer.write(inner.write(spark.range(3).toDF("k"), "t").filter("k > 0"), "t")
        assert os.path.isdir(at(inner))
    assert kept.count() == 2 and not os.path.exists(at(inner)) and os.path.isdir(at(outer))
    with pytest.raises(ZeroDivisionError), one_step():
        lost = Scratch(spark, "lost")
        lost.write(spark.range(1), "t")
        1 / 0  # noqa: B018
    assert not os.path.exists(at(lost))
