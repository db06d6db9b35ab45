"""Golden values of every codec, by side, in a session whose time zone is not UTC."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from concordat.functions import cells, codecs, exact
from concordat.manifest import parse_manifest

BAD, LOSSY = "CODEC_INVALID", "CODEC_LOSSY"


def spec(codec, nullable=True, **options):
    columns = {"id": {"codec": "integer", "nullable": False}, "c": {"codec": codec, "nullable": nullable, **options}}
    return parse_manifest({"version": 1, "tables": {"t": {"columns": columns, "primaryKey": ["id"]}}}).tables["t"].column("c")


def as_cell(v):
    if v is None:
        return ("null", None, None, None)
    if isinstance(v, int):
        return ("integer", v, None, None)
    if isinstance(v, float):
        return ("real", None, v, None)
    return ("text", None, None, bytearray(v.encode())) if isinstance(v, str) else ("blob", None, None, bytearray(v))


def loose(spark, s, values):
    df = spark.createDataFrame([(k, as_cell(v)) for k, v in enumerate(values)], f"k int, c {cells.CELL}")
    out = df.select("k", codecs.canonical(s, "loose", F.col("c")).alias("x"), codecs.error(s, "loose", F.col("c")).alias("e")).orderBy("k")
    return [r.e or r.x for r in out.collect()]


def back(spark, s, kind, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, c {kind}")
    out = []
    for r in df.select("k", codecs.to_loose(s, F.col("c")).alias("x")).orderBy("k").collect():
        c = r.x.value
        out.append(r.x.err or (c.i if c.cls == "integer" else c.r if c.cls == "real" else c.raw.decode()))
    return out


#: One instant for most cases: 2033-07-19, 16:16:08 in UTC.
SECONDS = 2_005_402_568
LEAP = ("2036-02-29", "2035-02-29")  # one is a date
DEEP = "[" * 513 + "]" * 513
CASES = [
    (spec("integer"), [(-318, "-318"), ("604", "604"), (77.0, "77"), (0.25, BAD), (2**53, LOSSY), (1 - 2**53, str(1 - 2**53)), ("+12", BAD), (" 12", BAD), ("-000", "0"), (b"12", BAD), ("8" * 40, LOSSY), (None, None)]),
    (spec("bigint"), [(-(2**63), str(-(2**63))), (str(2**63), LOSSY), (3.5e40, BAD), ("0x1F", BAD)]),
    (spec("real"), [(0.7, "0.7"), (3e-9, "3e-9"), (4e25, "4e+25"), (6.02e23, "6.02e+23"), (31.0, "31"), (-0.0, "-0"), (5e-324, "5e-324"), (float("nan"), BAD), (-float("inf"), BAD), (31, BAD)]),
    (spec("decimal-as-string"), [("+0042.10", "42.1"), ("-00.000", "0"), ("8.", "8"), ("-.75", "-0.75"), ("2E3", BAD), (4.5, BAD), (float("nan"), LOSSY), (4, BAD), ("31415926535897932384626.43383279500", "31415926535897932384626.433832795")]),
    (spec("decimal-as-string", acceptSqliteNumeric=True), [(50_411, "50411"), (0.7, "0.7"), (3e-9, "0.000000003"), (4e25, "4" + "0" * 25), (5e-324, "0." + "0" * 323 + "5"), (-0.0, LOSSY), (float("inf"), BAD), ("6.250", "6.25")]),
    (spec("boolean"), [(0, "false"), (1, "true"), (0.0, "false"), (-1, BAD), ("true", BAD), (0.75, BAD)]),
    (spec("blob"), [(b"", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), ("text", BAD)]),
    (spec("uuid-text"), [("0B5DA0E6-77C1-4F3B-9D1A-5E2F8C6B4A39", "0b5da0e6-77c1-4f3b-9d1a-5e2f8c6b4a39"), ("0B5DA0E677C14F3B9D1A5E2F8C6B4A39", BAD)]),
    (spec("timestamp-iso"), [("2033-07-19T21:46:08+05:30", "2033-07-19T21:46:08+05:30"), ("2033-07-19T21:46:08", BAD), ("2033-07-19T16:16:08.7654321Z", LOSSY), ("2033-07-19T16:16:08Z ", BAD)]),
    (spec("timestamp-iso", preserveText=False), [("2033-07-19T21:46:08.070809+05:30", "2033-07-19T16:16:08.070809Z"), ("2033-12-31T20:30:00,25-04:00", "2034-01-01T00:30:00.250000Z"), ("0001-01-01T00:00:00+13:00", LOSSY)]),
    (spec("timestamp-epoch-ms", preserveInteger=False, acceptSqliteDatetimeText=True), [(SECONDS * 1000 + 45, "2033-07-19T16:16:08.045000Z"), ("2033-07-19 16:16:08", "2033-07-19T16:16:08.000000Z"), (-86_400_001, "1969-12-30T23:59:59.999000Z"), (8 * 10**15 + 7 * 10**14, LOSSY), (SECONDS * 1000.0, "2033-07-19T16:16:08.000000Z")]),
    (spec("timestamp-epoch-s", preserveInteger=False, acceptSqliteDatetimeText=True), [(SECONDS, "2033-07-19T16:16:08.000000Z"), ("2033-07-19 16:16:08.25", LOSSY), (-1, "1969-12-31T23:59:59.000000Z")]),
    (spec("timestamp-naive"), [("2033-07-19 16:16:08.07", "2033-07-19T16:16:08.070000"), ("2033-07-19 24:16:08", BAD), ("0000-12-31 23:59:59", LOSSY)]),
    (spec("date-text"), [(LEAP[0], LEAP[0]), (LEAP[1], BAD), ("0000-06-30", LOSSY), ("1900-02-29", BAD), ("2000-02-29", "2000-02-29")]),
    (spec("json-text", pgType="jsonb"), [('{"z":0,"k":[{"y":3,"x":4},5]}', '{"k":[{"x":4,"y":3},5],"z":0}'), ("2500e-3", "2.5"), ("-7.25E+2", "-725"), ('"\\u00e4"', '"ä"'), ('{"q":1,"\\u0071":2}', BAD), ("Infinity", BAD), (DEEP, BAD), ("31415926535897932384626433", "31415926535897932384626433")]),
    (spec("json-text"), [('{"q":1,"q":2}', '{"q":1,"q":2}'), ("{,}", BAD)]),
    (spec("text"), [("übrig", "übrig"), ("", ""), (31, BAD), (b"\xc3\x28", BAD)]),
]


@pytest.mark.parametrize("s,pairs", CASES, ids=lambda x: x.codec if hasattr(x, "codec") else "")
def test_canonical(spark, s, pairs):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert loose(spark, s, [v for v, _ in pairs]) == [e for _, e in pairs]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_null_rule(spark):
    assert loose(spark, spec("text", nullable=False), [None, ""]) == ["CODEC_NULL", ""]


def test_invalid_utf8_is_refused(spark):
    df = spark.createDataFrame([(("text", None, None, bytearray(b"\xff")),)], f"c {cells.CELL}")
    assert df.select(codecs.error(spec("text"), "loose", F.col("c"))).first()[0] == BAD


def test_strict_to_loose(spark):
    at = dt.datetime(2033, 7, 19, 16, 16, 8)
    assert back(spark, spec("decimal-as-string", acceptSqliteNumeric=True), "string", ["50411.000", "0.3000000000000000166533453693773481063544750213623046875", str(2**63 + 11), "0.625"]) == [50_411, LOSSY, LOSSY, 0.625]
    assert back(spark, spec("timestamp-iso", preserveText=False), "timestamp", [at.replace(microsecond=750_000, tzinfo=dt.UTC)]) == ["2033-07-19T16:16:08.750Z"]
    assert back(spark, spec("timestamp-epoch-s", preserveInteger=False), "timestamp", [at.replace(tzinfo=dt.UTC), at.replace(microsecond=9, tzinfo=dt.UTC)]) == [SECONDS, LOSSY]
    assert back(spark, spec("timestamp-naive"), "timestamp_ntz", [at.replace(microsecond=70)]) == ["2033-07-19 16:16:08.000070"]
    assert back(spark, spec("json-text", pgType="jsonb"), "string", ['{"n": 18014398509481985, "f": 2.750}']) == ['{"n":18014398509481985,"f":2.750}']
    assert back(spark, spec("real"), "double", [-0.0, 6.5]) == [LOSSY, 6.5]


def test_number_text_round_trips():
    import random

    draw = random.Random(4)
    for _ in range(3000):
        x = draw.choice([draw.random() * 10 ** draw.randint(-320, 300), float(draw.randint(-(10**18), 10**18))])
        assert float(exact.number_text(x)) == x
        assert float(exact.plain_decimal(repr(x))) == x
