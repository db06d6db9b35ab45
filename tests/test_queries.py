"""Every registered query that has an oracle, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from concordat import catalog_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def compare(spark, query, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, rel = query(spark, DATA), db.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    mine = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    theirs = sorted(repr([plain(r[k]) for k in at]) for r in rel.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(catalog_queries.oracle_sql()))
def test_oracle(spark, name):
    compare(spark, catalog_queries.queries()[name], catalog_queries.oracle_sql()[name])


def test_entry_has_rows(spark):
    assert catalog_queries.entry(spark, DATA).count() > 0


def test_table_digest_follows_content_only(spark):
    from concordat.functions.encoding import table_digest
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(str(k), "v") for k in range(50)], "k string, v string")
    texts = {"k": F.col("k"), "v": F.col("v")}
    one = table_digest(df, ["k"], texts).first()
    assert one == table_digest(df.orderBy(F.rand(3)).repartition(5), ["k"], texts).first() and one.rows == 50
    assert one.sha256 != table_digest(df.withColumn("v", F.when(F.col("k") == "7", "w").otherwise("v")), ["k"], texts).first().sha256
    assert one.sha256 != table_digest(df.union(df.limit(1)), ["k"], texts).first().sha256
    assert table_digest(df.limit(0), ["k"], texts).first().rows == 0


def test_negative_zero_balance_is_as_in_the_sql(spark, tmp_path):
    rows = [(1, -0.0), (2, 0.0), (3, None), (4, -0.01), (5, 10.5), (6, -999.0)]
    spark.createDataFrame(rows, "c_custkey bigint, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    db = duckdb.connect()
    db.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = db.sql(catalog_queries.oracle_sql()["codec_decimal_numeric"]).fetchall()
    found = catalog_queries.queries()["codec_decimal_numeric"](spark, str(tmp_path))
    assert found.columns == ["c_custkey", "canonical", "err"]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert (1, "-0", None) in want
