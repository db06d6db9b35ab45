"""Row-by-row comparison of two sides by key, over canonical texts.

A full outer join on the canonical key replaces an ordered merge of two cursors: it needs no total
order, runs in parallel, and tells missing rows from changed ones. Duplicate keys would multiply in a
join of rows, so whole tables are compared by one row for each key: its count and its rows' hash.
Only where these differ are the columns themselves looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.errors import Refusal, Refused
from concordat.functions import codecs
from concordat.functions.encoding import row_digest, table_digest, tree_digest
from concordat.manifest import TableSpec


def canonical_frame(df: DataFrame, table: TableSpec, side: str) -> DataFrame:
    """All declared columns, generated ones too, as canonical texts."""
    return df.select(*[codecs.canonical(c, side, F.col(c.name)).alias(c.name) for c in table.columns])


def differences(left: DataFrame, right: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row for each key that differs: the key, ``kind`` (``missing`` on the right, ``extra`` there, or
    ``changed``) and the first differing column in the given order."""
    names = [c for c in (columns or left.columns) if c not in key]
    a = left.select(*[F.col(k).alias(f"a_{k}") for k in key], F.lit(True).alias("in_a"), *[F.col(c).alias(f"l_{c}") for c in names])
    b = right.select(*[F.col(k).alias(f"b_{k}") for k in key], F.lit(True).alias("in_b"), *[F.col(c).alias(f"r_{c}") for c in names])
    on = reduce(lambda x, y: x & y, [F.col(f"a_{k}") == F.col(f"b_{k}") for k in key])
    first = F.coalesce(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in names]) if names else F.lit(None).cast("string")
    kind = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(first.isNotNull(), "changed")
    joined = a.join(b, on, "full_outer").withColumn("kind", kind)
    keys = [F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in key]
    return joined.filter("kind is not null").select(*keys, "kind", F.when(F.col("kind") == "changed", first).alias("column"))


def first_difference(diff: DataFrame, key: list[str]) -> DataFrame:
    """The difference with the least key, as one row."""
    return diff.agg(*[F.min_by(c, F.struct(*key)).alias(c) for c in (*key, "kind", "column")])


def digest(canonical: DataFrame, table: TableSpec) -> DataFrame:
    """The table's receipt ``(rows, sha256)``."""
    return table_digest(canonical, list(table.primary_key), {c.name: F.col(c.name) for c in table.columns})


def sealed(canonical: DataFrame, key: list[str], mark: str) -> DataFrame:
    """One row for each key: the hashes of the key and of its row, and how many rows have the key."""
    names = [row_digest([F.col(k) for k in key]).alias("k"), row_digest([F.col(c) for c in canonical.columns]).alias("h")]
    return canonical.select(*names).groupBy("k").agg(F.min("h").alias(f"h_{mark}"), F.count("*").alias(f"n_{mark}"))


def compared(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """``(k, h, bad)`` of two canonical frames with equal columns: each key's hash, the left row's hash, and
    whether the key is not exactly once on both sides with equal rows."""
    both = sealed(left, key, "a").join(sealed(right, key, "b"), "k", "full_outer")
    same = (F.col("n_a") == 1) & (F.col("n_b") == 1) & (F.col("h_a") == F.col("h_b"))
    return both.select("k", F.coalesce("h_a", "h_b").alias("h"), (~F.coalesce(same, F.lit(False))).cast("int").alias("bad"))


def verified(source: DataFrame, target: DataFrame, table: TableSpec, sides: tuple[str, str] = ("loose", "strict")) -> dict:
    """``{rows, sha256}`` if both sides agree in every declared column that the target has; a refusal
    naming table and column otherwise. Each side is read once; only a failure reads them again."""
    present = source.columns if sides[0] == "strict" else target.columns
    spec = TableSpec(table.name, tuple(c for c in table.columns if c.name in present), table.primary_key)
    key = list(spec.primary_key)
    a, b = canonical_frame(source, spec, sides[0]), canonical_frame(target, spec, sides[1])
    receipt = tree_digest(compared(a, b, key), F.col("bad")).first()
    if receipt["sum_0"]:
        again = [df.groupBy(*key).count().filter("count > 1") for df in (a, b)]
        if any(not df.isEmpty() for df in again):
            raise Refused(Refusal("verification-mismatch", table.name, key[0]))
        raise Refused(Refusal("verification-mismatch", table.name, first_difference(differences(a, b, key), key).first()["column"]))
    return {"rows": receipt["rows"], "sha256": receipt["sha256"]}


def codec_errors(df: DataFrame, table: TableSpec, side: str) -> DataFrame:
    """``(column, err, rows)`` of values that are not carried, all columns in one scan."""
    pairs = F.array(*[F.struct(F.lit(c.name).alias("column"), codecs.error(c, side, F.col(c.name)).alias("err")) for c in table.columns])
    return df.select(F.inline(pairs)).filter("err is not null").groupBy("column", "err").agg(F.count("*").alias("rows"))


def sort_key(column: Column, codec: str) -> Column:
    """Key order that both sides agree on: bytes of texts, lower-cased for UUIDs, natural otherwise."""
    return F.lower(column) if codec == "uuid-text" else column
