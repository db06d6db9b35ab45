"""Keys: duplicates, orphans and set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.errors import Refusal
from concordat.functions import cells
from concordat.manifest import Manifest
from concordat.sources.scratch import Scratch


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has, with their ``rows``."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def adjacent_repeats(df: DataFrame, key: list[str]) -> DataFrame:
    """``repeats``: rows whose key equals the row's before in key order, as an ordered pass would count them."""
    return df.groupBy(*key).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeats"))


def _present(child: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [child[c].isNotNull() for c in columns])


def orphans(child: DataFrame, parent: DataFrame, columns: list[str], ref_columns: list[str]) -> DataFrame:
    """Child rows without a parent. A row with any null key column has nothing to match and is no
    orphan. Only the key columns of the parent are read."""
    wanted = parent.select(*[F.col(r).alias(f"__ref_{k}") for k, r in enumerate(ref_columns)])
    on = reduce(lambda a, b: a & b, [child[c] == wanted[f"__ref_{k}"] for k, c in enumerate(columns)])
    return child.filter(_present(child, columns)).join(wanted, on, "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, columns: list[str], ref_columns: list[str]) -> DataFrame:
    return orphans(child.select(*columns), parent, columns, ref_columns).agg(F.count("*").alias("orphans"))


def _kind(codec: str | None) -> str | None:
    return {"integer": "integer", "bigint": "integer", "text": "text"}.get(codec or "")


def _foreign_storage(df: DataFrame, columns: list[str], kinds: list[str]) -> Column:
    bad = [F.count_if(~F.col(c)["cls"].isin("null", k)) for c, k in zip(columns, kinds)]
    return reduce(lambda a, b: a + b, bad)


def orphan_refusals(tables: dict[str, DataFrame], manifest: Manifest, foreign_keys: list[dict]) -> tuple[list[Refusal], list[dict]]:
    """Anti-joins of loose tables over all keys between copied tables. A key is compared only where
    equality of stored values is equality of what they become; others are reported as skipped."""
    found, skipped = [], []
    for fk in foreign_keys:
        child, parent = manifest.tables.get(fk["table"]), manifest.tables.get(fk["ref_table"])
        if not child or not parent or fk["table"] not in tables or fk["ref_table"] not in tables:
            continue
        codecs = [((child.column(c) or None), (parent.column(r) or None)) for c, r in zip(fk["columns"], fk["ref_columns"])]
        names = [(c.codec if c else None, r.codec if r else None) for c, r in codecs]
        kinds = [_kind(c) if _kind(c) == _kind(r) else None for c, r in names]
        label = f"{fk['name']} -> {fk['ref_table']}"
        if None in kinds:
            c, r = names[kinds.index(None)]
            skipped.append({"code": "orphan-check-skipped", "table": fk["table"], "object": f"{label}: codecs {c or '?'} / {r or '?'} are not compared by raw equality"})
            continue
        a, b = tables[fk["table"]], tables[fk["ref_table"]]
        if any(df.agg(_foreign_storage(df, cols, kinds).alias("n")).first()["n"] for df, cols in ((a, fk["columns"]), (b, fk["ref_columns"]))):
            skipped.append({"code": "orphan-check-skipped", "table": fk["table"], "object": f"{label}: a key column holds values stored in another SQLite type than its codec reads"})
            continue
        flat = [df.select(*[(F.col(c)["i"] if k == "integer" else cells.text_of(F.col(c))).alias(c) for c, k in zip(cols, kinds)]) for df, cols in ((a, fk["columns"]), (b, fk["ref_columns"]))]
        n = orphan_count(*flat, fk["columns"], fk["ref_columns"]).first()["orphans"]
        if n:
            found.append(Refusal("orphan-foreign-keys", fk["table"], None, f"{label}, {n} rows"))
    return found, skipped


def missing_and_extra(have: DataFrame, want: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set differences both ways."""
    return want.subtract(have), have.subtract(want)


def numbered(df: DataFrame, key: Column, name: str = "position") -> DataFrame:
    """Places in key order, from 1, by one window. For refusals and reports, which are few rows."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(key)).cast("long"))


def binary_order(df: DataFrame, key: Column, name: str = "position") -> DataFrame:
    """Places in byte order of the key, from 1, for tables of any size: rows are sorted by ranges and
    written, and each range starts where the ones before it end. Only the ranges' sizes are gathered."""
    sorted_rows = df.orderBy(key).withColumn("__at", F.monotonically_increasing_id())
    rows = Scratch(df.sparkSession, "ordered").write(sorted_rows, "rows")
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    starts = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))
    return rows.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + inside + 1).drop("__at", "__part", "__start")
