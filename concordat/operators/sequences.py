"""Sequences: where they go on, who uses them, and what an AUTOINCREMENT table has issued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extremes(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("highest"), F.min(column).alias("lowest"))


def restart_value(highest: Column, lowest: Column, high_water: Column, increment: Column) -> Column:
    """The next value of a sequence: its extreme in its own direction, an ascending one's high water
    included, plus the increment; null for an empty table."""
    top = F.when(increment > 0, F.greatest(highest, high_water)).otherwise(lowest)
    return top + increment


def restarts(facts: DataFrame) -> DataFrame:
    """Facts ``(highest, lowest, high_water, increment, min, max)`` with ``restart_with`` and ``in_range``."""
    value = restart_value(F.col("highest"), F.col("lowest"), F.col("high_water"), F.col("increment"))
    return facts.withColumn("restart_with", value).withColumn("in_range", F.coalesce(F.col("restart_with").between(F.col("min"), F.col("max")), F.lit(True)))


def issued(last_value: Column, called: Column, increment: Column) -> Column:
    return F.when(called, last_value).otherwise(last_value - increment)


def high_water(facts: DataFrame) -> DataFrame:
    """``seq`` of AUTOINCREMENT tables from ``(table, highest, last_value, called, increment)``: the largest
    value a row has or the ascending sequence has handed out. Empty tables that issued nothing are left out."""
    given = F.when(F.col("increment") > 0, issued(F.col("last_value"), F.col("called"), F.col("increment")))
    seq = F.greatest(F.coalesce("highest", F.lit(0)), F.coalesce(given, F.lit(0)))
    return facts.withColumn("seq", seq.cast("long")).filter((F.col("seq") != 0) | F.col("highest").isNotNull()).select("table", "seq")


def classify(refs: DataFrame, copied: DataFrame) -> DataFrame:
    """One row for each sequence of ``refs (sequence_oid, schema, name, cycles, kind, table_oid, column)``:
    ``verdict`` is ``sequence-unowned``, ``sequence-shared``, ``sequence-cycles``, ``usable`` or ``foreign``. The table
    and column are those of the first use by a copied table, in the order of kind, relation and column;
    ``pos`` numbers sequences by schema and name."""
    marked = refs.join(copied.select(F.col("oid").alias("table_oid"), F.col("name").alias("copied_as")), "table_oid", "left")
    owner = F.col("kind") == "owner"
    place = F.struct("table_oid", "column")
    grouped = marked.groupBy("sequence_oid").agg(
        F.min("schema").alias("schema"),
        F.min("name").alias("name"),
        F.bool_or("cycles").alias("cycles"),
        F.count_if(owner).alias("owners"),
        F.collect_set(F.when(owner, place)).alias("owned_by"),
        F.collect_set(F.when(~owner, place)).alias("used_by"),
        F.bool_or(owner & F.col("copied_as").isNotNull()).alias("copied_owner"),
        F.min(F.when(F.col("copied_as").isNotNull(), F.struct("kind", "table_oid", "column", "copied_as"))).alias("used"),
    )
    shared = (F.col("owners") > 1) | (F.size(F.array_except("used_by", "owned_by")) > 0)
    verdict = F.when(F.col("owners") == 0, "sequence-unowned").when(shared, "sequence-shared").when(F.col("cycles"), "sequence-cycles").when(F.col("copied_owner"), "usable").otherwise("foreign")
    pos = F.row_number().over(Window.orderBy("schema", "name", "sequence_oid"))  # a database has few sequences
    return grouped.select("sequence_oid", verdict.alias("verdict"), F.col("used.copied_as").alias("table"), F.col("used.column").alias("column"), F.concat("schema", F.lit("."), "name").alias("object"), pos.alias("pos"))
