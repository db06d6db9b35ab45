"""Foreign keys before and after a load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: All that has to be the same again; the constraint's own number is new by design.
FIELDS = (
    "table_oid", "ref_oid", "definition", "validated", "enforced", "conkey", "confkey", "conpfeqop", "confdelsetcols",
    "confupdtype", "confdeltype", "confmatchtype", "deferrable", "deferred", "index_name",
)
KEY = ("table_schema", "table", "name")


def changed_foreign_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(table, name)`` of keys that are gone, new or differ in any of the fields."""
    a = before.select(*KEY, F.struct(*FIELDS).alias("was"), F.lit(True).alias("in_a"))
    b = after.select(*[F.col(k).alias(f"b_{k}") for k in KEY], F.struct(*FIELDS).alias("now"), F.lit(True).alias("in_b"))
    on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"b_{k}") for k in KEY])
    same = F.col("in_a").eqNullSafe(F.col("in_b")) & F.col("was").eqNullSafe(F.col("now"))
    return a.join(b, on, "full_outer").filter(~same).select(F.coalesce("table", "b_table").alias("table"), F.coalesce("name", "b_name").alias("name"))
