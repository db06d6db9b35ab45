"""Row encoding, digests and load text, all as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Version mark of the row encoding; a digest begins with it.
HEADER = "concordat row encoding v2"


def encode_row(canonicals: list[Column]) -> Column:
    """Bytes of a row: for each column 0 for NULL, or 1, four bytes of length and the UTF-8 text. The
    framing keeps ("ab", "c") apart from ("a", "bc") and NULL apart from an empty text."""

    def field(c: Column) -> Column:
        length = F.unhex(F.lpad(F.hex(F.octet_length(c)), 8, "0"))
        return F.when(c.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), length, F.encode(c, "UTF-8")))

    return F.concat(*[field(c) for c in canonicals])


def row_digest(canonicals: list[Column]) -> Column:
    return F.sha2(encode_row(canonicals), 256)


#: Leading hexadecimal digits of a key's hash that make a leaf and a branch of a table's hash tree.
LEAF, BRANCH = 5, 2


def _gathered(prefix: str, order: str, text: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(prefix).alias("p"), F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), ""), 256)


def tree_digest(hashes: DataFrame, *sums: Column) -> DataFrame:
    """``(rows, sha256, ...)`` of ``(k, h)``, the hashes of rows' keys and of rows: rows are hashed in the order
    of their keys' hashes, leaf by leaf, leaves into branches and branches into one. The tree has the
    same shape at any size, so a receipt tells nothing of how it was made, and no task gathers more than a
    millionth of the rows or some thousand leaves. ``sums`` are further columns to be added up on the way."""
    extra = [F.sum(c).alias(f"s{k}") for k, c in enumerate(sums)]
    again = [F.sum(f"s{k}").alias(f"s{k}") for k in range(len(sums))]
    leaves = hashes.withColumn("leaf", F.substring("k", 1, LEAF)).groupBy("leaf").agg(F.count("*").alias("n"), _gathered("k", "h", F.col("h")).alias("h"), *extra)
    branches = leaves.withColumn("branch", F.substring("leaf", 1, BRANCH)).groupBy("branch").agg(F.sum("n").alias("n"), _gathered("leaf", "h", F.concat("leaf", "h")).alias("h"), *again)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("branch", "h"))), lambda x: F.concat(x["branch"], x["h"])), "")
    named = [F.coalesce(F.sum(f"s{k}"), F.lit(0)).alias(f"sum_{k}") for k in range(len(sums))]
    return branches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.concat(F.lit(HEADER), listed), 256).alias("sha256"), *named)


def table_digest(rows: DataFrame, key: list[str], canonicals: dict[str, Column]) -> DataFrame:
    """``(rows, sha256)`` of a table by its hash tree."""
    return tree_digest(rows.select(row_digest([F.col(k) for k in key]).alias("k"), row_digest(list(canonicals.values())).alias("h")))


def load_text(value: Column, kind: str) -> Column:
    """One value in the text format of bulk loads: ``\\N`` for NULL, backslash, tab, line feed and
    carriage return escaped, booleans as t and f, bytes as hex."""
    if kind == "binary":
        text = F.concat(F.lit("\\\\x"), F.lower(F.hex(value)))
    elif kind == "boolean":
        text = F.when(value, "t").otherwise("f")
    elif kind == "string":
        escapes = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))
        text = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), escapes, value)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "\\N").otherwise(text)


def load_line(columns: dict[str, str]) -> Column:
    """A whole row, columns between tabs."""
    return F.concat_ws("\t", *[load_text(F.col(name), kind) for name, kind in columns.items()])
