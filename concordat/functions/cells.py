"""Loose cells: a column whose rows each have a storage class of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``cls`` is null, integer, real, text or blob; ``raw`` has the bytes of a text or blob.
CELL = "struct<cls:string,i:bigint,r:double,raw:binary>"


def cell(cls: Column | str, i: Column | None = None, r: Column | None = None, raw: Column | None = None) -> Column:
    name = F.lit(cls) if isinstance(cls, str) else cls
    return F.struct(
        name.alias("cls"),
        (F.lit(None) if i is None else i).cast("bigint").alias("i"),
        (F.lit(None) if r is None else r).cast("double").alias("r"),
        (F.lit(None) if raw is None else raw).cast("binary").alias("raw"),
    )


def null_cell() -> Column:
    return cell("null")


def integer_cell(value: Column) -> Column:
    return F.when(value.isNull(), null_cell()).otherwise(cell("integer", i=value))


def real_cell(value: Column) -> Column:
    return F.when(value.isNull(), null_cell()).otherwise(cell("real", r=value))


def text_cell(value: Column) -> Column:
    return F.when(value.isNull(), null_cell()).otherwise(cell("text", raw=F.encode(value.cast("string"), "UTF-8")))


def blob_cell(value: Column) -> Column:
    return F.when(value.isNull(), null_cell()).otherwise(cell("blob", raw=value))


def text_of(c: Column) -> Column:
    """The text of a text cell, null for every other class."""
    return F.when(c["cls"] == "text", c["raw"].cast("string"))


def is_null(c: Column) -> Column:
    return c.isNull() | (c["cls"] == "null")


def plain_integer(c: Column) -> Column:
    """The integer of an integer cell or of a text that is a plain decimal integer within 64 bits."""
    text = text_of(c)
    return F.when(c["cls"] == "integer", c["i"]).when(text.rlike(r"\A-?[0-9]+\z"), text.try_cast("bigint"))


def stored_bytes(c: Column) -> Column:
    """Bytes of the value as the loose store would write it out."""
    text = F.when(c["cls"] == "integer", c["i"].cast("string")).when(c["cls"] == "real", c["r"].cast("string"))
    return F.coalesce(F.octet_length(c["raw"]), F.octet_length(text), F.lit(0)).cast("long")
