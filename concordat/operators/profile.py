"""One-pass scans: size, NUL, UTF-8, lengths and integer widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.errors import Refusal
from concordat.functions import cells
from concordat.manifest import TableSpec

#: What the strict integer types hold.
INTEGER_RANGES = {"smallint": (-(1 << 15), (1 << 15) - 1), "integer": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1)}


def _bytes(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind.startswith("struct<cls"):
        return cells.stored_bytes(F.col(name))
    return F.coalesce(F.octet_length(F.col(name) if kind in ("string", "binary") else F.col(name).cast("string")), F.lit(0)).cast("long")


def _has_nul(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind.startswith("struct<cls"):
        return F.coalesce(F.contains(cells.text_of(F.col(name)), F.char(F.lit(0))), F.lit(False))
    return F.coalesce(F.contains(F.col(name), F.char(F.lit(0))), F.lit(False)) if kind == "string" else F.lit(False)


def _bad_utf8(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    text = cells.text_of(F.col(name)) if kind.startswith("struct<cls") else F.col(name).cast("string")
    return F.coalesce(~F.is_valid_utf8(text), F.lit(False))


def scan_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: ``rows``, ``bytes``, and for every column whether a text has a NUL or is not UTF-8. All
    columns share one scan."""
    names = columns or df.columns
    total = F.lit(0).cast("long")
    for n in names:
        total = total + _bytes(df, n)
    flags = [F.coalesce(F.bool_or(_has_nul(df, n)), F.lit(False)).alias(f"nul_{n}") for n in names]
    flags += [F.coalesce(F.bool_or(_bad_utf8(df, n)), F.lit(False)).alias(f"bad_utf8_{n}") for n in names if not dict(df.dtypes)[n] == "binary"]
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(total), F.lit(0)).alias("bytes"), *flags)


def source_refusals(df: DataFrame, table: TableSpec) -> tuple[dict, list[Refusal]]:
    """Rows and bytes of a loose table, and refusals for texts that the strict side cannot hold."""
    names = [c.name for c in table.written if c.name in df.columns]
    row = scan_profile(df, names).first().asDict()
    found = [Refusal("source-invalid-utf8", table.name, c.name) for c in table.written if c.name in names and c.reads_text and row.get(f"bad_utf8_{c.name}")]
    found += [Refusal("source-nul-in-text", table.name, c.name) for c in table.written if c.name in names and c.codec != "blob" and row.get(f"nul_{c.name}")]
    return {"table": table.name, "rows": row["rows"], "bytes": row["bytes"]}, found


def text_lengths(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``over_<c>`` and ``longest_<c>`` in characters, for every column with a limit, in one scan."""
    out = []
    for name, limit in limits.items():
        text = cells.text_of(F.col(name)) if dict(df.dtypes)[name].startswith("struct<cls") else F.col(name)
        out += [F.count_if(F.char_length(text) > limit).alias(f"over_{name}"), F.max(F.char_length(text)).cast("long").alias(f"longest_{name}")]
    return df.agg(*out)


def integer_bounds(df: DataFrame, names: list[str]) -> DataFrame:
    """``lo_<c>`` and ``hi_<c>``: of a loose column, integers and texts that are plain integers count."""
    out = []
    for name in names:
        value = cells.plain_integer(F.col(name)) if dict(df.dtypes)[name].startswith("struct<cls") else F.col(name).cast("bigint")
        out += [F.min(value).alias(f"lo_{name}"), F.max(value).alias(f"hi_{name}")]
    return df.agg(*out)


def limit_refusals(df: DataFrame, table: TableSpec, types: dict[str, str], max_lengths: dict[str, int]) -> list[Refusal]:
    """Texts beyond a strict column's length and integers beyond its type, found before any load."""
    limits = {c.name: max_lengths[c.name] for c in table.written if c.name in max_lengths and c.name in df.columns}
    widths = [c.name for c in table.written if c.codec in ("integer", "bigint") and types.get(c.name) in INTEGER_RANGES and c.name in df.columns]
    if not limits and not widths:
        return []
    aggregates = []
    row: dict = {}
    if limits:
        aggregates.append(text_lengths(df, limits))
    if widths:
        aggregates.append(integer_bounds(df, widths))
    for frame in aggregates:
        row |= frame.first().asDict()
    found = []
    for c in table.written:
        if c.name in limits and row[f"over_{c.name}"]:
            found.append(Refusal("varchar-overflow", table.name, c.name, f"max {limits[c.name]} chars, {row[f'over_{c.name}']} rows over, longest {row[f'longest_{c.name}']}"))
        if c.name in widths:
            low, high = INTEGER_RANGES[types[c.name]]
            lo, hi = row[f"lo_{c.name}"], row[f"hi_{c.name}"]
            if lo is not None and lo < low:
                found.append(Refusal("integer-width", table.name, c.name, f"{types[c.name]}, min {lo}"))
            if hi is not None and hi > high:
                found.append(Refusal("integer-width", table.name, c.name, f"{types[c.name]}, max {hi}"))
    return found


def null_violations(df: DataFrame, names: list[str]) -> DataFrame:
    """Nulls in each column, in one scan, as ``(column, nulls)``."""
    row = df.agg(*[(F.count("*") - F.count(n)).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("nulls")) for n in names])
    return row.select(F.inline(pairs))


def non_empty(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, non_empty)``, one probe of a single row for each table."""
    frames = [df.limit(1).agg((F.count("*") > 0).alias("non_empty")).select(F.lit(name).alias("table"), "non_empty") for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
