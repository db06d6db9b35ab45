"""The fourteen codecs as column expressions.

A codec reads a loose cell or a strict column into one logical value and an error class, and writes the
logical value as a canonical text, a strict column or a loose cell. ``bind`` adds the rule for NULL. The
error is null for a value that is carried, ``CODEC_NULL``, ``CODEC_INVALID`` or ``CODEC_LOSSY`` otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.errors import CODEC_INVALID, CODEC_LOSSY, CODEC_NULL
from concordat.functions import cells, exact
from concordat.functions import temporal as T
from concordat.functions.expressions import let
from concordat.manifest import ColumnSpec

SAFE = (1 << 53) - 1
DECIMAL = r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\z"
INTEGER = r"\A-?[0-9]+\z"
UUID = r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"


def outcome(value: Column, err: Column) -> Column:
    return F.struct(F.when(err.isNull(), value).alias("value"), err.alias("err"))


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _valid(value: Column, fits: Column, kind: str = CODEC_INVALID) -> Column:
    return outcome(value, F.when(~F.coalesce(fits, F.lit(False)), kind))


def minus_zero(x: Column) -> Column:
    return (x == 0) & (x.cast("string") == "-0.0")


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


# --- integers ---------------------------------------------------------------------------------


def _digits(text: Column) -> Column:
    """A text of decimal digits, however long: the value, or lossy beyond 64 bits."""
    return let(text.try_cast("bigint"), lambda value: outcome(value, F.when(~text.rlike(INTEGER), CODEC_INVALID).when(value.isNull(), CODEC_LOSSY)))


def loose_int64(c: Column) -> Column:
    whole = (F.abs(c["r"]) <= SAFE) & (c["r"] == F.floor(c["r"]))
    return (
        F.when(c["cls"] == "integer", outcome(c["i"], _none("string")))
        .when(c["cls"] == "real", _valid(c["r"].try_cast("bigint"), whole))
        .when(c["cls"] == "text", _digits(cells.text_of(c)))
        .otherwise(outcome(_none("bigint"), F.lit(CODEC_INVALID)))
    )


def _safe(read: Column) -> Column:
    return let(read, lambda r: outcome(r["value"], F.coalesce(r["err"], F.when(F.abs(r["value"].cast("decimal(20,0)")) > SAFE, CODEC_LOSSY))))


def strict_int64(c: Column) -> Column:
    return outcome(c.cast("bigint"), _none("string"))


# --- decimals ---------------------------------------------------------------------------------


def canonical_decimal(text: Column) -> Column:
    """Sign plus, leading zeros and trailing fractional zeros dropped; zero has no sign."""
    body = F.regexp_replace(text, r"\A[+-]?0*", "")
    body = F.when(F.contains(body, F.lit(".")), F.regexp_replace(F.regexp_replace(body, r"0+\z", ""), r"\.\z", "")).otherwise(body)
    body = F.when((body == "") | body.startswith("."), F.concat(F.lit("0"), body)).otherwise(body)
    return F.when(text.startswith("-") & (body != "0"), F.concat(F.lit("-"), body)).otherwise(body)


def _decimal_text(text: Column) -> Column:
    return _valid(text, text.rlike(DECIMAL))


def _loose_decimal(spec: ColumnSpec) -> Callable[[Column], Column]:
    def read(c: Column) -> Column:
        bad = outcome(_none("string"), F.lit(CODEC_INVALID))
        if spec.option("acceptSqliteNumeric"):
            real = outcome(exact.real_decimal(F.when(finite(c["r"]), c["r"])), F.when(~finite(c["r"]), CODEC_INVALID).when(minus_zero(c["r"]), CODEC_LOSSY))
            integer = outcome(c["i"].cast("string"), _none("string"))
        else:
            real = outcome(_none("string"), F.when(finite(c["r"]), CODEC_INVALID).otherwise(CODEC_LOSSY))
            integer = bad
        return F.when(c["cls"] == "text", _decimal_text(cells.text_of(c))).when(c["cls"] == "integer", integer).when(c["cls"] == "real", real).otherwise(bad)

    return read


def _decimal_cell(spec: ColumnSpec) -> Callable[[Column], Column]:
    def write(text: Column) -> Column:
        if not spec.option("acceptSqliteNumeric"):
            return outcome(cells.text_cell(text), _none("string"))
        plain = canonical_decimal(text)
        integer = F.when(plain.rlike(INTEGER), plain.try_cast("bigint"))
        real = exact.decimal_real(plain)
        return outcome(F.when(integer.isNotNull(), cells.integer_cell(integer)).otherwise(cells.real_cell(real)), F.when(integer.isNull() & real.isNull(), CODEC_LOSSY))

    return write


# --- timestamps -------------------------------------------------------------------------------


def _iso_pair(parsed: Column, text: Column) -> Column:
    return let(parsed, lambda p: outcome(F.struct(p["micros"].alias("micros"), text.alias("text")), p["err"]))


def _ranged(micros: Column) -> Column:
    """``struct(micros, err)`` of microseconds that a strict column has."""
    return let(micros, lambda m: F.struct(m.alias("micros"), F.when(~T.in_range(m), CODEC_LOSSY).alias("err")))


def _strict_micros(c: Column) -> Column:
    return _ranged(F.unix_micros(c.cast("timestamp")))


def _epoch(micros_per_unit: int, raw: Column) -> Column:
    top, low = T.MICROS_MAX // micros_per_unit, -(-T.MICROS_MIN // micros_per_unit)
    pair = F.struct(raw.alias("raw"), F.when(raw.between(low, top), raw * micros_per_unit).alias("micros"))
    return outcome(pair, F.when(~raw.between(low, top), CODEC_LOSSY))


def _loose_epoch(spec: ColumnSpec, unit: int) -> Callable[[Column], Column]:
    def from_micros(parsed: Column) -> Column:
        def units(p: Column) -> Column:
            pair = F.struct(T.floor_div(p["micros"], unit).alias("raw"), p["micros"].alias("micros"))
            return outcome(pair, F.coalesce(p["err"], F.when(F.pmod(p["micros"], F.lit(unit).cast("long")) != 0, CODEC_LOSSY)))

        return let(parsed, units)

    def read(c: Column) -> Column:
        none = _none("struct<raw:bigint,micros:bigint>")
        whole = let(loose_int64(c), lambda n: F.when(n["err"].isNull(), _epoch(unit, n["value"])).otherwise(outcome(none, n["err"])))
        if not spec.option("acceptSqliteDatetimeText"):
            return whole
        text = cells.text_of(c)
        return F.when((c["cls"] == "text") & ~text.rlike(INTEGER), from_micros(T.parse_loose_datetime(text))).otherwise(whole)

    def strict(c: Column) -> Column:
        return _epoch(unit, c.cast("bigint")) if spec.option("preserveInteger") else from_micros(_strict_micros(c))

    read.strict = strict
    return read


def _naive_micros(c: Column) -> Column:
    """Wall-clock microseconds of a zoneless timestamp column."""
    clock = (F.hour(c).cast("long") * 3600 + F.minute(c) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * T.DAY + clock


# --- JSON -------------------------------------------------------------------------------------


def _json(spec: ColumnSpec) -> Callable[[Column], Column]:
    check = exact.json_unique if spec.json_type == "jsonb" else exact.json_kept
    return lambda text: outcome(text, F.when(text.isNull() | check(text).isNull(), CODEC_INVALID))


# --- the registry -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Codec:
    """``loose`` and ``strict`` read; ``canonical``, ``to_strict`` and ``to_loose`` write a logical value, the
    last one with an error class of its own."""

    strict_type: str
    loose: Callable[[Column], Column]
    strict: Callable[[Column], Column]
    canonical: Callable[[Column], Column]
    to_strict: Callable[[Column], Column]
    to_loose: Callable[[Column], Column]


def _text_only(read: Callable[[Column], Column], kind: str) -> Callable[[Column], Column]:
    return lambda c: F.when(c["cls"] == "text", read(cells.text_of(c))).otherwise(outcome(_none(kind), F.lit(CODEC_INVALID)))


def _kept(write: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: outcome(write(v), _none("string"))


def _same(v: Column) -> Column:
    return v


def codec_for(spec: ColumnSpec) -> Codec:
    name = spec.codec
    if name == "text":
        return Codec("string", lambda c: _valid(cells.text_of(c), (c["cls"] == "text") & F.is_valid_utf8(c["raw"].cast("string"))), lambda c: _valid(c.cast("string"), c.isNotNull()), _same, _same, _kept(cells.text_cell))
    if name == "integer":
        return Codec("bigint", lambda c: _safe(loose_int64(c)), lambda c: _safe(strict_int64(c)), lambda v: v.cast("string"), _same, _kept(cells.integer_cell))
    if name == "bigint":
        return Codec("bigint", loose_int64, strict_int64, lambda v: v.cast("string"), _same, _kept(cells.integer_cell))
    if name == "real":
        return Codec(
            "double",
            lambda c: _valid(c["r"], (c["cls"] == "real") & finite(c["r"])),
            lambda c: _valid(c.cast("double"), finite(c.cast("double"))),
            exact.real_text,
            _same,
            lambda v: outcome(cells.real_cell(v), F.when(minus_zero(v), CODEC_LOSSY)),
        )
    if name == "decimal-as-string":
        return Codec("string", _loose_decimal(spec), lambda c: _decimal_text(c.cast("string")), canonical_decimal, _same, _decimal_cell(spec))
    if name == "boolean":
        bit = lambda c: F.when(c["cls"] == "integer", c["i"].cast("double")).when(c["cls"] == "real", c["r"])
        return Codec("boolean", lambda c: _valid(bit(c) == 1, bit(c).isin(0.0, 1.0)), lambda c: _valid(c.cast("boolean"), c.isNotNull()), lambda v: v.cast("string"), _same, _kept(lambda v: cells.integer_cell(v.cast("int"))))
    if name == "blob":
        return Codec("binary", lambda c: _valid(c["raw"], c["cls"] == "blob"), lambda c: _valid(c.cast("binary"), c.isNotNull()), lambda v: F.sha2(v, 256), _same, _kept(cells.blob_cell))
    if name == "uuid-text":
        read = lambda t: _valid(F.lower(t), t.rlike(UUID))
        return Codec("string", _text_only(read, "string"), lambda c: read(c.cast("string")), _same, _same, _kept(cells.text_cell))
    if name == "timestamp-iso":
        keep = spec.option("preserveText")
        loose = _text_only(lambda t: _iso_pair(T.parse_iso(t), t), "struct<micros:bigint,text:string>")
        if keep:
            return Codec("string", loose, lambda c: _iso_pair(T.parse_iso(c.cast("string")), c.cast("string")), lambda v: v["text"], lambda v: v["text"], _kept(lambda v: cells.text_cell(v["text"])))
        strict = lambda c: _iso_pair(_strict_micros(c), T.shortest_text(F.unix_micros(c.cast("timestamp"))))
        return Codec("timestamp", loose, strict, lambda v: T.micro_text(v["micros"]), lambda v: F.timestamp_micros(v["micros"]), _kept(lambda v: cells.text_cell(T.shortest_text(v["micros"]))))
    if name in ("timestamp-epoch-s", "timestamp-epoch-ms"):
        read = _loose_epoch(spec, 1_000_000 if name.endswith("-s") else 1000)
        keep = spec.option("preserveInteger")
        canonical = (lambda v: v["raw"].cast("string")) if keep else (lambda v: T.micro_text(v["micros"]))
        to_strict = (lambda v: v["raw"]) if keep else (lambda v: F.timestamp_micros(v["micros"]))
        return Codec("bigint" if keep else "timestamp", read, read.strict, canonical, to_strict, _kept(lambda v: cells.integer_cell(v["raw"])))
    if name == "timestamp-naive":
        read = lambda t: let(T.parse_naive(t), lambda p: outcome(p["micros"], p["err"]))
        strict = lambda c: let(_ranged(_naive_micros(c)), lambda p: outcome(p["micros"], p["err"]))
        return Codec("timestamp_ntz", _text_only(read, "bigint"), strict, T.naive_text, lambda v: T.naive_text(v).cast("timestamp_ntz"), _kept(lambda v: cells.text_cell(F.translate(T.naive_text(v), "T", " "))))
    if name == "date-text":
        read = lambda t: outcome(t, T.parse_date(t)["err"])
        return Codec("date", _text_only(read, "string"), lambda c: read(c.cast("string")), _same, lambda v: v.cast("date"), _kept(cells.text_cell))
    if name == "json-text":
        read = _json(spec)
        binary = spec.json_type == "jsonb"
        return Codec("string", _text_only(read, "string"), lambda c: read(c.cast("string")), exact.json_canonical if binary else _same, _same, _kept(lambda v: cells.text_cell(exact.json_unique(v) if binary else v)))
    raise ValueError(f"no codec {name}")


def bind(spec: ColumnSpec, side: str, value: Column) -> Column:
    """``struct(value, err)`` of a column on the ``loose`` or ``strict`` side, with the rule for NULL."""
    codec = codec_for(spec)
    absent = cells.is_null(value) if side == "loose" else value.isNull()
    read = codec.loose(value) if side == "loose" else codec.strict(value)
    null_err = _none("string") if spec.nullable else F.lit(CODEC_NULL)
    return let(read, lambda r: F.struct(F.when(~absent, r["value"]).alias("value"), F.when(absent, null_err).otherwise(r["err"]).alias("err")))


def written(spec: ColumnSpec, read: Column) -> Column:
    """The canonical text of a logical value that ``bind`` gave; null for null."""
    if spec.codec in ("real", "json-text"):  # these may go through Python, which a lambda cannot
        return F.when(read.isNotNull(), codec_for(spec).canonical(read))
    return let(read, lambda v: F.when(v.isNotNull(), codec_for(spec).canonical(v)))


def canonical(spec: ColumnSpec, side: str, value: Column) -> Column:
    """The canonical text, null for NULL and for values that are not carried."""
    return written(spec, bind(spec, side, value)["value"])


def error(spec: ColumnSpec, side: str, value: Column) -> Column:
    return bind(spec, side, value)["err"]


def to_strict(spec: ColumnSpec, cell: Column) -> Column:
    read = bind(spec, "loose", cell)["value"]
    return F.when(read.isNotNull(), codec_for(spec).to_strict(read)).cast(codec_for(spec).strict_type)


def to_loose(spec: ColumnSpec, value: Column) -> Column:
    """``struct(value, err)`` of the loose cell that a strict value becomes."""
    read = bind(spec, "strict", value)
    written = codec_for(spec).to_loose(read["value"])
    absent = read["value"].isNull()
    return F.struct(F.when(absent, cells.null_cell()).otherwise(written["value"]).alias("value"), F.coalesce(read["err"], F.when(~absent, written["err"])).alias("err"))
