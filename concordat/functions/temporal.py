"""Timestamps as microseconds since 1970, parsed and written by plain expressions.

Spark's own parsers are lenient, so every text passes an anchored pattern before its parts are read.
Nothing here depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.errors import CODEC_INVALID, CODEC_LOSSY
from concordat.functions.expressions import let

#: The first and last microsecond of the years 1 to 9999.
MICROS_MIN, MICROS_MAX = -62_135_596_800_000_000, 253_402_300_799_999_999
ISO = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?(Z|z|[+-][0-9]{2}(?::?[0-9]{2}(?::?[0-9]{2})?)?)\z"
NAIVE = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,6}))?\z"
LOOSE_DATETIME = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,3}))?\z"
DATE = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})\z"
DAY = 86_400_000_000


def in_range(micros: Column) -> Column:
    return micros.between(MICROS_MIN, MICROS_MAX)


def _offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC, null for an offset out of range."""
    digits = F.rpad(F.regexp_replace(F.substring(zone, 2, 8), ":", ""), 6, "0")
    h, m, s = (F.substring(digits, at, 2).try_cast("int") for at in (1, 3, 5))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    return F.when(F.lower(zone) == "z", 0).when((h <= 23) & (m <= 59) & (s <= 59), sign * (h * 3600 + m * 60 + s))


def _instant(text: Column, pattern: str, zone: int | None = None) -> Column:
    """``struct(micros, err)`` of a text that has the pattern's parts; ``zone`` is the part with the offset."""
    last = zone or (3 if pattern is DATE else 7)
    # One replacement writes all parts with a separator between them, in place of one match for each part.
    written = F.regexp_replace(text, pattern, "\x01".join(f"${k}" for k in range(1, last + 1)))
    parts = F.struct(text.rlike(pattern).alias("fits"), F.split(written, "\x01").alias("p"))

    def part(p: Column, k: int) -> Column:
        return F.get(p["p"], F.lit(k - 1))

    def number(p: Column, k: int) -> Column:
        return F.coalesce(part(p, k).try_cast("int"), F.lit(0)) if k <= last else F.lit(0)

    def read(p: Column) -> Column:
        fraction = part(p, 7) if last >= 7 else F.lit("")
        start = F.try_make_timestamp(*(number(p, k) for k in range(1, 6)), number(p, 6).cast("decimal(8,6)"), F.lit("UTC"))
        return F.struct(
            (p["fits"] & (number(p, 6) <= 59)).alias("fits"),
            (F.unix_micros(start) + F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("long")).alias("micros"),
            (_offset_seconds(part(p, zone)) if zone else F.lit(0)).cast("long").alias("east"),
            F.substring(fraction, 7, 1 << 20).rlike("[1-9]").alias("finer"),
        )

    def judge(x: Column) -> Column:
        micros = x["micros"] - x["east"] * 1_000_000
        err = F.when(~F.coalesce(x["fits"], F.lit(False)) | micros.isNull(), CODEC_INVALID).when(x["finer"] | ~in_range(micros), CODEC_LOSSY)
        return F.struct(F.when(err.isNull(), micros).alias("micros"), err.alias("err"))

    return let(let(parts, read), judge)


def parse_iso(text: Column) -> Column:
    """ISO-8601 with an explicit offset. Shape, calendar and offset are judged before precision and range."""
    return _instant(text, ISO, 8)


def parse_naive(text: Column) -> Column:
    return _instant(text, NAIVE)


def parse_loose_datetime(text: Column) -> Column:
    return _instant(text, LOOSE_DATETIME)


def parse_date(text: Column) -> Column:
    return _instant(text, DATE)


def floor_div(a: Column, b: int) -> Column:
    """Whole-number division towards minus infinity."""
    return F.call_function("div", a - F.pmod(a, F.lit(b).cast("long")), F.lit(b).cast("long"))


def naive_text(micros: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffff``."""

    def written(m: Column) -> Column:
        rest = F.pmod(m, F.lit(DAY).cast("long"))

        def two(unit: int, wrap: int) -> Column:
            return F.lpad(F.pmod(floor_div(rest, unit), F.lit(wrap)).cast("string"), 2, "0")

        clock = F.concat_ws(":", two(3_600_000_000, 24), two(60_000_000, 60), two(1_000_000, 60))
        fraction = F.lpad(F.pmod(rest, F.lit(1_000_000)).cast("string"), 6, "0")
        return F.concat(F.date_from_unix_date(floor_div(m, DAY).cast("int")).cast("string"), F.lit("T"), clock, F.lit("."), fraction)

    return let(micros, written)


def micro_text(micros: Column) -> Column:
    """UTC with six fractional digits."""
    return F.concat(naive_text(micros), F.lit("Z"))


def shortest_text(micros: Column) -> Column:
    """UTC with three fractional digits where they suffice, six otherwise."""
    whole = F.pmod(micros, F.lit(1000)) == 0
    return F.concat(F.substring(naive_text(micros), F.lit(1), F.when(whole, 23).otherwise(26)), F.lit("Z"))
