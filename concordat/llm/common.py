"""Helpers shared by the corpus operators: scratch tables, names, and text hashing.

Conventions used by every operator of this package:

* Input columns are picked by name and copied to private names first, so further columns
  of the input, whatever they are called, are never touched.
* A null text counts as an empty text; a null id stays null in the result.
* Where a text goes to Python, bytes that are no UTF-8 count as U+FFFD; columns that are carried along keep them.
* Intermediate tables are Parquet files below ``spark.checkpoint.dir``, a folder that the
  driver and all executors share, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.expressions import let
from concordat.sources.scratch import Scratch

__all__ = ["Scratch", "free_name", "let", "maybe_in", "mix64", "shingle_hashes", "tidy", "valid_text", "word_hashes"]

MASK = (1 << 64) - 1
def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have, compared without regard to case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def valid_text(text: Column) -> Column:
    """The text as Python can read it: bytes that are no UTF-8 become U+FFFD. Spark's strings may hold any bytes."""
    return F.make_valid_utf8(text)


FILTER_SEED = 90_107


def maybe_in(ids: DataFrame, column: Column, bits: int = 1 << 26) -> Column:
    """A test that is true for every id of the frame ``ids (id)`` and for few others: a bitmap of fixed
    size, 8 MB by default, over hashes of the ids. It only spares rows a shuffle; whoever uses it
    joins the rest exactly, so an overfull bitmap costs time and nothing else."""

    def place(c: Column) -> Column:  # Spark's bitmaps count from 1
        return F.pmod(F.xxhash64(F.lit(FILTER_SEED), c), F.lit(bits)) + 1

    parts = ids.select(place(F.col("id")).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    held = np.zeros(-(-bits // 32768) * 4096, dtype=np.uint8)
    for bucket, bitmap in parts.collect():  # at most bits / 32768 rows
        held[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(bitmap), dtype=np.uint8)

    @F.arrow_udf("boolean")
    def test(places: pa.Array) -> pa.Array:
        bit = places.to_numpy(zero_copy_only=False) - 1
        return pa.array((held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1, pa.bool_())

    return test(place(column))


def tidy(run):
    """A partition function that hands freed memory back to the system when its partition ends. Workers
    are kept for later tasks, and what an allocator holds on to would count against those."""

    def over(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return over


# --- hashing of words, for the operators that run in Python workers -------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit values, so that nearby inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BLOCK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 14)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def _hash_block(raw: np.ndarray) -> np.ndarray:
    n = len(raw)
    gap = np.empty(n + 2, dtype=bool)
    gap[0] = gap[-1] = True
    np.take(_SPACE, raw, out=gap[1:-1])
    starts = np.flatnonzero(gap[:-2] & ~gap[1:-1])
    if not len(starts):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
    up, down = _powers(n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, in order; words are runs of bytes other than
    ASCII white space. The hash of a word does not depend on where it stands. Long texts are
    taken in blocks that end at white space, so memory stays bounded."""
    if len(text) <= BLOCK:
        return _hash_block(np.frombuffer(text, dtype=np.uint8))
    parts, at = [], 0
    raw = np.frombuffer(text, dtype=np.uint8)
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:
            nxt = np.flatnonzero(_SPACE[raw[end : end + BLOCK]])
            end = end + int(nxt[0]) if len(nxt) else min(end + BLOCK, len(raw))
        parts.append(_hash_block(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a text with fewer words has one shingle, all of it,
    and a text without words has none."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : n - width + 1 + k]
        out = out ^ (out >> np.uint64(29))
    return mix64(out + np.uint64(width))
