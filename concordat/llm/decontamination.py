"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be found with up to ``k = m * error_percent / 100`` edits. It is cut into
k + 1 pieces; a passage within k edits leaves at least one piece whole, so every match shows as an
exact piece hit. One automaton finds the hits of all pieces in a text; the places around the hits
are verified with Myers' bit-parallel edit distance of the whole item.

The items go to the workers in blocks of at most ``block_chars`` characters, whatever the size of the
benchmark, and every block is matched against all documents. The driver holds one block at a time: if
there are several, what a block finds is written before the next one is read.

Defined results: texts and items are lower-cased and their white space is collapsed; positions are
places in that form. Null and empty items match nothing. Items of fewer than ``min_chars`` characters
are searched without edits and as whole words; ``drop_leaks`` leaves them out, since clean text holds a
short answer by chance. Null texts hold nothing; repeated rows are reported for each row; a document
and an item give one row, that of the smallest distance, the leftmost one on ties; an item id that is
null or repeats is reported as it is; an empty table of documents or items gives no row and drops none;
texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import Scratch, tidy, valid_text


@dataclass(frozen=True)
class MatchConfig:
    error_percent: int = 8
    min_chars: int = 32
    block_chars: int = 8_000_000

    def budget(self, length: int) -> int:
        return length * self.error_percent // 100 if length >= self.min_chars else 0


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length, with their places in the item."""
    cuts = [k * len(item) // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for k, c in enumerate(item):
        found[c] = found.get(c, 0) | 1 << k
    return found


def myers(peq: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int] | None:
    """Least distance of the item to any part of ``text`` and where that part ends, or None if it is
    over the budget. One column of the edit matrix is a pair of m-bit numbers."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = budget + 1, -1
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        diag = eq | down
        flat = (((eq & up) + up) ^ up) | eq
        plus = (down | ~(flat | up)) & full
        minus = up & flat
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus <<= 1
        minus <<= 1
        up = (minus | ~(diag | plus)) & full
        down = plus & diag & full
        if score < best:
            best, end = score, at
    return (best, end) if end >= 0 else None


def whole_words(text: str, begin: int, end: int) -> bool:
    """Whether no word goes on beyond either end of a passage."""
    before = begin > 0 and text[begin - 1].isalnum() and text[begin].isalnum()
    after = end < len(text) and text[end - 1].isalnum() and text[end].isalnum()
    return not (before or after)


class Matcher:
    """All pieces of one block of items in an automaton."""

    def __init__(self, items: list[tuple[int | None, str]], config: MatchConfig):
        import ahocorasick

        self.items: list[tuple] = []
        self.short: list[bool] = []
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for name, text in items:
            budget = config.budget(len(text))
            number = len(self.items)
            self.items.append((name, text, budget, masks(text)))
            self.short.append(len(text) < config.min_chars)
            for place, piece in pieces(text, budget):
                owners.setdefault(piece, []).append((number, place))
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def places(self, text: str) -> dict[int, list[int]]:
        """For each item where its start would lie, judged from its hits."""
        found: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for number, place in where:
                if self.short[number] and not whole_words(text, end + 1 - length, end + 1):
                    continue
                found.setdefault(number, set()).add(end + 1 - length - place)
        return {number: sorted(starts) for number, starts in found.items()}

    def matches(self, text: str) -> Iterator[tuple[int | None, int, int, int]]:
        for number, starts in self.places(text).items():
            name, item, budget, peq = self.items[number]
            best = None
            k = 0
            while k < len(starts):  # places whose windows touch are verified together
                first = last = starts[k]
                while k + 1 < len(starts) and starts[k + 1] - last <= len(item):
                    k += 1
                    last = starts[k]
                k += 1
                low = max(0, first - budget)
                hit = myers(peq, len(item), text[low : last + len(item) + budget], budget)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], low + hit[1])
            if best:
                yield name, best[0], budget, best[1]

    def any_match(self, text: str) -> bool:
        return next(iter(self.matches(text)), None) is not None


def blocks(benchmark: DataFrame, config: MatchConfig, item_col: str, text_col: str, least: int = 1) -> Iterator[list[tuple[int | None, str]]]:
    """The items of at least so many characters, streamed to the driver in blocks of bounded size."""
    block, size = [], 0
    for name, text in benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).toLocalIterator():
        text = normal(text)
        if len(text) < least:
            continue
        if block and size + len(text) > config.block_chars:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", config: MatchConfig = MatchConfig()) -> DataFrame:
    """One row for each document and item found in it: both ids, ``distance``, ``budget`` and
    ``end_char``, the place in the normalised text where the passage ends."""
    out = f"{id_col} long, {item_col} long, distance long, budget long, end_char long"
    schema = pa.schema([(id_col, pa.int64()), (item_col, pa.int64()), ("distance", pa.int64()), ("budget", pa.int64()), ("end_char", pa.int64())])
    slim = docs.select(F.col(id_col).cast("long").alias("id"), valid_text(F.col(text_col)).alias("text"))

    def over(items: list[tuple[int | None, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, config)
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    rows = [(name, *hit) for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in matcher.matches(normal(text))]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

        return run

    scratch, parts, held = Scratch(docs.sparkSession, "leaks"), [], None
    for items in blocks(benchmark, config, item_col, item_text_col):
        if held:
            parts.append(scratch.write(slim.mapInArrow(tidy(over(held)), out), f"block-{len(parts)}"))
        held = items
    if held:
        parts.append(slim.mapInArrow(tidy(over(held)), out))
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], out)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", config: MatchConfig = MatchConfig()) -> DataFrame:
    """The documents that hold no item, with the input's own columns; nothing is shuffled."""

    def clean(items: list[tuple[int | None, str]]) -> Column:
        built: list[Matcher] = []

        @F.arrow_udf("boolean")
        def judge(texts: pa.Array) -> pa.Array:
            if not built:
                built.append(Matcher(items, config))
            return pa.array([not built[0].any_match(normal(t.as_py())) for t in texts], pa.bool_())

        return judge(valid_text(F.col(text_col)))

    scratch, held, n = Scratch(docs.sparkSession, "clean"), None, 0
    for items in blocks(benchmark, config, item_col, item_text_col, config.min_chars):
        if held:
            docs, n = scratch.write(docs.filter(clean(held)), f"block-{n}"), n + 1
        held = items
    return docs.filter(clean(held)) if held else docs
