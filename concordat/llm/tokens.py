"""Token counts by a compiled finite-state transducer.

``machine`` compiles the tokenizer's merge table into a deterministic machine over bytes whose
transitions are annotated with the change in the number of tokens. White space brings it back to its
first state, so the map of any chunk from entry states to exit state and emitted count has three
parts: the run of bytes before the first white space, which continues whatever run is open, the count
of the runs that lie whole inside, and the run that is left open at the end. These maps compose
associatively. Every text is a sequence of chunks, cut wherever the chunk size falls, between the
maps of its two edges; neighbours are composed level by level, as a parallel prefix scan does, all
texts of a batch together.

Defined results: a null text is an empty one (0 bytes, 0 tokens); ids may be null or repeat, rows are
counted one by one; an empty table has no row; nothing is cut off from long texts. A run without any
white space has to fit the worker's memory.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from concordat.llm.common import tidy
from concordat.llm.machine import Machine, machine

#: Bytes that bring the machine back to its first state, whatever stands around them.
WHITE = re.compile(rb"[ \t\n\r\x0b\x0c]")


@dataclass(frozen=True)
class TokenConfig:
    tokenizer: str = "word_bpe_49k.json"
    limit: int = 2048
    chunk_bytes: int = 1 << 16
    most_states: int = 200_000


def tokenizer_path(name: str) -> str:
    """A path stays as it is; a bare name is looked up among the public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


class StateMap(NamedTuple):
    """``head`` is what a chunk adds to the run that is open before it; ``count`` is what the runs
    inside emit, or None if the chunk has no white space; ``tail`` is the run left open."""

    head: bytes
    count: int | None
    tail: bytes


#: White space and nothing else: what stands before and after a text.
EDGE = StateMap(b"", 0, b"")


class Transducer:
    def __init__(self, reader: Machine):
        self.reader = reader

    def state_maps(self, chunks: list[bytes]) -> list[StateMap]:
        """The maps of many chunks; what lies inside them goes through the machine at once."""
        cut = []
        for chunk in chunks:
            first = WHITE.search(chunk)
            if first is None:
                cut.append((chunk, None, b""))
                continue
            inner = chunk[first.start() :]
            tail = b"" if WHITE.match(inner, len(inner) - 1) else inner.rsplit(None, 1)[-1]
            cut.append((chunk[: first.start()], inner[: len(inner) - len(tail)], tail))
        counts = iter(self.reader.count([inner for _, inner, _ in cut if inner is not None]))
        return [StateMap(head, None if inner is None else next(counts), tail) for head, inner, tail in cut]

    @staticmethod
    def compose(a: StateMap, b: StateMap, between: int) -> StateMap:
        """``between`` is the count of the run that ``a`` leaves open and ``b`` closes."""
        if a.count is None:
            return StateMap(a.head + b.head, b.count, b.tail)
        if b.count is None:
            return StateMap(a.head, a.count, a.tail + b.head)
        return StateMap(a.head, a.count + between + b.count, b.tail)

    def level(self, rows: list[list[StateMap]]) -> list[list[StateMap]]:
        """Every row of maps with its neighbours composed; a last map without one stays."""
        pairs = [(a, b) for row in rows for a, b in zip(row[::2], row[1::2])]
        closed = [k for k, (a, b) in enumerate(pairs) if a.count is not None and b.count is not None and (a.tail or b.head)]
        between = dict(zip(closed, self.reader.count([pairs[k][0].tail + pairs[k][1].head for k in closed])))
        made = iter([self.compose(a, b, between.get(k, 0)) for k, (a, b) in enumerate(pairs)])
        return [[next(made) for _ in range(len(row) // 2)] + row[len(row) & ~1 :] for row in rows]

    def scan(self, rows: list[list[StateMap]]) -> list[StateMap]:
        """Each row composed to one map."""
        while any(len(row) > 1 for row in rows):
            rows = self.level(rows)
        return [row[0] for row in rows]

    def counts(self, texts: list[bytes], chunk_bytes: int = 1 << 16) -> list[int]:
        """Token counts of texts."""
        chunks = [[t[k : k + chunk_bytes] for k in range(0, len(t), chunk_bytes)] for t in texts]
        maps = iter(self.state_maps([c for row in chunks for c in row]))
        return [total.count for total in self.scan([[EDGE, *(next(maps) for _ in row), EDGE] for row in chunks])]


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: TokenConfig = TokenConfig()) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer(machine(tokenizer_path(config.tokenizer), config.most_states))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = byte_texts(batch.column(1))
                counts = transducer.counts(texts, config.chunk_bytes)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > config.limit for n in counts], pa.bool_())], schema=schema)

    slim = docs.selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text")
    return slim.mapInArrow(tidy(run), "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
