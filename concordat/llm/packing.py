"""Packing by concatenate and cut, with two-pass prefix sums.

First pass: every partition tokenises its documents, appends the end id, and writes the ids with the
partition's number and the offset inside the partition. Second pass: the partitions' totals, summed
from the first on, shift those offsets to places in one global stream, which windows of fixed
length cut. A document that crosses a window's end leaves a boundary record on either side, so no
id is lost and nothing but the stream's last window can be short.

The first pass is written to the shared folder, so the second reads fixed rows and a retried task
cannot move an offset. Only the partitions' totals, one number for each, reach the driver.

Defined results: a null text is an empty one and gives its end id only; ids may be null or repeat;
an empty table has no piece. Sequences are padded to the window, unless their fill is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import Scratch, tidy, valid_text
from concordat.llm.machine import machine
from concordat.llm.tokens import WHITE, byte_texts, tokenizer_path


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str = "word_bpe_49k.json"
    window: int = 2048
    end_id: int = 1
    most_states: int = 200_000
    chunk_bytes: int = 1 << 20


def parts(text: bytes, chunk_bytes: int) -> list[bytes]:
    """A text cut at white space, where no token changes, after every ``chunk_bytes`` bytes or as soon
    after them as there is some."""
    out, at = [], 0
    while len(text) - at > chunk_bytes and (found := WHITE.search(text, at + chunk_bytes)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def _tokenise(config: PackConfig):
    schema = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = machine(tokenizer_path(config.tokenizer), config.most_states)
        end = np.array([config.end_id], dtype="<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                cut = [parts(t, config.chunk_bytes) for t in byte_texts(batch.column(1))]
                found = iter(reader.ids([p for ps in cut for p in ps]))
                ids = [b"".join([*(next(found).tobytes() for _ in ps), end]) for ps in cut]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                local = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(local, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

    return run


def _cut(config: PackConfig, base: dict[int, int], with_ids: bool):
    fields = [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                cols: list[list] = [[] for _ in schema]
                for name, part, local, n, ids in zip(*(c.to_pylist() for c in whole.slice(first, 512).columns)):
                    place, start = base[part] + local, 0
                    while start < n:
                        sequence, offset = divmod(place + start, config.window)
                        length = min(n - start, config.window - offset)
                        piece = ids[4 * start : 4 * (start + length)]
                        for col, value in zip(cols, (name, start, length, zlib.crc32(piece), n, sequence, offset, piece)):
                            col.append(value)
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: PackConfig = PackConfig(), with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset``, and the ids as little-endian 32-bit numbers if asked for."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), valid_text(F.col(text_col)).alias("text"))
    rows = Scratch(spark, "packing").write(slim.mapInArrow(tidy(_tokenise(config)), "id long, part int, local long, n long, ids binary"), "ids")
    base, total = {}, 0
    for part, n in sorted(rows.groupBy("part").agg(F.sum("n")).collect()):
        base[part] = total
        total += n
    out = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return rows.mapInArrow(tidy(_cut(config, base, with_ids)), out).withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, config: PackConfig = PackConfig(), pad_id: int = 0) -> DataFrame:
    """Whole sequences ``(sequence_id, fill, ids)`` of pieces that carry their ids. A group holds at
    most one window of ids."""

    def run(key: tuple, batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("offset")
        ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype="<u4")
        fill = len(ids)
        if fill & (fill - 1):
            ids = np.concatenate([ids, np.full(config.window - fill, pad_id, dtype="<u4")])
        return pa.table({"sequence_id": [key[0].as_py()], "fill": [fill], "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(run, "sequence_id long, fill long, ids array<long>")
