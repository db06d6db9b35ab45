"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams (n = 1, 2), one of target text and one of raw text, give
each document a log importance weight: the sum of the log ratios of its n-grams, divided by the root
of their number, since the sum's spread grows with that root and documents of all lengths are to be
held to one scale, and times ``sharpness``. A Gumbel variate is added to it, and the ``k`` documents with
the largest sums are a sample without replacement in proportion to the weights.

The raw model counts every document of the corpus. The target model counts those that are labelled
good, among at most ``max_labels`` labelled rows, taken in order of a hash of their id; that is the one
bounded sample. ``k`` follows from the importance weights: it is the number of documents whose weight
is at least that of the share ``keep_good`` of the good labelled ones, each of these weighed by a target
model without itself. Models may be fitted on another table than the one that is sampled from, as
long as the labels' ids are its own.

The k-th largest sum is found exactly by counting leading bits of the keys in four passes over a
narrow table, so no sort of the whole table and no large limit is needed.

Defined results: a null or empty text has no n-gram and log weight 0; rows at the k-th place that
tie are all kept; without any good label that meets a document everything is kept; null labels and
labels with a null id count for nothing; null ids stay null and are kept or not like others; repeated
rows have equal keys and share their fate; an empty table gives an empty one; texts of any length
are counted whole; further columns are carried along or ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import Scratch, free_name, mix64, tidy, valid_text, word_hashes


#: Above the bits of any key.
ABOVE_ALL = (1 << 63) - 1


@dataclass(frozen=True)
class ResamplingConfig:
    bucket_bits: int = 14
    smoothing: float = 1.0
    blend: float = 0.05  # share of the raw model mixed into the target model
    max_labels: int = 50_000
    sharpness: float = 20.0
    keep_good: float = 0.998
    seed: int = 7_331


def features(text: str | None, bucket_bits: int) -> np.ndarray:
    """Buckets of the words and word pairs of a text, with repeats."""
    words = word_hashes((text or "").lower().encode("utf-8"))
    pairs = mix64(words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:])
    return (np.concatenate([words, pairs]) >> np.uint64(64 - bucket_bits)).astype(np.int64)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Signed integers in the same order as the floating-point numbers."""
    raw = values.astype(np.float64).view(np.int64)
    return np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw)


def _counter(config: ResamplingConfig):
    schema = pa.schema([("good", pa.bool_()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << config.bucket_bits
        counts = {True: np.zeros(size, np.int64), False: np.zeros(size, np.int64)}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                for good, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    counts[good] += np.bincount(features(text, config.bucket_bits), minlength=size)
        for good, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([good] * len(some), pa.bool_()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], schema=schema)

    return run


@dataclass(frozen=True)
class Model:
    """Counts of both models; ``cut`` is the least log weight that counts towards ``k``."""

    raw: np.ndarray
    target: np.ndarray
    config: ResamplingConfig
    cut: float = -math.inf

    def log_ratios(self, own: np.ndarray | None = None) -> np.ndarray:
        """Log ratio of each bucket; ``own`` is left out of the target."""
        raw, target = self.raw + self.config.smoothing, self.target + self.config.smoothing
        if own is not None:
            target = target - own
        ratio = (target / target.sum()) / (raw / raw.sum())
        return np.log((1 - self.config.blend) * ratio + self.config.blend)

    def weight(self, found: np.ndarray, ratios: np.ndarray) -> float:
        return float(self.config.sharpness * ratios[found].sum() / math.sqrt(len(found))) if len(found) else 0.0


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), valid_text(F.col(text_col)).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, config: ResamplingConfig, id_col: str, text_col: str) -> Model | None:
    """Count both models in one pass, then weigh the good labelled documents for the cut. What reaches
    the driver is one number for each bucket and one for each such document."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("q")).filter("id is not null and q is not null")
    known = known.groupBy("id").agg(F.max("q").alias("q")).orderBy(F.xxhash64(F.lit(config.seed), "id"), "id").limit(config.max_labels)
    good = F.broadcast(known.filter("q = 1").select("id", F.lit(True).alias("good")))
    slim = _slim(docs, id_col, text_col)
    marked = slim.join(good, "id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "text")
    raw, target = np.zeros((2, 1 << config.bucket_bits))
    for is_good, bucket, n in marked.mapInArrow(tidy(_counter(config)), "good boolean, bucket int, n long").groupBy("good", "bucket").agg(F.sum("n")).collect():
        raw[bucket] += n
        if is_good:
            target[bucket] += n
    if not target.any():
        return None
    model = Model(raw, target, config)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                found = [features(t, config.bucket_bits) for t in whole.column(0).slice(at, 512).to_pylist()]
                each = [model.weight(f, model.log_ratios(np.bincount(f, minlength=1 << config.bucket_bits))) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(each, pa.float64())], names=["weight"])

    rows = slim.join(good, "id").select("text").mapInArrow(tidy(weigh), "weight double").collect()
    weights = sorted(r.weight for r in rows)
    return replace(model, cut=weights[math.floor((1 - config.keep_good) * len(weights))])


def _scorer(model: Model):
    ratios, config = model.log_ratios(), model.config

    def score(ids: list, texts: list) -> tuple[list[int], np.ndarray, np.ndarray]:
        found = [features(t, config.bucket_bits) for t in texts]
        weight = np.array([model.weight(f, ratios) for f in found], dtype=np.float64)
        drawn = mix64(mix64(np.array([0 if i is None else i for i in ids], dtype=np.int64).view(np.uint64)) + np.uint64(config.seed))
        uniform = ((drawn >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
        return [len(f) for f in found], weight, weight - np.log(-np.log(uniform))

    return score


def _scored(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("n_features", pa.int64()), ("log_weight", pa.float64()), ("gumbel_key", pa.float64()), ("bits", pa.int64())])
    score = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, weight, key = score(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(weight), pa.array(key), pa.array(ordered_bits(key))], schema=schema)

    return _slim(docs, id_col, text_col).mapInArrow(tidy(run), "id long, n_features long, log_weight double, gumbel_key double, bits long")


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The value at place ``k`` from the top; None if there are fewer rows. Sixteen bits are settled in
    each pass, from counts of at most 65,536 prefixes."""
    left, low, shift = k, None, 48
    while shift >= 0:
        part = rows if low is None else rows.filter(F.shiftright(column, shift + 16) == low)
        counts = sorted(((r[0], r[1]) for r in part.groupBy(F.shiftright(column, shift).alias("p")).agg(F.count("*")).collect()), reverse=True)
        for prefix, n in counts:
            if n >= left:
                low = prefix
                break
            left -= n
        else:
            return None
        shift -= 16
    return low


def _least(rows: DataFrame, model: Model) -> int:
    """The bits of the smallest key that is sampled, from ``(log_weight, bits)`` of all rows."""
    k = rows.filter(F.col("log_weight") >= model.cut).count()
    found = kth_largest(rows, "bits", k) if k else None
    return ABOVE_ALL if found is None else found


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ResamplingConfig = ResamplingConfig(), corpus: DataFrame | None = None) -> DataFrame:
    """One row per input row: the id, ``n_features``, ``log_weight``, ``gumbel_key`` and ``kept``. The models are
    fitted on ``corpus`` if it is given."""
    model = fit(docs if corpus is None else corpus, labels, config, id_col, text_col)
    blank = model or Model(np.zeros(1 << config.bucket_bits), np.zeros(1 << config.bucket_bits), config)
    rows = Scratch(docs.sparkSession, "resampling").write(_scored(docs, blank, id_col, text_col), "scores")
    kept = F.col("bits") >= _least(rows, model) if model else F.lit(True)
    return rows.select(F.col("id").alias(id_col), "n_features", "log_weight", "gumbel_key", kept.alias("kept"))


def filter_resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ResamplingConfig = ResamplingConfig(), corpus: DataFrame | None = None) -> DataFrame:
    """The sampled documents with the input's own columns. Keys are computed where the rows are, so
    no text is shuffled."""
    model = fit(docs if corpus is None else corpus, labels, config, id_col, text_col)
    if model is None:
        return docs
    scored = _scored(docs, model, id_col, text_col).select("log_weight", "bits")
    least, score = _least(Scratch(docs.sparkSession, "resampling").write(scored, "keys"), model), _scorer(model)

    @F.arrow_udf("boolean")
    def stays(ids: pa.Array, texts: pa.Array) -> pa.Array:
        parts = [ordered_bits(score(ids.slice(at, 512).to_pylist(), texts.slice(at, 512).to_pylist())[2]) >= least for at in range(0, len(ids), 512)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0, bool), pa.bool_())

    return docs.filter(stays(F.col(id_col).cast("long"), valid_text(F.col(text_col))))
