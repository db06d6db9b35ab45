"""Corpus pipeline: documents go through the stages below, each written as Parquet and read again.

Quality rules and the quality classifier drop what they reject, the n-gram join leaves one document
of each near-duplicate class, decontamination drops documents that hold a benchmark item, and
packing turns the rest into pieces of token sequences. All stages but the last return the columns of
``documents``, further ones of any name included.

Defined results: null and empty texts go with the quality rules, as does any text of under twenty words;
rows with a null id are judged like others, all of them stay in the join stage, and packing gives them
null ids; rows that repeat an id are rows of their own, of which one of each text stays; of copies the
smallest id stays; an empty table, or one of which a stage leaves nothing, gives an empty result; without
any good label the classifier keeps everything, without benchmark items decontamination does; texts of
any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concordat.llm import decontamination, ngram_join, packing, quality_rules, resampling
from concordat.sources.scratch import Scratch, one_step


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_quality(docs)


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the whole table: after the rules hardly any bad text is left to tell good text from."""
    return resampling.filter_resampled(docs, _table(spark, sf_dir, "labels"), corpus=_table(spark, sf_dir, "documents"))


def apply_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def apply_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def apply_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", apply_quality_classifier),
    ("ngram_jaccard_join", apply_ngram_join),
    ("benchmark_decontamination", apply_decontamination),
    ("packing", apply_packing),
]

#: Sampling, minwise hashing, edit distances and token ids are not expressible in SQL;
#: tests/llm/test_pipeline.py holds the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``. The table between two stages lies in the shared scratch folder until
    the one after it is written; what a stage needed for itself goes when it is done."""
    scratch = Scratch(spark, "pipeline")
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with one_step():
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
