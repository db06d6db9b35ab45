"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import decontamination, fixity, html_extract, license_scan, ngram_join, oracles, packing, quality_rules, resampling, tokens, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_metrics(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def _second_replica(pages: DataFrame) -> DataFrame:
    """A replica that differs from the first where a careless copy would: pages cut off before their end
    tag were completed, pages of one farm of hosts were lost, and URLs with a fragment were stored
    once more without it."""
    whole = F.when(F.col("html").endswith("</html>"), F.col("html")).otherwise(F.concat("html", F.lit("</html>")))
    held = pages.filter(~F.coalesce(F.contains("url", F.lit("spam-farm")), F.lit(False)))
    again = held.filter(F.contains("url", F.lit("#"))).withColumn("url", F.substring_index("url", "#", 1))
    return held.withColumn("html", whole).union(again.withColumn("html", whole))


def op5_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = fixity.audit(pages, _second_replica(pages))
    return found.withColumnRenamed("id", "page_id").withColumn("version", F.col("version").cast("long"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_benchmark_decontamination,
    op2_quality_rules,
    op3_quality_classifier,
    op4_html_extraction,
    op5_merkle_fixity,
    op6_url_filters,
    op7_ngram_jaccard_join,
    op8_token_counts,
    op9_license_scan,
    op10_packing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES
