"""Queries op5 and op6 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.quality import score_quality

    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.language import language_id

    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
