"""Queries op1 and op10 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.tiff import media_digests, store_texts

    return media_digests(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.html import extract_text

    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
