"""Queries op4, op7 and op8 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.bpe import bpe_encode

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = bpe_encode(docs, tokenizer_path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.counts import token_counts

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, tokenizer_path("piece_bpe_32k.model"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewell.llm.packing import pack_documents

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))
