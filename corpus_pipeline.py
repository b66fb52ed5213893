"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
before the next. All but the last return the columns of `documents`, whatever columns those are
beside `doc_id` (an integer) and `text`; `n_chars`, where there is one, is kept true. An empty table
gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import jaccard, language, packing, quality, substrings
from tracewell.llm._text import checkpointed, release
from tracewell.llm.queries_tokens import tokenizer_path

#: Some stages hold texts whose language or quality can't be told by SQL.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below 0.5.

    Learns from `labels` and the texts of the documents they name; only those are measured before
    the one pass that scores all. Null and empty texts are scored like others, null ids too; equal
    texts stay or go together. Without a label that teaches, all rows stay.
    """
    model = quality.learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a likely language (a score below 0.5).

    Learns from the documents that state a language and aren't held out. Null and empty texts go.
    A column `lang` that is null or missing teaches nothing; without any, no language is known and
    all rows go, as it is with an empty table.
    """
    stated = docs.withColumn("lang", F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string"))
    model = language.fit(stated.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    return language.keep_identified(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies, the one with the smallest id, in one row.

    Documents without a word are no copies of others; rows with a null id all stay. Of rows with one
    id, those with different texts are documents of their own, of equal ones one stays.
    """
    return jaccard.one_of_each(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of twenty words or more that an earlier document or place has.

    Documents that lose all their words go; those that never had one stay, null texts as null. Rows
    with a null id are kept whole; repeated rows keep and lose the same.
    """
    count = next((c for c in docs.columns if c == "n_chars"), None)
    return substrings.cut_repeats(docs, count=count).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens.

    Every row is packed, as often as it appears; a null or empty text is its end token alone.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", no_repeats),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; what a stage has read is deleted once the next one's result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
        release(*before)
        before = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)  # stands on the pieces it has written
    release(*before)
    return out
