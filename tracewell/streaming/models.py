"""Statements that arrive as a stream: each row's lineage as it comes, with no state between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.lineage import resolve_models

STATEMENTS = "uid string, sql string, visible array<struct<relation:string,columns:array<string>>>"


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON files, one statement a line: uid, sql, and the lists of the relations it reads."""
    return spark.readStream.schema(STATEMENTS).json(folder)


def lineage_stream(stream: DataFrame) -> DataFrame:
    """One row for each edge of each statement; a statement that can't be read gives one row with its error."""
    none = F.expr("cast(array() as array<struct<source:string,columns:array<string>>>)")
    visible = F.transform("visible", lambda v: F.struct(v["relation"].alias("relation"), F.upper(v["relation"]).alias("key"), v["columns"].alias("columns"), none.alias("others")))
    facts = resolve_models(stream.select("uid", "sql", F.lit(None).cast("string").alias("problem"), visible.alias("visible")))
    return facts.select("uid", "parse_error", F.explode_outer("edges").alias("e")).select("uid", "parse_error", "e.*")
