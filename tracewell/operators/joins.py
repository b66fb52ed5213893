"""Joins that Spark has no operator for, by sorts and equi-joins that scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str]) -> DataFrame:
    """Each left row with the columns `take` of the latest right row of its key at or before it, nulls if there is none.

    Both sides are united and sorted once within their key; a running last value carries the right row
    along, so no range of rows is ever joined. Of right rows at one instant the greatest by `take` wins.
    """
    mark = F.struct(*[F.col(c) for c in take])
    # among equal instants, right rows come first so that a left row sees them
    both = left.select(*by, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType).alias("_right"))
    other = right.select(*by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("_left"), mark.alias("_right"))
    run = Window.partitionBy(*by).orderBy("_at", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.unionByName(other).withColumn("_right", F.last("_right", ignorenulls=True).over(run)).filter("_side = 1")
    return carried.select("_left.*", *[F.col(f"_right.{c}").alias(c) for c in take])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, extra: Column | None = None) -> DataFrame:
    """Pairs with low <= at < high, by an equi-join on buckets of `width`: a range is in every bucket it touches, a point in one."""
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    wide = ranges.withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    near = points.withColumn("_bucket", bucket(at)).join(wide, "_bucket").drop("_bucket")
    met = (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    return near.filter(met if extra is None else met & extra)
