"""Connected components of an edge table by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._text import checkpointed, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each node's component, for an edge table (a, b) of nodes of any ordered type.

    Each round every node joins the neighbour that a hash of that round puts first, and the edges
    between the joined nodes remain; the number of edges falls by a constant factor on average, so
    the rounds grow with the logarithm of the longest chain. A hub's edges are pre-aggregated and
    met by joins that Spark can split. Nothing but counts comes to the driver. Self edges make
    nodes of their own component; null ends are left out; an empty table gives an empty table.
    """
    spent = []
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    left = before = checkpointed(edges.select("a", "b").distinct())
    nodes, step = None, 0
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        joined = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
        chosen = checkpointed(joined.select("node", F.least(F.col("m"), order("node"))["v"].alias("to")))
        if nodes is None:
            nodes = chosen
        else:
            later = chosen.select(F.col("node").alias("to"), F.col("to").alias("then"))
            nodes = nodes.join(later, "to", "left").select("node", F.coalesce("then", "to").alias("to"))
        a = chosen.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = chosen.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = left.join(a, "a").join(b, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        left = checkpointed(left)
        release(before)
        before = left
        spent.append(chosen)
        if left.isEmpty():
            break
        if step:
            nodes = checkpointed(nodes)
            spent.append(nodes)
        step += 1
    nodes = checkpointed(nodes)
    release(left, *spent)
    least = nodes.groupBy("to").agg(F.min("node").alias("component"))
    out = checkpointed(nodes.join(least, "to").select("node", "component").repartition("node"))  # dealt evenly, however large a component is
    release(nodes)
    return out
