import pytest

from tracewell.operators import graph


@pytest.fixture
def one_partition(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", held)


def test_circles_end_early(one_partition):
    rows = [("x", "y", 0), ("y", "x", 0), ("z", "y", 0), ("y", "c", 1)]
    edges = one_partition.createDataFrame(rows, "uid string, parent string, ord int").coalesce(1)
    nodes = edges.select("uid").union(edges.select("parent")).distinct()
    found = {r["uid"]: r["level"] for r in graph.topo_levels(edges.select("uid", "parent"), nodes).collect()}
    assert found["c"] == 0 and all(0 < found[n] < 5 for n in "xyz")
    skipped = one_partition.createDataFrame([("x",), ("y",)], "uid string")
    ways = {r["uid"]: (r["parent"], r["path"]) for r in graph.read_through(edges, skipped).collect()}
    assert ways == {"x": ("c", [0, 1]), "y": ("c", [1]), "z": ("c", [0, 1])}
