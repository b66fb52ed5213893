import json
from collections import Counter

import pytest

from tracewell.operators import report
from tracewell.plans.lineage import Options, run_project
from tracewell.sources.demo import harbour
from tracewell.sources.project import Node, Project
from tracewell.sources.sinks import cache_document, write_cache, write_report


@pytest.fixture(scope="module")
def found(spark):
    return run_project(spark, harbour(), Options(indirect=True))


def test_harbour_edges(found):
    kinds = Counter(r["kind"] for r in found.edges.select("kind").collect())
    assert kinds == {"join_key": 25, "filter": 8, "passthrough": 10, "aggregate": 4, "transform": 5, "rename": 2, "window": 2, "hash": 1, "cast": 1}


def test_file_is_the_same_twice(spark, found, tmp_path):
    one = cache_document(found, now="t")
    assert one == cache_document(run_project(spark, harbour(), Options(indirect=True)), now="t")
    assert len(one["edges"]) == 58 and len(one["rules"]) == 4 and len(one["expressions"]) == 10 and len(one["roots"]) == 2
    written = write_cache(found, str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text()) == written


def test_report(found, tmp_path):
    totals = write_report(found, str(tmp_path / "r.json"), harbour())["totals"]
    assert totals["models"] == totals["parsed"] == totals["confirmed"] == 5
    assert (totals["columns_covered"], totals["columns_total"], totals["columns_root"]) == (25, 25, 2)
    assert totals["edges_indirect"] == 33 and totals["columns_lost"] == 0
    assert json.loads((tmp_path / "r.json").read_text())["models"] == []


def project(**models):
    out = Project({}, "p", "duckdb")
    out.nodes["source.p.raw"] = Node("source.p.raw", "raw", "source", "p", relation="db.s.raw")
    out.warehouse["source.p.raw"] = ["id", "amount", "status"]
    for name, (sql, parents, columns, declared) in models.items():
        uid = f"model.p.{name}"
        out.nodes[uid] = Node(uid, name, "model", "p", f"{name}.sql", f"db.s.{name}", "view", sql=sql, sql_source="manifest", parents=parents, declared=declared)
        if columns:
            out.warehouse[uid] = columns
    return out


def test_plans_inference_and_findings(spark):
    raw = ["source.p.raw"]
    seen = []
    found = run_project(
        spark,
        project(
            good=("select id, 'x' as tag from db.s.raw", raw, ["id", "tag"], []),
            broken=("select from db.s.raw", raw, ["id", "status"], []),
            behind=("select id, amount from db.s.raw", raw, ["id", "status"], []),
            stranger=("select x.id from db.s.elsewhere x", raw, [], []),
            gap=("with u as (select id from db.s.raw) select id, amount from u", raw, ["id", "amount"], []),
        ),
        observe=seen.append,
    )
    plans = {r["uid"].split(".")[-1]: r["plan"] for r in found.models.select("uid", "plan").collect()}
    assert plans == {"good": "parsed", "broken": "inferred", "behind": "per_column", "stranger": "parsed", "gap": "parsed"}
    edges = {(r["from"].split(".")[-1], r["from_col"], r["to"].split(".")[-1], r["to_col"], r["kind"]) for r in found.edges.collect()}
    assert ("raw", "status", "broken", "status", "inferred") in edges
    assert ("raw", "id", "behind", "id", "passthrough") in edges
    assert ("raw", "status", "behind", "status", "inferred") in edges
    assert not any(e[2] == "behind" and e[3] == "amount" for e in edges)
    assert [(r["column"], r["expressions"]) for r in found.roots.collect()] == [("tag", ["'x'"])]
    told = {r["category"] for r in report.findings(found).select("category").collect()}
    assert {"compile_does_not_parse", "relation_not_declared", "reads_a_name_its_cte_lacks"} <= told
    assert len(seen) == 5
    bare = run_project(spark, project(broken=("select from db.s.raw", raw, ["id"], [])), Options(infer=False))
    assert bare.edges.count() == 0


def test_streamed_statements(spark, tmp_path):
    from tracewell.streaming.models import lineage_stream, statements

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"uid": "m", "sql": "select id * 2 as d from db.s.t", "visible": [{"relation": "db.s.t", "columns": ["id"]}]}) + "\n")
    run = lineage_stream(statements(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("edges").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(60)
    assert [(r["from_column"], r["to_column"], r["kind"]) for r in spark.table("edges").collect()] == [("id", "d", "transform")]
