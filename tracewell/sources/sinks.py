"""Writers: the lineage file, the report file, one file for each model, and the tables themselves."""

from __future__ import annotations

import datetime
import json
import os
import re
import tempfile

from pyspark.sql import functions as F

from tracewell.operators import graph, report
from tracewell.plans.lineage import Lineage

VERSION = 1
PRODUCER = "tracewell"


def default_path(target: str) -> str:
    return os.path.join(target, f"column_lineage.{PRODUCER}.json")


def replace(path: str, text: str) -> None:
    """Writes a file beside `path` and moves it there at once; a link at `path` is replaced, not followed."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, beside = tempfile.mkstemp(prefix=".tracewell-", dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise


def cache_document(pass_: Lineage, target: str = "", now: str | None = None) -> dict:
    """The lineage file: lists in a fixed order, empty ones left out. Metadata only, so it is made on the driver."""
    out: dict = {"version": VERSION, "source": PRODUCER, "producer": PRODUCER}
    if target:
        out["target"] = target
    out["generated_at"] = now or datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    edges = pass_.edges.orderBy("model_ord", "edge_ord", "from", "from_col", "to_col")
    out["edges"] = [{"from": r["from"], "from_col": r["from_col"], "to": r["to"], "to_col": r["to_col"], "kind": r["kind"]} for r in edges.toLocalIterator()]
    roots = [{"node": r["uid"], "column": r["column"], "expressions": r["expressions"]} for r in pass_.roots.orderBy("model_ord", "column").toLocalIterator()]
    rules = [
        {"node": r["uid"], "clause": r["clause"], "text": r["text"], **({"cut": True} if r["cut"] else {}), "columns": [{"node": c["node"], "column": c["column"]} for c in r["columns"]]}
        for r in pass_.rules.orderBy("model_ord", "rule_ord").toLocalIterator()
    ]
    expressions = [
        {"node": r["uid"], "column": r["column"], "kind": r["kind"], "text": r["text"], "steps": r["steps"], **({"cut": True} if r["cut"] else {})}
        for r in pass_.expressions.orderBy("model_ord", "column").toLocalIterator()
    ]
    partial = [{"node": r["uid"], "column": r["column"], "reason": r["reason"], "name": r["name"]} for r in pass_.partial.orderBy("model_ord", "column", "reason", "name").toLocalIterator()]
    for name, rows in (("roots", roots), ("rules", rules), ("expressions", expressions), ("partial", partial)):
        if rows:
            out[name] = rows
    return out


def write_cache(pass_: Lineage, path: str, target: str = "", with_rules: bool = True) -> dict:
    document = cache_document(pass_, target)
    if not with_rules:
        document.pop("rules", None)
    replace(path, json.dumps(document, ensure_ascii=False, separators=(",", ":")))
    return document


def report_document(pass_: Lineage, project=None, now: str | None = None) -> dict:
    out: dict = {"generated_at": now or datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")}
    if project is not None:
        out |= {"project": project.name, "adapter": project.adapter, "dbt_version": project.version}
    plain = lambda rows: [{k: v for k, v in r.asDict(recursive=True).items() if v not in (None, [], False, "")} for r in rows.toLocalIterator()]
    if found := plain(pass_.elsewhere.orderBy("uid")):
        out["catalog_elsewhere"] = found
    if found := plain(graph.collisions(pass_.nodes).orderBy("key")):
        out["collisions"] = found
    out["totals"] = report.totals(pass_).first().asDict()
    told = report.findings(pass_).orderBy("rank").drop("rank")
    if found := [r.asDict(recursive=True) for r in told.toLocalIterator()]:
        out["findings"] = found
    unclean = report.model_reports(pass_).filter("not clean").orderBy("name", "uid")
    own = ("name", "uid", "file", "sql_source", "sql_set_aside", "plan", "agreement", "only_itself", "parse_error", "undeclared", "missing", "unexpected", "yaml_stale", "is_thin", "issues", "merged_scopes")
    joined = ("unknown_parents", "lost_columns", "partial_columns", "unbacked_reads", "row_deciding", "ambiguous", "absent_reads")
    out["models"] = plain(unclean.select(*own, *joined))
    return out


def write_report(pass_: Lineage, path: str, project=None) -> dict:
    document = report_document(pass_, project)
    replace(path, json.dumps(document, ensure_ascii=False, indent=2) + "\n")
    return document


def dump_models(pass_: Lineage, folder: str) -> int:
    """What the pass saw of each model, a file each, into a folder that must be empty or missing."""
    if os.path.exists(folder) and os.listdir(folder):
        raise FileExistsError(f"{folder} is not empty")
    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in pass_.rows():
        name = re.sub(r"[^\w.-]", "_", row["uid"])[:200]
        replace(os.path.join(folder, f"{name}.json"), json.dumps(row, ensure_ascii=False, indent=1, default=str))
        n += 1
    return n


def write_tables(pass_: Lineage, folder: str) -> None:
    """All tables of a pass as Parquet, for readers at scale."""
    for name in ("models", "edges", "roots", "rules", "expressions", "partial"):
        getattr(pass_, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    pass_.lists.withColumn("kept", F.col("kept")).write.mode("overwrite").parquet(f"{folder}/lists")
