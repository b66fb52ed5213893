"""The lineage pass over a project: models level by level, then publication as DataFrame algebra.

The only step outside SQL is the resolver of one statement, which runs over Arrow batches of models;
a level's models are resolved in parallel, with the column lists that lower levels left. Everything
published is made by joins and aggregations of the resolver's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import graph
from tracewell.operators.resolve import resolve
from tracewell.plans.stored import stored

TEXT_CUT = 500
NO_TEXTS = "cast(array() as array<string>)"

FACTS = (
    "uid string, outputs array<string>, projection array<string>, "
    "edges array<struct<from_relation:string,from_column:string,to_column:string,expression:string,steps:int,kind:string>>, "
    "indirect array<struct<relation:string,column:string,role:string>>, "
    "rules array<struct<clause:string,text:string,columns:array<struct<relation:string,column:string>>>>, "
    "roots array<struct<column:string,expressions:array<string>,complete:boolean>>, "
    "lost array<struct<column:string,ends:array<struct<reason:string,via:string,column:string,names:array<string>,reads:array<string>,star:boolean>>>>, "
    "partial array<struct<output:string,name:string,reason:string>>, "
    "unbacked array<struct<output:string,cte:string,column:string,owners:array<string>>>, "
    "unknown_columns array<struct<relation:string,column:string>>, "
    "merged_scopes array<struct<kind:string,name:string,count:int>>, "
    "issues array<struct<code:string,message:string,degrading:boolean,relation:string,span:array<int>>>, "
    "reads array<string>, approximate boolean, parse_error string, unplaced_join int, unplaced_filter int, unplaced_qualify int, "
    "bridged array<struct<relation:string,column:string,witness:string>>"
)


def _read_through_star(sql: str, visible: list[tuple[str, list[str]]], others: dict[str, list[tuple[str, list[str]]]], found: dict) -> tuple[dict, list[dict]]:
    """Columns lost behind a star over one relation, whose other list has them, are read with that list's word for it."""
    from tracewell.operators.resolve import relation_key

    added: dict[str, list[str]] = {}
    bridged = []
    for lost in found["lost"]:
        for end in lost["ends"]:
            if end["reason"] == "phantom" and end["star"] and len(end["reads"]) == 1:
                relation = end["reads"][0]
                witness = next((source for source, columns in others.get(relation, []) if end["column"] in columns), None)
                if witness:
                    added.setdefault(relation, []).append(end["column"])
                    bridged.append({"relation": relation, "column": end["column"], "witness": witness})
    if not added:
        return found, []
    wider = [(name, columns + [c for c in dict.fromkeys(added.get(relation_key(name), [])) if c not in columns]) for name, columns in visible]
    again = resolve(sql, wider)
    key = lambda e: (e["from_relation"], e["from_column"], e["to_column"])
    if not {key(e) for e in found["edges"]} <= {key(e) for e in again["edges"]} or not set(found["outputs"]) <= set(again["outputs"]):
        return found, []
    if again["outputs"] != found["outputs"]:  # the star itself would widen the output
        keep = set(found["outputs"])
        for part, name in (("edges", "to_column"), ("roots", "column"), ("lost", "column"), ("partial", "output"), ("unbacked", "output")):
            again[part] = [x for x in again[part] if x[name] in keep]
        again["outputs"], again["projection"] = found["outputs"], found["projection"]
    return again, bridged


def _resolve_batches(batches, schema: pa.Schema, facts: list[str], keep: list[str]):
    for batch in batches:
        out = []
        for row in batch.select(["uid", "sql", "problem", "visible"]).to_pylist():
            visible = [(v["relation"], v["columns"]) for v in row["visible"] or []]
            if row["sql"] is None:
                found = resolve("", [])
                found["parse_error"] = row["problem"] or "no SQL is known"
                found["issues"] = []
                bridged = []
            else:
                found = resolve(row["sql"], visible)
                others = {v["key"]: [(x["source"], x["columns"]) for x in v["others"] or []] for v in row["visible"] or []}
                found, bridged = _read_through_star(row["sql"], visible, others, found)
            out.append({"uid": row["uid"], **found, "bridged": bridged})
        made = pa.RecordBatch.from_pylist(out, schema=pa.schema([schema.field(n) for n in facts]))
        kept = [batch.column(n).cast(schema.field(n).type) for n in keep]
        yield pa.RecordBatch.from_arrays([*made.columns, *kept], schema=schema)


def resolve_models(models: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Facts of each model: rows (uid, sql, problem, visible), the lists as an array of (relation, key, columns, others), and the columns `keep` as they are."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    facts = StructType.fromDDL(FACTS)
    models = models.select("uid", "sql", "problem", "visible", *keep)
    whole = StructType([*facts.fields, *(models.schema[c] for c in keep)])
    if not models.isStreaming:  # small rows that take long: spread them, however few bytes they are; by a hash, since a deal by uid itself is left out after a join on uid
        models = models.repartition(models.sparkSession.sparkContext.defaultParallelism, F.xxhash64("uid"))
    run = partial(_resolve_batches, schema=to_arrow_schema(whole), facts=facts.names, keep=list(keep))
    return models.mapInArrow(run, whole)


@dataclass
class Options:
    infer: bool = True
    indirect: bool = False


@dataclass
class Lineage:
    """All tables of a pass."""

    nodes: DataFrame
    lists: DataFrame  # with computed lists, and `kept` false for those that don't stand for their model
    models: DataFrame  # one row for each model: the resolver's facts, its lists, agreement and plan
    edges: DataFrame
    roots: DataFrame
    rules: DataFrame
    expressions: DataFrame
    partial: DataFrame
    guesses: DataFrame  # inferred columns: what settled on which of how many candidates
    elsewhere: DataFrame  # catalog entries of another relation than the manifest's

    def rows(self) -> Iterator[dict]:
        """What the pass saw of each model, in its order: the hook for callers that audit models."""
        for row in self.models.orderBy("model_ord").toLocalIterator():
            yield row.asDict(recursive=True)


def verdicts(rows: DataFrame) -> DataFrame:
    """Adds agreement, plan and what they rest on to rows of a model's facts, lists, own key, dependencies and `parents_known`.

    A compile is silent if it has no edge though a list of something it reads is known. `gap` is what
    the resolver admits to have missed, but for the model's own relation, which an incremental model
    reads to decide its rows; unless an output comes from that alone.
    """
    own = F.coalesce("own_key", F.lit(""))
    fed_by = lambda same: F.transform(F.filter("edges", lambda e: (e["from_relation"] == own) == F.lit(same)), lambda e: e["to_column"])
    carried = F.size(F.array_except(fed_by(True), fed_by(False))) > 0
    rows = rows.withColumns(
        {
            "computed": F.col("outputs"),
            "undeclared": F.sort_array(F.array_except(F.array_except("reads", "dependencies"), F.array(own))),
            "silent": (F.size("edges") == 0) & F.coalesce("parents_known", F.lit(False)),
            "gap": F.exists("issues", lambda i: i["degrading"] & (carried | ~F.coalesce(i["relation"] == own, F.lit(False)))),
        }
    )
    rows = graph.missing_unexpected(graph.yaml_is_stale(graph.thin(graph.agreement(rows))))
    foreign = (F.col("sql_source") == "file") & (F.size("undeclared") > 0)
    common = F.array_intersect("outputs", F.when(F.size("warehouse") > 0, F.col("warehouse")).otherwise(F.col("declared")))
    rows = rows.withColumns({"foreign": foreign, "unsound": F.col("parse_error").isNotNull() | F.col("silent") | foreign, "shared_columns": common})
    rows = rows.withColumn("plan", graph.plan_of(F.col("unsound"), F.col("agreement"), F.size("shared_columns"), F.size("unbacked") > 0))
    stand_in = (F.size("warehouse") > 0) | (F.size("declared") > 0)
    return rows.withColumn("retracted", (F.col("plan") != "parsed") | ((F.size("unbacked") > 0) & stand_in))


ELSEWHERE = "uid string, relation string, catalog_relation string"


def run(nodes: DataFrame, lists: DataFrame, options: Options | None = None, observe: Callable[[dict], None] | None = None, elsewhere: DataFrame | None = None) -> Lineage:
    """The whole pass over `nodes` and `lists` as the readers of `sources.project` give them.

    One write for each level of the graph, whatever the number of models in it.
    """
    options = options or Options()
    models = nodes.filter("kind in ('model', 'snapshot')").withColumn("own_key", graph.relation_key("relation"))
    read = models.select("uid", "level", F.posexplode("reads_of").alias("path", "parent"))
    related = nodes.filter("relation is not null").select(F.col("uid").alias("parent"), "relation", graph.relation_key("relation").alias("key"))
    asked = stored(read.join(related, "parent"))
    by_source = lists.groupBy("uid").pivot("source", ["warehouse", "seed_file", "declared"]).agg(F.first("columns"))
    needed = asked.groupBy("uid").agg(F.collect_set("key").alias("dependencies"))
    base = models.drop("declared").join(by_source, "uid", "left").join(needed, "uid", "left")
    base = stored(base.withColumn("dependencies", F.coalesce("dependencies", F.expr(NO_TEXTS))))
    known, parts, read = lists.withColumn("kept", F.lit(True)), None, read.drop("level")
    kept = tuple(c for c in base.columns if c not in ("uid", "sql", "sql_problem", "parents", "file_columns"))
    depth = [r["level"] for r in base.select("level").distinct().orderBy("level").collect()]
    for level in depth:
        here = base.filter(F.col("level") == level).withColumnRenamed("sql_problem", "problem")
        wanted = asked.filter(F.col("level") == level)
        lists_of = graph.visible_lists(known.join(wanted.select(F.col("parent").alias("uid")), "uid", "left_semi")).withColumnRenamed("uid", "parent").drop("source")
        visible = wanted.join(lists_of, "parent").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("path", "relation", "key", "columns", "others"))).alias("visible"))
        given = here.join(visible, "uid", "left").withColumn("parents_known", F.col("visible").isNotNull())
        judged = stored(verdicts(resolve_models(given, (*kept, "parents_known"))))
        computed = judged.filter(F.size("projection") > 0).select("uid", F.lit("computed").alias("source"), F.col("projection").alias("columns"), (~F.col("retracted")).alias("kept"))
        known = known.unionByName(computed)
        parts = judged if parts is None else parts.unionByName(judged)
    if parts is None:
        facts = nodes.sparkSession.createDataFrame([], FACTS).withColumn("parents_known", F.lit(False))
        parts = verdicts(facts.join(base.select("uid", *kept), "uid"))
    out = publish(nodes, known, parts, read, options, elsewhere)
    if observe is not None:
        for row in out.rows():
            observe(row)
    return out


def _mapped(frame: DataFrame, names: DataFrame, relation: str, into: str) -> DataFrame:
    """Adds the node that `relation` means to the row's model; reads of the model itself go."""
    joined = frame.join(names.select("uid", F.col("relation").alias(relation), F.col("node").alias(into)), ["uid", relation])
    return joined.filter((F.col(into) != F.col("uid")) & ~F.col(relation).eqNullSafe(F.col("own_key")))


def publish(nodes: DataFrame, lists: DataFrame, wide: DataFrame, read: DataFrame, options: Options, elsewhere: DataFrame | None = None) -> Lineage:
    """Edges, roots, rules, expressions and give-ups of all models."""
    own = wide.select("uid", "plan", "own_key", "model_ord", "shared_columns", "agreement")
    keys = nodes.filter("relation is not null").select(F.col("uid").alias("parent"), graph.relation_key("relation").alias("key"))
    asked = wide.select("uid", F.explode(F.array_distinct(F.concat(F.transform("edges", lambda e: e["from_relation"]), F.transform("indirect", lambda i: i["relation"]), F.flatten(F.transform("unbacked", lambda u: u["owners"])), F.flatten(F.transform("rules", lambda r: F.transform(r["columns"], lambda c: c["relation"])))))).alias("relation"))
    names = stored(graph.claimants(asked, read.select("uid", "parent"), keys, graph.owners(nodes)))

    each = wide.select("uid", "plan", "own_key", "model_ord", "shared_columns", F.posexplode("edges").alias("edge_ord", "e")).select("*", "e.*").drop("e")
    parsed_all = stored(_mapped(each, names, "from_relation", "from"))
    best = graph.best_lists(lists.filter("kept"))
    in_shared = F.array_contains("shared_columns", F.col("to_column"))
    parsed = parsed_all.filter((F.col("plan") == "parsed") | ((F.col("plan") == "per_column") & in_shared))
    parsed = parsed.select("from", F.col("from_column").alias("from_col"), F.col("uid").alias("to"), F.col("to_column").alias("to_col"), "kind", "model_ord", F.col("edge_ord").cast("long").alias("edge_ord"))
    direct, guessed = parsed, None
    if options.infer:
        wanted = wide.filter("plan <> 'parsed'").select("uid", "plan", "shared_columns", F.when(F.size("warehouse") > 0, F.col("warehouse")).when(F.size("declared") > 0, F.col("declared")).otherwise(F.col("outputs")).alias("listed"))
        missing = F.when(F.col("plan") == "per_column", F.array_except("listed", "shared_columns")).otherwise(F.col("listed"))
        outputs = wanted.select(F.col("uid").alias("to"), F.explode(F.array_distinct(missing)).alias("col"))
        offered = read.join(best.withColumnRenamed("uid", "parent"), "parent").select(F.col("uid").alias("to"), "parent", F.col("path").alias("ord"), F.explode("columns").alias("col"), F.col("source").alias("list"))
        same = parsed_all.filter("from_column = to_column").select(F.col("uid").alias("to"), F.col("from").alias("parent"), F.col("to_column").alias("col"))
        guessed = stored(graph.infer_edges(outputs, offered, same))
        inferred = guessed.join(own.select(F.col("uid").alias("to"), "model_ord"), "to").select("from", "from_col", "to", "to_col", F.lit("inferred").alias("kind"), "model_ord", (F.lit(1 << 32) + F.col("ord")).cast("long").alias("edge_ord"))
        unbacked = wide.filter("plan = 'parsed'").select("uid", "own_key", "model_ord", F.explode("unbacked").alias("u")).filter(F.size("u.owners") == 1)
        unbacked = _mapped(unbacked.select("uid", "own_key", "model_ord", F.element_at("u.owners", 1).alias("from_relation"), "u.column", "u.output"), names, "from_relation", "from")
        backed = unbacked.select("from", F.col("column").alias("from_col"), F.col("uid").alias("to"), F.col("output").alias("to_col"), F.lit("inferred").alias("kind"), "model_ord", F.lit(1 << 33).cast("long").alias("edge_ord")).distinct()
        backed = backed.join(parsed.select("from", "from_col", "to", "to_col"), ["from", "from_col", "to", "to_col"], "left_anti")
        direct = parsed.unionByName(inferred).unionByName(backed.select(*parsed.columns))
    direct = stored(direct)
    sound = wide.filter("plan <> 'inferred'")
    reads = _mapped(sound.select("uid", "own_key", F.explode("indirect").alias("i")).select("uid", "own_key", F.col("i.relation").alias("relation"), F.col("i.column").alias("from_col"), F.col("i.role").alias("role")), names, "relation", "from")
    edges = direct
    if options.indirect:
        listed = wide.filter("plan = 'parsed'").select(F.col("uid").alias("to"), F.explode("outputs").alias("to_col"))
        listed = listed.unionByName(wide.filter("plan = 'per_column'").select(F.col("uid").alias("to"), F.explode("shared_columns").alias("to_col")))
        fanned = graph.fan_out(reads.withColumnRenamed("uid", "to"), listed, direct)
        fanned = fanned.join(own.select(F.col("uid").alias("to"), "model_ord"), "to").withColumn("edge_ord", F.lit(1 << 40).cast("long"))
        edges = direct.unionByName(fanned.select(*direct.columns))
    with_edges = direct.select(F.col("to").alias("uid"), F.col("to_col").alias("column")).distinct()
    allowed = (F.col("plan") == "parsed") | ((F.col("plan") == "per_column") & F.array_contains("shared_columns", F.col("column")))
    roots = wide.select("uid", "plan", "shared_columns", "model_ord", F.explode("roots").alias("r")).select("*", "r.*").filter(allowed)
    roots = roots.join(with_edges, ["uid", "column"], "left_anti").select("uid", "column", "expressions", "complete", "model_ord")
    partial_ = wide.select("uid", "plan", "shared_columns", "model_ord", F.explode("partial").alias("p")).select("uid", "plan", "shared_columns", "model_ord", F.col("p.output").alias("column"), "p.name", "p.reason")
    partial_ = partial_.filter(allowed).join(with_edges, ["uid", "column"], "left_semi").select("uid", "column", "name", "reason", "model_ord")
    told = parsed_all.filter((F.col("plan") == "parsed") | ((F.col("plan") == "per_column") & in_shared))
    rank = F.array_position(F.array(*[F.lit(r) for r in ("passthrough", "rename", "cast", "transform", "hash", "aggregate", "window")]), F.col("kind"))
    best_text = graph.loudest(told.withColumn("rank", rank), ["uid", "to_column"], "rank", "expression", "steps")
    kind = F.element_at(F.array(*[F.lit(r) for r in ("passthrough", "rename", "cast", "transform", "hash", "aggregate", "window")]), F.col("rank").cast("int"))
    expressions = best_text.withColumn("kind", kind).filter("kind in ('cast', 'transform', 'aggregate', 'window')").join(own.select("uid", "model_ord"), "uid")
    expressions = expressions.select("uid", F.col("to_column").alias("column"), "kind", F.substring("expression", 1, TEXT_CUT).alias("text"), F.col("steps"), (F.char_length("expression") > TEXT_CUT).alias("cut"), "model_ord")
    rules = _rules(sound, names)
    spark = nodes.sparkSession
    if guessed is None:
        guesses = spark.createDataFrame([], "uid string, column string, settled string, candidates long, chosen array<string>")
    else:
        guesses = guessed.groupBy(F.col("to").alias("uid"), F.col("to_col").alias("column"), "settled", "candidates").agg(F.sort_array(F.collect_set("from")).alias("chosen"))
    other = elsewhere if elsewhere is not None else spark.createDataFrame([], ELSEWHERE)
    return Lineage(nodes, lists, wide, edges, roots, rules, expressions, partial_, guesses, other)


def _rules(sound: DataFrame, names: DataFrame) -> DataFrame:
    """(uid, rule_ord, clause, text, cut, columns): each rule once, with the nodes of its columns, without the model's own."""
    flat = sound.select("uid", "own_key", "model_ord", F.posexplode("rules").alias("rule_ord", "r"))
    cells = flat.select("uid", "own_key", "model_ord", "rule_ord", "r.clause", "r.text", F.posexplode("r.columns").alias("place", "c"))
    cells = _mapped(cells.select("uid", "own_key", "model_ord", "rule_ord", "clause", "text", "place", "c.relation", "c.column"), names, "relation", "node")
    rules = cells.groupBy("uid", "model_ord", "rule_ord", "clause", "text").agg(F.sort_array(F.collect_list(F.struct("place", "node", "column"))).alias("cells"))
    rules = rules.withColumn("columns", F.array_distinct(F.transform("cells", lambda c: F.struct(c["node"].alias("node"), c["column"].alias("column")))))
    once = rules.groupBy("uid", "model_ord", "clause", "text", "columns").agg(F.min("rule_ord").alias("rule_ord"))
    return once.select("uid", "rule_ord", "clause", F.substring("text", 1, TEXT_CUT).alias("text"), (F.char_length("text") > TEXT_CUT).alias("cut"), "columns", "model_ord")


def run_project(spark: SparkSession, project, options: Options | None = None, observe: Callable[[dict], None] | None = None) -> Lineage:
    from tracewell.sources.project import tables

    return run(*tables(spark, project), options, observe, spark.createDataFrame(project.elsewhere, ELSEWHERE))
