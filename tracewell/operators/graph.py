"""Operators on a project's graph and column lists, as DataFrame algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.stored import discard, stored

SOURCES = ("warehouse", "seed_file", "computed", "declared")  # from the most trusted list to the least
THIN_FLOOR = 8
CUT = 6  # rounds of a loop after which its tables are stored, which bounds their plans


def relation_key(column: str) -> Column:
    """A relation's name for comparison: parts without spaces and quotes around them, in upper case."""
    parts = F.transform(F.split(F.col(column), r"\."), lambda p: F.upper(F.regexp_replace(F.trim(p), r'^["`]+|["`]+$', "")))
    return F.array_join(parts, ".")


def collisions(nodes: DataFrame) -> DataFrame:
    """(key, owner, uids): relations that several nodes claim; the lowest uid owns one."""
    keyed = nodes.filter("relation is not null").withColumn("key", relation_key("relation"))
    return keyed.groupBy("key").agg(F.min("uid").alias("owner"), F.sort_array(F.collect_set("uid")).alias("uids")).filter(F.size("uids") > 1)


def owners(nodes: DataFrame) -> DataFrame:
    """(key, owner): the node that a relation means to a model that doesn't depend on a claimant."""
    return nodes.filter("relation is not null").groupBy(relation_key("relation").alias("key")).agg(F.min("uid").alias("owner"))


def parent_edges(nodes: DataFrame) -> DataFrame:
    """(uid, parent, ord) of all nodes."""
    return nodes.select("uid", F.posexplode("parents").alias("ord", "parent"))


def topo_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uid, level): the longest way to a node from one without parents; `edges` is (uid, parent).

    Nodes leave in rounds, each once, when the last of their parents has left: a round joins the edges
    of those that left last, and takes what it met off the counts of open parents, so all rounds
    together touch each edge once. Nodes in circles or behind them never leave; they come out with the
    level of the round after the last.
    """
    known = nodes.select("uid").distinct()
    inner = edges.select("uid", "parent").distinct().join(known.select(F.col("uid").alias("parent")), "parent", "left_semi").join(known, "uid", "left_semi")
    inner = stored(inner)
    waits = inner.groupBy("uid").agg(F.count(F.lit(1)).alias("waits"))
    open_ = stored(known.join(waits, "uid", "left").select("uid", F.coalesce("waits", F.lit(0)).alias("waits")))
    out, level = None, 0
    while True:
        left = stored(open_.filter("waits = 0").select("uid", F.lit(level).alias("level")))
        if left.isEmpty():
            rest = open_.select("uid", F.lit(level).alias("level"))
            return rest if out is None else out.unionByName(rest)
        out = left if out is None else out.unionByName(left)
        met = inner.join(left.select(F.col("uid").alias("parent")), "parent").groupBy("uid").agg(F.count(F.lit(1)).alias("met"))
        before, open_ = open_, stored(open_.filter("waits > 0").join(met, "uid", "left").select("uid", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits")))
        discard(before)
        level += 1
        if level % CUT == 0:
            out = stored(out)


def read_through(edges: DataFrame, through: DataFrame) -> DataFrame:
    """(uid, parent, path): parents with each node of `through` (uid) replaced by its own parents, in place.

    `path` orders a node's parents as their places in the project's order would. Loops until no node of
    `through` is left; a way that comes back to a node it has passed is dropped, so circles end.
    """
    marked = through.select(F.col("uid").alias("parent"), F.lit(True).alias("skipped")).distinct()
    inner = edges.select(F.col("uid").alias("parent"), F.col("parent").alias("then"), F.col("ord").alias("then_ord"))
    open_, done, step = edges.select("uid", "parent", F.array("ord").alias("path"), F.array("uid").alias("passed")), None, 0
    while True:
        step += 1
        split = stored(open_.join(marked, "parent", "left"))
        direct = split.filter("skipped is null").select("uid", "parent", "path")
        done = direct if done is None else done.unionByName(direct)
        rest = split.filter("skipped").filter(~F.array_contains("passed", F.col("parent")))
        if rest.isEmpty():
            return done.groupBy("uid", "parent").agg(F.min("path").alias("path"))
        open_ = rest.join(inner, "parent").select("uid", F.col("then").alias("parent"), F.concat("path", F.array("then_ord")).alias("path"), F.concat("passed", F.array("parent")).alias("passed"))
        if step % CUT == 0:
            done = stored(done.groupBy("uid", "parent").agg(F.min("path").alias("path")))


def best_lists(lists: DataFrame) -> DataFrame:
    """(uid, source, columns): of each node's lists the most trusted one that isn't empty."""
    return visible_lists(lists.withColumn("kept", F.lit(True))).drop("others")


def visible_lists(lists: DataFrame) -> DataFrame:
    """(uid, source, columns, others): of each node's lists that are `kept` the most trusted one that isn't empty, and all of them."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    usable = F.when(F.col("kept") & (F.size("columns") > 0), rank)
    one = F.struct("source", "columns")
    found = lists.groupBy("uid").agg(F.min_by(one, usable).alias("b"), F.max(usable).alias("any"), F.collect_list(one).alias("others"))
    return found.filter("any is not null").select("uid", "b.source", "b.columns", "others")


def same_set(a: str, b: str) -> Column:
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))


def agreement(frame: DataFrame) -> DataFrame:
    """Adds `agreement` to rows of (warehouse, declared, computed), arrays or null: confirmed, degraded or unchecked."""
    empty = F.expr("cast(array() as array<string>)")
    filled = frame.withColumns({c: F.coalesce(F.col(c), empty) for c in ("warehouse", "declared", "computed")})
    by_warehouse = F.when(same_set("warehouse", "computed"), "confirmed").otherwise("degraded")
    apart = (F.size("declared") > 0) & (F.size("computed") > 0) & ~F.arrays_overlap("declared", "computed")
    return filled.withColumn("agreement", F.when(F.size("warehouse") > 0, by_warehouse).when(apart, "degraded").otherwise("unchecked"))


def thin(frame: DataFrame) -> DataFrame:
    """Adds `shared` and `is_thin`: without a warehouse list, fewer than half of at least eight declared columns are computed."""
    shared = F.size(F.array_intersect("declared", "computed"))
    floor = (F.size("warehouse") == 0) & (F.size("declared") >= THIN_FLOOR) & (shared * 2 < F.size("declared"))
    return frame.withColumns({"shared": shared, "is_thin": floor})


def yaml_is_stale(frame: DataFrame) -> DataFrame:
    """Adds `yaml_stale`: both lists are there and differ as sets."""
    return frame.withColumn("yaml_stale", (F.size("declared") > 0) & (F.size("warehouse") > 0) & ~same_set("declared", "warehouse"))


def missing_unexpected(frame: DataFrame) -> DataFrame:
    """Adds `missing` (in the warehouse, not computed) and `unexpected` (computed, not in the warehouse), sorted."""
    some = F.size("warehouse") > 0
    none = F.expr("cast(array() as array<string>)")
    return frame.withColumns(
        {
            "missing": F.when(some, F.sort_array(F.array_except("warehouse", "computed"))).otherwise(none),
            "unexpected": F.when(some, F.sort_array(F.array_except("computed", "warehouse"))).otherwise(none),
        }
    )


def plan_of(unsound: Column, agreement_: Column, shared: Column, unbacked: Column) -> Column:
    """parsed, per_column or inferred: what a model's compile is worth."""
    per_column = (agreement_ == "degraded") & (shared > 0) & ~unbacked
    return F.when(unsound, "inferred").when(per_column, "per_column").when(agreement_ == "degraded", "inferred").otherwise("parsed")


def loudest(rows: DataFrame, keys: list[str], rank: str, text: str, steps: str) -> DataFrame:
    """One row for each key: the highest rank, on a tie the greater text by bytes, and the most steps."""
    best = F.struct(rank, text)
    return rows.groupBy(*keys).agg(F.max(best).alias("b"), F.max(steps).alias(steps)).select(*keys, f"b.{rank}", f"b.{text}", steps)


def fan_out(indirect: DataFrame, outputs: DataFrame, direct: DataFrame) -> DataFrame:
    """Row-deciding reads as edges onto every output of their node, one for each pair, by the strongest role.

    `indirect` (to, from, from_col, role), `outputs` (to, to_col), `direct` (to, from, from_col, to_col).
    A join on the node gives reads x outputs of one node, which is the operator's result.
    """
    strength = F.array_position(F.array(F.lit("filter"), F.lit("join_key"), F.lit("dedup_key")), F.col("role"))
    strongest = indirect.filter("`from` <> `to`").groupBy("to", "from", "from_col").agg(F.max_by("role", strength).alias("kind"))
    return strongest.join(outputs, "to").join(direct, ["to", "from", "from_col", "to_col"], "left_anti").select("from", "from_col", "to", "to_col", "kind")


def infer_edges(outputs: DataFrame, candidates: DataFrame, compiled: DataFrame) -> DataFrame:
    """Edges by name: (from, from_col, to, to_col, settled, candidates).

    `outputs` (to, col), `candidates` (to, parent, col, ord, list): the parents' visible columns in the
    order of parents, with the kind of list, `compiled` (to, parent, col): same-name edges of the
    set-aside compile. One candidate is taken; of several, those that the compile reads; else, if the
    model has a compile but none is read there, all (without those known from documentation only, if
    others are known better); else the first parent.
    """
    own = Window.partitionBy("to", "col")
    marked = outputs.join(candidates, ["to", "col"]).join(compiled.select("to", "parent", "col", F.lit(1).alias("read")).distinct(), ["to", "parent", "col"], "left")
    has = compiled.select("to").distinct().withColumn("compile", F.lit(1))
    marked = marked.join(has, "to", "left").withColumns(
        {
            "n": F.count(F.lit(1)).over(own),
            "reads": F.sum(F.coalesce("read", F.lit(0))).over(own),
            "better": F.max((F.col("list") != "declared").cast("int")).over(own),
            "first": F.min("ord").over(own),
        }
    )
    settled = F.when(F.col("n") == 1, "one").when(F.col("reads") > 0, "compile").when(F.col("compile").isNotNull(), "every").otherwise("order")
    keep = (
        F.when(F.col("settled") == "one", True)
        .when(F.col("settled") == "compile", F.col("read").isNotNull())
        .when(F.col("settled") == "every", (F.col("better") == 0) | (F.col("list") != "declared"))
        .otherwise(F.col("ord") == F.col("first"))
    )
    return marked.withColumn("settled", settled).filter(keep).select(F.col("parent").alias("from"), F.col("col").alias("from_col"), "to", F.col("col").alias("to_col"), "settled", F.col("n").alias("candidates"), "ord")


def claimants(reads: DataFrame, parents: DataFrame, keys: DataFrame, owned: DataFrame) -> DataFrame:
    """(uid, relation, node): what a relation means to a model.

    `reads` (uid, relation key), `parents` (uid, parent), `keys` (parent, key): the node it depends on
    that claims it; if two do or none, the relation's owner; else `rel:` and the name in lower case.
    """
    own = parents.join(keys, "parent").select("uid", F.col("key").alias("relation"), "parent").distinct()
    one = own.groupBy("uid", "relation").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("claimant")).filter("n = 1")
    found = reads.select("uid", "relation").distinct().join(one.drop("n"), ["uid", "relation"], "left")
    found = found.join(owned.select(F.col("key").alias("relation"), "owner"), "relation", "left")
    return found.select("uid", "relation", F.coalesce("claimant", "owner", F.concat(F.lit("rel:"), F.lower("relation"))).alias("node"))
