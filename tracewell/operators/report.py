"""What a pass found and what it missed: totals, coverage, reads that decide rows, gaps and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.graph import best_lists, collisions, relation_key
from tracewell.plans.lineage import Lineage

LOSSES = ("name_unresolved", "relation_unknown", "window_key_unbound")
SHOWN = 10

#: (category, owner, severity, title, why, action): who can act and what it means, in our own words.
CATEGORIES = (
    ("catalog_of_another_target", "inputs", "error", "catalog entries of another target", "The catalog lists columns of another relation than the manifest names, so the entry says nothing of this node.", "Make the catalog and the manifest in one run, with one target."),
    ("compiled_file_from_another_graph", "inputs", "warning", "compiled files of another graph", "A compiled file reads relations that its model doesn't depend on.", "Compile the project again with the manifest's target."),
    ("source_without_columns", "inputs", "warning", "sources without columns", "No catalog and no documentation lists the columns of a source that is read.", "Document the source or hand in a catalog."),
    ("compile_does_not_parse", "project", "error", "statements that don't parse", "The compiled text is no statement this reader knows.", "Look at the position told with the model."),
    ("reads_a_name_its_cte_lacks", "project", "warning", "names that a CTE doesn't project", "A query reads a column of a CTE or derived table that doesn't give it.", "Add the column to the CTE, or correct the name."),
    ("relation_not_declared", "project", "warning", "relations no dependency declares", "A model reads a relation that is none of its dependencies.", "Use a reference instead of a literal name."),
    ("parent_without_columns", "project", "warning", "parents without columns", "Nothing is known of the columns of a parent.", "Build the parent, document it or hand in a catalog."),
    ("table_older_than_code", "project", "warning", "tables that lack columns of the code", "The compile gives columns that the warehouse doesn't have.", "Run the model."),
    ("code_ahead_of_table", "project", "warning", "tables with columns the code lacks", "The warehouse has columns that the compile doesn't give.", "Run the model with a full refresh, or compile again."),
    ("thin_compile", "project", "info", "compiles far short of their documentation", "Fewer than half of the documented columns are in the compile.", "Check the target that the compile was made for."),
    ("reads_only_itself", "project", "info", "models that read only themselves", "Every relation the model reads is its own.", "Nothing is lost; check that this is meant."),
    ("yaml_out_of_date", "project", "info", "documentation out of date", "Documented columns and the warehouse's differ.", "Bring the documentation up to date."),
    ("lineage_lost", "tracewell", "warning", "columns whose lineage was lost", "A column has no edge and is no root.", "Report the statement."),
    ("lineage_partial", "tracewell", "warning", "columns whose lineage is partial", "Something that feeds a column could not be followed.", "Report the statement."),
)


def coverage(pass_: Lineage) -> DataFrame:
    """(uid, listed, covered, independent_listed, independent_covered, roots, self_only) of each model.

    Once against the list that stands for the model, once against lists that its own compile didn't make
    (the warehouse, or documentation), leaving out roots and, of models that read only themselves, the
    columns without an edge (`self_only`): these come from the model's own earlier rows.
    """
    own = pass_.models.select("uid", "model_ord", reads_only_itself().alias("only_itself"), F.when(F.size("warehouse") > 0, F.col("warehouse")).when(F.size("declared") > 0, F.col("declared")).otherwise(F.expr("cast(array() as array<string>)")).alias("independent"), "outputs")
    fed = pass_.edges.filter("kind not in ('join_key', 'dedup_key', 'filter')").groupBy(F.col("to").alias("uid")).agg(F.collect_set("to_col").alias("fed"))
    ends = pass_.roots.groupBy("uid").agg(F.collect_set("column").alias("root_columns"))
    none = F.expr("cast(array() as array<string>)")
    rows = own.join(fed, "uid", "left").join(ends, "uid", "left").withColumns({"fed": F.coalesce("fed", none), "root_columns": F.coalesce("root_columns", none)})
    listed = F.when(F.size("independent") > 0, F.col("independent")).otherwise(F.col("outputs"))
    rows = rows.withColumn("listed_columns", listed).withColumn("told", F.array_except("independent", "root_columns"))
    rows = rows.withColumn("alone", F.when(F.col("only_itself"), F.array_except("told", "fed")).otherwise(none)).withColumn("told", F.array_except("told", "alone"))
    both = F.array_union("fed", "root_columns")
    return rows.select(
        "uid",
        "model_ord",
        F.size("listed_columns").alias("listed"),
        F.size(F.array_intersect("listed_columns", both)).alias("covered"),
        F.size("told").alias("independent_listed"),
        F.size(F.array_intersect("told", "fed")).alias("independent_covered"),
        F.size(F.when(F.size("independent") > 0, F.array_intersect("independent", "root_columns")).otherwise(F.col("root_columns"))).alias("roots"),
        F.size("alone").alias("self_only"),
    )


def row_deciding_reads(pass_: Lineage) -> DataFrame:
    """(uid, relation, column, role, projected): what decides rows in trusted compiles, and whether it is also a value; own relations are left out."""
    reads = pass_.models.filter("plan <> 'inferred'").select("uid", "own_key", "model_ord", F.explode("indirect").alias("i")).select("uid", "own_key", "model_ord", "i.*")
    reads = reads.filter(~F.col("relation").eqNullSafe(F.col("own_key")))
    values = pass_.models.select("uid", F.explode("edges").alias("e")).select("uid", F.col("e.from_relation").alias("relation"), F.col("e.from_column").alias("column"), F.lit(True).alias("projected")).distinct()
    return reads.join(values, ["uid", "relation", "column"], "left").select("uid", "model_ord", "relation", "column", "role", F.coalesce("projected", F.lit(False)).alias("projected"))


def lost_columns(pass_: Lineage) -> DataFrame:
    """(uid, column, ends, lists) of columns without an edge that are no roots, in compiles that count and read more than themselves.

    `lists` says for each relation that an end reads where the list came from that lacks the column.
    """
    rows = pass_.models.filter("plan <> 'inferred'").filter(~reads_only_itself()).select("uid", "model_ord", "plan", "shared_columns", F.explode("lost").alias("l")).select("uid", "model_ord", "plan", "shared_columns", "l.*")
    rows = rows.filter((F.col("plan") == "parsed") | F.array_contains("shared_columns", F.col("column")))
    bridged = pass_.edges.select(F.col("to").alias("uid"), F.col("to_col").alias("column")).distinct()
    rows = rows.join(bridged, ["uid", "column"], "left_anti").select("uid", "model_ord", "column", "ends")
    read = rows.select("uid", "column", F.explode(F.array_distinct(F.flatten(F.transform("ends", lambda e: e["reads"])))).alias("key"))
    named = pass_.nodes.filter("relation is not null").select(F.col("uid").alias("node"), relation_key("relation").alias("key"))
    said = read.join(named, "key").join(best_lists(pass_.lists.filter("kept")).select(F.col("uid").alias("node"), "source"), "node", "left")
    said = said.groupBy("uid", "column").agg(F.sort_array(F.collect_set(F.struct(F.col("key").alias("relation"), F.coalesce("source", F.lit("none")).alias("list")))).alias("lists"))
    return rows.join(said, ["uid", "column"], "left")


def partial_columns(pass_: Lineage) -> DataFrame:
    """(uid, column, gaps, is_loss): give-ups of each column that has an edge."""
    lost = F.col("reason").isin(*LOSSES)
    return pass_.partial.groupBy("uid", "model_ord", "column").agg(F.sort_array(F.collect_set(F.struct("reason", "name"))).alias("gaps"), F.max(lost).alias("is_loss"))


def unbacked_reads(pass_: Lineage) -> DataFrame:
    """(uid, cte, column, owners), each once."""
    rows = pass_.models.select("uid", "model_ord", F.explode("unbacked").alias("u")).select("uid", "model_ord", "u.cte", "u.column", "u.owners")
    return rows.dropDuplicates(["uid", "cte", "column"])


def read_downstream_but_absent(pass_: Lineage) -> DataFrame:
    """(uid, column, read_by): columns that children read of a model whose list lacks them."""
    keys = pass_.models.select(F.col("uid").alias("parent"), F.col("own_key").alias("relation"))
    asked = pass_.models.select("uid", F.explode("unknown_columns").alias("c")).select("uid", "c.relation", "c.column")
    return asked.join(keys, "relation").groupBy(F.col("parent").alias("uid"), "column").agg(F.sort_array(F.collect_set("uid")).alias("read_by"))


def reads_only_itself() -> Column:
    return (F.size("reads") > 0) & (F.size(F.array_except("reads", F.array("own_key"))) == 0)


def totals(pass_: Lineage) -> DataFrame:
    """One row of counters over all models and edges."""
    n = lambda condition: F.coalesce(F.sum(condition.cast("long")), F.lit(0))
    size = lambda c: F.coalesce(F.sum(F.size(c)).cast("long"), F.lit(0))
    models = pass_.models.agg(
        F.count(F.lit(1)).alias("models"),
        n(F.col("parse_error").isNull()).alias("parsed"),
        n(F.col("parse_error").isNotNull()).alias("parse_failed"),
        n(F.col("sql_source") == "missing").alias("without_compiled_code"),
        n(F.col("sql_source") == "file").alias("sql_from_files"),
        n(F.col("foreign")).alias("sql_from_files_set_aside"),
        *[n(F.col("agreement") == a).alias(a) for a in ("confirmed", "degraded", "unchecked")],
        n(F.col("plan") == "per_column").alias("per_column"),
        F.coalesce(F.sum(F.when(F.col("plan") == "per_column", F.size(F.array_except("outputs", "shared_columns")))).cast("long"), F.lit(0)).alias("columns_withheld"),
        n(F.col("yaml_stale")).alias("yaml_stale"),
        n(F.col("is_thin")).alias("thin"),
        n(reads_only_itself()).alias("self_reads"),
        n(F.size("undeclared") > 0).alias("undeclared"),
        size("merged_scopes").alias("scope_merged"),
        size("unbacked").alias("unbacked_reads"),
        size("bridged").alias("read_through_star"),
        F.coalesce(F.sum("unplaced_qualify"), F.lit(0)).alias("qualify_unplaced"),
        F.coalesce(F.sum("unplaced_join"), F.lit(0)).alias("join_unplaced"),
        F.coalesce(F.sum("unplaced_filter"), F.lit(0)).alias("filter_unplaced"),
    )
    indirect = F.col("kind").isin("join_key", "dedup_key", "filter")
    edges = pass_.edges.agg(n(~indirect & (F.col("kind") != "inferred")).alias("edges_parsed"), n(F.col("kind") == "inferred").alias("edges_inferred"), n(indirect).alias("edges_indirect"))
    covered = coverage(pass_).agg(
        *[F.coalesce(F.sum(a).cast("long"), F.lit(0)).alias(b) for a, b in (("covered", "columns_covered"), ("listed", "columns_total"), ("independent_covered", "columns_covered_independent"), ("independent_listed", "columns_total_independent"), ("roots", "columns_root"), ("self_only", "columns_self"))]
    )
    ways = pass_.guesses.filter("candidates > 1").agg(*[n(F.col("settled") == way).alias(f"ambiguous_by_{way}") for way in ("compile", "every", "order")])
    blind = pass_.models.select("uid", F.explode("lost").alias("l")).select("uid", F.explode("l.ends").alias("e")).filter("e.reason = 'phantom' and e.star").filter(F.size("e.reads") == 1)
    unwitnessed = blind.select("uid", "e.reads", "e.column").distinct()
    deciding = row_deciding_reads(pass_).agg(F.count(F.lit(1)).alias("row_deciding_reads"), n(~F.col("projected")).alias("read_not_projected"))
    counts = [("rules", pass_.rules), ("expressions", pass_.expressions), ("columns_lost", lost_columns(pass_)), ("columns_partial", partial_columns(pass_)), ("read_downstream_but_absent", read_downstream_but_absent(pass_)), ("read_through_star_unwitnessed", unwitnessed), ("catalog_elsewhere", pass_.elsewhere), ("collisions", collisions(pass_.nodes))]
    out = models.crossJoin(edges).crossJoin(covered).crossJoin(deciding).crossJoin(ways)  # each is one row
    for name, frame in counts:
        out = out.crossJoin(frame.agg(F.count(F.lit(1)).alias(name)))
    return out


def _clean_row() -> Column:
    """Whether nothing needs to be said of a model's own row."""
    return (
        (F.col("plan") == "parsed")
        & F.col("parse_error").isNull()
        & (F.size("undeclared") == 0)
        & (F.size("missing") == 0)
        & (F.size("unexpected") == 0)
        & ~F.col("is_thin")
        & ~F.col("yaml_stale")
        & ~F.col("gap")
        & (F.size("unbacked") == 0)
        & ~reads_only_itself()
    )


def model_reports(pass_: Lineage) -> DataFrame:
    """A row for each model with all that the report says of it, and `clean`: whether that is nothing.

    Columns beside the model's own: lost, partial, unbacked, row_deciding, ambiguous,
    absent_reads (columns that children read and it lacks), unknown_parents, sql_set_aside.
    """

    def listed(frame: DataFrame, name: str, *columns: str) -> DataFrame:
        return frame.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    parts = [
        listed(lost_columns(pass_), "lost_columns", "column", "ends", "lists"),
        listed(partial_columns(pass_), "partial_columns", "column", "gaps", "is_loss"),
        listed(unbacked_reads(pass_), "unbacked_reads", "cte", "column", "owners"),
        listed(row_deciding_reads(pass_), "row_deciding", "relation", "column", "role", "projected"),
        listed(pass_.guesses.filter("candidates > 1"), "ambiguous", "column", "candidates", "chosen", F.col("settled").alias("by")),
        listed(read_downstream_but_absent(pass_), "absent_reads", "column", "read_by"),
        listed(parents_without_columns(pass_), "unknown_parents", "parent", "kind"),
    ]
    rows = pass_.models.withColumn("sql_set_aside", F.col("foreign")).withColumn("only_itself", reads_only_itself()).drop("ambiguous")
    for part in parts:
        rows = rows.join(part, "uid", "left")
    loss = F.coalesce(F.exists("partial_columns", lambda p: p["is_loss"]), F.lit(False))
    clean = _clean_row() & F.col("lost_columns").isNull() & ~loss & F.col("absent_reads").isNull() & F.col("unknown_parents").isNull()
    return rows.withColumn("clean", clean)


def parents_without_columns(pass_: Lineage) -> DataFrame:
    """(uid, parent, kind): what a model reads and no list is known of."""
    read = pass_.models.select("uid", F.explode("reads_of").alias("parent"))
    listed = pass_.lists.filter("kept").filter(F.size("columns") > 0).select(F.col("uid").alias("parent")).distinct()
    kinds = pass_.nodes.select(F.col("uid").alias("parent"), "kind")
    return read.join(listed, "parent", "left_anti").join(kinds, "parent")


def findings(pass_: Lineage) -> DataFrame:
    """(category, owner, severity, title, why, action, columns, models) with the models of each cause, at most told in a line each."""
    m, none = pass_.models, F.lit(0)
    shown = lambda c: F.array_join(F.slice(c, 1, SHOWN), ", ")
    bare = parents_without_columns(pass_)
    lost, gaps = lost_columns(pass_), partial_columns(pass_).filter("is_loss")
    row = lambda frame, category, detail, columns: frame.select(F.lit(category).alias("category"), "uid", detail.cast("string").alias("detail"), columns.cast("long").alias("columns"))
    parts = [
        row(m.filter("foreign"), "compiled_file_from_another_graph", shown("undeclared"), none),
        row(bare.filter("kind = 'source'"), "source_without_columns", F.col("parent"), none),
        row(m.filter("parse_error is not null"), "compile_does_not_parse", F.col("parse_error"), none),
        row(unbacked_reads(pass_), "reads_a_name_its_cte_lacks", F.concat("cte", F.lit("."), "column"), F.lit(1)),
        row(m.filter(F.size("undeclared") > 0).filter("not foreign"), "relation_not_declared", shown("undeclared"), none),
        row(bare.filter("kind <> 'source'"), "parent_without_columns", F.col("parent"), none),
        row(m.filter(F.size("unexpected") > 0).filter("not unsound"), "table_older_than_code", shown("unexpected"), F.size("unexpected")),
        row(m.filter(F.size("missing") > 0).filter("not unsound"), "code_ahead_of_table", shown("missing"), F.size("missing")),
        row(m.filter("is_thin"), "thin_compile", F.col("shared"), none),
        row(m.filter(reads_only_itself()), "reads_only_itself", F.lit(""), F.size("outputs")),
        row(m.filter("yaml_stale"), "yaml_out_of_date", F.lit(""), none),
        row(lost, "lineage_lost", F.col("column"), F.lit(1)),
        row(gaps, "lineage_partial", F.col("column"), F.lit(1)),
    ]
    told = F.concat(F.lit("manifest: "), "relation", F.lit(", catalog: "), "catalog_relation")
    parts.append(row(pass_.elsewhere, "catalog_of_another_target", told, none))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    each = rows.groupBy("category", "uid").agg(F.array_join(F.slice(F.sort_array(F.collect_set("detail")), 1, SHOWN), ", ").alias("detail"), F.sum("columns").alias("columns"))
    each = each.join(pass_.nodes.select("uid", "name"), "uid")
    grouped = each.groupBy("category").agg(F.sum("columns").alias("columns"), F.sort_array(F.collect_list(F.struct("name", "uid", "detail"))).alias("models"))
    known = pass_.models.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(CATEGORIES)], "place int, category string, owner string, severity string, title string, why string, action string")
    order = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    joined = grouped.join(F.broadcast(known), "category")  # a fixed few rows
    placed = joined.withColumn("rank", F.struct(order("owner", ("inputs", "project", "tracewell")), order("severity", ("error", "warning", "info")), "place"))
    return placed.select("rank", "category", "owner", "severity", F.concat(F.size("models").cast("string"), F.lit(" models: "), "title").alias("title"), "why", "action", "columns", "models")
