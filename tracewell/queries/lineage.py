"""Queries of the lineage engine: its passes over bundled projects, and its graph operators on test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import roles
from tracewell.operators import graph
from tracewell.plans.lineage import Options, run_project
from tracewell.queries.relational import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return wrap


def values(columns: str, text: str) -> str:
    """Rows written by hand, one a line, as SQL."""
    rows = [[c.strip() for c in line.split(" | ")] for line in text.strip('\n').splitlines()]
    shown = ",\n".join("(" + ", ".join("'" + c.replace("'", "''") + "'" for c in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {shown}) AS t({columns})"


# What feeds what in the bundled harbour, written by hand from its SQL.
EDGES = """
berth_log | vessel_code | moorings | vessel_code | passthrough
berth_log | berth | moorings | berth | passthrough
berth_log | arrived_at | moorings | arrived_at | passthrough
berth_log | departed_at | moorings | departed_at | passthrough
berth_log | arrived_at | moorings | stay_hours | transform
berth_log | departed_at | moorings | stay_hours | transform
berth_log | cargo_kg | moorings | cargo_t | transform
vessels | code | fleet | vessel_code | rename
vessels | flag | fleet | flag | transform
vessels | built_year | fleet | age | transform
vessels | owner_name | fleet | owner_key | hash
moorings | berth | berth_days | berth | passthrough
moorings | arrived_at | berth_days | day | cast
moorings | cargo_t | berth_days | tonnes | aggregate
moorings | stay_hours | berth_days | longest | aggregate
moorings | vessel_code | tide_at_arrival | vessel_code | passthrough
moorings | arrived_at | tide_at_arrival | arrived_at | passthrough
tides | height_cm | tide_at_arrival | tide_cm | rename
moorings | berth | tide_at_arrival | tide_rank | window
tides | height_cm | tide_at_arrival | tide_rank | window
fleet | vessel_code | vessel_summary | vessel_code | passthrough
fleet | flag | vessel_summary | flag | passthrough
fleet | age | vessel_summary | age | passthrough
moorings | cargo_t | vessel_summary | total_t | aggregate
moorings | berth | vessel_summary | berths | aggregate
"""
# Each row-deciding column with the outputs that it doesn't feed.
INDIRECT = {
    "berth_log departed_at moorings filter": "vessel_code berth arrived_at cargo_t",
    "moorings cargo_t berth_days filter": "berth day calls longest",
    "tides measured_at tide_at_arrival join_key": "vessel_code arrived_at tide_cm tide_rank",
    "tides station tide_at_arrival join_key": "vessel_code arrived_at tide_cm tide_rank",
    "moorings arrived_at tide_at_arrival join_key": "vessel_code tide_cm tide_rank",
    "moorings berth tide_at_arrival join_key": "vessel_code arrived_at tide_cm",
    "fleet vessel_code vessel_summary join_key": "flag age total_t berths state",
    "moorings vessel_code vessel_summary join_key": "vessel_code flag age total_t berths state",
}
RULES = """
moorings | WHERE | l.departed_at IS NOT NULL | berth_log.departed_at
berth_days | HAVING | sum(cargo_t) > 0 | moorings.cargo_t
tide_at_arrival | JOIN | t.measured_at = m.arrived_at AND t.station = m.berth | tides.measured_at,moorings.arrived_at,tides.station,moorings.berth
vessel_summary | JOIN | USING (vessel_code) | fleet.vessel_code,moorings.vessel_code
"""
EXPRESSIONS = """
moorings | stay_hours | transform | datediff('hour', l.arrived_at, l.departed_at) | 1
moorings | cargo_t | transform | CAST(l.cargo_kg AS DOUBLE) / 1000.0 | 1
fleet | flag | transform | upper(flag) | 1
fleet | age | transform | 2026 - built_year | 1
berth_days | day | cast | CAST(arrived_at AS DATE) | 1
berth_days | tonnes | aggregate | sum(cargo_t) | 1
berth_days | longest | aggregate | max(stay_hours) | 1
tide_at_arrival | tide_rank | window | rank() OVER (PARTITION BY m.berth ORDER BY t.height_cm DESC) | 1
vessel_summary | total_t | aggregate | sum(cargo_t) | 2
vessel_summary | berths | aggregate | listagg(DISTINCT berth, '/') | 1
"""


def short(column: str):
    return F.element_at(F.split(column, r"\."), -1)


def _harbour(spark: SparkSession, indirect: bool = False):
    from tracewell.sources.demo import harbour

    return run_project(spark, harbour(), Options(indirect=indirect))


def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select(short("from").alias("source"), F.col("from_col").alias("source_column"), short("to").alias("target"), F.col("to_col").alias("target_column"), "kind")


@query(values("source, source_column, target, target_column, kind", EDGES))
def lineage_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_rows(_harbour(spark).edges)


@query(values("source, source_column, target, target_column, kind", "\n".join(" | ".join([*key.split()[:3], column, key.split()[3]]) for key, columns in INDIRECT.items() for column in columns.split())))
def lineage_indirect_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_rows(_harbour(spark, True).edges.filter("kind in ('join_key', 'filter', 'dedup_key')"))


@query(values("model, column_name, expressions", "berth_days | calls | count(*)\nvessel_summary | state | 'active'"))
def lineage_roots(spark: SparkSession, sf: str) -> DataFrame:
    return _harbour(spark).roots.select(short("uid").alias("model"), F.col("column").alias("column_name"), F.array_join("expressions", ",").alias("expressions"))


@query(values("model, clause, text, columns", RULES))
def lineage_rules(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.array_join(F.transform("columns", lambda c: F.concat(F.element_at(F.split(c["node"], r"\."), -1), F.lit("."), c["column"])), ",")
    return _harbour(spark).rules.select(short("uid").alias("model"), "clause", "text", shown.alias("columns"))


@query(values("model, column_name, kind, text, steps", EXPRESSIONS))
def lineage_expressions(spark: SparkSession, sf: str) -> DataFrame:
    return _harbour(spark).expressions.select(short("uid").alias("model"), F.col("column").alias("column_name"), "kind", "text", F.col("steps").cast("string").alias("steps"))


@query("SELECT column_name AS name FROM (DESCRIBE orders)")
def star_expand_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A star resolved against the table's own list."""
    from tracewell.operators.resolve import resolve

    columns = table(spark, sf, "orders").columns
    found = resolve("with a as (select * from raw.main.orders) select * from a", [("raw.main.orders", columns)])
    return spark.createDataFrame([(e["to_column"],) for e in found["edges"]], "name string")


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A graph out of the test tables: (uid) and (uid, parent, ord), an order under its customer, nation and region."""
    link = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("uid"), F.concat(F.lit(b), F.col(y).cast("string")).alias("parent"), F.lit(0).alias("ord"))
    edges = link(table(spark, sf, "nation"), "n", "n_nationkey", "r", "n_regionkey")
    edges = edges.unionByName(link(table(spark, sf, "customer"), "c", "c_custkey", "n", "c_nationkey"))
    edges = edges.unionByName(link(table(spark, sf, "orders"), "o", "o_orderkey", "c", "o_custkey"))
    regions = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("uid"))
    return regions.unionByName(edges.select("uid")), edges


_GRAPH = """e AS (SELECT 'n' || n_nationkey AS uid, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders), v AS (SELECT 'r' || r_regionkey AS uid FROM region UNION ALL SELECT uid FROM e)"""


@query(
    f"""WITH RECURSIVE {_GRAPH}, l AS (SELECT uid, 0 AS level FROM v UNION SELECT e.uid, l.level + 1 FROM l JOIN e ON e.parent = l.uid)
    SELECT uid, CAST(max(level) AS INT) AS level FROM l GROUP BY uid"""
)
def topo_levels(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return graph.topo_levels(edges.select("uid", "parent"), nodes)


@query(
    f"""WITH {_GRAPH} SELECT e.uid, coalesce(p.parent, e.parent) AS parent FROM e LEFT JOIN e p ON e.parent = p.uid AND CAST(substring(p.uid, 2) AS INT) % 2 = 0 AND p.uid LIKE 'n%'"""
)
def read_through_ephemeral(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = _graph(spark, sf)
    skipped = table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("uid"))
    return graph.read_through(edges, skipped).select("uid", "parent")


_RELATIONS = """SELECT 'm' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS uid, 'DB.S.' || CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE '"' || lower(p_type) || '"' END AS relation FROM part"""


@query(
    f"""WITH r AS ({_RELATIONS}), k AS (SELECT uid, upper(replace(relation, '"', '')) AS key FROM r)
    SELECT key, min(uid) AS owner, string_agg(uid, ',' ORDER BY uid) AS uids FROM k GROUP BY key HAVING count(*) > 1"""
)
def collisions(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    shown = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.concat(F.lit('"'), F.lower("p_type"), F.lit('"')))
    nodes = part.select(F.concat(F.lit("m"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("uid"), F.concat(F.lit("DB.S."), shown).alias("relation"))
    return graph.collisions(nodes).withColumn("uids", F.array_join("uids", ","))


@query(
    """SELECT l_suppkey AS k, CAST(rank AS INT) AS rank, text, CAST(steps AS INT) AS steps FROM (
      SELECT l_suppkey, l_linenumber % 7 AS rank, l_returnflag || l_linestatus || CAST(l_partkey % 10 AS VARCHAR) AS text,
        max(l_linenumber) OVER (PARTITION BY l_suppkey) AS steps FROM lineitem)
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY rank DESC, text DESC) = 1"""
)
def loudest_role(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("k"),
        (F.col("l_linenumber") % 7).alias("rank"),
        F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 10).cast("string")).alias("text"),
        F.col("l_linenumber").alias("steps"),
    )
    return graph.loudest(rows, ["k"], "rank", "text", "steps")


_LISTS = """WITH a AS (SELECT c_custkey AS k, list_sort(list_distinct(list(o_orderpriority))) AS warehouse, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus <> 'F'))) AS computed,
  list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'O'))) AS declared FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1),
  b AS (SELECT k, CASE WHEN k % 3 = 0 THEN [] ELSE coalesce(warehouse, []) END AS warehouse, coalesce(computed, []) AS computed, coalesce(declared, []) AS declared FROM a)"""


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    one = lambda when: F.sort_array(F.collect_set(F.when(when, F.col("o_orderpriority"))))
    lists = pairs.groupBy(F.col("c_custkey").alias("k")).agg(one(F.lit(True)).alias("w"), one(F.col("o_orderstatus") != "F").alias("computed"), one(F.col("o_orderstatus") == "O").alias("declared"))
    empty = F.expr("cast(array() as array<string>)")
    return lists.select("k", F.when(F.col("k") % 3 == 0, empty).otherwise(F.col("w")).alias("warehouse"), "computed", "declared")


@query(
    f"""{_LISTS} SELECT k, CASE WHEN len(warehouse) > 0 THEN CASE WHEN warehouse = computed THEN 'confirmed' ELSE 'degraded' END
      WHEN len(declared) > 0 AND len(computed) > 0 AND NOT list_has_any(declared, computed) THEN 'degraded' ELSE 'unchecked' END AS agreement FROM b"""
)
def schema_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return graph.agreement(_lists(spark, sf)).select("k", "agreement")


@query(f"{_LISTS} SELECT k, len(declared) > 0 AND len(warehouse) > 0 AND declared <> warehouse AS yaml_stale FROM b")
def yaml_stale(spark: SparkSession, sf: str) -> DataFrame:
    return graph.yaml_is_stale(_lists(spark, sf)).select("k", "yaml_stale")


@query(
    f"""{_LISTS} SELECT k, CASE WHEN len(warehouse) = 0 THEN '' ELSE array_to_string(list_sort(list_filter(warehouse, lambda x: NOT list_contains(computed, x))), ',') END AS missing,
      CASE WHEN len(warehouse) = 0 THEN '' ELSE array_to_string(list_sort(list_filter(computed, lambda x: NOT list_contains(warehouse, x))), ',') END AS unexpected FROM b"""
)
def missing_unexpected(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.missing_unexpected(_lists(spark, sf))
    return found.select("k", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"))


@query(
    """WITH t AS (SELECT p_brand AS k, list_distinct(list(p_type)) AS declared, list_distinct(list(p_type) FILTER (WHERE p_size < 25 OR p_size % 2 = 0 AND p_brand < 'Brand#3')) AS computed FROM part GROUP BY 1)
    SELECT k, CAST(len(list_intersect(declared, coalesce(computed, []))) AS INT) AS shared, len(declared) >= 8 AND len(list_intersect(declared, coalesce(computed, []))) * 2 < len(declared) AS is_thin FROM t"""
)
def thin_compile(spark: SparkSession, sf: str) -> DataFrame:
    made = (F.col("p_size") < 25) | ((F.col("p_size") % 2 == 0) & (F.col("p_brand") < "Brand#3"))
    lists = table(spark, sf, "part").groupBy(F.col("p_brand").alias("k")).agg(F.collect_set("p_type").alias("declared"), F.collect_set(F.when(made, F.col("p_type"))).alias("computed"))
    return graph.thin(lists.withColumn("warehouse", F.expr("cast(array() as array<string>)"))).select("k", "shared", "is_thin")


@query(
    f"""{_LISTS}, c AS (SELECT k, 'warehouse' AS source, warehouse AS columns, 1 AS r FROM b UNION ALL SELECT k, 'computed', computed, 3 FROM b UNION ALL SELECT k, 'declared', declared, 4 FROM b)
    SELECT k, source, array_to_string(columns, ',') AS columns FROM c WHERE len(columns) > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY r) = 1"""
)
def visible_priority(spark: SparkSession, sf: str) -> DataFrame:
    each = [F.struct(F.lit(c).alias("source"), F.col(c).alias("columns")) for c in ("warehouse", "computed", "declared")]
    lists = _lists(spark, sf).select(F.col("k").alias("uid"), F.inline(F.array(*each)))
    return graph.best_lists(lists).select(F.col("uid").alias("k"), "source", F.array_join("columns", ",").alias("columns"))


@query(
    f"""{_LISTS} SELECT k, CASE WHEN k % 11 = 0 THEN 'inferred' WHEN degraded AND shared > 0 AND k % 5 <> 0 THEN 'per_column' WHEN degraded THEN 'inferred' ELSE 'parsed' END AS plan
    FROM (SELECT k, len(list_intersect(declared, computed)) AS shared, CASE WHEN len(warehouse) > 0 THEN warehouse <> computed ELSE len(declared) > 0 AND len(computed) > 0 AND NOT list_has_any(declared, computed) END AS degraded FROM b)"""
)
def plan_verdict(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.thin(graph.agreement(_lists(spark, sf)))
    return rows.select("k", graph.plan_of(F.col("k") % 11 == 0, F.col("agreement"), F.col("shared"), F.col("k") % 5 == 0).alias("plan"))


@query(
    """WITH i AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS t, CAST(s_nationkey AS VARCHAR) AS f, c_mktsegment AS fc,
        CASE WHEN c_custkey % 3 = 0 THEN 'filter' WHEN c_custkey % 3 = 1 THEN 'join_key' ELSE 'dedup_key' END AS role
      FROM customer JOIN supplier ON (c_nationkey + 1) % 25 = s_nationkey),
    s AS (SELECT t, f, fc, CASE max(CASE role WHEN 'filter' THEN 1 WHEN 'join_key' THEN 2 ELSE 3 END) WHEN 1 THEN 'filter' WHEN 2 THEN 'join_key' ELSE 'dedup_key' END AS kind FROM i WHERE f <> t GROUP BY t, f, fc),
    o AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS t, c_mktsegment AS tc FROM customer)
    SELECT s.f AS source, s.fc AS source_column, s.t AS target, o.tc AS target_column, s.kind FROM s JOIN o ON s.t = o.t WHERE s.fc <> o.tc"""
)
def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    role = F.when(F.col("c_custkey") % 3 == 0, "filter").when(F.col("c_custkey") % 3 == 1, "join_key").otherwise("dedup_key")
    pairs = customer.join(supplier, (F.col("c_nationkey") + 1) % 25 == F.col("s_nationkey"))
    reads = pairs.select(F.col("c_nationkey").cast("string").alias("to"), F.col("s_nationkey").cast("string").alias("from"), F.col("c_mktsegment").alias("from_col"), role.alias("role")).distinct()
    outputs = customer.select(F.col("c_nationkey").cast("string").alias("to"), F.col("c_mktsegment").alias("to_col")).distinct()
    direct = reads.select("to", "from", "from_col", F.col("from_col").alias("to_col")).distinct()
    found = graph.fan_out(reads, outputs, direct)
    return found.select(F.col("from").alias("source"), F.col("from_col").alias("source_column"), F.col("to").alias("target"), F.col("to_col").alias("target_column"), "kind")


_TEXTS = {
    0: ("", "copy"),
    1: ("CAST(size AS INT)", "cast"),
    2: ("size * 2", "transform"),
    3: ("md5(size)", "hash"),
    4: ("coalesce(sum(size), 0)", "aggregate"),
    5: ("rank() OVER (ORDER BY size)", "window"),
    6: ("my_sum(size)", "transform"),
    7: ("CAST(md5(concat(a, b)) AS BINARY(20))", "hash"),
    8: ("coalesce(md5(x), '-1')", "transform"),
    9: ("(CAST(a AS INT))::VARCHAR", "cast"),
    10: ("CAST(a AS INT) + b", "transform"),
    11: ("x::INT IS NULL", "transform"),
    12: ("concat(a, 'sum(x)')", "transform"),
    13: ("over_due", "copy"),
}
_CASES = " ".join(f"WHEN {k} THEN '{'plain' if r == 'copy' else r}'" for k, (_, r) in _TEXTS.items())


@query(
    f"""SELECT p_partkey, replace(CASE p_partkey % {len(_TEXTS)} {_CASES} END, 'plain', CASE WHEN p_size % 2 = 0 THEN 'passthrough' ELSE 'rename' END) AS role FROM part"""
)
def classify_roles(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    text = F.element_at(F.array(*[F.lit(t) for t, _ in _TEXTS.values()]), (F.col("p_partkey") % len(_TEXTS)).cast("int") + 1)
    target = F.when(F.col("p_size") % 2 == 0, "SIZE").otherwise("other")
    rows = part.select("p_partkey", text.alias("text"), F.lit("size").alias("source"), target.alias("target"))
    return roles.with_role(rows, "text", "source", "target").select("p_partkey", "role")


@query("""SELECT o_orderkey, upper('db.' || replace(o_orderpriority, '-', '.') || '.' || o_orderstatus) AS key FROM orders""")
def norm_relation(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit('"db". '), F.regexp_replace("o_orderpriority", "-", "."), F.lit(".`"), F.lower("o_orderstatus"), F.lit("`"))
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", graph.relation_key("raw").alias("key"))


@query("SELECT doc_id, md5(substring(text, 1, 500)) AS text_md5, length(text) > 500 AS is_cut FROM documents")
def cut_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", roles.cut(F.col("text")).alias("c")).select("doc_id", F.md5("c.text").alias("text_md5"), F.col("c.cut").alias("is_cut"))


# What feeds what in the models over the test tables, written by hand from their SQL.
DEMO_EDGES = """
customer | c_custkey | stg_customer | customer_id | rename
customer | c_name | stg_customer | name | rename
customer | c_nationkey | stg_customer | nation_id | cast
customer | c_acctbal | stg_customer | balance | rename
customer | c_mktsegment | stg_customer | c_mktsegment | passthrough
orders | o_orderkey | stg_orders | order_id | rename
orders | o_custkey | stg_orders | customer_id | rename
orders | o_orderstatus | stg_orders | status | rename
orders | o_totalprice | stg_orders | price | rename
stg_orders | customer_id | int_order_totals | customer_id | passthrough
stg_orders | price | int_order_totals | total | aggregate
stg_customer | customer_id | orders_enriched | customer_id | passthrough
stg_customer | name | orders_enriched | name | passthrough
stg_orders | price | orders_enriched | total | aggregate
orders_enriched | customer_id | customer_ltv | customer_id | passthrough
orders_enriched | total | customer_ltv | ltv | transform
events | event_id | latest_event | event_id | passthrough
events | user_id | latest_event | user_id | passthrough
events | user_id | latest_event | rn | window
events | ts | latest_event | rn | window
events | event_id | event_kinds | id | rename
documents | doc_id | event_kinds | id | rename
orders | o_custkey | big_spenders | o_custkey | passthrough
documents | text | doc_keys | doc_key | hash
documents | lang | doc_keys | lang_key | transform
documents | doc_id | doc_labels | doc_id | passthrough
labels | quality | doc_labels | quality | passthrough
nation | n_nationkey | nation_tree | id | rename
region | r_regionkey | star_edits | r_regionkey | passthrough
events | event_id | self_incremental | event_id | passthrough
events | ts | self_incremental | ts | passthrough
part | p_partkey | behind_table | p_partkey | passthrough
part | p_name | behind_table | p_name | inferred
supplier | s_suppkey | broken_compile | s_suppkey | inferred
supplier | s_name | broken_compile | s_name | inferred
supplier | s_suppkey | thin_stage | s_suppkey | passthrough
supplier | s_acctbal | thin_stage | s_acctbal | inferred
things | k | undeclared_reader | k | passthrough
orders | o_orderkey | best_line | o_orderkey | passthrough
lineitem | l_quantity | best_line | best | aggregate
events | event_id | event_props | event_id | passthrough
events | props | event_props | prop | transform
documents | doc_id | which_doc | doc_id | inferred
labels | quality | which_doc | quality | inferred
"""
DEMO_READS = """
orders_enriched | STG_CUSTOMER | customer_id | join_key | true
orders_enriched | STG_ORDERS | customer_id | join_key | false
latest_event | EVENTS | user_id | dedup_key | true
latest_event | EVENTS | ts | dedup_key | true
big_spenders | ORDERS | o_custkey | filter | true
big_spenders | CUSTOMER | c_custkey | filter | false
big_spenders | CUSTOMER | c_acctbal | filter | false
big_spenders | ORDERS | o_totalprice | filter | false
doc_labels | DOCUMENTS | doc_id | join_key | true
doc_labels | LABELS | doc_id | join_key | false
self_incremental | EVENTS | ts | filter | true
best_line | LINEITEM | l_orderkey | filter | false
best_line | ORDERS | o_orderkey | filter | true
"""
DEMO_PLANS = "\n".join(
    f"{name} | {'per_column' if name == 'behind_table' else 'inferred' if name in ('broken_compile', 'silent_macro', 'which_doc') else 'parsed'}"
    for name in "stg_customer stg_orders int_order_totals orders_enriched customer_ltv latest_event event_kinds big_spenders doc_keys doc_labels nation_tree spine star_edits self_incremental behind_table broken_compile thin_stage undeclared_reader best_line event_props silent_macro which_doc carried_over".split()
)


def _demo(spark: SparkSession, sf: str):
    from tracewell.sources.demo import over_tables

    return run_project(spark, over_tables(lambda name: table(spark, sf, name).columns))


@query(values("source, source_column, target, target_column, kind", DEMO_EDGES))
def demo_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_rows(_demo(spark, sf).edges)


@query(values("model, relation, column_name, role, projected", DEMO_READS))
def demo_row_deciding_reads(spark: SparkSession, sf: str) -> DataFrame:
    from tracewell.operators.report import row_deciding_reads

    reads = row_deciding_reads(_demo(spark, sf))
    return reads.select(short("uid").alias("model"), short("relation").alias("relation"), F.col("column").alias("column_name"), "role", F.col("projected").cast("string").alias("projected"))


@query(values("model, column_name, expressions, complete", "event_kinds | kind | 'document','event' | true\nnation_tree | depth |  | false\nspine | n | seq4() | true"))
def demo_roots(spark: SparkSession, sf: str) -> DataFrame:
    roots = _demo(spark, sf).roots
    return roots.select(short("uid").alias("model"), F.col("column").alias("column_name"), F.array_join("expressions", ",").alias("expressions"), F.col("complete").cast("string").alias("complete"))


@query(values("model, plan", DEMO_PLANS))
def demo_plans(spark: SparkSession, sf: str) -> DataFrame:
    return _demo(spark, sf).models.select(short("uid").alias("model"), "plan")


@query(values("model, cte, column_name, owners", "thin_stage | u | s_acctbal | DEMO.RAW.SUPPLIER"))
def demo_unbacked(spark: SparkSession, sf: str) -> DataFrame:
    from tracewell.operators.report import unbacked_reads

    rows = unbacked_reads(_demo(spark, sf))
    return rows.select(short("uid").alias("model"), "cte", F.col("column").alias("column_name"), F.array_join("owners", ",").alias("owners"))


@query(
    values(
        "category, owner, severity, models",
        "catalog_of_another_target | inputs | error | pages\ncompile_does_not_parse | project | error | broken_compile,which_doc\nreads_only_itself | project | info | carried_over\nreads_a_name_its_cte_lacks | project | warning | thin_stage\nrelation_not_declared | project | warning | undeclared_reader\n"
        "table_older_than_code | project | warning | behind_table\ncode_ahead_of_table | project | warning | behind_table",
    )
)
def demo_findings(spark: SparkSession, sf: str) -> DataFrame:
    from tracewell.operators.report import findings

    rows = findings(_demo(spark, sf))
    return rows.select("category", "owner", "severity", F.array_join(F.transform("models", lambda m: m["name"]), ",").alias("models"))


@query(
    """SELECT 23 AS models, 21 AS parsed, 2 AS parse_failed, 38 AS edges_parsed, 6 AS edges_inferred, 13 AS row_deciding_reads, 6 AS read_not_projected, 3 AS columns_root, 1 AS unbacked_reads, 1 AS undeclared,
      1 AS catalog_elsewhere, 1 AS columns_self, 0 AS read_through_star_unwitnessed, 0 AS ambiguous_by_compile, 0 AS ambiguous_by_every, 1 AS ambiguous_by_order, 1 AS self_reads, 0 AS collisions"""
)
def demo_totals(spark: SparkSession, sf: str) -> DataFrame:
    from tracewell.operators.report import totals

    names = "models parsed parse_failed edges_parsed edges_inferred row_deciding_reads read_not_projected columns_root unbacked_reads undeclared catalog_elsewhere columns_self read_through_star_unwitnessed ambiguous_by_compile ambiguous_by_every ambiguous_by_order self_reads collisions".split()
    return totals(_demo(spark, sf)).select(*[F.col(n).cast("int").alias(n) for n in names])


@query(
    values(
        "model, why",
        """
behind_table | plan,missing,unexpected
broken_compile | plan,parse_error,gap,missing
which_doc | plan,parse_error,gap,missing,ambiguous
thin_stage | unbacked
undeclared_reader | undeclared
silent_macro | plan
carried_over | only_itself
""",
    )
)
def demo_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Models of which something is to be said, and what."""
    from tracewell.operators.report import model_reports

    reasons = {
        "plan": "plan <> 'parsed'",
        "parse_error": "parse_error is not null",
        "undeclared": "size(undeclared) > 0",
        "gap": "gap",
        "missing": "size(missing) > 0",
        "unexpected": "size(unexpected) > 0",
        "thin": "is_thin",
        "stale": "yaml_stale",
        "unbacked": "unbacked_reads is not null",
        "lost": "lost_columns is not null",
        "partial": "exists(partial_columns, p -> p.is_loss)",
        "absent": "absent_reads is not null",
        "parents": "unknown_parents is not null",
        "ambiguous": "ambiguous is not null",
        "only_itself": "only_itself",
    }
    why = F.array_join(F.array(*[F.when(F.expr(condition), F.lit(name)) for name, condition in reasons.items()]), ",")
    return model_reports(_demo(spark, sf)).filter("not clean").select(short("uid").alias("model"), why.alias("why"))


def _constructs(family: str):
    from tracewell.queries import constructs

    rows = [(construct, fact) for construct, _, facts in constructs.cases(family) for fact in facts]
    shown = ",\n".join("(" + ", ".join("'" + c.replace("'", "''") + "'" for c in row) + ")" for row in rows)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return construct_facts(spark, [(c, sql) for c, sql, _ in constructs.cases(family)])

    run.__name__ = f"resolve_{family}"
    query(f"SELECT * FROM (VALUES {shown}) AS t(construct, fact)")(run)


def construct_facts(spark: SparkSession, statements: list[tuple[str, str]]) -> DataFrame:
    """(construct, fact): all that the resolver finds in each statement, a line for each fact."""
    from tracewell.plans.lineage import resolve_models
    from tracewell.queries import constructs

    lists = F.array(*[F.struct(F.lit(r).alias("relation"), F.lit(r.upper()).alias("key"), F.array(*map(F.lit, c)).alias("columns"), F.expr("cast(array() as array<struct<source:string,columns:array<string>>>)").alias("others")) for r, c in constructs.LISTS.items()])
    models = spark.createDataFrame(statements, "uid string, sql string").select("uid", "sql", F.lit(None).cast("string").alias("problem"), lists.alias("visible"))
    found = resolve_models(models)
    tail = lambda c: F.lower(F.element_at(F.split(c, r"\."), -1))
    joined = lambda c: F.array_join(c, ", ")
    each = {
        "edges": lambda x: F.concat(x["kind"], F.lit(" "), tail(x["from_relation"]), F.lit("."), x["from_column"], F.lit(" > "), x["to_column"]),
        "indirect": lambda x: F.concat(x["role"], F.lit(" "), tail(x["relation"]), F.lit("."), x["column"]),
        "roots": lambda x: F.concat(F.lit("root "), x["column"], F.lit(" ="), F.when(F.size(x["expressions"]) > 0, F.concat(F.lit(" "), joined(x["expressions"]))).otherwise(F.lit(""))),
        "partial": lambda x: F.concat_ws(" ", F.lit("partial"), x["output"], x["reason"], x["name"]),
        "lost": lambda x: F.concat(F.lit("lost "), x["column"]),
        "unbacked": lambda x: F.rtrim(F.concat(F.lit("unbacked "), x["output"], F.lit(" "), x["cte"], F.lit("."), x["column"], F.lit(" of "), joined(F.transform(x["owners"], tail)))),
        "unknown_columns": lambda x: F.concat(F.lit("unknown "), tail(x["relation"]), F.lit("."), x["column"]),
        "merged_scopes": lambda x: F.concat_ws(" ", F.lit("merged"), x["kind"], x["name"], x["count"].cast("string")),
        "rules": lambda x: F.concat_ws(" ", F.lit("rule"), x["clause"], x["text"]),
    }
    lines = F.concat(*[F.transform(name, f) for name, f in each.items()], F.when(F.size("projection") > 0, F.array(F.concat(F.lit("columns "), joined("projection")))).otherwise(F.array()))
    error = F.when(F.col("parse_error").isNotNull(), F.array(F.concat(F.lit("parse error at "), F.element_at("issues", 1)["span"][0].cast("string")))).otherwise(F.array())
    return found.select(F.col("uid").alias("construct"), F.explode(F.concat(lines, error)).alias("fact"))


for _family in ("projection", "subqueries", "joins", "aggregates", "windows", "sets", "generators", "gaps"):
    _constructs(_family)

# What Spark's analyzer can't read of the constructs, with string columns for everything; and what only one reader finds.
_UNREAD = "A4 A4b A10 A10b A15 A4c J8 J9 G5b W5 U2 F1 F2 F3 F3b F3c F3d F3e F4 F5 F5c F6 F7 F9 F10 F11 F5d B14 B15 B15b B16 B17 B20 B20b B20c".split()
_ALONE = {"G6": ["tides.station > level"]}


def _witnessed() -> str:
    from tracewell.queries import constructs

    kinds = ("passthrough", "rename", "cast", "transform", "hash", "aggregate", "window")
    rows = []
    for family in constructs.FAMILIES:
        for construct, _, facts in constructs.cases(family):
            if construct in _UNREAD:
                rows.append(f"{construct} | unread | ")
                continue
            edges = {fact.split(" ", 1)[1] for fact in facts if fact.split(" ", 1)[0] in kinds}
            rows.extend(f"{construct} | {'resolver' if e in _ALONE.get(construct, ()) else 'both'} | {e}" for e in sorted(edges))
    return "\n".join(rows)


@query(values("construct, readers, edge", _witnessed()))
def second_reader(spark: SparkSession, sf: str) -> DataFrame:
    """Every edge of the constructs with the readers that find it: the resolver, Spark's analyzer or both."""
    from tracewell.operators.second_reader import audit
    from tracewell.queries import constructs

    every = [(construct, sql, constructs.LISTS) for family in constructs.FAMILIES for construct, sql, _ in constructs.cases(family)]
    edge = F.concat(F.element_at(F.split("relation", r"\."), -1), F.lit("."), F.col("column"), F.lit(" > "), F.col("output"))
    return audit(spark, every).select(F.col("uid").alias("construct"), "readers", F.coalesce(edge, F.lit("")).alias("edge"))
