"""Every SQL construct whose lineage the engine reads, executed on data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.joins import asof_join, range_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str):
    def wrap(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return wrap


def sql_query(name: str, tables: str, spark_sql: str, other: str | None = None) -> None:
    """A query whose text Spark and the other engine share, or nearly."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return spark.sql(spark_sql, **{t: table(spark, sf, t) for t in tables.split()})

    QUERIES[name] = run
    text = other or spark_sql
    for t in tables.split():
        text = text.replace("{" + t + "}", t)
    ORACLE[name] = text


CENTS = "CAST(round({} * 100) AS BIGINT)"


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


# scans, projections, predicates
sql_query("scan_project", "nation", "SELECT n_nationkey, n_name, n_regionkey FROM {nation}")
sql_query("where_filter", "orders", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
sql_query("expression_projection", "part", "SELECT p_partkey, p_size * 2 + 1 AS twice, upper(p_brand) AS brand, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS bulk FROM {part}")
sql_query("star_exclude", "nation", "SELECT * EXCEPT (n_regionkey) FROM {nation}", "SELECT * EXCLUDE (n_regionkey) FROM nation")


@query("SELECT * RENAME (n_name AS name) FROM nation")
def star_rename(spark, sf):
    return table(spark, sf, "nation").withColumnRenamed("n_name", "name")


@query("SELECT * REPLACE (upper(n_name) AS n_name) FROM nation")
def star_replace(spark, sf):
    return table(spark, sf, "nation").withColumn("n_name", F.upper("n_name"))


@query("SELECT n_nationkey FROM nation")
def star_like(spark, sf):
    nation = table(spark, sf, "nation")
    return nation.select([c for c in nation.columns if "nationkey" in c.lower()])


sql_query("having", "orders", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql_query("in_subquery", "customer orders", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 400000)")
sql_query("not_in_values", "customer", "SELECT c_custkey FROM {customer} WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
sql_query("exists_correlated", "customer orders", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sql_query("not_exists", "customer orders", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
sql_query(
    "scalar_correlated",
    "nation customer",
    "SELECT n_nationkey, (SELECT max(c_custkey) FROM {customer} WHERE c_nationkey = n_nationkey) AS last_customer FROM {nation}",
)
sql_query("scalar_subquery_filter", "part", "SELECT p_partkey FROM {part} WHERE p_size = (SELECT max(p_size) FROM {part})")
sql_query("cte_chain", "orders", "WITH a AS (SELECT o_custkey AS k, o_orderkey FROM {orders}), b AS (SELECT k, count(o_orderkey) AS n FROM a GROUP BY k) SELECT k, n FROM b")
sql_query(
    "cte_same_name_nested",
    "nation",
    "WITH a AS (SELECT n_nationkey AS k FROM {nation}) SELECT k, m FROM a JOIN (WITH a AS (SELECT n_nationkey AS j, n_regionkey AS m FROM {nation}) SELECT j, m FROM a) s ON k = j",
)
sql_query("derived_table", "nation", "SELECT r, n FROM (SELECT n_regionkey AS r, count(*) AS n FROM {nation} GROUP BY n_regionkey) t WHERE n > 1")
sql_query("values_list", "", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(id, name)")
sql_query("distinct_rows", "customer", "SELECT DISTINCT c_nationkey, c_mktsegment FROM {customer}")
sql_query(
    "recursive_cte",
    "",
    "WITH RECURSIVE t AS (SELECT 1 AS n, 1 AS f UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 15) SELECT CAST(n AS INT) AS n, CAST(f AS INT) AS f FROM t",
)

# joins
sql_query("join_inner", "nation region", "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
sql_query("join_left", "customer orders", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000")
sql_query("join_right", "customer orders", "SELECT c_custkey, o_orderkey FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey AND o_totalprice > 300000")
sql_query("join_full", "customer supplier", "SELECT c_custkey, s_suppkey FROM {customer} FULL OUTER JOIN {supplier} ON c_custkey = s_suppkey AND c_acctbal > s_acctbal")
sql_query("join_cross", "region", "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM {region} a CROSS JOIN {region} b")
sql_query("join_comma", "nation region", "SELECT n_nationkey, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey AND r_name LIKE 'A%'")
sql_query("join_semi", "customer orders", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
sql_query("join_anti", "customer orders", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 250000", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
sql_query("join_using", "documents labels", "SELECT doc_id, lang, quality FROM {documents} JOIN {labels} USING (doc_id)")
sql_query("join_natural", "documents labels", "SELECT doc_id, source, toxic FROM {documents} NATURAL JOIN {labels}")
sql_query("join_nested", "customer nation region", "SELECT c_custkey, r_name FROM {customer} JOIN ({nation} JOIN {region} ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey")
sql_query(
    "join_lateral",
    "nation customer",
    "SELECT n_nationkey, t.c_custkey FROM {nation} JOIN LATERAL (SELECT c_custkey FROM {customer} WHERE c_nationkey = n_nationkey ORDER BY c_custkey LIMIT 2) t ON true",
)
sql_query("join_theta", "region", "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM {region} a JOIN {region} b ON a.r_regionkey < b.r_regionkey")


@query(
    """SELECT e.event_id, o.o_orderkey AS latest_order FROM events e
    ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o
    ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate"""
)
def join_asof(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("k"), "ts")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey")
    found = asof_join(events, orders, ["k"], "ts", "o_orderdate", ["o_orderkey"])
    return found.select("event_id", F.col("o_orderkey").alias("latest_order"))


@query(
    """SELECT p.p_partkey, r.band FROM part p JOIN (SELECT * FROM (VALUES (0.0, 950.0, 1), (950.0, 1200.0, 2), (1100.0, 5000.0, 3)) AS v(low, high, band)) r
    ON p.p_retailprice >= r.low AND p.p_retailprice < r.high"""
)
def join_range(spark, sf):
    bands = spark.createDataFrame([(0.0, 950.0, 1), (950.0, 1200.0, 2), (1100.0, 5000.0, 3)], "low double, high double, band int")
    return range_join(table(spark, sf, "part"), bands, "p_retailprice", "low", "high", 250.0).select("p_partkey", "band")


# aggregation
sql_query(
    "group_aggregates",
    "lineitem",
    f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum({CENTS.format('l_extendedprice')}) AS BIGINT) AS cents, min(l_quantity) AS low, max(l_quantity) AS high FROM {{lineitem}} GROUP BY l_returnflag, l_linestatus",
)
sql_query("count_distinct", "orders", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY o_orderstatus")
sql_query("case_in_aggregate", "orders", "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done FROM {orders} GROUP BY o_custkey")
sql_query("filter_aggregate", "orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders FROM {orders} GROUP BY o_orderpriority")
sql_query(
    "rollup",
    "customer",
    "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {customer} GROUP BY ROLLUP (c_nationkey, c_mktsegment)",
)
sql_query("cube", "customer", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {customer} GROUP BY CUBE (c_nationkey, c_mktsegment)")
sql_query(
    "grouping_sets",
    "customer",
    "SELECT c_nationkey, c_mktsegment, CAST(grouping(c_nationkey) AS INT) AS all_nations, count(*) AS n FROM {customer} GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())",
)
sql_query(
    "ordered_aggregate",
    "nation",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
)
sql_query("median_mode", "part", "SELECT p_brand, CAST(median(p_size) AS DOUBLE) AS middle FROM {part} GROUP BY p_brand")
sql_query(
    "statistics",
    "part",
    "SELECT p_brand, round(stddev_samp(p_size), 6) AS s, round(var_pop(p_size), 6) AS v, round(avg(p_size), 6) AS a FROM {part} GROUP BY p_brand",
)
sql_query(
    "correlation",
    "part",
    "SELECT round(corr(p_size, p_partkey), 6) AS c, round(covar_pop(p_size, p_partkey), 4) AS p FROM {part}",
)
sql_query("bit_aggregates", "part", "SELECT p_brand, bit_and(p_size) AS a, bit_or(p_size) AS o, bit_xor(p_size) AS x FROM {part} GROUP BY p_brand")
sql_query("percentiles", "part", "SELECT CAST(percentile_cont(0.25) WITHIN GROUP (ORDER BY p_size) AS DOUBLE) AS q FROM {part}", "SELECT CAST(quantile_cont(p_size, 0.25) AS DOUBLE) AS q FROM part")
sql_query("max_by", "customer", "SELECT c_nationkey, max_by(c_name, c_custkey) AS latest FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, arg_max(c_name, c_custkey) AS latest FROM customer GROUP BY c_nationkey")

# windows
sql_query(
    "window_rank",
    "customer",
    "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS d FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey)",
)
sql_query("window_ntile", "supplier", "SELECT s_suppkey, CAST(ntile(4) OVER (ORDER BY s_suppkey) AS INT) AS part FROM {supplier}")
sql_query(
    "window_lag_lead",
    "orders",
    "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after2 FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
)
sql_query(
    "window_frame",
    "orders",
    "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS moving FROM {orders}",
)
sql_query(
    "window_first_last",
    "orders",
    "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_order, last_value(o_orderkey) OVER w AS last_order FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
)
sql_query("window_over_aggregate", "customer", "SELECT c_nationkey, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM {customer} GROUP BY c_nationkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def qualify_dedup(spark, sf):
    latest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("rn", F.row_number().over(latest)).filter("rn = 1").select("o_custkey", "o_orderkey")


sql_query(
    "sessions",
    "events",
    """WITH gaps AS (SELECT event_id, user_id, ts, CASE WHEN unix_timestamp(ts) - unix_timestamp(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800 THEN 0 ELSE 1 END AS fresh FROM {events})
    SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM gaps""",
    """WITH gaps AS (SELECT event_id, user_id, ts, CASE WHEN CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) <= 1800 THEN 0 ELSE 1 END AS fresh FROM events)
    SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM gaps""",
)

# sorts, limits, set operations
sql_query("top_k", "orders", "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
sql_query("limit_offset", "customer", "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 5 OFFSET 10")
sql_query("union_all", "customer supplier", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
sql_query("union_distinct", "customer supplier", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql_query("union_position", "region", "SELECT r_regionkey AS a, r_regionkey + 1 AS b FROM {region} UNION ALL SELECT r_regionkey * 2 AS b, r_regionkey AS a FROM {region}")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL BY NAME SELECT r_name AS name, r_regionkey AS k, 1 AS region FROM region")
def union_by_name(spark, sf):
    left = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    right = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"), F.lit(1).alias("region"))
    return left.unionByName(right, allowMissingColumns=True)


sql_query("intersect", "customer supplier", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
sql_query("except_distinct", "customer orders", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 250000")
sql_query("except_all", "customer supplier", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
sql_query("parenthesised_set", "region", "(SELECT r_regionkey AS k FROM {region} WHERE r_regionkey < 3) UNION ALL (SELECT r_regionkey FROM {region} EXCEPT SELECT 4)")

# pivots, generators, nested values
sql_query(
    "pivot",
    "orders",
    "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM {orders}) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1",
)


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def pivot_frame(spark, sf):
    orders = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    return orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count("o_orderkey")).select("o_orderpriority", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("SELECT r_regionkey, name, value FROM (SELECT r_regionkey, r_regionkey + 1 AS up, r_regionkey - 1 AS down FROM region) UNPIVOT (value FOR name IN (up, down))")
def unpivot(spark, sf):
    wide = table(spark, sf, "region").select("r_regionkey", (F.col("r_regionkey") + 1).alias("up"), (F.col("r_regionkey") - 1).alias("down"))
    return wide.unpivot("r_regionkey", ["up", "down"], "name", "value")


sql_query(
    "flatten_json",
    "events",
    "SELECT event_id, t.key AS key, t.val AS value FROM {events} LATERAL VIEW explode(from_json(props, 'map<string,string>')) t AS key, val",
    "SELECT event_id, key, json_extract_string(props, '$.\"' || key || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)",
)
sql_query("json_path", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
sql_query("explode_position", "nation", "SELECT n_nationkey, pos, part FROM {nation} LATERAL VIEW posexplode(split(n_name, '_')) t AS pos, part", "SELECT n_nationkey, CAST(generate_subscripts(p, 1) - 1 AS INT) AS pos, unnest(p) AS part FROM (SELECT n_nationkey, string_split(n_name, '_') AS p FROM nation)")
sql_query("generator", "", "SELECT CAST(id AS INT) AS n, CAST(id * id AS INT) AS square FROM range(100)", "SELECT CAST(i AS INT) AS n, CAST(i * i AS INT) AS square FROM range(100) t(i)")
sql_query("higher_order", "embeddings", "SELECT vec_id, CAST(size(filter(embedding, x -> x > 0)) AS INT) AS positive FROM {embeddings}", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive FROM embeddings")
sql_query("array_membership", "part", "SELECT p_partkey, array_contains(split(p_type, ' '), 'BRASS') AS brass FROM {part}", "SELECT p_partkey, list_contains(string_split(p_type, ' '), 'BRASS') AS brass FROM part")

# scalar functions
sql_query("casts", "orders", "SELECT o_orderkey, CAST(o_totalprice AS INT) AS whole, CAST(o_orderkey AS STRING) AS text, try_cast(o_orderpriority AS INT) AS none FROM {orders}", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INT) AS whole, CAST(o_orderkey AS VARCHAR) AS text, try_cast(o_orderpriority AS INT) AS none FROM orders")
sql_query("hashes", "customer", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s FROM {customer}", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
sql_query("surrogate_key", "customer", "SELECT c_custkey, coalesce(md5(concat(c_name, '-', CAST(c_nationkey AS STRING))), '-1') AS k FROM {customer}", "SELECT c_custkey, coalesce(md5(concat(c_name, '-', CAST(c_nationkey AS VARCHAR))), '-1') AS k FROM customer")
sql_query("strings", "part", "SELECT p_partkey, lower(p_name) AS l, substring(p_name, 2, 3) AS s, length(p_name) AS n, replace(p_brand, '#', '-') AS r, trim(p_type) AS t, position('a' IN p_name) AS p FROM {part}", "SELECT p_partkey, lower(p_name) AS l, substring(p_name, 2, 3) AS s, CAST(length(p_name) AS INT) AS n, replace(p_brand, '#', '-') AS r, trim(p_type) AS t, CAST(position('a' IN p_name) AS INT) AS p FROM part")
sql_query("regular_expressions", "part", "SELECT p_partkey, p_name RLIKE '[0-9]+$' AS ends_in_digit, regexp_replace(p_brand, '[^0-9]', '') AS digits FROM {part}", "SELECT p_partkey, regexp_matches(p_name, '[0-9]+$') AS ends_in_digit, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits FROM part")
sql_query("dates", "orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS first_day, datediff(DATE'2000-01-01', o_orderdate) AS age FROM {orders}", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INT) AS age FROM orders")
sql_query("math", "part", "SELECT p_partkey, abs(p_size - 25) AS a, p_size % 7 AS m, CAST(floor(p_size / 3) AS INT) AS f, round(sqrt(p_size), 6) AS s, greatest(p_size, 10) AS g FROM {part}")
sql_query("null_handling", "customer", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS n, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS c, c_mktsegment IS DISTINCT FROM 'BUILDING' AS d FROM {customer}")
sql_query("tumbling_window", "events", "SELECT date_format(window.start, 'yyyy-MM-dd HH') AS hour, event_type, count(*) AS n FROM {events} GROUP BY window(ts, '1 hour'), event_type", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
