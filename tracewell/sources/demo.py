"""Projects whose artifacts are built in memory: an invented harbour, and models over the test tables."""

from __future__ import annotations

from tracewell.sources.project import Node, Project

_LOGS = {
    "berth_log": "vessel_code berth arrived_at departed_at cargo_kg",
    "vessels": "code flag built_year owner_name",
    "tides": "station measured_at height_cm",
}
# (name, parents, columns, SQL); a relation in braces stands for its full name
_HARBOUR = (
    ("moorings", "berth_log", "vessel_code berth arrived_at departed_at stay_hours cargo_t", """
select l.vessel_code, l.berth, l.arrived_at, l.departed_at,
  datediff('hour', l.arrived_at, l.departed_at) as stay_hours, cast(l.cargo_kg as double) / 1000.0 as cargo_t
from {berth_log} as l
where l.departed_at is not null"""),
    ("fleet", "vessels", "vessel_code flag age owner_key", "select code as vessel_code, upper(flag) as flag, 2026 - built_year as age, md5(owner_name) as owner_key from {vessels}"),
    ("berth_days", "moorings", "berth day calls tonnes longest", """
select berth, cast(arrived_at as date) as day, count(*) as calls, sum(cargo_t) as tonnes, max(stay_hours) as longest
from {moorings}
group by berth, cast(arrived_at as date)
having sum(cargo_t) > 0"""),
    ("tide_at_arrival", "tides moorings", "vessel_code arrived_at tide_cm tide_rank", """
select m.vessel_code, m.arrived_at, t.height_cm as tide_cm, rank() over (partition by m.berth order by t.height_cm desc) as tide_rank
from {moorings} m left join {tides} t on t.measured_at = m.arrived_at and t.station = m.berth"""),
    ("vessel_summary", "moorings fleet", "vessel_code flag age total_t berths state", """
select f.vessel_code, f.flag, f.age, coalesce(s.total_t, 0) as total_t, s.berths, 'active' as state
from {fleet} f
left join (select vessel_code, sum(cargo_t) as total_t, listagg(distinct berth, '/') as berths from {moorings} group by vessel_code) s using (vessel_code)"""),
)


def harbour() -> Project:
    """Five models over three seeds, all with a catalog entry."""
    name = lambda n: f'"port"."main"."{n}"'
    every = [*_LOGS, *(m[0] for m in _HARBOUR)]
    project = Project({}, "harbour", "duckdb")
    for seed, columns in _LOGS.items():
        uid = f"seed.harbour.{seed}"
        project.nodes[uid] = Node(uid, seed, "seed", "harbour", f"seeds/{seed}.csv", name(seed))
        project.warehouse[uid] = columns.split()
    for model, parents, columns, sql in _HARBOUR:
        uid = f"model.harbour.{model}"
        given = [f"{'seed' if p in _LOGS else 'model'}.harbour.{p}" for p in parents.split()]
        text = sql.strip().format(**{n: name(n) for n in every})
        project.nodes[uid] = Node(uid, model, "model", "harbour", f"models/{model}.sql", name(model), "view", sql=text, sql_source="manifest", parents=given)
        project.warehouse[uid] = columns.split()
    project.nodes = dict(sorted(project.nodes.items()))
    return project


# Models over the test tables, one or two shapes of SQL each: (name, parents, warehouse columns, SQL).
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_MODELS = (
    ("stg_customer", "customer", "customer_id name nation_id balance c_mktsegment", "with src as (select * from demo.raw.customer) select c_custkey as customer_id, c_name as name, cast(c_nationkey as bigint) as nation_id, c_acctbal as balance, c_mktsegment from src"),
    ("stg_orders", "orders", "order_id customer_id status price", "select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as status, o_totalprice as price from demo.raw.orders"),
    ("int_order_totals", "stg_orders", "", "select customer_id, sum(price) as total from demo.main.stg_orders group by customer_id"),
    ("orders_enriched", "int_order_totals stg_customer", "customer_id name total", "with totals as (select customer_id, sum(price) as total from demo.main.stg_orders group by customer_id), c as (select * from demo.main.stg_customer) select c.customer_id, c.name, coalesce(t.total, 0) as total from c left join totals t on c.customer_id = t.customer_id"),
    ("customer_ltv", "orders_enriched", "customer_id ltv", "select customer_id, total * 0.1 as ltv from demo.main.orders_enriched"),
    ("latest_event", "events", "event_id user_id rn", "select event_id, user_id, row_number() over (partition by user_id order by ts desc) as rn from demo.raw.events qualify rn = 1"),
    ("event_kinds", "events documents", "id kind", "select event_id as id, 'event' as kind from demo.raw.events union all select doc_id, 'document' from demo.raw.documents"),
    ("big_spenders", "orders customer", "o_custkey", "select o_custkey from demo.raw.orders where o_custkey in (select c_custkey from demo.raw.customer where c_acctbal > 0) group by o_custkey having sum(o_totalprice) > 100"),
    ("doc_keys", "documents", "doc_key lang_key", "select cast(md5(text) as varchar) as doc_key, coalesce(md5(lang), '-1') as lang_key from demo.raw.documents"),
    ("doc_labels", "documents labels", "doc_id quality", "select doc_id, quality from demo.raw.documents join demo.raw.labels using (doc_id)"),
    ("nation_tree", "nation", "id depth", "with recursive t as (select n_nationkey as id, 0 as depth from demo.raw.nation union all select id, depth + 1 from t where depth < 3) select id, depth from t"),
    ("spine", "", "n", "select seq4() as n from table(generator(rowcount => 10))"),
    ("star_edits", "region", "r_regionkey", "select * exclude (r_name) from demo.raw.region"),
    ("self_incremental", "events", "event_id ts", "select event_id, ts from demo.raw.events where ts > (select max(ts) from demo.main.self_incremental)"),
    ("behind_table", "part", "p_partkey p_name", "select p_partkey, p_brand from demo.raw.part"),
    ("broken_compile", "supplier", "s_suppkey s_name", "select from demo.raw.supplier"),
    ("thin_stage", "supplier", "s_suppkey s_acctbal", "with u as (select s_suppkey from demo.raw.supplier) select s_suppkey, s_acctbal from u"),
    ("undeclared_reader", "", "k", "select x.k from demo.elsewhere.things x"),
    ("best_line", "orders lineitem", "o_orderkey best", "select o_orderkey, (select max(l.l_quantity) from demo.raw.lineitem l where l.l_orderkey = o.o_orderkey) as best from demo.raw.orders o"),
    ("silent_macro", "nation", "", "select 1 as one"),
    ("which_doc", "documents labels", "doc_id quality", "select from demo.raw.documents"),
    ("carried_over", "", "total", "select total from demo.main.carried_over"),
    ("event_props", "events", "event_id prop", "select e.event_id, f.value as prop from demo.raw.events e, lateral flatten(input => parse_json(e.props)) f"),
)


def over_tables(columns_of) -> Project:
    """A project over the test tables; `columns_of` gives a table's columns, which stand for the catalog."""
    project = Project({}, "demo", "snowflake")
    for name in _TABLES:
        uid = f"source.demo.{name}"
        project.nodes[uid] = Node(uid, name, "source", "demo", relation=f"demo.raw.{name}")
        project.warehouse[uid] = [c.lower() for c in columns_of(name)]
    for name, parents, columns, sql in _MODELS:
        uid = f"model.demo.{name}"
        given = [f"{'source' if p in _TABLES else 'model'}.demo.{p}" for p in parents.split()]
        ephemeral = name.startswith("int_")
        project.nodes[uid] = Node(uid, name, "model", "demo", f"models/{name}.sql", "" if ephemeral else f"demo.main.{name}", "ephemeral" if ephemeral else "table", sql=sql, sql_source="manifest", parents=given)
        if columns:
            project.warehouse[uid] = columns.split()
    project.elsewhere.append(("source.demo.pages", "DEMO.RAW.PAGES", "STAGE.RAW.PAGES"))
    project.nodes = dict(sorted(project.nodes.items()))
    return project
