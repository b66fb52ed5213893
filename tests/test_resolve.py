"""The resolver on statements over an invented harbour, and what must stay the same when a statement is rewritten."""

import pytest

from tracewell.operators.resolve import resolve
from tracewell.queries import constructs
from tracewell.queries.lineage import construct_facts

LISTS = list(constructs.LISTS.items())
B, V, T = constructs.RELATIONS.values()


def found(sql):
    return resolve(sql, LISTS)


def edges(sql):
    return {(e["from_relation"].split(".")[-1].lower(), e["from_column"], e["to_column"], e["kind"]) for e in found(sql)["edges"]}


def indirect(sql):
    return {(i["relation"].split(".")[-1].lower(), i["column"], i["role"]) for i in found(sql)["indirect"]}


@pytest.mark.parametrize("family", list(constructs.FAMILIES))
def test_constructs_give_their_facts(spark, family):
    given = constructs.cases(family)
    rows = construct_facts(spark, [(c, sql) for c, sql, _ in given]).collect()
    assert sorted((r["construct"], r["fact"]) for r in rows) == sorted((c, fact) for c, _, facts in given for fact in facts)


def test_every_construct_has_one_name():
    names = [c for family in constructs.FAMILIES for c, _, _ in constructs.cases(family)]
    assert len(names) == len(set(names)) > 80


JOINED = f"select v.code, v.flag, l.berth, l.cargo_kg * 2 as double_kg from {V} v join {B} l on l.vessel_code = v.code where l.departed_at is null"


@pytest.mark.parametrize(
    "rewritten",
    [
        JOINED.replace("v.", "ship.").replace(f"{V} v", f"{V} ship").replace("l.", "call.").replace(f"{B} l", f"{B} as call"),
        f"select x.code, x.flag, y.berth, y.cargo_kg * 2 as double_kg from (select * from {V}) x join (select * from {B} where departed_at is null) y on y.vessel_code = x.code",
        f"with x as (select code, flag from {V}), y as (select berth, vessel_code, cargo_kg, departed_at from {B}) select code, flag, berth, cargo_kg * 2 as double_kg from x join y on vessel_code = code where departed_at is null",
        f"with all_in as ({JOINED}) select * from all_in",
        f"select code, flag, berth, cargo_kg * 2 as double_kg from {B} inner join {V} on code = vessel_code where departed_at is null",
        f"SELECT CODE, Flag, BERTH, Cargo_KG * 2 AS Double_Kg FROM {B.upper()} JOIN {V} ON CODE = VESSEL_CODE WHERE DEPARTED_AT IS NULL -- where tides.height_cm",
    ],
)
def test_rewriting_changes_no_fact(rewritten):
    assert edges(rewritten) == edges(JOINED) and indirect(rewritten) == indirect(JOINED)


def test_union_branches_can_be_swapped():
    one, two = f"select berth as place, sum(cargo_kg) as n from {B} group by 1", f"select upper(station) as place, height_cm as n from {T}"
    assert edges(f"{one} union all {two}") == edges(f"{two} union all {one}")


@pytest.mark.parametrize("depth", [1, 5, 40])
def test_the_loudest_role_and_the_steps_of_a_chain(depth):
    chain = ", ".join([f"c0 as (select max(height_cm) as h from {T})", *(f"c{i} as (select h + {i} as h from c{i - 1})" for i in range(1, depth + 1))])
    (edge,) = found(f"with {chain} select cast(h as int) as peak from c{depth}")["edges"]
    assert (edge["kind"], edge["expression"], edge["steps"]) == ("aggregate", "max(height_cm)", min(32, depth + 2))


def test_window_outranks_aggregate_and_ties_take_the_greater_text():
    assert edges(f"select sum(sum(cargo_kg)) over (order by berth) as running from {B} group by berth") == {("berth_log", "cargo_kg", "running", "window"), ("berth_log", "berth", "running", "window")}
    (edge,) = found(f"select x + y as z from (select cargo_kg * 2 as x, cargo_kg * 3 as y from {B})")["edges"]
    assert edge["expression"] == "x + y"


def test_rules_come_outermost_select_first_in_the_order_of_clauses():
    sql = f"""with late as (select vessel_code, berth, arrived_at from {B} where departed_at > arrived_at)
    select late.berth, count(*) as n from late join {V} v on v.code = late.vessel_code where v.flag = 'PA' group by late.berth having min(v.built_year) > 2000"""
    rules = [(r["clause"], r["text"]) for r in found(sql)["rules"]]
    assert [c for c, _ in rules if c != "WHERE"] == ["JOIN", "HAVING"]
    outer = [x for x in rules if x != ("WHERE", "departed_at > arrived_at")]
    assert outer == [("JOIN", "v.code = late.vessel_code"), ("WHERE", "v.flag = 'PA'"), ("HAVING", "min(v.built_year) > 2000")]


@pytest.mark.parametrize(
    ("sql", "places"),
    [
        (f"select berth from {B} order by cargo_kg", set()),
        (f"select distinct berth from {B} group by berth, cargo_kg", set()),
        (f"select l.berth from {B} l join {T} t on height = 1", {"join"}),
        (f"select l.berth from {B} l, {B} k where arrived_at is null", {"filter"}),
        (f"select l.berth from {B} l cross join {B} k qualify row_number() over (order by cargo_kg) = 1", {"qualify"}),
    ],
)
def test_names_that_bind_nowhere_are_counted(sql, places):
    facts = found(sql)
    assert {p for p in ("join", "filter", "qualify") if facts[f"unplaced_{p}"]} == places
    assert facts["indirect"] == []


@pytest.mark.parametrize(
    "inner",
    [
        f"select count(*) from {T} v where v.height_cm > 0",
        f"select count(*) from {T}, lateral flatten(input => measured_at) as v where v.value = 1",
        f"select max(v.height_cm) from ({T} as v join {B} on station = berth) where v.height_cm = 1",
    ],
)
def test_an_inner_name_hides_an_outer_one(inner):
    assert not any(x[0] == "vessels" for x in indirect(f"select v.code, ({inner}) as n from {V} as v"))


def test_a_cte_and_a_derived_table_see_no_outer_names():
    sql = f"select v.code, d.n from {V} v join (select count(*) as n, berth from {B} where vessel_code = v.code group by berth) d on d.berth = v.flag"
    assert ("vessels", "code", "filter") not in indirect(sql)
    lateral = sql.replace("join (select", "join lateral (select")
    assert ("vessels", "code", "filter") in indirect(lateral)


def test_outputs_keep_their_order_and_are_listed_sorted():
    facts = found(f"select station, height_cm as a, measured_at as m from {T}")
    assert facts["projection"] == ["station", "a", "m"] and facts["outputs"] == ["a", "m", "station"]


def test_relations_in_quotes_and_unknown_ones():
    facts = resolve('select "berth" from "Port"."raw"."Quay Log"', [('"Port"."raw"."Quay Log"', ["berth"])])
    assert facts["reads"] == ["PORT.RAW.QUAY LOG"] and not facts["approximate"]
    facts = resolve("select q.* from port.raw.quay q", LISTS)
    assert facts["approximate"] and facts["reads"] == ["PORT.RAW.QUAY"] and {i["code"] for i in facts["issues"]} >= {"UNRESOLVED_REFERENCE", "APPROXIMATE_LINEAGE"}
    assert resolve("select 1 as one from quay", [])["reads"] == []


@pytest.mark.parametrize("sql", ["", "select", f"select berth from {B} where", f"select {{{{ ref('x') }}}} from {B}", f"select * from {{{{ x }}}}", f"selec berth from {B}", f"select berth from {B} limit 3 3", "select '"])
def test_what_is_no_statement_says_where(sql):
    facts = found(sql)
    assert facts["parse_error"].startswith("PARSE_ERROR: ") and facts["edges"] == [] and facts["approximate"]
    low, high = facts["issues"][0]["span"]
    assert 0 <= low <= high <= max(len(sql), 1)


def test_a_star_behind_an_unlisted_relation_is_lost_with_a_word_on_it():
    facts = resolve("with a as (select * from port.raw.quay) select lamp from a", [*LISTS])
    assert [(x["column"], x["ends"][0]["reads"], x["ends"][0]["star"]) for x in facts["lost"]] == [("lamp", ["PORT.RAW.QUAY"], True)]
