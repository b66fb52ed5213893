"""Statements over an invented harbour, one or more for each construct, with the facts that the resolver has to find in them.

Facts tell what a column comes from and how, what decides rows, rules, literals, and what can't be
told. They were noted from a run and then checked by hand, one by one, against the statements. B, V
and T stand for the three relations.
"""

from __future__ import annotations

RELATIONS = {"B": "port.raw.berth_log", "V": "port.raw.vessels", "T": "port.raw.tides"}
LISTS = {
    "port.raw.berth_log": ["vessel_code", "berth", "arrived_at", "departed_at", "cargo_kg"],
    "port.raw.vessels": ["code", "flag", "built_year", "owner_name", "papers"],
    "port.raw.tides": ["station", "measured_at", "height_cm"],
}


PROJECTION = r"""
A1 | select berth from {B}
    passthrough berth_log.berth > berth
    columns berth
A2 | select * from {T}
    passthrough tides.height_cm > height_cm
    passthrough tides.measured_at > measured_at
    passthrough tides.station > station
    columns station, measured_at, height_cm
A2b | select t.*, v.flag from {T} t cross join {V} v
    passthrough vessels.flag > flag
    passthrough tides.height_cm > height_cm
    passthrough tides.measured_at > measured_at
    passthrough tides.station > station
    columns station, measured_at, height_cm, flag
A3 | with a as (select * from {T}), b as (select a.* from a) select * from b
    passthrough tides.height_cm > height_cm
    passthrough tides.measured_at > measured_at
    passthrough tides.station > station
    columns station, measured_at, height_cm
A4 | select * exclude (papers, owner_name) rename (code as vessel) replace (lower(flag) as flag) from {V}
    passthrough vessels.built_year > built_year
    transform vessels.flag > flag
    rename vessels.code > vessel
    columns vessel, flag, built_year
A4b | select * ilike '%year' from {V}
    passthrough vessels.built_year > built_year
    columns built_year
A5 | select code, flag as country from {V}
    passthrough vessels.code > code
    rename vessels.flag > country
    columns code, country
A6 | select height_cm / 100 + 1 as metres from {T}
    transform tides.height_cm > metres
    columns metres
A7 | select upper(flag) from {V}
    transform vessels.flag > upper(flag)
    columns upper(flag)
A8 | select berth from {B} where cargo_kg > 1000 and departed_at is null
    passthrough berth_log.berth > berth
    filter berth_log.cargo_kg
    filter berth_log.departed_at
    rule WHERE cargo_kg > 1000 AND departed_at IS NULL
    columns berth
A9 | select berth, avg(cargo_kg) as mean_kg from {B} group by berth having count(departed_at) > 3
    passthrough berth_log.berth > berth
    aggregate berth_log.cargo_kg > mean_kg
    filter berth_log.departed_at
    rule HAVING count(departed_at) > 3
    columns berth, mean_kg
A10 | select vessel_code from {B} qualify row_number() over (partition by vessel_code order by arrived_at desc) = 1
    passthrough berth_log.vessel_code > vessel_code
    dedup_key berth_log.arrived_at
    dedup_key berth_log.vessel_code
    rule QUALIFY row_number() OVER (PARTITION BY vessel_code ORDER BY arrived_at DESC) = 1
    columns vessel_code
A10b | select berth, dense_rank() over (order by cargo_kg) as place from {B} qualify place < 4
    passthrough berth_log.berth > berth
    window berth_log.cargo_kg > place
    dedup_key berth_log.cargo_kg
    rule QUALIFY place < 4
    columns berth, place
A14 | with t as (with t as (select berth from {B}) select berth as pier from t) select pier from t
    rename berth_log.berth > pier
    merged cte t 2
    columns pier
A15 | with recursive d as (select height_cm as h, measured_at from {T} union all select h - 10, measured_at from d where h > 0) select h, measured_at from d
    transform tides.height_cm > h
    passthrough tides.measured_at > measured_at
    filter tides.height_cm
    partial h steps_capped h
    rule WHERE h > 0
    columns h, measured_at
A16 | select pier from (select berth as pier from {B}) q
    rename berth_log.berth > pier
    columns pier
A16b | select pier from (select berth as pier from {B})
    rename berth_log.berth > pier
    columns pier
A17 | select c as code, n + 1 as n from (values ('x', 1), ('y', 2)) as w(c, n)
    root code =
    root n =
    columns code, n
A18 | select distinct flag, built_year from {V}
    passthrough vessels.built_year > built_year
    passthrough vessels.flag > flag
    columns flag, built_year
A18b | select flag from {V} group by flag, built_year
    passthrough vessels.flag > flag
    columns flag
S1 | select code from {V} order by built_year desc limit 5
    passthrough vessels.code > code
    columns code
A4c | select top (5) [l].[berth] from [port].[raw].[berth_log] as l where [l].[cargo_kg] > 0
    passthrough berth_log.berth > berth
    filter berth_log.cargo_kg
    rule WHERE "l"."cargo_kg" > 0
    columns berth
"""

SUBQUERIES = r"""
A11 | select code from {V} where code in (select vessel_code from {B} where berth = 'N1')
    passthrough vessels.code > code
    filter berth_log.berth
    filter berth_log.vessel_code
    filter vessels.code
    rule WHERE code IN (SELECT vessel_code FROM {B} WHERE berth = 'N1')
    rule WHERE berth = 'N1'
    columns code
A11b | select station from {T} where height_cm > (select avg(height_cm) from {T})
    passthrough tides.station > station
    filter tides.height_cm
    rule WHERE height_cm > (SELECT avg(height_cm) FROM {T})
    columns station
A12 | select v.flag from {V} v where exists (select 1 from {B} l where l.vessel_code = v.code)
    passthrough vessels.flag > flag
    filter berth_log.vessel_code
    filter vessels.code
    rule WHERE l.vessel_code = v.code
    columns flag
A12b | select v.flag from {V} v where exists (select 1 from {B} v where v.berth = 'N1')
    passthrough vessels.flag > flag
    filter berth_log.berth
    rule WHERE v.berth = 'N1'
    columns flag
A13 | select v.code, (select max(l.arrived_at) from {B} l where l.vessel_code = v.code) as last_call from {V} v
    passthrough vessels.code > code
    aggregate berth_log.arrived_at > last_call
    filter berth_log.vessel_code
    filter vessels.code
    rule WHERE l.vessel_code = v.code
    columns code, last_call
"""

JOINS = r"""
J1 | select l.berth, v.flag from {B} l join {V} v on l.vessel_code = v.code
    passthrough berth_log.berth > berth
    passthrough vessels.flag > flag
    join_key berth_log.vessel_code
    join_key vessels.code
    rule JOIN l.vessel_code = v.code
    columns berth, flag
J2 | select l.berth, coalesce(v.flag, '??') as flag from {B} l left join {V} v on l.vessel_code = v.code and v.built_year > 1990
    passthrough berth_log.berth > berth
    transform vessels.flag > flag
    join_key berth_log.vessel_code
    join_key vessels.built_year
    join_key vessels.code
    rule JOIN l.vessel_code = v.code AND v.built_year > 1990
    columns berth, flag
J3 | select v.code from {B} l right outer join {V} v on v.code = l.vessel_code
    passthrough vessels.code > code
    join_key berth_log.vessel_code
    join_key vessels.code
    rule JOIN v.code = l.vessel_code
    columns code
J4 | select coalesce(l.vessel_code, v.code) as code from {B} l full join {V} v on v.code = l.vessel_code
    transform berth_log.vessel_code > code
    transform vessels.code > code
    join_key berth_log.vessel_code
    join_key vessels.code
    rule JOIN v.code = l.vessel_code
    columns code
J5 | select l.berth, t.station from {B} l cross join {T} t
    passthrough berth_log.berth > berth
    passthrough tides.station > station
    columns berth, station
J6 | select code from {V} left semi join {B} on code = vessel_code
    passthrough vessels.code > code
    join_key berth_log.vessel_code
    join_key vessels.code
    rule JOIN code = vessel_code
    columns code
J7 | select code from {V} left anti join {B} on code = vessel_code
    passthrough vessels.code > code
    join_key berth_log.vessel_code
    join_key vessels.code
    rule JOIN code = vessel_code
    columns code
J8 | select l.berth from {B} l straight_join {V} v on l.vessel_code = v.code
    passthrough berth_log.berth > berth
    join_key berth_log.vessel_code
    join_key vessels.code
    rule JOIN l.vessel_code = v.code
    columns berth
J9 | select l.berth, t.height_cm from {B} l asof join {T} t match_condition (l.arrived_at >= t.measured_at) on l.berth = t.station
    passthrough berth_log.berth > berth
    passthrough tides.height_cm > height_cm
    join_key berth_log.berth
    join_key tides.station
    rule JOIN l.berth = t.station
    columns berth, height_cm
J10 | select * from (select code, flag from {V}) a natural join (select vessel_code as code, berth from {B}) b
    passthrough berth_log.berth > berth
    passthrough vessels.code > code
    passthrough vessels.flag > flag
    columns code, flag, berth
J10b | select code, berth from (select code, flag from {V}) a join (select vessel_code as code, berth from {B}) b using (code)
    passthrough berth_log.berth > berth
    passthrough vessels.code > code
    join_key berth_log.vessel_code
    join_key vessels.code
    rule JOIN USING (code)
    columns code, berth
J11 | select l.berth, v.flag from {B} l, {V} v where v.code = l.vessel_code
    passthrough berth_log.berth > berth
    passthrough vessels.flag > flag
    filter berth_log.vessel_code
    filter vessels.code
    rule WHERE v.code = l.vessel_code
    columns berth, flag
J12 | select v.code, t.height_cm from {V} v join ({B} l join {T} t on l.berth = t.station) on v.code = l.vessel_code
    passthrough vessels.code > code
    passthrough tides.height_cm > height_cm
    join_key berth_log.berth
    join_key berth_log.vessel_code
    join_key tides.station
    join_key vessels.code
    rule JOIN l.berth = t.station
    rule JOIN v.code = l.vessel_code
    columns code, height_cm
J13 | select v.code, k.n from {V} v, lateral (select count(l.berth) as n from {B} l where l.vessel_code = v.code) k
    passthrough vessels.code > code
    aggregate berth_log.berth > n
    filter berth_log.vessel_code
    filter vessels.code
    rule WHERE l.vessel_code = v.code
    columns code, n
J14 | select l.berth, t.height_cm from {B} l join {T} t on t.measured_at between l.arrived_at and l.departed_at
    passthrough berth_log.berth > berth
    passthrough tides.height_cm > height_cm
    join_key berth_log.arrived_at
    join_key berth_log.departed_at
    join_key tides.measured_at
    rule JOIN t.measured_at BETWEEN l.arrived_at AND l.departed_at
    columns berth, height_cm
"""

AGGREGATES = r"""
G1 | select berth, sum(cargo_kg) / 1000 as tonnes, median(cargo_kg) as mid from {B} group by berth
    passthrough berth_log.berth > berth
    aggregate berth_log.cargo_kg > mid
    aggregate berth_log.cargo_kg > tonnes
    columns berth, tonnes, mid
G2 | select count(distinct vessel_code) as callers from {B}
    aggregate berth_log.vessel_code > callers
    columns callers
G3 | select sum(case when flag = 'PA' then built_year else 0 end) as y from {V}
    aggregate vessels.built_year > y
    aggregate vessels.flag > y
    columns y
G4 | select count(*) as calls, berth from {B} group by berth
    passthrough berth_log.berth > berth
    root calls = count(*)
    columns calls, berth
G4b | select hash(*) as fingerprint from {T}
    hash tides.height_cm > fingerprint
    hash tides.measured_at > fingerprint
    hash tides.station > fingerprint
    columns fingerprint
G5 | select listagg(berth, '+') within group (order by arrived_at) as route from {B}
    aggregate berth_log.arrived_at > route
    aggregate berth_log.berth > route
    columns route
G5b | select array_agg(berth order by arrived_at desc) as route from {B}
    aggregate berth_log.arrived_at > route
    aggregate berth_log.berth > route
    columns route
G6 | select station, max(height_cm) as top, grouping(station) as level from {T} group by rollup (station)
    aggregate tides.station > level
    passthrough tides.station > station
    aggregate tides.height_cm > top
    columns station, top, level
"""

WINDOWS = r"""
W1 | select avg(height_cm) over (partition by station) as level from {T}
    window tides.height_cm > level
    window tides.station > level
    columns level
W2 | select lag(t.height_cm) over (partition by t.station order by t.measured_at) as before from {T} t join {V} v on v.code = t.station
    window tides.height_cm > before
    window tides.measured_at > before
    window tides.station > before
    join_key tides.station
    join_key vessels.code
    rule JOIN v.code = t.station
    columns before
W3 | select first_value(berth) over w as home from {B} window w as (partition by vessel_code order by arrived_at)
    window berth_log.arrived_at > home
    window berth_log.berth > home
    window berth_log.vessel_code > home
    columns home
W4 | select sum(cargo_kg) over (order by arrived_at rows between 2 preceding and current row) as recent from {B}
    window berth_log.arrived_at > recent
    window berth_log.cargo_kg > recent
    columns recent
W5 | select row_number() over () as n, ntile(4) over (order by built_year) as quarter from {V}
    window vessels.built_year > quarter
    root n = row_number() OVER ()
    columns n, quarter
"""

SETS = r"""
U1 | select berth as place from {B} union all select station from {T}
    rename berth_log.berth > place
    rename tides.station > place
    columns place
U1b | select 'berth' as kind, berth as place from {B} union select 'gauge', upper(station) from {T}
    rename berth_log.berth > place
    transform tides.station > place
    root kind = 'berth', 'gauge'
    columns kind, place
U2 | select berth, cargo_kg from {B} union all by name select height_cm as cargo_kg, station as berth from {T}
    passthrough berth_log.berth > berth
    rename tides.station > berth
    passthrough berth_log.cargo_kg > cargo_kg
    rename tides.height_cm > cargo_kg
    columns berth, cargo_kg
U3 | select berth from {B} intersect select station from {T}
    passthrough berth_log.berth > berth
    rename tides.station > berth
    columns berth
U3b | select berth from {B} except select station from {T} where height_cm < 0
    passthrough berth_log.berth > berth
    filter tides.height_cm
    filter tides.station
    rule WHERE height_cm < 0
    columns berth
U4 | (select code from {V}) union all (select vessel_code from {B} order by arrived_at limit 3)
    rename berth_log.vessel_code > code
    passthrough vessels.code > code
    columns code
"""

GENERATORS = r"""
F1 | select v.code, f.value as paper, f.index as n, f.seq + 1 as s from {V} v, lateral flatten(input => v.papers) f
    passthrough vessels.code > code
    transform vessels.papers > paper
    root n =
    root s =
    columns code, paper, n, s
F2 | select f.value::string as paper from {V} v, table(flatten(input => parse_json(v.papers))) f
    transform vessels.papers > paper
    columns paper
F3 | select v.code, p.paper from {V} v lateral view explode(v.papers) p as paper
    passthrough vessels.code > code
    transform vessels.papers > paper
    columns code, paper
F3b | select v.code, paper from {V} v cross join unnest(v.papers) as u(paper)
    passthrough vessels.code > code
    transform vessels.papers > paper
    columns code, paper
F3c | select j.kind from {V} v, json_table(v.papers, '$[*]' columns (kind varchar(10) path '$.kind')) j
    transform vessels.papers > kind
    columns kind
F3d | select j.kind from {V} v cross apply openjson(v.papers) with (kind varchar(10) '$.kind') j
    transform vessels.papers > kind
    columns kind
F3e | select x.kind from {V} v, xmltable('/p' passing v.papers columns kind varchar(10) path 'k') x
    transform vessels.papers > kind
    columns kind
F4 | select seq4() as n, uniform(1, 6, random()) as dice from table(generator(rowcount => 10))
    root dice = uniform(1, 6, random())
    root n = seq4()
    columns n, dice
F5 | select * from (select berth, vessel_code, cargo_kg from {B}) pivot (sum(cargo_kg) for berth in ('n1', 's2')) as p
    aggregate berth_log.berth > n1
    aggregate berth_log.cargo_kg > n1
    aggregate berth_log.berth > s2
    aggregate berth_log.cargo_kg > s2
    passthrough berth_log.vessel_code > vessel_code
    columns vessel_code, n1, s2
F5b | select * from (select station, height_cm from {T}) unpivot (reading for what in (height_cm)) as u
    rename tides.height_cm > reading
    passthrough tides.station > station
    root what = 'height_cm'
    columns station, what, reading
F5c | select * from {T} match_recognize (partition by station order by measured_at measures last(up.height_cm) as peak one row per match pattern (strt up+) define up as height_cm > prev(height_cm))
    transform tides.height_cm > peak
    passthrough tides.station > station
    filter tides.height_cm
    filter tides.measured_at
    filter tides.station
    columns station, peak
F6 | select cast(built_year as varchar) as y, try_cast(code as int) as c, flag::char(2) as f, (code)::int + 1 as k from {V}
    cast vessels.code > c
    cast vessels.flag > f
    transform vessels.code > k
    cast vessels.built_year > y
    columns y, c, f, k
F7 | select md5(owner_name) as k, cast(sha2(code, 256) as varchar) as c, concat(md5(flag), '!') as x from {V}
    hash vessels.code > c
    hash vessels.owner_name > k
    transform vessels.flag > x
    columns k, c, x
F8 | select case when height_cm > 100 then 'high' else station end as label, date_trunc('day', measured_at) as day from {T}
    transform tides.measured_at > day
    transform tides.height_cm > label
    transform tides.station > label
    columns label, day
F9 | select current_date() as today, 'harbour' as place, null::varchar as note, -1.5 as shift, code from {V}
    passthrough vessels.code > code
    root note = NULL::VARCHAR
    root place = 'harbour'
    root shift = -1.5
    root today = current_date()
    columns today, place, note, shift, code
F10 | select transform(papers, p -> p || code) as stamped from {V}
    transform vessels.code > stamped
    transform vessels.papers > stamped
    columns stamped
F11 | select papers:kind::string as kind, v.papers.issued.by as issuer from {V} v
    rename vessels.papers > issuer
    transform vessels.papers > kind
    columns kind, issuer
F11b | select struct(code as id, flag) as ship from {V}
    transform vessels.code > ship
    transform vessels.flag > ship
    columns ship
F5d | select * from (select berth, vessel_code, cargo_kg from {B}) pivot (sum(cargo_kg) for berth in (any order by berth)) as p
    passthrough berth_log.vessel_code > vessel_code
    columns vessel_code
"""

GAPS = r"""
B14 | with a as (select * from {V}), b as (select * from {V}) select lower(flag) as flag, a.code from a cross join b
    passthrough vessels.code > code
    lost flag
    columns flag, code
B15 | select l.cargo_kg + sum(l.cargo_kg) over (order by z.nowhere) as n from {B} l
    window berth_log.cargo_kg > n
    partial n window_key_unbound nowhere
    columns n
B15b | with c as (select berth, cargo_kg from {B}) select c.cargo_kg * c.rate as fee from c
    transform berth_log.cargo_kg > fee
    partial fee cte_lacks_name rate
    unbacked fee c.rate of
    columns fee
B16 | with c as (select berth, 'eur' as money from {B}), d as (select money, sha1(vessel_code) as k from c) select * from d
    root money = 'eur'
    lost k
    unbacked k c.vessel_code of berth_log
    columns money, k
B17 | select tonnage from {V}
    passthrough vessels.tonnage > tonnage
    unknown vessels.tonnage
    columns tonnage
B18 | select x.berth from (select berth from {B}) x join (select x.station from (select station from {T}) x) y on x.berth = y.station
    passthrough berth_log.berth > berth
    join_key berth_log.berth
    join_key tides.station
    merged derived x 2
    rule JOIN x.berth = y.station
    columns berth
B20 | select from {V}
    parse error at 12
B20b | select {{ columns }} from {V}
    parse error at 7
B20c | select code from {V} where (flag = 'PA'
    parse error at 52
"""

FAMILIES = {"projection": PROJECTION, "subqueries": SUBQUERIES, "joins": JOINS, "aggregates": AGGREGATES, "windows": WINDOWS, "sets": SETS, "generators": GENERATORS, "gaps": GAPS}


def cases(family: str) -> list[tuple[str, str, list[str]]]:
    """(construct, statement, facts) of a family."""

    def named(text: str) -> str:
        for letter, relation in RELATIONS.items():
            text = text.replace(f"{{{letter}}}", relation)
        return text

    out: list[tuple[str, str, list[str]]] = []
    for line in FAMILIES[family].strip().splitlines():
        if line.startswith("    "):
            out[-1][2].append(named(line.strip()))
        else:
            construct, sql = line.split(" | ", 1)
            out.append((construct, named(sql), []))
    return out
