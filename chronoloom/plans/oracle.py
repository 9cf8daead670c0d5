"""The queries of this library in DuckDB's SQL. Timestamps are cut to milliseconds by division, as ``epoch_ms`` rounds."""

from __future__ import annotations

from .queries import AT, EARLY, FROM, TO

FOREVER = 9223372036854775807
MS = "epoch_us(ts) // 1000"
TYPE = f"select event_id as seq, user_id, 'event_type' as attr, 6 as tag, cast(null as double) as f, event_type as s, {MS} as ts from events"
ALL = f"""{TYPE}
    union all select event_id, user_id, 'value', 4, value, null, {MS} from events
    union all select event_id, user_id, 'props', 7, null, props, {MS} from events"""


def runs(ops: str) -> str:
    """CTEs up to ``runs`` from a select of (seq, user_id, attr, tag, f, s, ts)."""
    return f"""
    with o as ({ops}),
    ded as (select * from o qualify row_number() over (partition by user_id, attr, ts order by seq desc) = 1),
    c as (select *, case when lag(tag) over w = tag and lag(f) over w is not distinct from f and lag(s) over w is not distinct from s then 0 else 1 end as chg
          from ded window w as (partition by user_id, attr order by ts)),
    i as (select *, sum(chg) over (partition by user_id, attr order by ts) as isl from c),
    r as (select user_id, attr, isl, min(ts) as first_seen, max(ts) as last_seen, min(tag) as tag, min(f) as f, min(s) as s from i group by user_id, attr, isl),
    runs as (select user_id, attr, first_seen, last_seen,
                    coalesce(lead(first_seen) over (partition by user_id, attr order by first_seen) - 1, {FOREVER}) as valid_to, tag, f, s from r)
    """


CUSTOMERS = "select r_name, n_name, c_mktsegment, c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def codes(field: str) -> str:
    return f"select {field} as value, cast(row_number() over (order by min(c_custkey), {field}) as integer) as code from ({CUSTOMERS}) group by {field}"


CODED = f"""with p as ({CUSTOMERS}), r as ({codes("r_name")}), n as ({codes("n_name")}), s as ({codes("c_mktsegment")}),
    k as (select r_name, n_name, c_mktsegment, c_custkey, r.code as r_name_code, n.code as n_name_code, s.code as c_mktsegment_code
          from p join r on r.value = r_name join n on n.value = n_name join s on s.value = c_mktsegment)"""
ONE = "user_id, first_seen, last_seen, valid_to, s as v"

ORACLE: dict[str, str] = {
    "runs_canonical": f"{runs(TYPE)} select {ONE} from runs",
    "compact_noop": f"{runs(TYPE)} select {ONE} from runs",
    "history": f"{runs(ALL)} select *, false as is_tombstone from runs",
    "history_range": f"{runs(ALL)} select * from runs where first_seen <= {TO} and valid_to >= {FROM}",
    "scan_overlap": f"{runs(ALL)} select * from runs where first_seen <= {TO} and valid_to >= {FROM}",
    "state_changes": f"""with o as ({TYPE}) select seq as event_id, user_id, s is distinct from lag(s) over (partition by user_id order by ts, seq) as changed from o""",
    "get_latest": f"with o as ({TYPE}) select user_id, attr, 6 as tag, cast(null as double) as f, arg_max(s, ts) as s from o group by user_id, attr",
    "get_at": f"{runs(TYPE)} select user_id, attr, first_seen, valid_to, tag, f, s from runs where first_seen <= {AT} and valid_to >= {AT}",
    "asof_batch": f"""with o as ({TYPE}), p as (select event_id, user_id, {MS} - 86400000 as probe_ts from events)
        select event_id, p.user_id, probe_ts, s as v from p asof left join o on p.user_id = o.user_id and p.probe_ts >= o.ts""",
    "neighbours": f"""{runs(TYPE)} select user_id, attr, max(first_seen) filter (where first_seen <= {AT}) as predecessor, min(first_seen) filter (where first_seen >= {AT}) as successor,
        min(first_seen) as leftmost, max(first_seen) as rightmost from runs group by user_id, attr""",
    "tombstone_asof": f"""with o as ({TYPE}), a as (select user_id, attr, arg_max(s, ts) as s from o where ts <= {AT} group by user_id, attr)
        select user_id, attr, 6 as tag, cast(null as double) as f, s from a where s <> 'error'""",
    "timeless_mix": f"""with o as (select c_custkey as user_id, 0 as ts, c_mktsegment as s from customer union all select user_id, {MS}, event_type from events),
        a as (select user_id, s, ts, row_number() over (partition by user_id order by ts desc) as k from o where ts <= {EARLY}),
        b as (select user_id, ts, s, lag(s) over (partition by user_id order by ts) as before from o where ts <= {EARLY}),
        starts as (select user_id, max(ts) as first_seen from b where before is distinct from s group by user_id)
        select user_id, 'state' as attr, first_seen, 6 as tag, cast(null as double) as f, s from a join starts using (user_id) where k = 1""",
    "clear_attr": f"""with o as ({TYPE}), a as (
            select user_id, attr, arg_max(s, ts) filter (where s <> 'error') as s, max(seq) filter (where s <> 'error') as put, max(seq) filter (where s = 'error') as cleared from o group by user_id, attr)
        select user_id, attr, 6 as tag, cast(null as double) as f, s from a where s is not null and (cleared is null or cleared < put)""",
    "delete_entity": f"""{runs(f"select t.* from ({TYPE}) t left join (select user_id, max(event_id) as dropped from events where event_type = 'signup' group by user_id) x on t.user_id = x.user_id where dropped is null or seq > dropped")} select * from runs""",
    "get_all": f"{runs(ALL)} select user_id, attr, tag, f, s from runs where valid_to = {FOREVER}",
    "get_all_at": f"{runs(ALL)} select user_id, attr, tag, f, s from runs where first_seen <= {AT} and valid_to >= {AT}",
    "versions": f"""{runs(ALL)}, points as (select user_id, t, coalesce(lead(t) over (partition by user_id order by t) - 1, {FOREVER}) as until from (select distinct user_id, first_seen as t from runs))
        select p.user_id, t as first_seen, until as valid_to, attr, tag, f, s from points p join runs r on p.user_id = r.user_id and t between r.first_seen and r.valid_to""",
    "ext_interval_join": f"""{runs(ALL)} select a.user_id, greatest(a.first_seen, b.first_seen) as overlap_from, least(a.valid_to, b.valid_to) as overlap_to, a.s as event_type, b.s as props
        from runs a join runs b on a.user_id = b.user_id and a.first_seen <= b.valid_to and b.first_seen <= a.valid_to where a.attr = 'event_type' and b.attr = 'props'""",
    "ext_time_weighted": f"""{runs(TYPE)} select user_id, cast(sum(least(valid_to, {TO - 1}) - greatest(first_seen, {FROM}) + 1) as bigint) as duration_ms, tag, f, s
        from runs where first_seen <= {TO - 1} and valid_to >= {FROM} group by user_id, tag, f, s""",
    "scan_all": f"{CODED} select * from k",
    "scan_prefix_1": f"{CUSTOMERS} where r_name = 'ASIA'",
    "scan_prefix_2": f"{CUSTOMERS} where r_name = 'ASIA' and n_name = 'NATION_7'",
    "scan_unsat": f"{CUSTOMERS} where false",
    "scan_bytes": f"""{CODED} select c_custkey, printf('%04X%04X%04X%08X', r_name_code, n_name_code, c_mktsegment_code, c_custkey) as key_hex
        from k where r_name_code = 1 and n_name_code = 1 and c_mktsegment_code = 1 and c_custkey < 65536""",
    "scan_prefix_first": f"select *, count(*) over () as n_matches from ({CUSTOMERS} where r_name = 'ASIA') order by r_name, n_name, c_mktsegment, c_custkey limit 20",
    "stats_samples": f"select *, count(*) over () as n_matches from (select distinct * from ({CUSTOMERS})) order by r_name, n_name, c_mktsegment, c_custkey limit 5",
    "dict_attributes": "select * from (values ('value', 1), ('event_type', 2), ('props', 3)) t(value, code)",
    "size": f"select count(*) as n_entities, count(*) = 0 as is_empty from (select distinct * from ({CUSTOMERS}))",
    "stats": " union all ".join(f"select '{x}' as field, count(*) as size, max(code) + 1 as next_code, (select count(*) from ({CUSTOMERS})) as n_entities from ({codes(x)})" for x in ("r_name", "n_name", "c_mktsegment")),
    "dict_build": " union all ".join(f"select '{x}' as field, value, code from ({codes(x)})" for x in ("r_name", "n_name", "c_mktsegment")),
    "dict_resolve": f"""with d as ({codes("n_name")}), n as (select n_name from nation union all select 'ATLANTIS' union all select null)
        select n_name, case when n_name is null then 0 else coalesce(code, -1) end as code from n left join d on value = n_name""",
    "dict_reverse": f"with d as ({codes('c_mktsegment')}) select cast(g.code as integer) as code, value from (select unnest(generate_series(0, 7)) as code) g left join d on d.code = g.code",
    "ingest_cells": """
        select o_orderkey, 'o_orderstatus' as attr, epoch_us(o_orderdate) // 1000 as ts, 6 as tag, cast(null as bigint) as i, cast(null as double) as f, o_orderstatus as s from orders where o_orderstatus is not null
        union all select o_orderkey, 'o_totalprice', epoch_us(o_orderdate) // 1000, 4, null, o_totalprice, null from orders where o_totalprice is not null
        union all select o_orderkey, 'o_orderdate', epoch_us(o_orderdate) // 1000, 2, epoch_us(o_orderdate) // 1000, null, null from orders where o_orderdate is not null
        union all select o_orderkey, 'o_orderpriority', epoch_us(o_orderdate) // 1000, 6, null, null, o_orderpriority from orders where o_orderpriority is not null""",
    "json_roundtrip": r"""select doc_id, '["' || lang || '",null,"' || source || '","a \"quote\""]' as json, '[]' as empty_json, cast(4 as bigint) as n, true as null_kept, true as same from documents""",
    "roundtrip_verify": "select count(*) as n_rows, count(*) * 4 as n_cells, cast(0 as bigint) as n_mismatches from orders",
}
