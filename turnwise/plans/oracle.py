"""DuckDB SQL for the queries of the catalog, written from their definitions."""

from __future__ import annotations

import math

from . import leak_sql, mixed_sql, prompt_sql, vector_sql, what_if_sql
from .base_sql import base as _base

_HOPS = """, h1 as (select distinct graph_id, src as source, dst as node_id, 1 as depth from adj
), h2 as (select distinct h1.graph_id, source, dst as node_id, 2 as depth from h1 join adj on adj.graph_id = h1.graph_id and src = node_id
), h3 as (select distinct h2.graph_id, source, dst as node_id, 3 as depth from h2 join adj on adj.graph_id = h2.graph_id and src = node_id
), hops2 as (select graph_id, source, node_id, min(depth) as depth from (from h1 union all from h2) where node_id <> source group by all
), hops3 as (select graph_id, source, node_id, min(depth) as depth from (from h1 union all from h2 union all from h3) where node_id <> source group by all)"""

_PATHS = """, walk as (
  select graph_id, node_id as source, node_id as node, 0.0::double as cost, [node_id] as path from nodes where status = 'open'
  union all
  select w.graph_id, source, dst, cost + weight, list_append(path, dst) from walk w join oadj a on a.graph_id = w.graph_id and a.src = w.node where not list_contains(path, dst)
), best as (
  select graph_id, source, node as target, cost, path from (select *, row_number() over (partition by graph_id, source, node order by cost, path) as r from walk) where r = 1
)"""

_SAYINGS = {
    "SET_CLOSED": ("{x} is closed now.", "Service at {x} has been suspended.", "Please mark {x} as closed."),
    "SET_OPEN": ("{x} has reopened.", "Service at {x} has resumed.", "Please mark {x} as open."),
    "ADD": ("A new {r} link now connects {x} and {y}.", "A {r} connection between {x} and {y} has opened.", "Please add a {r} edge between {x} and {y}."),
    "DEL": ("The {r} link between {x} and {y} is gone.", "The {r} connection between {x} and {y} has closed.", "Please remove the {r} edge between {x} and {y}."),
}
_SILENCES = (
    ("No change this turn.", "Nothing to update on the graph.", "Leave the network as it is."),
    ("Operations report: no network changes.", "Service bulletin: status quo maintained.", "No suspension or reopening this turn."),
    ("Please make no changes to the graph.", "Hold the current network state.", "Do not apply any edit this turn."),
)


def _filled(t: str, names: dict[str, str]) -> str:
    parts = []
    for i, piece in enumerate(t.replace("}", "{").split("{")):
        if piece:
            parts.append(names[piece] if i % 2 else "'" + piece.replace("'", "''") + "'")
    return " || ".join(parts)


def _saying() -> str:
    names = {"x": "x.label", "y": "y.label", "r": "t.relation"}
    said = " ".join(f"when op = '{op}' and session_id % 3 = {i} then {_filled(t, names)}" for op, ways in _SAYINGS.items() for i, t in enumerate(ways))
    none = " ".join(f"when session_id % 3 = {i} and event_id % 3 = {j} then '{t}'" for i, ways in enumerate(_SILENCES) for j, t in enumerate(ways))
    return f"case {said} {none} end"


_KINDS = ("shortest_path", "reachability", "filtered_neighbor_count", "filtered_path_count", "cycle_membership", "edge_exists", "node_degree", "node_count", "path_cost", "link_prediction", "constrained_reachability", "within_hops_count", "within_hops_list", "most_common_attribute_within_hops", "attribute_lookup", "attribute_check")
_PAIRS = "('shortest_path', 'reachability', 'filtered_path_count', 'edge_exists', 'path_cost', 'link_prediction', 'constrained_reachability')"

_TURNS = """, numbered as (
  select *, row_number() over (partition by user_id order by ts, event_id) - 1 as turn_index from events
), raw as (
  select user_id as session_id, turn_index, graph_id, event_id, event_type,
         cast(json_extract_string(props, '$.k') as bigint) % 25 as x, event_id % 25 as y
  from numbered join gids on user_id % 25 = gi
), turns0 as (
  select session_id, turn_index, graph_id, event_id, 'n' || x as a, 'n' || y as b,
         case when x = y then 'NOOP' else case event_type when 'error' then 'SET_CLOSED' when 'signup' then 'SET_OPEN' when 'purchase' then 'ADD' when 'click' then 'DEL' else 'NOOP' end end as op
  from raw
), nth as (
  select graph_id, src, dst, row_number() over (partition by graph_id order by src, dst) - 1 as ordinal, count(*) over (partition by graph_id) as n_edges from edges
), turns1 as (
  select t.*, case op when 'ADD' then least(a, b) when 'DEL' then least(src, dst) end as lo,
         case op when 'ADD' then greatest(a, b) when 'DEL' then greatest(src, dst) end as hi
  from turns0 t left join nth e on op = 'DEL' and e.graph_id = t.graph_id and ordinal = event_id % n_edges
), turns as (
  select t.*, case when x.line = y.line then 'track' when x.line <> y.line then 'transfer' end as relation
  from turns1 t left join nodes x on x.graph_id = t.graph_id and x.node_id = t.lo left join nodes y on y.graph_id = t.graph_id and y.node_id = t.hi
), upairs as (select distinct graph_id, least(src, dst) as lo, greatest(src, dst) as hi from edges
), ends as (select session_id, graph_id, max(turn_index) + 1 as n_turns from turns group by 1, 2
), ring as (
  select session_id, coalesce(lead(graph_id) over (order by session_id), first_value(graph_id) over (order by session_id)) as other from (select distinct session_id, graph_id from turns)
), asked0 as (
  select t.*, other, [""" + ", ".join(f"'{k}'" for k in _KINDS) + """][(session_id + turn_index) % 16 + 1] as kind from turns t join ring using (session_id)
), asked as (
  select *, a as source, case when kind in """ + _PAIRS + """ then b end as target,
    case when kind in ('filtered_neighbor_count', 'filtered_path_count', 'attribute_check') or (kind in ('within_hops_count', 'within_hops_list') and event_id % 4 <> 3) then ['has_rail', 'status', 'cleanliness'][event_id % 3 + 1]
         when kind = 'constrained_reachability' then ['has_rail', 'status'][event_id % 2 + 1]
         when kind in ('most_common_attribute_within_hops', 'attribute_lookup') then ['line', 'status', 'cleanliness'][event_id % 3 + 1] end as attribute,
    case when kind in ('filtered_neighbor_count', 'filtered_path_count', 'attribute_check') or (kind in ('within_hops_count', 'within_hops_list') and event_id % 4 <> 3) then ['True', 'closed', 'dirty'][event_id % 3 + 1]
         when kind = 'constrained_reachability' then ['False', 'closed'][event_id % 2 + 1] end as value,
    case when kind in ('within_hops_count', 'within_hops_list', 'most_common_attribute_within_hops') then event_id % 4 end as hops
  from asked0
), said as (
  select t.*, ['direct', 'service', 'notice'][session_id % 3 + 1] as family, """ + _saying() + """ as utterance
  from turns t left join nodes x on x.graph_id = t.graph_id and x.node_id = case when op = 'DEL' then t.lo else t.a end
  left join nodes y on y.graph_id = t.graph_id and y.node_id = case when op = 'DEL' then t.hi else t.b end
), hits as (
  select s.session_id, s.turn_index, arg_min(n.node_id, n.nk) as hit, case when lower(min(utterance)) similar to '.*(closed|suspended).*' then 'closed' else 'open' end as status
  from said s join nodes n on n.graph_id = s.graph_id and contains(lower(utterance), lower(n.label))
  where lower(utterance) similar to '.*(closed|suspended|open|resumed).*' group by 1, 2
), guess as (
  select t.session_id, t.turn_index, t.graph_id, t.event_id, coalesce(hit, t.a) as a, t.b, case when hit is null then 'NOOP' when h.status = 'closed' then 'SET_CLOSED' else 'SET_OPEN' end as op,
         null::varchar as lo, null::varchar as hi, null::varchar as relation
  from turns t left join hits h using (session_id, turn_index)
)"""


def _states(p: str, turns: str) -> str:
    """The graphs as of every turn of a table of turns: {p}sn, {p}se, and {p}mv, the applied operations with their intervals."""
    return f""", {p}k as (
  select t.*, case when op like 'SET%' then 'n:' || t.a when op in ('ADD', 'DEL') then 'e:' || t.lo || '-' || t.hi end as key, op in ('SET_OPEN', 'ADD') as goal,
    case when op like 'SET%' then n.status = 'open' else u.lo is not null end as beg
  from {turns} t left join nodes n on n.graph_id = t.graph_id and n.node_id = t.a left join upairs u on u.graph_id = t.graph_id and u.lo = t.lo and u.hi = t.hi
), {p}b as (select *, coalesce(lag(goal) over (partition by session_id, key order by turn_index), beg) as before from {p}k
), {p}mv as (
  select *, turn_index as from_turn, lead(turn_index) over (partition by session_id, key order by turn_index) as to_turn from {p}b where op <> 'NOOP' and before <> goal
), {p}sp as (
  select m.session_id, m.graph_id, m.key, m.a, m.lo, m.hi, m.goal, m.beg, m.relation, unnest(range(from_turn, coalesce(to_turn, n_turns))) as turn_index from {p}mv m join ends using (session_id)
), {p}se as (
  select t.session_id, t.turn_index, least(e.src, e.dst) as lo, greatest(e.src, e.dst) as hi, e.relation, case when s.goal then 1.0 else e.weight end as weight
  from (select distinct session_id, turn_index, graph_id from {turns}) t join edges e on e.graph_id = t.graph_id
  left join {p}sp s on s.session_id = t.session_id and s.turn_index = t.turn_index and s.lo = least(e.src, e.dst) and s.hi = greatest(e.src, e.dst) and s.key like 'e:%' where coalesce(s.goal, true)
  union all select session_id, turn_index, lo, hi, relation, 1.0 from {p}sp where key like 'e:%' and goal and not beg
), {p}sn as (
  select t.session_id, t.turn_index, n.* replace (case when s.goal is null then n.status when s.goal then 'open' else 'closed' end as status)
  from {turns} t join nodes n on n.graph_id = t.graph_id left join {p}sp s on s.session_id = t.session_id and s.turn_index = t.turn_index and s.key = 'n:' || n.node_id
)"""


def _val(m: str) -> str:
    return f"case q.attribute when 'has_rail' then case when {m}.has_rail then 'True' else 'False' end when 'status' then {m}.status when 'cleanliness' then {m}.cleanliness when 'line' then {m}.line end"


_ANSWERS = _states("", "turns") + _states("p", "guess") + """, gn as (
  select graph_id as g, nodes.* exclude (graph_id) from nodes
  union all select session_id || ':' || turn_index, sn.* exclude (session_id, turn_index, graph_id) from sn
  union all select 'p' || session_id || ':' || turn_index, psn.* exclude (session_id, turn_index, graph_id) from psn
), ge0 as (
  select graph_id as g, src, dst, weight from edges
  union all select session_id || ':' || turn_index, lo, hi, weight from se
  union all select 'p' || session_id || ':' || turn_index, lo, hi, weight from pse
), ge as (select g, src, dst, weight from ge0 union all select g, dst, src, weight from ge0
), goe as (
  select ge.* from ge join gn x on x.g = ge.g and x.node_id = src and x.status = 'open' join gn y on y.g = ge.g and y.node_id = dst and y.status = 'open'
), q as (
  select session_id, turn_index, kind, source, target, attribute, value, coalesce(nullif(hops, 0), 2) as hops,
    unnest(['gold', 'stale', 'initial', 'shuffled', 'predicted']) as role,
    unnest([session_id || ':' || turn_index, case when turn_index = 0 then graph_id else session_id || ':' || (turn_index - 1) end, graph_id, other, 'p' || session_id || ':' || turn_index]) as g
  from asked
), hop1 as (select distinct ge.g, src as source, dst as node_id, 1 as depth from ge join (select distinct g, source from q where hops is not null and kind in ('within_hops_count', 'within_hops_list', 'most_common_attribute_within_hops')) w on w.g = ge.g and w.source = ge.src
), hop2 as (select distinct h.g, source, dst as node_id, 2 as depth from hop1 h join ge on ge.g = h.g and src = node_id
), hop3 as (select distinct h.g, source, dst as node_id, 3 as depth from hop2 h join ge on ge.g = h.g and src = node_id
), hop as (select g, source, node_id, min(depth) as depth from (from hop1 union all from hop2 union all from hop3) where node_id <> source group by all
), gwalk as (
  select distinct q.g, source, source as node, 0.0::double as cost, [source] as path from q join gn n on n.g = q.g and n.node_id = source and n.status = 'open' where kind in ('shortest_path', 'path_cost', 'filtered_path_count')
  union all select w.g, source, dst, cost + weight, list_append(path, dst) from gwalk w join goe a on a.g = w.g and a.src = w.node where not list_contains(path, dst)
), gbest as (select g, source, node as target, cost, path from (select *, row_number() over (partition by g, source, node order by cost, path) as r from gwalk) where r = 1
), greach as (
  select distinct q.g, source, source as spot from q join gn n on n.g = q.g and n.node_id = source and n.status = 'open' where kind = 'reachability'
  union select r.g, source, dst from greach r join goe a on a.g = r.g and a.src = spot
), gaway as (
  select distinct g, source, target, attribute, value, source as spot from q where kind = 'constrained_reachability'
  union select q.g, q.source, q.target, q.attribute, q.value, a.dst from gaway q join ge a on a.g = q.g and a.src = q.spot join gn m on m.g = a.g and m.node_id = a.dst where a.dst = q.target or (""" + _val("m") + """) <> q.value
), gring as (
  select distinct q.g, source as v, dst as s, dst as spot from q join ge a on a.g = q.g and a.src = source where kind = 'cycle_membership'
  union select r.g, v, s, dst from gring r join ge a on a.g = r.g and a.src = spot where dst <> v
), gcycle as (select distinct r.g, v from gring r join ge a on a.g = r.g and a.src = v and a.dst = spot where spot <> s
), sol as (
  select session_id, turn_index, role, case kind when 'shortest_path' then coalesce(cast(len(path) as varchar), 'unreachable') when 'path_cost' then coalesce(cast(cast(cost as bigint) as varchar), 'unreachable')
    else case when path is null then 'unreachable' else cast((select count(*) from gn m where m.g = q.g and list_contains(path, m.node_id) and (""" + _val("m") + """) = q.value) as varchar) end end as answer
  from q left join gbest b on b.g = q.g and b.source = q.source and b.target = q.target where kind in ('shortest_path', 'path_cost', 'filtered_path_count')
  union all select session_id, turn_index, role, case when r.g is null then 'no' else 'yes' end from q left join greach r on r.g = q.g and r.source = q.source and r.spot = q.target where kind = 'reachability'
  union all select session_id, turn_index, role, case when r.g is null then 'no' else 'yes' end from q left join gaway r on r.g = q.g and r.source = q.source and r.target = q.target and r.attribute = q.attribute and r.value = q.value and r.spot = q.target where kind = 'constrained_reachability'
  union all select session_id, turn_index, role, case when c.g is null then 'no' else 'yes' end from q left join gcycle c on c.g = q.g and c.v = q.source where kind = 'cycle_membership'
  union all select session_id, turn_index, role, case when count(a.dst) > 0 then 'yes' else 'no' end from q left join ge a on a.g = q.g and a.src = q.source and a.dst = q.target where kind in ('edge_exists', 'link_prediction') group by 1, 2, 3
  union all select session_id, turn_index, role, cast(count(a.dst) as varchar) from q left join ge a on a.g = q.g and a.src = q.source where kind = 'node_degree' group by 1, 2, 3
  union all select session_id, turn_index, role, '25' from q where kind = 'node_count'
  union all select q.session_id, q.turn_index, role, cast(count(m.node_id) as varchar) from q left join ge a on a.g = q.g and a.src = q.source left join gn m on m.g = a.g and m.node_id = a.dst and (""" + _val("m") + """) = q.value where kind = 'filtered_neighbor_count' group by 1, 2, 3
  union all select q.session_id, q.turn_index, role, cast(count(m.node_id) as varchar) from q left join hop h on h.g = q.g and h.source = q.source and h.depth <= q.hops left join gn m on m.g = h.g and m.node_id = h.node_id and (q.attribute is null or (""" + _val("m") + """) = q.value) where kind = 'within_hops_count' group by 1, 2, 3
  union all select q.session_id, q.turn_index, role, coalesce(string_agg(m.label, ', ' order by m.label), 'none') from q left join hop h on h.g = q.g and h.source = q.source and h.depth <= q.hops left join gn m on m.g = h.g and m.node_id = h.node_id and (q.attribute is null or (""" + _val("m") + """) = q.value) where kind = 'within_hops_list' group by 1, 2, 3
  union all select session_id, turn_index, role, v from (select *, row_number() over (partition by session_id, turn_index, role order by n desc, v) as r from (
    select q.session_id, q.turn_index, role, """ + _val("m") + """ as v, count(*) as n from q join (select g, source, node_id, depth from hop union all select distinct g, source, source, 0 from q where kind = 'most_common_attribute_within_hops') h on h.g = q.g and h.source = q.source and h.depth <= q.hops join gn m on m.g = h.g and m.node_id = h.node_id where kind = 'most_common_attribute_within_hops' group by all)) where r = 1
  union all select session_id, turn_index, role, """ + _val("m") + """ from q join gn m on m.g = q.g and m.node_id = q.source where kind = 'attribute_lookup'
  union all select session_id, turn_index, role, case when (""" + _val("m") + """) = q.value then 'yes' else 'no' end from q join gn m on m.g = q.g and m.node_id = q.source where kind = 'attribute_check'
), wide as (
  select session_id, turn_index, max(answer) filter (where role = 'gold') as gold, max(answer) filter (where role = 'stale') as stale, max(answer) filter (where role = 'initial') as initial, max(answer) filter (where role = 'shuffled') as shuffled, max(answer) filter (where role = 'predicted') as predicted from sol group by 1, 2
), ans as (select session_id, turn_index, graph_id, op, kind, gold, stale, initial, shuffled, predicted from asked join wide using (session_id, turn_index)
), prior as (
  select kind, gold as prior from (select kind, gold, row_number() over (partition by kind order by count(*) desc, gold) as r from ans where session_id % 2 = 0 group by kind, gold) where r = 1
), skey as (
  select session_id, turn_index, coalesce(string_agg(case when status = 'closed' then node_id end, ',' order by node_id), '') as closed from sn group by 1, 2
), pskey as (
  select session_id, turn_index, coalesce(string_agg(case when status = 'closed' then node_id end, ',' order by node_id), '') as closed from psn group by 1, 2
), ekey as (select session_id, turn_index, string_agg(least(lo, hi) || '-' || greatest(lo, hi), ',' order by least(lo, hi) || '-' || greatest(lo, hi)) as pairs from se group by 1, 2
), pekey as (select session_id, turn_index, string_agg(least(lo, hi) || '-' || greatest(lo, hi), ',' order by least(lo, hi) || '-' || greatest(lo, hi)) as pairs from pse group by 1, 2
), writes as (
  select t.session_id, t.turn_index, t.op, p.op as said_op, p.op like 'SET%' and p.op = t.op and p.a = t.a as edit_correct, s.closed = ps.closed and coalesce(e.pairs, '') = coalesce(pe.pairs, '') as state_exact
  from turns t join guess p using (session_id, turn_index) join skey s using (session_id, turn_index) join pskey ps using (session_id, turn_index) left join ekey e using (session_id, turn_index) left join pekey pe using (session_id, turn_index)
), erows0 as (
  select a.session_id, a.turn_index, kind, gold as g0, stale as s0, edit_correct as ec, state_exact as sx,
    unnest(['question_only', 'frozen_graph_history', 'graph_once_then_text', 'shuffled_graph', 'oracle_updated_graph', 'predicted_updated_graph', 'serialized_initial_history', 'token_matched_history', 'serialized_current_graph', 'tool_solver', 'soft_prompt', 'soft_prompt_no_history', 'structure_only', 'modify_and_print', 'stale_answer', 'majority_answer']) as condition,
    unnest([null, initial, initial, shuffled, gold, predicted, gold, gold, gold, gold, gold, gold, null, gold, stale, prior]) as raw
  from ans a left join prior using (kind) join writes using (session_id, turn_index) where session_id % 2 = 1
), erows1 as (
  select session_id, turn_index, condition, kind, lower(g0) as gold, lower(s0) as stale_answer, case lower(raw) when 'true' then 'yes' when 'false' then 'no' else lower(raw) end as predicted, ec, sx from erows0
), erows as (
  select session_id, turn_index, condition, kind, gold, stale_answer, predicted, coalesce(gold = predicted, false) as correct, coalesce(stale_answer = predicted, false) as stale,
    case when condition = 'predicted_updated_graph' then ec end as edit_correct, case when condition = 'predicted_updated_graph' then sx else true end as state_exact from erows1
)"""


def _rates(by: str, source: str) -> str:
    return f"""
select {by}, turns, sessions, r / turns as accuracy, o / turns as stale_rate,
  round(greatest(0.0, (r / turns + 1.96 * 1.96 / (2 * turns) - 1.96 * sqrt((r / turns) * (1 - r / turns) / turns + 1.96 * 1.96 / (4.0 * turns * turns))) / (1 + 1.96 * 1.96 / turns)), 9) as wilson_low,
  round(least(1.0, (r / turns + 1.96 * 1.96 / (2 * turns) + 1.96 * sqrt((r / turns) * (1 - r / turns) / turns + 1.96 * 1.96 / (4.0 * turns * turns))) / (1 + 1.96 * 1.96 / turns)), 9) as wilson_high
from (select {by}, count(*) as turns, count(distinct session_id) as sessions, count(*) filter (where correct) as r, count(*) filter (where stale) as o from {source} group by {by})"""


_EDIT = """case op when 'SET_CLOSED' then 'SET NODE ' || a || ' status closed' when 'SET_OPEN' then 'SET NODE ' || a || ' status open'
  when 'ADD' then 'ADD EDGE ' || a || ' ' || b || ' ' || relation when 'DEL' then 'DEL EDGE ' || lo || ' ' || hi || ' ' || relation else 'NOOP' end"""

_FIELDS = """select session_id, turn_index as pos, case op when 'NOOP' then 'NOOP' else left(op, 3) end as operation,
  case when op in ('SET_CLOSED', 'SET_OPEN') then 'NODE' when op in ('ADD', 'DEL') then 'EDGE' end as target,
  case when op = 'DEL' then lo when op <> 'NOOP' then a end as "first", case op when 'ADD' then b when 'DEL' then hi end as "second",
  case when op in ('SET_CLOSED', 'SET_OPEN') then 'status' end as attribute,
  case op when 'SET_CLOSED' then 'closed' when 'SET_OPEN' then 'open' end as value, null::varchar as label, relation, null::varchar as reason, null::varchar as error from turns"""

_TOUCHED = "case when op like 'SET%' then [a] when op in ('ADD', 'DEL') then [lo, hi] else []::varchar[] end"
_NAMED = "case when target is null or target = source then [source] else [source, target] end"

_DIMENSIONS = f""", dims as (
  select t.session_id, t.turn_index, kind as task, n_turns as length, t.turn_index + 1 as turn, family, lower(gold) <> lower(stale) as changed,
    len(list_intersect({_TOUCHED.replace("op", "t.op").replace("[a]", "[t.a]").replace("[lo, hi]", "[t.lo, t.hi]")}, {_NAMED})) > 0 as mentions,
    case when t.op = 'NOOP' then 'noop' when t.op like 'SET%' then 'SET NODE' else t.op || ' EDGE' end as ops
  from asked t join (select session_id, turn_index, family from said) using (session_id, turn_index) join (select session_id, turn_index, gold, stale from ans) using (session_id, turn_index) join ends using (session_id)
)"""

_LADDER = (
    "".join(f", m{i} as (select {k}, gold as g, sum(n) over (partition by {k}) as n, row_number() over (partition by {k} order by n desc, gold) as r from (select {k}, gold, count(*) as n from ans where session_id % 2 = 0 group by all))" for i, k in enumerate(("kind, op, stale", "kind, stale", "kind")))
    + ", ladder as (select a.session_id, a.turn_index, gold, case when m0.n >= 3 then m0.g when m1.n >= 3 then m1.g else m2.g end as guess, cast(case when m0.n >= 3 then 0 when m1.n >= 3 then 1 when m2.g is not null then 2 end as bigint) as level from ans a left join m0 on m0.r = 1 and m0.kind = a.kind and m0.op = a.op and m0.stale = a.stale left join m1 on m1.r = 1 and m1.kind = a.kind and m1.stale = a.stale left join m2 on m2.r = 1 and m2.kind = a.kind where a.session_id % 2 = 1)"
)


def _question() -> str:
    fields = {"s": "x.label", "t": "coalesce(y.label, '')", "a": "coalesce(attribute, 'None')", "v": "coalesce(value, 'None')", "h": "cast(coalesce(nullif(hops, 0), 2) as varchar)"}
    out = " ".join(f"when kind = '{k}' and {'attribute is not null' if f else 'true'} then {_filled(t, fields)}" for k, f, t in _QUESTIONS)
    facts = lambda n: f"{n}.label || ': ' || array_to_string(list_filter([case when not coalesce(hide = 'cleanliness', false) then 'cleanliness=' || {n}.cleanliness end, 'disabled_access=' || case when {n}.disabled_access then 'True' else 'False' end, case when not coalesce(hide = 'has_rail', false) then 'has_rail=' || case when {n}.has_rail then 'True' else 'False' end end, case when not coalesce(hide = 'line', false) then 'line=' || {n}.line end, 'size=' || {n}.size], lambda z: z is not null), ', ') || '.'"
    hide = "(select *, case when kind in ('attribute_lookup', 'attribute_check', 'most_common_attribute_within_hops') then attribute end as hide from asked)"
    return f"select session_id, turn_index, case when y.node_id is null or y.node_id = x.node_id then {facts('x')} else {facts('x')} || ' ' || {facts('y')} end || chr(10) || case {out} else {_filled('Is there a direct edge between {s} and {t}? Answer yes or no.', fields)} end as question from {hide} t join nodes x on x.graph_id = t.graph_id and x.node_id = t.source left join nodes y on y.graph_id = t.graph_id and y.node_id = t.target"


#: The wording of questions: kind, whether for one that names an attribute, text. More special ones come first.
_QUESTIONS = (
    ("shortest_path", False, "How many stations, including endpoints, are on the shortest open path from {s} to {t}? Answer with a number or unreachable."),
    ("reachability", False, "Can {t} be reached from {s} using open stations? Answer yes or no."),
    ("filtered_neighbor_count", False, "How many stations directly connected to {s} have {a} equal to {v}? Answer with a number."),
    ("filtered_path_count", False, "On the shortest open path from {s} to {t}, how many stations have {a} equal to {v}?"),
    ("cycle_membership", False, "Is {s} part of any cycle? Answer yes or no."),
    ("node_degree", False, "What is the degree of {s}? Answer with a number."),
    ("node_count", False, "How many stations are in the network? Answer with a number."),
    ("path_cost", False, "What is the total travel cost along the shortest open path from {s} to {t}? Answer with a number or unreachable."),
    ("constrained_reachability", False, "Can {t} be reached from {s} without passing through any station where {a} is {v}? Answer yes or no."),
    ("within_hops_count", True, "How many other stations within {h} hops of {s} have {a} equal to {v}? Answer with a number."),
    ("within_hops_count", False, "How many other stations are within {h} hops of {s}? Answer with a number."),
    ("within_hops_list", True, "Which stations within {h} hops of {s} have {a} equal to {v}? Answer with a comma-separated list, or 'none'."),
    ("within_hops_list", False, "Which stations are within {h} hops of {s}? Answer with a comma-separated list, or 'none'."),
    ("most_common_attribute_within_hops", False, "What is the most common {a} among stations within {h} hops of {s}, including {s} itself?"),
    ("attribute_lookup", False, "What is the {a} of {s}? Answer directly."),
    ("attribute_check", False, "Does {s} have {a} equal to {v}? Answer yes or no."),
)

#: Poisson(1) weights from an MD5, and its cumulative chances.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(18)]
_WEIGHT = "(select " + " + ".join(f"(u >= {p!r})::int" for p in _POISSON) + ")"
_U = "cast(('0x' || substr(md5('0/' || rep || '/' || session_id), 1, 13)) as bigint) / 4503599627370496.0"

_NODE_ATTRS = "'cleanliness=' || cleanliness || '{c}disabled_access=' || case when disabled_access then 'True' else 'False' end || '{c}has_rail=' || case when has_rail then 'True' else 'False' end || '{c}line=' || line || '{c}size=' || size || '{c}status=' || status"
_NORMAL = r"""lines as (select conv_id, turn, text, trim(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '')[1]) as l from src),
n as (select conv_id, turn, text, regexp_replace(lower(coalesce(l, '')), '\.+$', '') as l from lines),
p as (select *, regexp_extract(l, '^(yes|no|true|false)($|[^\p{L}\p{M}\p{N}_])', 1) as lead, regexp_extract(l, '^(-?[0-9]+(\.[0-9]+)?)($|[^\p{L}\p{M}\p{N}_.-])', 1) as num, regexp_extract(l, '(^|[^\p{L}\p{M}\p{N}_.-])(-?[0-9]+(\.[0-9]+)?)($|[^\p{L}\p{M}\p{N}_.-])', 2) as num2, regexp_extract(l, '(^|[^\p{L}\p{M}\p{N}_])(yes|no|true|false)($|[^\p{L}\p{M}\p{N}_])', 2) as word from n)
, norm as (select conv_id, turn, case when text is null then null when l = 'true' then 'yes' when l = 'false' then 'no' when l in ('no path', 'not reachable') then 'unreachable'
  when regexp_matches(l, '^(unreachable|no path|not reachable)($|[^\p{L}\p{M}\p{N}_])') then 'unreachable' when lead <> '' then case lead when 'true' then 'yes' when 'false' then 'no' else lead end when num <> '' then num
  when contains(l, 'unreachable') or contains(l, 'no path') then 'unreachable' when num2 <> '' then num2 when word <> '' then case word when 'true' then 'yes' when 'false' then 'no' else word end else l end as answer from p)"""


def oracle_sql() -> dict[str, str]:
    b, b2 = _base(1), _base(2)
    t = b + _TURNS
    w = t + _ANSWERS
    d = w + _DIMENSIONS
    h2 = "select n.graph_id, n.node_id as source, tok.token, {x} as answer from nodes n cross join (select unnest(['s:small', 's:large']) as token) tok left join hops2 h on h.graph_id = n.graph_id and h.source = n.node_id left join nodes m on m.graph_id = h.graph_id and m.node_id = h.node_id and 's:' || m.size = tok.token group by 1, 2, 3"
    return {
        **what_if_sql.sql(b, w),
        **prompt_sql.sql(t + _states("p", "turns"), _NODE_ATTRS.format(c=", "), _question()),
        "node_degree": b + "select graph_id, node_id as source, cast(degree as varchar) as answer from deg",
        "node_count": b + "select graph_id, node_id as source, cast(count(*) over (partition by graph_id) as varchar) as answer from nodes",
        "edge_exists": b + "select *, case when exists (from adj a where a.graph_id = pq.graph_id and a.src = source and a.dst = target) then 'yes' else 'no' end as answer from pq",
        "link_prediction": b2 + "select *, case when exists (from adj a where a.graph_id = pq.graph_id and a.src = source and a.dst = target) then 'yes' else 'no' end as answer from pq",
        "filtered_neighbor_count": b + "select n.graph_id, n.node_id as source, cast(count(m.node_id) as varchar) as answer from nodes n left join adj a on a.graph_id = n.graph_id and a.src = n.node_id left join nodes m on m.graph_id = a.graph_id and m.node_id = a.dst and m.has_rail group by 1, 2",
        "attribute_lookup": b + "select graph_id, node_id as source, case when disabled_access then 'True' else 'False' end as answer from nodes",
        "attribute_check": b + "select graph_id, node_id as source, case when cleanliness = 'dirty' then 'yes' else 'no' end as answer from nodes",
        "within_hops_count": b + _HOPS + "select n.graph_id, n.node_id as source, cast(count(m.node_id) as varchar) as answer from nodes n left join hops2 h on h.graph_id = n.graph_id and h.source = n.node_id left join nodes m on m.graph_id = h.graph_id and m.node_id = h.node_id and m.has_rail group by 1, 2",
        "within_hops_list": b + _HOPS + "select n.graph_id, n.node_id as source, coalesce(string_agg(m.label, ', ' order by m.label), 'none') as answer from nodes n left join hops2 h on h.graph_id = n.graph_id and h.source = n.node_id left join nodes m on m.graph_id = h.graph_id and m.node_id = h.node_id group by 1, 2",
        "most_common_attribute": b + _HOPS + ", near as (select graph_id, source, node_id from hops2 union all select graph_id, node_id, node_id from nodes), c as (select near.graph_id, source, line, count(*) as n from near join nodes m on m.graph_id = near.graph_id and m.node_id = near.node_id group by all) select graph_id, source, line as answer from (select *, row_number() over (partition by graph_id, source order by n desc, line) as r from c) where r = 1",
        "hop_map": b + _HOPS + "select graph_id, source, node_id, cast(depth as bigint) as depth from hops3",
        "reachability": b + ", r as (select graph_id, node_id as s, node_id as t from nodes where status = 'open' union select r.graph_id, s, dst from r join oadj on oadj.graph_id = r.graph_id and src = t) select pq.*, case when exists (from r where r.graph_id = pq.graph_id and s = source and t = target) then 'yes' else 'no' end as answer from pq",
        "graph_components": b + ", r as (select graph_id, node_id as s, node_id as t from nodes union select r.graph_id, s, dst from r join adj on adj.graph_id = r.graph_id and src = t) select graph_id, s as node_id, min(t) as component from r group by 1, 2",
        "shortest_path": b + _PATHS + "select pq.*, coalesce(cast(len(path) as varchar), 'unreachable') as answer from pq left join best using (graph_id, source, target)",
        "path_cost": b + _PATHS + "select pq.*, coalesce(cast(cast(cost as bigint) as varchar), 'unreachable') as answer from pq left join best using (graph_id, source, target)",
        "filtered_path_count": b + _PATHS + "select pq.*, case when path is null then 'unreachable' else cast((select count(*) from nodes n where n.graph_id = pq.graph_id and list_contains(path, n.node_id) and n.has_rail) as varchar) end as answer from pq left join best using (graph_id, source, target)",
        "constrained_reachability": b + ", r as (select graph_id, source, target, source as spot from pq union select r.graph_id, r.source, r.target, a.dst from r join adj a on a.graph_id = r.graph_id and a.src = r.spot join nodes n on n.graph_id = a.graph_id and n.node_id = a.dst where n.has_rail or a.dst = r.target) select graph_id, source, target, case when bool_or(spot = target) then 'yes' else 'no' end as answer from r group by 1, 2, 3",
        "cycle_membership": b + ", r as (select a.graph_id, a.src as v, a.dst as s, a.dst as spot from adj a union select r.graph_id, v, s, dst from r join adj on adj.graph_id = r.graph_id and src = spot where dst <> v), on_cycle as (select distinct r.graph_id, v from r join adj a on a.graph_id = r.graph_id and a.src = v and a.dst = spot where spot <> s) select n.graph_id, n.node_id as source, case when c.v is null then 'no' else 'yes' end as answer from nodes n left join on_cycle c on c.graph_id = n.graph_id and c.v = n.node_id",
        "bridges": b + ", p as (select distinct graph_id, least(src, dst) as a, greatest(src, dst) as b from edges), r as (select graph_id, a, b, a as spot from p union select r.graph_id, a, b, dst from r join adj on adj.graph_id = r.graph_id and src = spot where not (least(src, dst) = a and greatest(src, dst) = b)) select graph_id, a, b from r group by all having not bool_or(spot = b)",
        "graph_extent": b2 + ", r as (select graph_id, node_id as s, node_id as t, 0 as d from nodes union select r.graph_id, s, dst, d + 1 from r join adj on adj.graph_id = r.graph_id and src = t where d < 24), m as (select graph_id, s, t, min(d) as d from r group by all), e as (select graph_id, s, max(d) as ecc, count(*) as n from m group by all) select graph_id, bool_and(n = 25) as connected, cast(case when bool_and(n = 25) then max(ecc) end as bigint) as diameter, cast(case when bool_and(n = 25) then min(ecc) end as bigint) as radius from e group by 1",
        "triangles": b2 + ", p as (select distinct graph_id, least(src, dst) as a, greatest(src, dst) as b from edges) select x.graph_id, x.a, x.b, y.b as c from p x join p y on y.graph_id = x.graph_id and y.a = x.b join p z on z.graph_id = x.graph_id and z.a = x.a and z.b = y.b",
        "common_neighbors": b + ", d as (select distinct graph_id, src, dst from adj) select x.graph_id, x.src as a, y.src as b, count(*) as n from d x join d y on y.graph_id = x.graph_id and y.dst = x.dst and x.src < y.src group by 1, 2, 3",
        "two_hop_reach": b + _HOPS + "select n.graph_id, n.node_id, cast(least(count(h.node_id), 8) as bigint) as reach from nodes n left join hops2 h on h.graph_id = n.graph_id and h.source = n.node_id group by 1, 2",
        "leaf_neighbors": b + "select n.graph_id, n.node_id, coalesce(bool_or(d.degree = 1), false) as has_leaf from nodes n left join adj a on a.graph_id = n.graph_id and a.src = n.node_id left join deg d on d.graph_id = a.graph_id and d.node_id = a.dst group by 1, 2",
        "density_bins": b + ", c as (select n.graph_id, count(distinct node_id) as n_nodes, (select count(*) from edges e where e.graph_id = n.graph_id) as n_edges from nodes n group by 1) select graph_id, n_nodes, n_edges, case when n_edges * 2 / (n_nodes * (n_nodes - 1)) < 0.08 then 'sparse' when n_edges * 2 / (n_nodes * (n_nodes - 1)) < 0.18 then 'medium' else 'dense' end as density_bin from c",
        "mean_degree": b + "select graph_id, sum(degree) / count(*) as mean_degree from deg group by 1",
        "missing_edges": b + "select x.graph_id, x.node_id as a, y.node_id as b from nodes x join nodes y on y.graph_id = x.graph_id and x.node_id < y.node_id where not exists (from adj where adj.graph_id = x.graph_id and src = x.node_id and dst = y.node_id)",
        "graph_violations": b + ", e as (select * from edges union all select * from edges where src = 'n0' union all select graph_id, src, src, relation, weight from edges where dst = 'n7') select graph_id, 'self_loop' as rule, src as item, count(*) as n from e where src = dst group by 1, 3 union all select graph_id, 'duplicate_edge', least(src, dst) || '|' || greatest(src, dst) || '|' || relation, count(*) from e group by 1, 3 having count(*) > 1",
        "state_key": b + "select n.graph_id, md5(coalesce((select string_agg(distinct node_id, ',' order by node_id) from nodes c where c.graph_id = n.graph_id and status = 'closed'), '') || '/' || coalesce((select string_agg(p, ',' order by p) from (select distinct least(src, dst) || '-' || greatest(src, dst) as p from edges e where e.graph_id = n.graph_id)), '')) as state_key from (select distinct graph_id from nodes) n",
        "neighborhood_hash": b + ", d as (select distinct graph_id, src, dst from adj), c0 as (select graph_id, node_id, md5('line=' || line || ',size=' || size || ',status=' || status) as c from nodes)"
        + "".join(f", c{i} as (select x.graph_id, x.node_id, md5(x.c || '|' || coalesce(string_agg(y.c, ',' order by y.c), '')) as c from c{i - 1} x left join d on d.graph_id = x.graph_id and d.src = x.node_id left join c{i - 1} y on y.graph_id = d.graph_id and y.node_id = d.dst group by x.graph_id, x.node_id, x.c)" for i in (1, 2, 3))
        + "select graph_id, md5(string_agg(c, ',' order by c)) as wl_hash from c3 group by 1",
        "neighbor_aggregate": b + "select n.graph_id, n.node_id, coalesce(sum(weight * d.degree), 0.0) as sum, coalesce(sum(weight * d.degree), 0.0) / greatest(coalesce(sum(weight), 0.0), 1.0) as mean, coalesce(max(cast(d.degree as double)), 0.0) as max from nodes n left join adj a on a.graph_id = n.graph_id and a.src = n.node_id left join deg d on d.graph_id = a.graph_id and d.node_id = a.dst group by 1, 2",
        "two_token_neighbor_count": b2 + "select n.graph_id, n.node_id as source, tok.token, cast(count(m.node_id) as varchar) as answer from nodes n cross join (select unnest(['s:dirty', 's:clean']) as token) tok left join adj a on a.graph_id = n.graph_id and a.src = n.node_id left join nodes m on m.graph_id = a.graph_id and m.node_id = a.dst and 's:' || m.cleanliness = tok.token group by 1, 2, 3",
        "two_token_hops_count": b + _HOPS + h2.format(x="cast(count(m.node_id) as varchar)"),
        "two_token_hops_list": b + _HOPS + h2.format(x="coalesce(string_agg(m.label, ', ' order by m.label), 'none')"),
        "two_token_path_count": b + _PATHS + "select pq.*, tok.token, case when path is null then 'unreachable' else cast((select count(*) from nodes n where n.graph_id = pq.graph_id and list_contains(path, n.node_id) and n.has_rail = (tok.token = 'n:1')) as varchar) end as answer from pq cross join (select unnest(['n:1', 'n:0']) as token) tok left join best using (graph_id, source, target)",
        "open_hop_map": b + _HOPS.replace(" adj", " oadj") + "select graph_id, source, node_id, cast(depth as bigint) as depth from hops3",
        "ring_pairs": b + ", d as (select distinct graph_id, src, dst from adj), c as (select distinct x.graph_id, x.src as a, y.src as b from d x join d y on y.graph_id = x.graph_id and y.dst = x.dst and x.src < y.src) select c.graph_id, c.a, c.b, d.src is not null as joined from c left join d on d.graph_id = c.graph_id and d.src = c.a and d.dst = c.b",
        "graph_text": b + f", n as (select graph_id, string_agg(node_id || ':' || label || '[' || {_NODE_ATTRS.format(c=', ')} || ']', '; ' order by node_id) as n from nodes group by 1), e as (select graph_id, string_agg(src || '-' || dst || '(relation=' || relation || ',weight=' || cast(weight as bigint) || ')', '; ' order by src, dst, relation) as e from edges group by 1) select graph_id, 'Nodes: ' || n || '. Edges: ' || coalesce(e, '') || '.' as text from n left join e using (graph_id)",
        "graph_fingerprint": b + f", n as (select graph_id, string_agg(x, ';' order by x) as n from (select graph_id, node_id || '|' || label || '|' || {_NODE_ATTRS.format(c=',')} as x from nodes) group by 1), e as (select graph_id, string_agg(x, ';' order by x) as e from (select graph_id, least(src, dst) || '|' || greatest(src, dst) || '|' || relation || '|' || cast(weight as bigint) as x from edges) group by 1) select graph_id, sha256(n || '//' || coalesce(e, '')) as fingerprint from n left join e using (graph_id)",
        "node_text": b + "select graph_id, node_id, label || ': cleanliness=' || cleanliness || ', disabled_access=' || case when disabled_access then 'True' else 'False' end || ', has_rail=' || case when has_rail then 'True' else 'False' end || ', line=' || line || ', size=' || size || '.' as text from nodes",
        "graph_audit": b2 + ", c as (select graph_id, 25 as n_nodes, (select count(*) from edges e where e.graph_id = n.graph_id) as n_edges from (select distinct graph_id from nodes) n) select case when n_edges * 2 / 600.0 < 0.08 then 'sparse' when n_edges * 2 / 600.0 < 0.18 then 'medium' else 'dense' end as density_bin, count(*) as graphs, avg(n_nodes) as nodes_mean, avg(n_edges) as edges_mean, max(n_edges) as edges_max from c group by 1",
        "session_edits": t + "select session_id, turn_index, graph_id, op, a, b, lo, hi, relation from turns",
        "edit_effects": t + _states("", "turns") + "select session_id, turn_index, op, op <> 'NOOP' and before <> goal as applied, case when op = 'NOOP' or before <> goal then null when op like 'SET%' then 'no_state_change' when op = 'ADD' then 'edge_exists' else 'edge_missing' end as error from b",
        "session_node_state": t + _states("", "turns") + "select session_id, a as node_id, goal as is_open, from_turn, to_turn from mv where key like 'n:%'",
        "session_edge_state": t + _states("", "turns") + "select session_id, lo, hi, goal as present, from_turn, to_turn from mv where key like 'e:%'",
        "state_nodes": t + ", last as (select t.session_id, t.turn_index, n.node_id, coalesce((select arg_max(o.op = 'SET_OPEN', o.turn_index) from turns o where o.session_id = t.session_id and o.turn_index <= t.turn_index and o.op like 'SET%' and o.a = n.node_id), n.status = 'open') as is_open from turns t join nodes n on n.graph_id = t.graph_id) select session_id || ':' || turn_index as graph_id, node_id, is_open from last",
        "state_edges": t + _states("", "turns") + "select session_id || ':' || turn_index as graph_id, lo as src, hi as dst, relation, cast(weight as double) as weight from se",
        "utterances": t + "select session_id, turn_index, family, utterance from said",
        "predicted_edits": t + "select session_id, turn_index, op, a from guess",
        "write_accuracy": w + "select session_id, turn_index, op, said_op, edit_correct, state_exact from writes",
        "session_questions": t + _question(),
        "session_answers": w + "from ans",
        "edit_programs": t + f"select session_id, string_agg({_EDIT}, ' ; ' order by turn_index) || ' ; END' as program from turns group by 1",
        "parse_programs": t + _FIELDS,
        "malformed_edits": t + "select session_id, turn_index as pos, case when e is null then o end as operation, e as error from (select *, case op when 'NOOP' then 'NOOP' else left(op, 3) end as o, case turn_index % 4 when 1 then case when op like 'SET%' then 'value_missing' end when 2 then 'unknown_operation' when 3 then case when op in ('ADD', 'DEL') then 'set_edge' end end as e from turns)",
        "applied_effects": t + _states("", "turns") + "select session_id, turn_index as pos, op <> 'NOOP' and before <> goal as applied, case when op = 'NOOP' or before <> goal then null when op like 'SET%' then 'no_state_change' when op = 'ADD' then 'edge_exists' else 'unknown_edge' end as error from b",
        "applied_edges": t + _states("", "turns") + "select se.session_id, lo, hi, relation, cast(weight as double) as weight from se join ends on ends.session_id = se.session_id and se.turn_index = n_turns - 1",
        "program_equivalence": t + f", f as ({_FIELDS}), p as (select session_id, count(*) as n, string_agg(concat_ws('~', pos, operation, coalesce(target, '-'), coalesce(\"first\", '-'), coalesce(\"second\", '-'), coalesce(attribute, '-'), coalesce(value, '-'), coalesce(relation, '-')), ';' order by pos) as sig from f group by 1) select x.session_id, x.n, x.sig = y.sig as equal from p x join p y on y.session_id = x.session_id + 1",
        "edit_mentions": t + f"select session_id, turn_index, len(list_intersect({_TOUCHED}, {_NAMED})) > 0 as mentions from asked",
        "operation_sets": t + ", s as (select session_id, string_agg(distinct op, '+' order by op) as ops, count(*) as turns from turns group by 1) select ops, count(*) as sessions, cast(sum(turns) as bigint) as turns from s group by 1",
        "asked_before": t + ", q as (select session_id, turn_index, concat_ws('|', kind, source, coalesce(target, ''), coalesce(attribute, ''), coalesce(value, ''), coalesce(hops, -1)) as q from asked) select session_id, turn_index, exists (from q p where p.session_id = q.session_id and p.turn_index < q.turn_index and p.q = q.q) as asked_before from q",
        "turn_dimensions": d + "from dims",
        "last_mention": t + "select a.session_id, a.turn_index, a.kind, max(b.turn_index) as last_turn from asked a left join asked b on b.session_id = a.session_id and b.kind = a.kind and b.turn_index < a.turn_index group by 1, 2, 3",
        "states_seen": t + _states("", "turns") + ", o as (select t.session_id, t.turn_index, coalesce(string_agg(s.key, ',' order by s.key) filter (where s.goal <> s.beg), '') as sig from turns t left join sp s using (session_id, turn_index) group by 1, 2) select session_id, turn_index, sig = '' or exists (from o p where p.session_id = o.session_id and p.turn_index < o.turn_index and p.sig = o.sig) as seen from o",
        "closed_counts": t + _states("", "turns") + "select session_id || ':' || turn_index as graph_id, count(*) filter (where status = 'closed') as closed from sn group by 1",
        "evaluation_rows": w + "from erows",
        "condition_summary": w + _rates("condition", "erows"),
        "stratified_accuracy": w + _rates("condition, kind", "erows"),
        "final_state_accuracy": w + ", l as (select condition, session_id, arg_max(correct, turn_index) as c from erows group by 1, 2) select condition, count(*) as sessions, count(*) filter (where c) / count(*) as final_accuracy from l group by 1",
        "session_totals": w + "select condition, session_id, count(*) filter (where correct) as \"right\", count(*) as turns from erows group by 1, 2",
        "paired_delta": w + ", x as (select a.kind, a.correct::int as l, b.correct::int as r from erows a join erows b using (session_id, turn_index, kind) where a.condition = 'tool_solver' and b.condition = 'stale_answer') select 'tool_solver' as left_condition, 'stale_answer' as right_condition, kind, count(*) as n, sum(l - r) / count(*) as delta, count(*) filter (where l > r) as wins, count(*) filter (where l < r) as losses, count(*) filter (where l = r) as ties from x group by kind",
        "cluster_bootstrap": w + f", st as (select condition, session_id, count(*) filter (where correct) as c, count(*) as n from erows group by 1, 2), dr as (select session_id, rep, {_WEIGHT} as w from (select session_id, rep, {_U} as u from (select distinct session_id from st) s, range(1, 2001) r(rep))), rp as (select condition, rep, sum(w * c) / sum(w * n) as x from dr join st using (session_id) where w > 0 group by 1, 2), ci as (select condition, round(quantile_cont(x, 0.025), 9) as low, round(quantile_cont(x, 0.975), 9) as high from rp group by 1) select condition, sum(c) / sum(n) as accuracy, low, high from st join ci using (condition) group by condition, low, high",
        "paired_bootstrap": w + f", pr as (select a.session_id, a.correct::int as l, b.correct::int as r from erows a join erows b using (session_id, turn_index) where a.condition = 'predicted_updated_graph' and b.condition = 'stale_answer'), st as (select session_id, sum(l - r) as dd, count(*) as n from pr group by 1), dr as (select rep, sum(w * dd) / greatest(sum(w * n), 1) as x from (select *, {_WEIGHT} as w from (select session_id, dd, n, rep, {_U} as u from st, range(1, 2001) r(rep))) group by 1), ci as (select round(quantile_cont(x, 0.025), 9) as low, round(quantile_cont(x, 0.975), 9) as high, least(1.0, 2 * least(count(*) filter (where x <= 0) / count(*), count(*) filter (where x >= 0) / count(*))) as p_value from dr) select count(*) as n, count(distinct session_id) as sessions, sum(l - r) / count(*) as mean_delta, low, high, p_value, count(*) filter (where l > r) as wins, count(*) filter (where l < r) as losses, count(*) filter (where l = r) as ties from pr, ci group by low, high, p_value",
        "static_gate": w + ", g as (select kind, count(*) as n, count(*) filter (where correct) / count(*) as accuracy from erows where condition = 'stale_answer' group by grouping sets ((), (kind))) select kind, n, accuracy, case when kind is null then accuracy >= 0.7 else accuracy >= 0.5 end as passed from g",
        "slice_accuracy": d + _LADDER + ", x as (select r.correct, m.*, case when l.level = 0 then l.guess = l.gold end as s1, l.guess = l.gold as s2 from erows r join dims m using (session_id, turn_index) left join ladder l using (session_id, turn_index) where condition = 'stale_answer'), s as ("
        + " union all ".join(f"select '{k}' as slice, correct from x where {c}" for k, c in (("all", "true"), ("answer_changing", "changed"), ("answer_unchanged", "not changed"), ("no_mention", "not mentions"), ("mention", "mentions"), ("shortcut_wrong", "s1 is false"), ("shortcut_right", "s1 is true"), ("changed_and_no_mention", "changed and not mentions"), ("local_wrong", "s1 is false and s2 is false"), ("local_right", "s1 is true or s2 is true"), ("family_direct", "family = 'direct'"), ("family_service", "family = 'service'"), ("family_notice", "family = 'notice'")))
        + ") select slice, count(*) as turns, count(*) filter (where correct) / count(*) as accuracy from s group by 1",
        "breakdowns": d + ", x as (select condition, correct, m.* from erows join dims m using (session_id, turn_index)), v as ("
        + " union all ".join(f"select condition, correct, '{k}' as view, cast({c} as varchar) as bucket from x" for k, c in (("all", "'all'"), ("by_length", "length"), ("by_turn", "turn"), ("by_task", "task"), ("by_family", "family"), ("by_change", "case when changed then 'changed' else 'unchanged' end"), ("by_operation", "ops"), ("changed_no_mention", "case when changed and not mentions then 'changed_no_mention' end")))
        + ") select condition, view, bucket, count(*) as turns, count(*) filter (where correct) / count(*) as accuracy from v where bucket is not null group by 1, 2, 3",
        "write_path_report": d + "select ops, family, count(*) as turns, count(*) filter (where edit_correct) / count(*) as edit_accuracy, count(*) filter (where state_exact) / count(*) as exact_states from writes join dims using (session_id, turn_index) group by 1, 2",
        "condition_gain": w + ", a as (select condition, count(*) filter (where correct) / count(*) as x from erows group by 1), m as (select max(x) filter (where condition = 'predicted_updated_graph') as f, max(x) filter (where condition in ('frozen_graph_history', 'question_only')) as p from a) select f as \"full\", p as best_part, f - p as gain, f - p >= 0.1 as passed from m",
        "seed_summary": w + ", p as (select condition, kind, session_id % 3 as run, count(*) filter (where correct) / count(*) as x from erows group by 1, 2, 3) select condition, kind, round(avg(x), 9) as mean, round(stddev_samp(x), 9) as sd, min(x) as low, max(x) as high from p group by 1, 2 having count(*) = (select count(distinct session_id % 3) from erows)",
        "label_audit": w + ", c as (select kind, gold as answer, count(*) as n from ans group by 1, 2) select * from (select *, n / sum(n) over (partition by kind) as share, row_number() over (partition by kind order by n desc, answer) as rank from c) where rank <= 6",
        "session_audit": w + "select 'operation' as measure, op as value, count(*) as n from turns group by 2 union all select 'kind', kind, count(*) from ans group by 2 union all select 'answer', gold, count(*) from ans group by 2 union all select 'all', 'turns', count(*) from turns union all select 'all', 'sessions', count(distinct session_id) from turns union all select 'all', 'noop_turns', count(*) from turns where op = 'NOOP' union all select 'all', 'changed', count(*) from ans where gold <> stale",
        "session_violations": w + ", x as (select session_id, turn_index, gold, stale, regexp_extract_all(lower(utterance), '[a-z0-9_-]+') as ws from said join (select session_id, turn_index, gold, stale from ans) using (session_id, turn_index) where op <> 'NOOP') select session_id, turn_index, 'unchanged_answer' as rule from x where gold = stale union all select session_id, turn_index, 'answer_in_wording' from x where list_contains(ws, lower(gold))",
        "chance_of_mention": t + f", x as (select len({_NAMED}) as k, len(list_distinct({_TOUCHED})) as t, len(list_intersect({_TOUCHED}, {_NAMED})) > 0 as hit from asked where op <> 'NOOP') select count(*) as turns, count(*) filter (where hit) as mentioned, round(sum(1 - case k when 1 then (25.0::double - t) / 25 else (25.0::double - t) * (24 - t) / 600 end), 6) as expected from x",
        "split_overlap": t + ", x as (select distinct graph_id, session_id from turns) select graph_id, count(*) filter (where session_id % 2 = 0) as learn_sessions, count(*) filter (where session_id % 2 = 1) as score_sessions from x group by 1 having count(*) filter (where session_id % 2 = 0) > 0 and count(*) filter (where session_id % 2 = 1) > 0",
        "majority_prior": w + "from prior",
        "lookup_ladder": w + _LADDER + "from ladder",
        "stride_sample": t + "select session_id, turn_index, graph_id, op, a, b, event_id, lo, hi, relation from (select *, row_number() over (order by session_id, turn_index) - 1 as no from turns) where no % 7 = 0 and no < 350",
        "first_sessions": t + "select session_id, turn_index, op from turns where session_id in (select distinct session_id from turns order by 1 limit 5)",
        "last_states": t + ", k as (select *, case when op like 'SET%' then 'n:' || a when op in ('ADD', 'DEL') then 'e:' || lo || '-' || hi end as key from turns) select session_id, key, max(turn_index) as turn_index, arg_max(op, turn_index) as op from k where key is not null group by 1, 2",
        "first_states": t + ", k as (select *, case when op like 'SET%' then 'n:' || a when op in ('ADD', 'DEL') then 'e:' || lo || '-' || hi end as key from turns) select session_id, key, min(turn_index) as turn_index, arg_min(op, turn_index) as op from k where key is not null group by 1, 2",
        "changed_questions": w + "select session_id, min(turn_index) as turn_index, kind, arg_min(stale, turn_index) as before, arg_min(gold, turn_index) as after from ans where gold <> stale group by session_id, kind",
        "two_sided_strata": w + "select kind, op, count(distinct gold) as answers, count(*) as n from ans group by 1, 2 having count(distinct gold) >= 2",
        "training_examples": w + f", qq as ({_question()}) select session_id || '-turn-' || turn_index as example_id, session_id || ':' || turn_index as graph_id, question as prompt, gold as answer, case when session_id % 2 = 0 then 'train' else 'test' end as split from qq join ans using (session_id, turn_index)",
        "session_records": w + "select session_id, turn_index, utterance, kind, gold as gold_answer, stale as stale_answer from said join (select session_id, turn_index, kind, gold, stale from ans) using (session_id, turn_index)",
        "record_hash": w + """, l as (select session_id, turn_index, sha256('{"gold_answer":"' || gold || '","kind":"' || kind || '","session_id":' || session_id || ',"stale_answer":"' || stale || '","turn_index":' || turn_index || ',"utterance":"' || utterance || '"}') as h from said join (select session_id, turn_index, kind, gold, stale from ans) using (session_id, turn_index)) select session_id, count(*) as records, sha256(string_agg(h, '' order by turn_index)) as sha256 from l group by 1""",
        "query_eligibility": b + "select pq.graph_id, source, target, x.status = 'open' and y.status = 'open' as path, degree = 2 as cycle from pq join nodes x on x.graph_id = pq.graph_id and x.node_id = source join nodes y on y.graph_id = pq.graph_id and y.node_id = target join deg on deg.graph_id = pq.graph_id and deg.node_id = source",
        "candidate_questions": b + "select n.graph_id, n.node_id as source, attribute, token from nodes n join (select distinct graph_id, 'has_rail' as attribute, case when has_rail then 'n:1' else 'n:0' end as token from nodes union select distinct graph_id, 'cleanliness', 's:' || cleanliness from nodes) v on v.graph_id = n.graph_id",
        "unique_mode": b + ", v as (select graph_id, 'line' as name, line as text from nodes union all select graph_id, 'size', size from nodes), c as (select graph_id, name, text, count(*) as n from v group by 1, 2, 3), m as (select *, max(n) over (partition by graph_id, name) as top from c) select graph_id, name, min(text) as text, min(n) as n from m where n = top group by 1, 2 having count(*) = 1",
        "pair_strata": b + "select pq.graph_id, source, target, case when x.line = y.line then 'same_line' else 'diff_line' end || '|deg' || least(dx.degree, 3) || '-deg' || least(dy.degree, 3) as stratum from pq join nodes x on x.graph_id = pq.graph_id and x.node_id = source join nodes y on y.graph_id = pq.graph_id and y.node_id = target join deg dx on dx.graph_id = pq.graph_id and dx.node_id = source join deg dy on dy.graph_id = pq.graph_id and dy.node_id = target",
        "scale_and_hop_bins": b + _HOPS + "select pq.graph_id, pq.source, pq.target, 'scale_large' as scale, case when depth = 1 then 'local' when depth <= 3 then 'mid' else 'global' end as hops from pq left join hops3 h on h.graph_id = pq.graph_id and h.source = pq.source and h.node_id = pq.target",
        "tensor_order": b + ", o as (select graph_id, node_id, row_number() over (partition by graph_id order by node_id) - 1 as at from nodes) select a.graph_id, row_number() over (partition by a.graph_id order by x.at, y.at, relation, weight) - 1 as row, x.at as src_row, y.at as dst_row, weight from adj a join o x on x.graph_id = a.graph_id and x.node_id = src join o y on y.graph_id = a.graph_id and y.node_id = dst",
        "grid_cells": b + "select graph_id, unnest([" + ", ".join(f"'{k}'" for k in _KINDS) + "]) as kind from gids",
        "values_present": b + "select distinct graph_id, 'has_rail' as name, case when has_rail then 'True' else 'False' end as text from nodes union select graph_id, 'disabled_access', case when disabled_access then 'True' else 'False' end from nodes union select graph_id, 'line', line from nodes union select graph_id, 'cleanliness', cleanliness from nodes union select graph_id, 'size', size from nodes union select graph_id, 'status', status from nodes",
        "normalized_answers": f"with src as (select conv_id, turn, text from conversations), {_NORMAL} from norm",
        "answer_matches": w + "select session_id, turn_index, lower(gold) = lower(initial) as matches from ans",
        "history_text": "with n as (select *, row_number() over (partition by conv_id order by turn) as nth from conversations) select a.conv_id, a.turn, coalesce(string_agg('Update ' || b.nth || ': ' || coalesce(b.text, ''), chr(10) order by b.nth), '') as history from n a left join n b on b.conv_id = a.conv_id and b.nth < a.nth group by 1, 2",
        "token_budget": "with w as (select conv_id, turn, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from conversations) select conv_id, turn, case when len(w) <= 16 then text else array_to_string(w[-16:], ' ') end as kept, len(w) as n_words from w",
        "set_f1": "with src as (select conv_id, turn, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ',') as text from conversations), "
        + _NORMAL
        + ", s as (select conv_id, turn, role, case when coalesce(answer, '') in ('none', '') then [] else list_distinct(list_filter(list_transform(string_split(answer, ','), lambda x: trim(x)), lambda x: x <> '')) end as w from norm join conversations using (conv_id, turn)) select a.conv_id, a.turn, case when len(a.w) + len(b.w) = 0 then 1.0 else 2 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) end as f1 from s a join s b on b.conv_id = a.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'",
        "pooled_mean": "with d as (select label, unnest(embedding) as x, cast(unnest(range(len(embedding))) as bigint) as dim from embeddings where label is not null) select label, dim, round(avg(cast(x as double)), 6) as mean from d group by 1, 2",
        "text_leak_audit": leak_sql.audit(w),
        **mixed_sql.oracle_sql(),
        **vector_sql.oracle_sql(),
    }
