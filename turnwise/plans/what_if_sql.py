"""SQL for edits that change answers, by solving the graph after every candidate edit, and for the quota of changed answers."""

from __future__ import annotations

_EDITED = """, joined as (select distinct graph_id, least(src, dst) as a, greatest(src, dst) as b from edges
), edits as (
  select graph_id, case when status = 'open' then 'SET_CLOSED' else 'SET_OPEN' end as op, node_id as a, null as b, null as relation from nodes
  union all select graph_id, 'DEL', least(src, dst), greatest(src, dst), relation from edges
  union all select x.graph_id, 'ADD', x.node_id, y.node_id, null from nodes x join nodes y on y.graph_id = x.graph_id and x.node_id < y.node_id
            left join joined j on j.graph_id = x.graph_id and j.a = x.node_id and j.b = y.node_id where j.a is null
), edit as (select *, row_number() over (order by graph_id, op, a, b, relation) as g from edits
  union all select distinct graph_id, 'none', null, null, null, -gi - 1 from nodes
), gn as (
  select g, nk, node_id, (n.status = 'open') <> (op like 'SET%' and a = node_id) as is_open from edit join nodes n using (graph_id)
), gpair as (
  select g, least(src, dst) as lo, greatest(src, dst) as hi, weight from edit t join edges e using (graph_id) where not (op = 'DEL' and a = least(src, dst) and b = greatest(src, dst) and t.relation = e.relation)
  union all select g, a, b, 1.0 from edit where op = 'ADD'
), gadj as (select g, lo as src, hi as dst, weight from gpair union all select g, hi, lo, weight from gpair
), gopen as (
  select gadj.* from gadj join gn x on x.g = gadj.g and x.node_id = src and x.is_open join gn y on y.g = gadj.g and y.node_id = dst and y.is_open
), reach as (
  select g, node_id as s, node_id as t from gn where is_open union select reach.g, s, dst from reach join gopen o on o.g = reach.g and o.src = reach.t
), walk as (
  select g, nk as s, nk as t, 0.0::double as cost, [nk] as path from gn where is_open
  union all select w.g, s, y.nk, cost + weight, list_append(path, y.nk) from walk w join gopen o on o.g = w.g and o.src = 'n' || t join gn y on y.g = w.g and y.node_id = o.dst where not list_contains(path, y.nk)
), cheapest as (select g, 'n' || s as s, 'n' || t as t, min(cost) as cost from walk group by all
), spread as (
  select a.g, a.src as v, a.dst as s, a.dst as spot from gadj a join edit using (g) where op not like 'SET%'
  union select p.g, v, s, dst from spread p join gadj a on a.g = p.g and a.src = spot where dst <> v
), ringed as (select distinct p.g, v from spread p join gadj a on a.g = p.g and a.src = v and a.dst = spot where spot <> s
), gdeg as (select g, src as v, count(*) as n from gadj group by all
), said as (
  select e.*, 'reachability' as kind, source, target, (r.g is not null)::varchar as answer from edit e join pq using (graph_id) left join reach r on r.g = e.g and s = source and t = target
  union all select e.*, 'path_cost', source, target, coalesce(cost::varchar, 'unreachable') from edit e join pq using (graph_id) left join cheapest r on r.g = e.g and s = source and t = target
  union all select e.*, 'edge_exists', source, target, (j.g is not null)::varchar from edit e join pq using (graph_id) left join (select distinct g, src, dst from gadj) j on j.g = e.g and src = source and dst = target
  union all select e.*, 'cycle_membership', node_id, null, (c.g is not null)::varchar from edit e join gn using (g) left join ringed c on c.g = e.g and v = node_id where op not like 'SET%'
  union all select e.*, 'node_degree', node_id, null, coalesce(n, 0)::varchar from edit e join gn using (g) left join gdeg d on d.g = e.g and v = node_id
)
select x.kind, x.graph_id, x.source, x.target, x.op, count(*) as edits, min(concat_ws('-', x.a, x.b, x.relation)) as first_edit, max(concat_ws('-', x.a, x.b, x.relation)) as last_edit
from said x join said o on o.op = 'none' and o.graph_id = x.graph_id and o.kind = x.kind and o.source = x.source and o.target is not distinct from x.target
where x.op <> 'none' and x.answer <> o.answer group by all"""

#: Rows of a cell in the order of their seeded hash, dealt in turn until the need of their side is met.
_QUOTA = """, a as (select session_id, turn_index, kind, gold, stale, gold <> stale as changed, md5('0:' || session_id || ':' || turn_index) as h from ans
), c as (
  select kind, case when kind in ('reachability', 'cycle_membership', 'edge_exists', 'link_prediction', 'constrained_reachability', 'attribute_check')
    then 2 * least(count(*) filter (where changed and gold = 'yes'), count(*) filter (where changed and gold = 'no')) else count(*) filter (where changed) end as c, count(*) filter (where not changed) as u from a group by 1
), need as (
  select kind, true as changed, case when c = 0 or u = 0 then c else least(c, u * 45 // 55) end as need from c
  union all select kind, false, case when c = 0 or u = 0 then u else least(u, c * 55 // 45) end from c
), ranked_in_cell as (select *, row_number() over (partition by kind, changed, gold order by h, session_id, turn_index) as no from a
), dealt as (select *, row_number() over (partition by kind, changed order by no, gold) as place from ranked_in_cell)
select session_id, turn_index, kind, gold, stale, changed from dealt join need using (kind, changed) where place <= need"""


def sql(base: str, answered: str) -> dict[str, str]:
    return {"changing_edits": base + _EDITED, "changed_quota": answered + _QUOTA}
