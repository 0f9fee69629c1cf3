"""The trade graphs in DuckDB SQL, which all other SQL of the catalogue starts from."""

from __future__ import annotations


def base(k: int = 1) -> str:
    return f"""
with recursive counts as (
  select c_mktsegment || '|' || o_orderpriority as graph_id, c_nationkey as s, s_nationkey as t, count(*) as cnt
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  where c_nationkey <> s_nationkey group by all
), gids as (
  select graph_id, row_number() over (order by graph_id) - 1 as gi
  from (select distinct s.c_mktsegment || '|' || p.o_orderpriority as graph_id from (select distinct c_mktsegment from customer) s, (select distinct o_orderpriority from orders) p)
), nodes as (
  select graph_id, gi, n_nationkey as nk, 'n' || n_nationkey as node_id, n_name as label, r_name as line,
         case when (n_nationkey * 7 + gi * 3) % 11 = 0 then 'closed' else 'open' end as status,
         n_nationkey % 2 = 0 as has_rail, (n_nationkey // 5) % 2 = 0 as disabled_access,
         ['clean', 'average', 'dirty'][n_nationkey % 3 + 1] as cleanliness,
         ['small', 'medium', 'large', 'small'][n_nationkey % 4 + 1] as size
  from gids, nation join region on n_regionkey = r_regionkey
), ranked as (
  select *, row_number() over (partition by graph_id, s order by cnt desc, t) as rk from counts
), pairs as (
  select graph_id, least(s, t) as a, greatest(s, t) as b, max(cnt) as cnt from ranked where rk <= {k} group by all
), edges as (
  select p.graph_id, 'n' || a as src, 'n' || b as dst, case when x.line = y.line then 'track' else 'transfer' end as relation,
         cast(1 + cnt % 5 as double) as weight
  from pairs p join nodes x on x.graph_id = p.graph_id and x.nk = a join nodes y on y.graph_id = p.graph_id and y.nk = b
), adj as (
  select graph_id, src, dst, relation, weight from edges union all select graph_id, dst, src, relation, weight from edges
), oadj as (
  select adj.* from adj join nodes x on x.graph_id = adj.graph_id and x.node_id = src and x.status = 'open'
  join nodes y on y.graph_id = adj.graph_id and y.node_id = dst and y.status = 'open'
), pq as (
  select x.graph_id, x.node_id as source, y.node_id as target from nodes x join nodes y on x.graph_id = y.graph_id
  where x.nk < y.nk
), deg as (
  select n.graph_id, n.node_id, count(a.dst) as degree from nodes n left join adj a on a.graph_id = n.graph_id and a.src = n.node_id group by all
)"""
