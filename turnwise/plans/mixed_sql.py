"""DuckDB SQL for the queries over collections in which some graphs are directed."""

from __future__ import annotations

from .base_sql import base

_KINDS = (
    "shortest_path", "reachability", "filtered_neighbor_count", "filtered_path_count", "cycle_membership", "edge_exists", "node_degree", "node_count",
    "path_cost", "link_prediction", "constrained_reachability", "within_hops_count", "within_hops_list", "most_common_attribute_within_hops", "attribute_lookup", "attribute_check",
)

#: Rounds of paths; no path of a graph of 25 nodes has more steps.
_ROUNDS = 24

_GRAPHS = """, medges as materialized (
  select e.graph_id, src, dst, weight, false as directed from edges e join gids using (graph_id) where gi % 2 = 0
  union all select r.graph_id, 'n' || s, 'n' || t, (1 + cnt % 7) / 2.0::double, true from ranked r join gids using (graph_id) where gi % 2 = 1 and rk <= 2
), madj as materialized (
  select graph_id, src, dst, weight, directed from medges union all select graph_id, dst, src, weight, directed from medges where not directed
), moadj as materialized (
  select a.* from madj a join nodes x on x.graph_id = a.graph_id and x.node_id = src and x.status = 'open' join nodes y on y.graph_id = a.graph_id and y.node_id = dst and y.status = 'open'
)"""

_ASKED = f""", mq as materialized (
  select graph_id || '/' || source || '/' || target as query_id, graph_id, source, target, {list(_KINDS)}[no % 16 + 1] as kind,
    ['has_rail', 'status', 'cleanliness', null][(no // 16) % 4 + 1] as attribute, ['False', 'closed', 'dirty', null][(no // 16) % 4 + 1] as value, no % 7 as hops, coalesce(nullif(no % 7, 0), 2) as radius
  from (select x.graph_id, x.node_id as source, y.node_id as target, x.nk * 25 + y.nk + x.gi * 3 as no from nodes x join nodes y on x.graph_id = y.graph_id where x.nk <> y.nk)
)"""


def _paths() -> str:
    first = """, mb0 as materialized (
  select distinct q.graph_id, source, source as node, {'cost': 0.0::double, 'path': [source]} as best from mq q join nodes n on n.graph_id = q.graph_id and n.node_id = source and n.status = 'open' where kind in ('shortest_path', 'path_cost', 'filtered_path_count'))"""
    step = """, mb{j} as materialized (
  select graph_id, source, node, min(best) as best from (
    select * from mb{i} union all
    select b.graph_id, source, dst, {{'cost': best.cost + weight, 'path': list_append(best.path, dst)}} from mb{i} b join moadj a on a.graph_id = b.graph_id and a.src = b.node where not list_contains(best.path, dst))
  group by 1, 2, 3)"""
    return first + "".join(step.format(i=i, j=i + 1) for i in range(_ROUNDS))


def _value(m: str) -> str:
    """What an attribute compares as; of the codes, all but the string are one number."""
    return f"case q.attribute when 'has_rail' then case when {m}.has_rail then 'True' else 'False' end when 'status' then {m}.status when 'cleanliness' then {m}.cleanliness when 'code' then case {m}.nk % 4 when 1 then 'string' else 'number' end end"


def _text(m: str) -> str:
    """What an attribute prints as."""
    return f"case q.attribute when 'code' then ['True', 'true', '1', '1.0'][{m}.nk % 4 + 1] else {_value(m)} end"


def _rows(kinds: str, answer: str, joins: str = "", group: bool = False) -> str:
    return f"select query_id, {answer} as answer from mq q {joins} where kind in ({kinds})" + (" group by query_id" if group else "")


def mixed_answers(asked: str = _ASKED, graphs: str = _GRAPHS) -> str:
    """All sixteen kinds over the mixed collection, each as its definition says."""
    path = f"left join mb{_ROUNDS} b on b.graph_id = q.graph_id and b.source = q.source and b.node = q.target"
    edge = "left join madj a on a.graph_id = q.graph_id and a.src = q.source"
    hop = "left join mhop h on h.graph_id = q.graph_id and h.source = q.source and h.depth <= q.radius left join nodes m on m.graph_id = h.graph_id and m.node_id = h.node"
    wanted = f"(q.attribute is null or ({_value('m')}) = q.value)"
    own = "join nodes m on m.graph_id = q.graph_id and m.node_id = q.source"
    parts = [
        _rows("'shortest_path'", "coalesce(cast(len(best.path) as varchar), 'unreachable')", path),
        _rows("'path_cost'", "coalesce(case when best.cost = floor(best.cost) then cast(cast(best.cost as bigint) as varchar) else cast(round(best.cost, 2) as varchar) end, 'unreachable')", path),
        _rows("'filtered_path_count'", f"case when q.attribute is null then 'invalid' when best is null then 'unreachable' else cast((select count(*) from nodes m where m.graph_id = q.graph_id and list_contains(best.path, m.node_id) and ({_value('m')}) = q.value) as varchar) end", path),
        _rows("'reachability'", "case when r.graph_id is null then 'no' else 'yes' end", "left join mreach r on r.graph_id = q.graph_id and r.source = q.source and r.spot = q.target"),
        _rows("'constrained_reachability'", "case when q.attribute is null then 'invalid' when r.qid is null then 'no' else 'yes' end", "left join maway r on r.qid = q.query_id and r.spot = q.target"),
        _rows("'cycle_membership'", "case when c.graph_id is null then 'no' else 'yes' end", "left join mcycle c on c.graph_id = q.graph_id and c.v = q.source"),
        _rows("'edge_exists', 'link_prediction'", "case when count(a.dst) > 0 then 'yes' else 'no' end", edge + " and a.dst = q.target", True),
        _rows("'node_degree'", "cast(count(a.dst) as varchar)", edge, True),
        _rows("'node_count'", "'25'"),
        _rows("'filtered_neighbor_count'", f"case when any_value(q.attribute) is null then 'invalid' else cast(count(a.dst) filter (where ({_value('m')}) = q.value) as varchar) end", edge + " left join nodes m on m.graph_id = a.graph_id and m.node_id = a.dst", True),
        _rows("'within_hops_count'", f"cast(count(m.node_id) filter (where {wanted}) as varchar)", hop, True),
        _rows("'within_hops_list'", f"coalesce(string_agg(m.label, ', ' order by m.label) filter (where {wanted}), 'none')", hop, True),
        "select query_id, coalesce(v, 'none') from (select *, row_number() over (partition by query_id order by n desc, v) as r from (" + f"select query_id, {_text('m')} as v, count(*) as n from mq q join (select graph_id, source, node, depth from mhop union all select graph_id, node_id, node_id, 0 from nodes) h on h.graph_id = q.graph_id and h.source = q.source and h.depth <= q.radius join nodes m on m.graph_id = h.graph_id and m.node_id = h.node where kind = 'most_common_attribute_within_hops' and q.attribute is not null group by all)) where r = 1",
        _rows("'most_common_attribute_within_hops'", "'invalid'") + " and q.attribute is null",
        _rows("'attribute_lookup'", f"case when q.attribute is null then 'invalid' else {_text('m')} end", own),
        _rows("'attribute_check'", f"case when q.attribute is null then 'invalid' when ({_value('m')}) = q.value then 'yes' else 'no' end", own),
    ]
    reach = f""", mreach as (
  select distinct q.graph_id, source, source as spot from mq q join nodes n on n.graph_id = q.graph_id and n.node_id = source and n.status = 'open' where kind = 'reachability'
  union select r.graph_id, source, dst from mreach r join moadj a on a.graph_id = r.graph_id and a.src = spot
), maway as (
  select query_id as qid, graph_id, target, attribute, value, source as spot from mq where kind = 'constrained_reachability' and attribute is not null
  union select q.qid, q.graph_id, q.target, q.attribute, q.value, a.dst from maway q join madj a on a.graph_id = q.graph_id and a.src = q.spot join nodes m on m.graph_id = a.graph_id and m.node_id = a.dst where q.spot <> q.target and (a.dst = q.target or ({_value("m")}) <> q.value)
), mring as (
  select distinct q.graph_id, source as v, dst as s, dst as spot from mq q join madj a on a.graph_id = q.graph_id and a.src = source and not directed where kind = 'cycle_membership'
  union select r.graph_id, v, s, dst from mring r join madj a on a.graph_id = r.graph_id and a.src = spot and not directed where dst <> v
), mcycle as (select distinct r.graph_id, v from mring r join madj a on a.graph_id = r.graph_id and a.src = v and a.dst = spot where spot <> s
), mwalk as (
  select distinct graph_id, source, source as node, 0 as depth from mq where kind in ('within_hops_count', 'within_hops_list', 'most_common_attribute_within_hops')
  union select w.graph_id, source, dst, depth + 1 from mwalk w join madj a on a.graph_id = w.graph_id and a.src = node where depth < 6
), mhop as (select graph_id, source, node, min(depth) as depth from mwalk where node <> source group by all)"""
    return base(1) + graphs + asked + _paths() + reach + "\n" + "\nunion all ".join(parts)


def directed_components() -> str:
    """Strongly connected components by the closure of all nodes."""
    return base(1) + _GRAPHS + """, far as (
  select graph_id, node_id as a, node_id as b from nodes union select f.graph_id, f.a, m.dst from far f join madj m on m.graph_id = f.graph_id and m.src = f.b
) select x.graph_id, x.a as node_id, min(x.b) as component from far x join far y on x.graph_id = y.graph_id and x.a = y.b and x.b = y.a group by all"""


def directed_closure() -> str:
    """Number of nodes that each node leads to over open nodes, itself included."""
    return base(1) + _GRAPHS + """, far as (
  select graph_id, node_id as a, node_id as b from nodes where status = 'open' union select f.graph_id, f.a, m.dst from far f join moadj m on m.graph_id = f.graph_id and m.src = f.b
) select graph_id, a as node_id, count(*) as reached from far group by all"""


def deep_hops() -> str:
    """All nodes at any number of steps."""
    return base(1) + _GRAPHS + """, walk as (
  select graph_id, node_id as source, node_id as node, 0 as depth from nodes union select w.graph_id, source, dst, depth + 1 from walk w join madj a on a.graph_id = w.graph_id and a.src = node where depth < 24
) select graph_id, source, node as node_id, cast(min(depth) as bigint) as depth from walk where node <> source group by graph_id, source, node"""


def _static() -> str:
    """Rows of the static evaluation: answers on the graphs as stored against those on the graphs without directions."""
    n = "cast(substr(source, 2) as int)"
    asked = _ASKED.replace("mq as materialized", "mq0 as materialized") + f""", mq as materialized (
  select query_id, graph_id, source, target, kind, case when {n} % 3 = 0 then 'code' else attribute end as attribute, case when {n} % 3 = 0 then 'number' else value end as value, hops, radius
  from mq0 where target = 'n' || ({n} + 7) % 25
)"""
    gold, said = (mixed_answers(asked, g) for g in (_GRAPHS.replace(", true from", ", false from"), _GRAPHS))
    word = "case lower({0}) when 'true' then 'yes' when 'false' then 'no' else lower({0}) end"
    return f"""
with gold as ({gold}), said as ({said}), asked as ({base(1)}{_GRAPHS}{asked} select query_id, kind, source from mq)
select query_id as tuple_id, case when {n} % 2 = 0 then 'train' else 'test' end as split, kind as reasoning_type, case when {n} < 10 then 'small' else 'large' end as scale_bin,
  {word.format("gold.answer")} as gold_answer, {word.format("said.answer")} as predicted_answer,
  case when kind = 'path_cost' and try_cast(gold.answer as double) is not null and try_cast(said.answer as double) is not null then abs(cast(gold.answer as double) - cast(said.answer as double)) <= 0.011 else {word.format("gold.answer")} = {word.format("said.answer")} end as correct
from asked join gold using (query_id) join said using (query_id)"""


def _static_report() -> str:
    acc = "count(*) as n, count(*) filter (where correct) / count(*) as accuracy"
    return f"""with r as ({_static()}), t as (select reasoning_type as bucket, {acc} from r group by 1)
select 'task' as level, bucket, n, accuracy, accuracy >= 0.5 as passed from t
union all select 'scale', scale_bin, {acc}, null from r group by scale_bin
union all select 'all', null, {acc}, count(*) filter (where correct) / count(*) >= 0.7 and (select count(*) from t where accuracy < 0.5) = 0 from r"""


def oracle_sql() -> dict[str, str]:
    return {"mixed_answers": mixed_answers(), "directed_components": directed_components(), "directed_closure": directed_closure(), "deep_hops": deep_hops(), "static_eval": _static(), "static_report": _static_report()}
