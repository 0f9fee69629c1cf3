"""DuckDB SQL for hashed node vectors, messages, covariance and collapse statistics."""

from __future__ import annotations

from .base_sql import base

_HASH = """, vkeys as (
  select graph_id, node_id, unnest(['id=' || node_id, 'label=' || label, 'attr:has_rail=' || case when has_rail then 'true' else 'false' end, 'attr:disabled_access=' || case when disabled_access then 'true' else 'false' end,
    'attr:line="' || line || '"', 'attr:cleanliness="' || cleanliness || '"', 'attr:size="' || size || '"', 'attr:status="' || status || '"',
    'attr:code=' || ['true', '"true"', '1', '1.0'][nk % 4 + 1], case when nk % 4 >= 2 then 'numeric:code' end]) as key from nodes
), vplace as (
  select graph_id, node_id, cast(cast('0x' || left(h, 16) as ubigint) % 256 as int) as bucket, case when key like 'numeric:%' then tanh(1.0) else 1.0 end * case when cast('0x' || substr(h, 17, 2) as int) % 2 = 1 then 1 else -1 end as x
  from (select *, sha256('graph-node-v1' || chr(0) || key) as h from vkeys where key is not null)
), vraw as (select graph_id, node_id, bucket, sum(x) as value from vplace group by all having sum(x) <> 0
), vec as (select graph_id, node_id, bucket, value / sqrt(sum(value * value) over (partition by graph_id, node_id)) as value from vraw)"""


def node_vectors() -> str:
    return base(1) + _HASH + "select graph_id, node_id, bucket, round(value, 9) as value from vec"


def messages(how: str) -> str:
    value = {"sum": "total", "mean": "total / greatest(w, 1.0)", "max": "case when n < every then greatest(top, 0.0) else top end"}[how]
    return base(1) + _HASH + f""", met as (
  select a.graph_id, a.dst as node_id, bucket, sum(weight * value) as total, max(weight * value) as top, count(*) as n from adj a join vec v on v.graph_id = a.graph_id and v.node_id = a.src group by all
), about as (select graph_id, dst as node_id, sum(abs(weight)) as w, count(*) as every from adj group by all)
select graph_id, node_id, bucket, round({value}, 9) as value from met join about using (graph_id, node_id) where {value} <> 0"""


_FINITE = "usable as (select vec_id, label, embedding from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), dims as materialized (select vec_id, label, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from usable)"


def covariance() -> str:
    return f"with {_FINITE} select a.i, b.i as j, round(covar_samp(a.x, b.x), 6) + 0.0 as value from dims a join dims b using (vec_id) group by all"


def collapse() -> str:
    return f"""with {_FINITE}, unit as (select label, i, x / greatest(sqrt(sum(x * x) over (partition by vec_id)), 1e-12) as v from dims),
parts as (select label, i, sum(v) as s, count(*) as n from unit group by all),
cosine as (select label, (sum(s * s) - max(n)) / greatest(1, max(n) * (max(n) - 1)) as c from parts group by label),
cov as (select a.i, b.i as j, covar_samp(a.x, b.x) as value from dims a join dims b using (vec_id) group by all)
select round((select avg(c) from cosine), 9) as mean_within_cosine, round(power(sum(value) filter (where i = j), 2) / sum(value * value), 6) as effective_rank, count(*) filter (where i = j) as dim from cov"""


def oracle_sql() -> dict[str, str]:
    return {"node_vectors": node_vectors(), **{f"message_{h}": messages(h) for h in ("sum", "mean", "max")}, "embedding_covariance": covariance(), "collapse_statistics": collapse()}
