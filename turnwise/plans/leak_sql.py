"""DuckDB SQL for the text-leak audit, from the sessions' answers."""

from __future__ import annotations


def _told(role: str, node: str) -> str:
    """What a prompt says of a node: names and values, without the status and what is asked for."""
    fields = {"line": f"{node}.line", "has_rail": f"case when {node}.has_rail then 'True' else 'False' end", "disabled_access": f"case when {node}.disabled_access then 'True' else 'False' end", "cleanliness": f"{node}.cleanliness", "size": f"{node}.size"}
    hidden = "kind in ('attribute_lookup', 'attribute_check', 'most_common_attribute_within_hops') and attribute = '{0}'"
    return ", ".join(f"case when {node}.node_id is not null and not coalesce({hidden.format(k)}, false) then {{'k': '{role}.{k}', 'v': {v}}} end" for k, v in fields.items())


def audit(answers: str) -> str:
    """answers: the CTEs up to asked, nodes and ans."""
    line = "case when list_contains(list_transform(f, lambda x: x.k), 'src.line') and list_contains(list_transform(f, lambda x: x.k), 'tgt.line') then {'k': 'same_line', 'v': case when list_filter(f, lambda x: x.k = 'src.line')[1].v = list_filter(f, lambda x: x.k = 'tgt.line')[1].v then 'true' else 'false' end} end"
    mode = "arg_max(answer, {{'n': {n}, 'a': -{a}}}) filter (where {n} > 0)"
    same = "r.task = c.task and r.question = c.question and r.ord = c.ord and r.key = c.key"
    key = "array_to_string(list_transform(names, lambda n: coalesce(list_filter(f, lambda x: x.k = n)[1].v, chr(1))), chr(2))"
    return answers + f""", lf0 as (
  select q.session_id, q.turn_index, q.kind as task, gold as answer,
    list_filter([{{'k': 'q.attribute', 'v': attribute}}, {{'k': 'q.value', 'v': value}}, {{'k': 'q.hops', 'v': cast(hops as varchar)}}, {_told("src", "x")}, {_told("tgt", "y")}], lambda x: x is not null) as f
  from asked q join (select session_id, turn_index, gold from ans) using (session_id, turn_index) left join nodes x on x.graph_id = q.graph_id and x.node_id = q.source left join nodes y on y.graph_id = q.graph_id and y.node_id = q.target
), lf as materialized (select session_id, turn_index, task, answer, list_filter(list_append(f, {line}), lambda x: x is not null) as f from lf0
), lfit as materialized (
  select *, row_number() over (partition by task order by session_id, turn_index) - 1 as idx, case when row_number() over (partition by task order by session_id, turn_index) - 1 >= count(*) over (partition by task) // 2 then 1 else 0 end as fold from lf where session_id % 2 = 0
), lnames as (
  select task, list_sort(list_filter(ns, lambda n: starts_with(n, 'q.'))) as q, list_sort(list_filter(ns, lambda n: not starts_with(n, 'q.'))) as w from (select task, list(distinct k) as ns from (select task, unnest(list_transform(f, lambda x: x.k)) as k from lfit) group by task)
), lsets as materialized (
  select task, true as question, 0 as ord, []::varchar[] as names from lnames
  union all select task, true, i, [q[i]] from (select *, unnest(range(1, len(q) + 1)) as i from lnames)
  union all select task, true, len(q) + 1, q from lnames where len(q) > 1
  union all select task, false, i, list_append(q, w[i]) from (select *, unnest(range(1, len(w) + 1)) as i from lnames)
  union all select task, false, i * 1000 + j, list_append(list_append(q, w[i]), w[j]) from (select *, unnest(range(i + 1, len(w) + 1)) as j from (select *, unnest(range(1, len(w) + 1)) as i from lnames))
), lcount as materialized (
  select task, question, ord, key, answer, count(*) filter (where fold = 0) as n0, count(*) filter (where fold = 1) as n1, min(idx) filter (where fold = 0) as a0, min(idx) filter (where fold = 1) as a1, min(idx) as a
  from (select l.task, question, ord, answer, fold, idx, {key} as key from lfit l join lsets s on s.task = l.task) group by all
), lrule as materialized (
  select task, question, ord, key, {mode.format(n="n0", a="a0")} as r0, {mode.format(n="n1", a="a1")} as r1, arg_max(answer, {{'n': n0 + n1, 'a': -a}}) as rule from lcount group by all
), lcv as (
  select c.task, c.question, c.ord, coalesce(sum(n1) filter (where answer = r0), 0) / greatest(sum(n1), 1) + coalesce(sum(n0) filter (where answer = r1), 0) / greatest(sum(n0), 1) as cv from lcount c join lrule r on {same} group by all
), lbest as (
  select task, question, ord, names from (select s.*, row_number() over (partition by s.task, s.question order by cv desc, s.ord) as r from lsets s join lcv using (task, question, ord)) where r = 1
), lscore as (
  select c.task, c.question, avg(case when r.rule = c.answer then 1.0 else 0.0 end) as acc from (
    select l.task, l.answer, b.question, b.ord, {key} as key from lf l join lbest b on b.task = l.task where session_id % 2 = 1) c left join lrule r on {same} group by all
), lmajor as (select task, max(n) / sum(n) as m from (select task, answer, count(*) as n from lf where session_id % 2 = 1 group by all) group by task)
select q.task, m as majority_accuracy, q.acc as question_only_rule_accuracy, n.acc as with_node_text_rule_accuracy, array_to_string(b.names, '+') as node_text_rule_features, n.acc > q.acc + 0.05 as leak_flag
from lscore q join lscore n on q.task = n.task and q.question and not n.question join lbest b on b.task = q.task and not b.question join lmajor m on m.task = q.task"""
