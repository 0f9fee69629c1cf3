"""SQL for the lengths of prompts, by writing every prompt out and counting its words, and for the structures of graphs after a first turn."""

from __future__ import annotations

_SIZES = """, gt as (
  select t.session_id, t.turn_index, n || '. Edges: ' || coalesce(e, '') || '.' as text from turns t
  join (select session_id, turn_index, 'Nodes: ' || string_agg(node_id || ':' || label || '[' || {attrs} || ']', '; ' order by node_id) as n from psn group by 1, 2) using (session_id, turn_index)
  left join (select session_id, turn_index, string_agg(lo || '-' || hi || '(relation=' || relation || ',weight=' || cast(weight as bigint) || ')', '; ' order by lo, hi) as e from pse group by 1, 2) using (session_id, turn_index)
), g0 as (
  select graph_id, n || '. Edges: ' || coalesce(e, '') || '.' as text
  from (select graph_id, 'Nodes: ' || string_agg(node_id || ':' || label || '[' || {attrs} || ']', '; ' order by node_id) as n from nodes group by 1)
  left join (select graph_id, string_agg(src || '-' || dst || '(relation=' || relation || ',weight=' || cast(weight as bigint) || ')', '; ' order by src, dst) as e from edges group by 1) using (graph_id)
), lines as (select session_id, turn_index, 'Update ' || row_number() over (partition by session_id order by turn_index) || ': ' || utterance as line from said
), past as (select a.session_id, a.turn_index, string_agg(b.line, chr(10) order by b.turn_index) as h from lines a join lines b on b.session_id = a.session_id and b.turn_index <= a.turn_index group by 1, 2
), told as (
  select session_id, turn_index, gt.text as now, g0.text as start, h, question,
         array_to_string(list_filter(string_split_regex(h, '\\s+'), lambda x: x <> '')[-64:], ' ') as budget
  from turns join gt using (session_id, turn_index) join g0 using (graph_id) join past using (session_id, turn_index) join ({question}) using (session_id, turn_index)
), prompts as (
  select session_id, turn_index, condition, case
      when condition = 'serialized_initial_history' then 'Initial graph: ' || start || chr(10) || h || chr(10) || question
      when condition = 'serialized_current_graph' then 'Current graph: ' || now || chr(10) || question
      when condition = 'modify_and_print' then 'Current graph: ' || now || chr(10) || h || chr(10) || question
      when condition = 'token_matched_history' then budget || chr(10) || question
      when condition in ('frozen_graph_history', 'graph_once_then_text', 'soft_prompt') then h || chr(10) || question else question end as prompt
  from told, (select unnest(['question_only', 'frozen_graph_history', 'graph_once_then_text', 'shuffled_graph', 'oracle_updated_graph', 'predicted_updated_graph', 'serialized_initial_history', 'token_matched_history',
    'serialized_current_graph', 'tool_solver', 'soft_prompt', 'soft_prompt_no_history', 'structure_only', 'modify_and_print', 'stale_answer', 'majority_answer']) as condition)
)
select session_id, turn_index, condition, len(list_filter(string_split_regex(prompt, '\\s+'), lambda x: x <> '')) as input_tokens from prompts"""


def _round(i: int) -> str:
    return f""", c{i} as (
  select c.session_id, c.node_id, md5(any_value(c.c) || '|' || coalesce(string_agg(o.c, ',' order by o.c), '')) as c
  from c{i - 1} c left join ladj a on a.session_id = c.session_id and a.src = c.node_id left join c{i - 1} o on o.session_id = a.session_id and o.node_id = a.dst group by 1, 2
)"""


_STRUCTURES = """, opening as (select session_id, turn_index from turns where turn_index = 0
), ladj as (
  select distinct session_id, lo as src, hi as dst from pse join opening using (session_id, turn_index) union select session_id, hi, lo from pse join opening using (session_id, turn_index)
), c0 as (select session_id, node_id, md5('line=' || line || ',size=' || size || ',status=' || status) as c from psn join opening using (session_id, turn_index))""" + "".join(map(_round, (1, 2, 3))) + """
, h as (select session_id, md5(string_agg(c, ',' order by c)) as wl_hash from c3 group by 1)
select wl_hash, count(*) filter (where session_id % 2 = 0) as learn_sessions, count(*) filter (where session_id % 2 = 1) as score_sessions from h group by 1
having count(*) filter (where session_id % 2 = 0) > 0 and count(*) filter (where session_id % 2 = 1) > 0"""


def sql(turns_and_states: str, attrs: str, question: str) -> dict[str, str]:
    return {"structure_overlap": turns_and_states + _STRUCTURES, "prompt_sizes": turns_and_states + _SIZES.replace("{attrs}", attrs).replace("{question}", question)}
