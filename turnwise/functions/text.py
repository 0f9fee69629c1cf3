"""Text functions: answers, edit programs, histories, budgets. All are Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import let, literal

#: Answers that mean the same.
ALIASES = {"true": "yes", "false": "no", "no path": "unreachable", "not reachable": "unreachable"}
_LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """What a group of the pattern's first match holds, null without a match."""
    found = F.regexp_extract(c, pattern, group)
    return F.when(found != "", found)


def normalize_answer(c: Column) -> Column:
    """The answer in a reply, read from its first line that is not blank, in lower case and without final stops.

    In this order: an alias as it stands; what the line leads with (unreachable, yes or no, a
    number); unreachable or no path anywhere; the first number that stands by itself; the first yes
    or no; the line itself. Null stays null.
    """
    lines = F.filter(F.transform(F.split(c, _LINE_ENDS), stripped), lambda x: x != "")
    line = F.regexp_replace(F.lower(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))), r"\.+$", "")
    # What most answers are stays as it is.
    plain = c.isin("yes", "no", "unreachable") | c.rlike(r"^[0-9]+\z")
    return F.when(plain, c).when(c.isNotNull(), let(line, _answer_in))


def _answer_in(line: Column) -> Column:
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    lead, word = _first(line, r"(?U)^(yes|no|true|false)\b"), _first(line, r"(?U)\b(yes|no|true|false)\b")
    return F.coalesce(
        alias[line],
        F.when(line.rlike(r"(?U)^(?:unreachable|no path|not reachable)\b"), "unreachable"),
        alias[lead], lead,
        _first(line, r"(?U)^(-?\d+(?:\.\d+)?)(?![\w.-])"),
        F.when(line.contains("unreachable") | line.contains("no path"), "unreachable"),
        _first(line, r"(?U)(?<![\w.-])(-?\d+(?:\.\d+)?)(?![\w.-])"),
        alias[word], word, line,
    )


def answer_set(c: Column) -> Column:
    """The distinct entries of a comma-separated list; none and the empty text are the empty list."""
    parts = F.filter(F.transform(F.split(c, ","), stripped), lambda x: x != "")
    return F.when(c.isin("none", ""), F.array().cast("array<string>")).otherwise(F.array_distinct(parts))


def set_f1(gold: Column, said: Column) -> Column:
    """F1 of two answers as sets; 1 if both are empty. Null is the empty list."""
    x, y = (answer_set(F.coalesce(normalize_answer(c), F.lit(""))) for c in (gold, said))
    both = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 1.0).otherwise(2 * both / total)


#: Kinds whose answers are compared as numbers, within 0.01.
NUMERIC = ("shortest_path", "filtered_neighbor_count", "filtered_path_count", "node_degree", "node_count", "path_cost", "within_hops_count")


def answers_match(kind: Column, gold: Column, said: Column) -> Column:
    """Whether two answers agree once normalised: numbers within 0.01, lists as sets, other kinds as equal texts; null equals null only."""
    return let(F.struct(normalize_answer(gold).alias("a"), normalize_answer(said).alias("b")), lambda x: normalized_match(kind, x["a"], x["b"]))


def normalized_match(kind: Column, a: Column, b: Column) -> Column:
    """answers_match() of answers that normalize_answer() has been through."""
    x, y = a.try_cast("double"), b.try_cast("double")
    as_sets = (a == b) | (F.array_sort(answer_set(a)) == F.array_sort(answer_set(b)))
    same = F.when(kind == "within_hops_list", as_sets).when(kind.isin(*NUMERIC) & x.isNotNull() & y.isNotNull(), F.abs(x - y) <= 0.01).otherwise(a == b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def token_budget(c: Column, n: int) -> Column:
    """The last n words, or the text unchanged if it has no more."""
    w = words(c)
    return F.when(F.size(w) <= n, c).otherwise(F.array_join(F.slice(w, -n, n), " "))


def history(turns: DataFrame, session: str, order: str, text: str, kept: int | None = None) -> DataFrame:
    """Turns with ``history``: the texts before each, or the last ``kept`` of them, numbered from the first of the session.

    Without kept a history is as long as its session, which is for sessions of bounded length.
    """
    w = Window.partitionBy(session).orderBy(order)
    said = turns.withColumn("_nth", F.row_number().over(w)).withColumn("_line", F.concat(F.lit("Update "), F.col("_nth").cast("string"), F.lit(": "), F.coalesce(text, F.lit(""))))
    lines = F.collect_list("_line").over(w.rowsBetween(Window.unboundedPreceding if kept is None else -kept, -1))
    return said.withColumn("history", F.array_join(lines, "\n")).drop("_nth", "_line")


def canonical_edit(operation: Column, target: Column, first: Column, second: Column, attribute: Column, value: Column, label: Column, relation: Column) -> Column:
    """The program text of one edit: nulls at the end are left out."""
    def line(*parts):
        return F.array_join(F.array_compact(F.array(*parts)), " ")

    node = F.when(operation == "SET", line(operation, target, first, attribute, value)).otherwise(line(operation, target, first, label))
    return F.when(operation == "NOOP", "NOOP").when(target == "NODE", node).otherwise(line(operation, target, first, second, relation))


def program_text(edits: Column) -> Column:
    """The text of a program from the texts of its edits."""
    return F.when(F.size(edits) == 0, "END").otherwise(F.concat(F.array_join(edits, " ; "), F.lit(" ; END")))


def program_edits(c: Column) -> Column:
    """The edit texts of a program: cut at a final END, split at semicolons, blanks dropped."""
    body = F.regexp_replace(stripped(c), r"(?i)END$", "")
    return F.filter(F.transform(F.split(body, ";"), stripped), lambda x: x != "")


def generated_program(c: Column) -> Column:
    """The program in a generation: what stands before the first END as a word, else its first line."""
    has_end = c.rlike(r"(?i)\bEND\b")
    return F.when(has_end, F.regexp_extract(c, r"(?is)^(.*?)\bEND\b", 1)).otherwise(F.try_element_at(F.split(c, "\n", 2), F.lit(1)))


def parse_edit(c: Column, names: Column | None = None) -> Column:
    """A struct (operation, target, first, second, attribute, value, label, relation, reason, error) of one edit text.

    names maps lower-cased names to ids: the longest name that the words begin with is taken, else
    one word is an id of its own. value is the literal as it prints, error says what is wrong (null
    if nothing), and then the other fields are null.
    """
    return let(words(c), lambda t: let(_take(_after(t, F.lit(2)), names), lambda one: let(_take(one["rest"], names), lambda two: let(literal(F.array_join(_after(one["rest"], F.lit(1)), " ")), lambda value: _edit(t, one, two, value)))))


def _after(x: Column, n: Column) -> Column:
    """The words after the first n."""
    return F.when(n < F.size(x), F.slice(x, n + 1, F.size(x))).otherwise(F.array().cast("array<string>"))


def _take(x: Column, names: Column | None) -> Column:
    """A struct of the id that the words begin with, and the words that are left."""
    one = F.struct(F.try_element_at(x, F.lit(1)).alias("id"), _after(x, F.lit(1)).alias("rest"))
    if names is None:
        return one
    sizes = F.when(F.size(x) > 0, F.sequence(F.size(x), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    known = F.filter(sizes, lambda n: F.map_contains_key(names, F.lower(F.array_join(F.slice(x, 1, n), " "))))
    return let(F.try_element_at(known, F.lit(1)), lambda n: F.when(n.isNull(), one).otherwise(F.struct(names[F.lower(F.array_join(F.slice(x, 1, n), " "))].alias("id"), _after(x, n).alias("rest"))))


def _edit(t: Column, one: Column, two: Column, value: Column) -> Column:
    op, target, rest = F.upper(F.try_element_at(t, F.lit(1))), F.upper(F.try_element_at(t, F.lit(2))), one["rest"]
    error = (
        F.when(F.size(t) == 0, "empty")
        .when(~op.isin("SET", "ADD", "DEL", "NOOP"), "unknown_operation")
        .when(op == "NOOP", F.lit(None))
        .when(F.size(t) < 3, "incomplete")
        .when(~target.isin("NODE", "EDGE"), "unknown_target")
        .when((target == "NODE") & (op == "SET") & (F.size(rest) < 2), "value_missing")
        .when((target == "NODE") & (op == "SET") & value["error"].isNotNull(), "value_not_scalar")
        .when((target == "EDGE") & (op == "SET"), "set_edge")
        .when((target == "EDGE") & ((F.size(t) < 4) | two["id"].isNull()), "name_missing")
    )
    joined = lambda x: F.when(F.size(x) > 0, F.array_join(x, " "))

    def fields(error: Column) -> Column:
        fine = error.isNull()
        node_set, edge = fine & (op == "SET"), fine & (target == "EDGE")
        return F.struct(
            F.when(fine, op).alias("operation"),
            F.when(fine & (op != "NOOP"), target).alias("target"),
            F.when(fine & (op != "NOOP"), one["id"]).alias("first"),
            F.when(edge, two["id"]).alias("second"),
            F.when(node_set, F.try_element_at(rest, F.lit(1))).alias("attribute"),
            F.when(node_set, value["text"]).alias("value"),
            F.when(fine & (target == "NODE") & (op != "SET"), joined(rest)).alias("label"),
            F.when(edge, F.coalesce(F.try_element_at(two["rest"], F.lit(1)), F.lit("connected"))).alias("relation"),
            F.when(fine & (op == "NOOP"), joined(_after(t, F.lit(1)))).alias("reason"),
            error.alias("error"),
        )

    return let(error, fields)


#: What a user says for an edit, by family; {x} and {y} are labels, {r} the relation.
SAYINGS = {
    ("SET_CLOSED", "direct"): "{x} is closed now.", ("SET_CLOSED", "service"): "Service at {x} has been suspended.", ("SET_CLOSED", "notice"): "Please mark {x} as closed.",
    ("SET_OPEN", "direct"): "{x} has reopened.", ("SET_OPEN", "service"): "Service at {x} has resumed.", ("SET_OPEN", "notice"): "Please mark {x} as open.",
    ("ADD", "direct"): "A new {r} link now connects {x} and {y}.", ("ADD", "service"): "A {r} connection between {x} and {y} has opened.", ("ADD", "notice"): "Please add a {r} edge between {x} and {y}.",
    ("DEL", "direct"): "The {r} link between {x} and {y} is gone.", ("DEL", "service"): "The {r} connection between {x} and {y} has closed.", ("DEL", "notice"): "Please remove the {r} edge between {x} and {y}.",
}
#: What a user says when nothing changes.
SILENCES = {
    "direct": ("No change this turn.", "Nothing to update on the graph.", "Leave the network as it is."),
    "service": ("Operations report: no network changes.", "Service bulletin: status quo maintained.", "No suspension or reopening this turn."),
    "notice": ("Please make no changes to the graph.", "Hold the current network state.", "Do not apply any edit this turn."),
}


def filled(template: str, **fields: Column) -> Column:
    """A template's text with its {fields} replaced by columns."""
    parts = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        if piece:
            parts.append(fields[piece] if i % 2 else F.lit(piece))
    return F.concat(*parts)


def utterance(op: Column, family: Column, x: Column, y: Column, relation: Column, pick: Column) -> Column:
    """What a user of a family of wordings says for an edit; pick (0 to 2) chooses among the ways to say that nothing changes."""
    out = F.lit(None).cast("string")
    for (o, f), t in SAYINGS.items():
        out = F.when((op == o) & (family == f), filled(t, x=x, y=y, r=relation)).otherwise(out)
    for f, ways in SILENCES.items():
        out = F.when((op == "NOOP") & (family == f), F.element_at(F.array(*map(F.lit, ways)), (pick + 1).cast("int"))).otherwise(out)
    return out


#: The wording of each kind of question; {s} and {t} are labels, {a} the attribute, {v} its value, {h} the hops.
QUESTIONS = {
    "shortest_path": "How many stations, including endpoints, are on the shortest open path from {s} to {t}? Answer with a number or unreachable.",
    "reachability": "Can {t} be reached from {s} using open stations? Answer yes or no.",
    "filtered_neighbor_count": "How many stations directly connected to {s} have {a} equal to {v}? Answer with a number.",
    "filtered_path_count": "On the shortest open path from {s} to {t}, how many stations have {a} equal to {v}?",
    "cycle_membership": "Is {s} part of any cycle? Answer yes or no.",
    "node_degree": "What is the degree of {s}? Answer with a number.",
    "node_count": "How many stations are in the network? Answer with a number.",
    "path_cost": "What is the total travel cost along the shortest open path from {s} to {t}? Answer with a number or unreachable.",
    "constrained_reachability": "Can {t} be reached from {s} without passing through any station where {a} is {v}? Answer yes or no.",
    "within_hops_count": "How many other stations are within {h} hops of {s}? Answer with a number.",
    "within_hops_count/filtered": "How many other stations within {h} hops of {s} have {a} equal to {v}? Answer with a number.",
    "within_hops_list": "Which stations are within {h} hops of {s}? Answer with a comma-separated list, or 'none'.",
    "within_hops_list/filtered": "Which stations within {h} hops of {s} have {a} equal to {v}? Answer with a comma-separated list, or 'none'.",
    "most_common_attribute_within_hops": "What is the most common {a} among stations within {h} hops of {s}, including {s} itself?",
    "attribute_lookup": "What is the {a} of {s}? Answer directly.",
    "attribute_check": "Does {s} have {a} equal to {v}? Answer yes or no.",
}
#: The wording of every other kind, and of a constrained question that states which ends are exempt.
EDGE_QUESTION = "Is there a direct edge between {s} and {t}? Answer yes or no."
EXEMPT_QUESTION = "Can {t} be reached from {s} without passing through any intermediate station where {a} is {v}? (The start and end stations are exempt.) Answer yes or no."


def question(kind: Column, source: Column, target: Column, attribute: Column, value: Column, hops: Column, exempt: bool = False) -> Column:
    """The text of a question; source and target are labels, hops 0 or null stands for 2. exempt states the exemption of the ends."""
    radius = F.coalesce(F.when(hops != 0, hops), F.lit(2)).cast("string")
    fields = {"s": source, "t": F.coalesce(target, F.lit("")), "a": F.coalesce(attribute, F.lit("None")), "v": F.coalesce(value, F.lit("None")), "h": radius}
    out = filled(EDGE_QUESTION, **fields)
    for name, t in QUESTIONS.items():
        k, _, filtered = name.partition("/")
        t = EXEMPT_QUESTION if exempt and k == "constrained_reachability" else t
        on = (kind == k) & attribute.isNotNull() if filtered else (kind == k)
        out = F.when(on, filled(t, **fields)).otherwise(out)
    return out


def facts(label: Column, attributes: Column, excluded: Column) -> Column:
    """A node in words: its label and its attributes (array of structs name, text), sorted by name, without the excluded names."""
    kept = F.filter(F.array_sort(attributes), lambda x: ~F.array_contains(excluded, x["name"]))
    listed = F.array_join(F.transform(kept, lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x["text"], F.lit("None")))), ", ")
    return F.when(F.size(kept) > 0, F.concat(label, F.lit(": "), listed, F.lit("."))).otherwise(F.concat(label, F.lit(".")))


def with_facts(text: Column, source: Column, target: Column) -> Column:
    """A question with the words of its nodes in a line before it, equal ones once, null ones not at all."""
    said = F.array_distinct(F.array_compact(F.array(source, target)))
    return F.when(F.size(said) > 0, F.concat(F.array_join(said, " "), F.lit("\n"), text)).otherwise(text)
