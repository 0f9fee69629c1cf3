"""Line dedup against a comparison of all pairs of lines."""

import random

from turnwise.llm import line_dedup as L

SCHEMA = "doc_id long, text string, line string, _dropped int"


def one_edit(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, min_chars):
    lines = sorted((d, i, x.strip()) for d, t in docs if d is not None and t is not None for i, x in enumerate(t.split("\n")))
    lines = [x for x in lines if len(x[2]) >= min_chars]
    out = {}
    for k, (d, i, x) in enumerate(lines):
        if any(one_edit(x, y) for _, _, y in lines[:k]):
            out.setdefault(d, set()).add(i)
    return {d: sorted(s) for d, s in out.items()}


def random_docs(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randint(5, 14))) for _ in range(25)]

    def edited(x):
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.randrange(len(x) + 1)
            x = rng.choice([x[:p] + "z" + x[p:], x[:p] + x[p + 1 :], x[:p] + "q" + x[p + 1 :]]) or "a"
        return x

    return [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for i in range(n)]


def test_equals_all_pairs(spark):
    for seed in range(3):
        docs = random_docs(seed, 60) + [(1000, None), (1001, ""), (1002, "x" * 20_000 + "\n" + "x" * 19_999)]
        got = {r[0]: r[1] for r in L.dropped_lines(spark.createDataFrame(docs, "doc_id long, text string"), 6).collect()}
        assert got == brute(docs, 6)


def test_lines_go_and_rows_and_columns_stay(spark):
    line = "a line that is long enough"
    rows = [(1, f"{line}\nshort", "a", 1), (2, f"first\n{line}!\nlast", None, 2), (None, line, "b", 3), (3, None, "c", 4), (1, f"{line}\nshort", "a", 1)]
    out = L.dedup_lines(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "line", "_dropped"]
    texts = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert len(texts) == 5 and ("2", "first\nlast") in texts and ("None", line) in texts and ("3", "None") in texts


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert L.dropped_lines(none).count() == 0 and L.dedup_lines(none).count() == 0
