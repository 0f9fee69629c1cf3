"""Moments, components, collapse, the probe and boosting against plain NumPy; the leak audit against loops."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.operators import boosting, leaks, spectrum


def table(spark, x, labels):
    rows = [(i, str(v), r.tolist()) for i, (r, v) in enumerate(zip(x, labels, strict=True))]
    return spark.createDataFrame([*rows, (900, "a", None), (901, "b", [float("nan")] * x.shape[1]), (902, "a", [1.0])], "vec_id long, label string, embedding array<double>").repartition(5)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 150)
    return rng.normal(size=(3, 6))[y] + rng.normal(size=(150, 6)) * 1.5, y


def test_moments_components_and_collapse(spark, data):
    x, y = data
    df = table(spark, x, y)
    n, mean, c = spectrum.moments(df)
    assert n == 150 and np.allclose(mean, x.mean(0)) and np.allclose(c, np.cov(x, rowvar=False))
    got = spectrum.principal_components(df, 4).orderBy("component").collect()
    values, basis = np.linalg.eigh(np.cov(x, rowvar=False))
    assert np.allclose([r.eigenvalue for r in got], values[::-1][:4]) and np.isclose(sum(r.explained for r in got), values[::-1][:4].sum() / values.sum())
    assert all(np.isclose(abs(np.dot(r.vector, basis[:, -1 - i])), 1) and max(r.vector, key=abs) > 0 for i, r in enumerate(got))
    r = spectrum.collapse(df, "label").first()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.mean([((u[y == k] @ u[y == k].T).sum() - (y == k).sum()) / ((y == k).sum() * ((y == k).sum() - 1)) for k in range(3)])
    assert np.isclose(r.mean_within_cosine, want) and np.isclose(r.effective_rank, values.sum() ** 2 / (values**2).sum()) and r.dim == 6
    assert spectrum.moments(df.where("false"))[0] == 0 and spectrum.principal_components(df.where("false"), 2).count() == 0


def test_probe_equals_newton(spark, data):
    x, y = data
    p = spectrum.fit_probe(table(spark, x, y).where("vec_id < 900"), "label")
    z = np.c_[(x - x.mean(0)) / x.std(0, ddof=1), np.ones(150)]
    w, ridge = np.zeros((3, 7)), np.diag([2e-4] * 6 + [1e-12])
    for _ in range(50):
        s = np.exp(z @ w.T)
        q = s / s.sum(1, keepdims=True)
        g = (q - np.eye(3)[y]).T @ z / 150 + w @ ridge
        h = np.einsum("nk,nkl,ni,nj->kilj", np.ones((150, 3)), np.einsum("nk,kl->nkl", q, np.eye(3)) - q[:, :, None] * q[:, None, :], z, z).reshape(21, 21) / 150 + np.kron(np.eye(3), ridge)
        w -= np.linalg.lstsq(h, g.ravel(), rcond=None)[0].reshape(3, 7)
    assert np.allclose(p.weights[:, :-1], w[:, :-1], atol=2e-3)
    assert np.allclose(p.weights[:, -1] - p.weights[0, -1], w[:, -1] - w[0, -1], atol=2e-3)
    got = {r.vec_id: r.predicted for r in p.predict(table(spark, x, y), "label").collect()}
    assert got == {i: str(k) for i, k in enumerate((z @ w.T).argmax(1))}


def plain_boost(x, y, classes, rounds, depth, rate):
    """Scores by exhaustive splits over raw rows."""
    k = len(classes)
    onehot = np.array([[a == c for c in classes] for a in y], float)
    s = np.tile(np.log(onehot.mean(0)), (len(x), 1))

    def grow(g, rows, left):
        value = (k - 1) / k * g[rows].sum() / h if (h := (np.abs(g[rows]) * (1 - np.abs(g[rows]))).sum()) > 1e-150 else 0.0
        best = (1e-12, None)
        if left and len(rows) > 1:
            for j in range(x.shape[1]):
                for v in sorted(set(x[rows, j]))[:-1]:
                    a, b = rows[x[rows, j] <= v], rows[x[rows, j] > v]
                    gain = len(a) * len(b) / len(rows) * (g[a].mean() - g[b].mean()) ** 2
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (a, b))
        if best[1] is None:
            return [(rows, value)]
        return grow(g, best[1][0], left - 1) + grow(g, best[1][1], left - 1)

    for _ in range(rounds):
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for c in range(k):
            for rows, value in grow(onehot[:, c] - p[:, c], np.arange(len(x)), depth):
                s[rows, c] += rate * value
    return s


def test_boosting_equals_a_plain_fit(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 2)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (120, 4)).astype(float)
    y = ["a" if r[0] + r[1] > 6 else ("b" if r[2] > 2 else "c") for r in x]
    y = [rng.choice(["a", "b", "c"]) if rng.random() < 0.15 else v for v in y]
    rows = [("t", r.tolist(), str(v)) for r, v in zip(x, y, strict=True)] + [("one", [1.0, 2.0, 3.0, 4.0], "z")] * 3 + [("t", [0.0] * 4, None)]
    df = spark.createDataFrame(rows, "task string, features array<double>, answer string").repartition(3)
    model = boosting.fit(df, rounds=4, depth=3)
    want = plain_boost(x, y, ["a", "b", "c"], 4, 3, 0.1)
    assert np.allclose(model.scores("t", model.binned("t", x)), want, atol=1e-9)
    asked = spark.createDataFrame([(i, "t", r.tolist()) for i, r in enumerate(x)] + [(500, "one", [0.0] * 4), (501, "new", [0.0] * 4)], "id int, task string, features array<double>")
    got = {r.id: r.guess for r in boosting.predict(asked, model).collect()}
    assert got == {i: "abc"[k] for i, k in enumerate(want.argmax(1))} | {500: "z", 501: None}


def plain_audit(fit, score):
    out = {}
    for task in sorted({t for t, _, _ in score}):
        rows, held = [(f, a) for t, a, f in score if t == task], [(f, a) for t, a, f in fit if t == task]
        names = sorted({n for f, _ in held for n in f})
        q, w = [n for n in names if n.startswith("q.")], [n for n in names if not n.startswith("q.")]

        def acc(a, b, combo):
            rule = {}
            for f, y in a:
                rule.setdefault(tuple(f.get(n) for n in combo), Counter())[y] += 1
            rule = {k: c.most_common(1)[0][0] for k, c in rule.items()}
            return sum(rule.get(tuple(f.get(n) for n in combo)) == y for f, y in b) / max(1, len(b))

        half = len(held) // 2
        cv = lambda c: acc(held[:half], held[half:], c) + acc(held[half:], held[:half], c)  # noqa: E731, B023
        own = [(), *[(n,) for n in q]] + ([tuple(q)] if len(q) > 1 else [])
        both = [(*q, n) for n in w] + [(*q, a, b) for i, a in enumerate(w) for b in w[i + 1 :]]
        qc = max(own, key=cv)
        nc = max(both, key=cv) if both else qc
        a, b = acc(held, rows, qc), acc(held, rows, nc)
        out[task] = (Counter(y for _, y in rows).most_common(1)[0][1] / len(rows), a, b, "+".join(nc), b > a + 0.05)
    return out


def test_leak_audit_equals_loops(spark):
    rng = random.Random(2)
    def row(task):
        f = {"q.attribute": rng.choice("xy"), "src.line": rng.choice("rgb"), "tgt.line": rng.choice(["r", "g", None]), "src.size": rng.choice("12")}
        if rng.random() < 0.3:
            del f["src.size"]
        if task == "b":
            f["q.hops"] = rng.choice("23")
        if task == "plain":
            f = {"q.attribute": rng.choice("xy")}
        leak = f.get("src.line", "n") if rng.random() < 0.7 else rng.choice("rgb")
        return task, leak if task != "c" else rng.choice("rgb"), f
    fit, score = [row(rng.choice(["a", "b", "c", "plain"])) for _ in range(240)], [row(rng.choice(["a", "b", "c", "plain", "new"])) for _ in range(120)]
    frame = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, task string, answer string, features map<string,string>").repartition(4)
    got = {r.task: (r.majority_accuracy, r.question_only_rule_accuracy, r.with_node_text_rule_accuracy, r.node_text_rule_features, r.leak_flag) for r in leaks.audit(frame(fit), frame(score), ["i"]).collect()}
    want = plain_audit(fit, score)
    assert got.keys() == want.keys()
    for t in want:
        assert got[t][:3] == pytest.approx(want[t][:3]) and got[t][3:] == want[t][3:], t


def test_structure_features(spark):
    nodes = spark.createDataFrame([("g", n, n != "c") for n in "abcd"], "graph_id string, node_id string, is_open boolean")
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "a"), ("g", "b", "c")], "graph_id string, src string, dst string")
    q = spark.createDataFrame([("g", "b", "d", 3), ("g", "a", None, None), ("g", "zz", "c", 0)], "graph_id string, source string, target string, hops int")
    got = {r.source: r.features for r in boosting.structure_features(q, nodes, edges).collect()}
    assert got == {"b": [2, 0, 2, 1, 1, 0, 0, 0, 0, 0, 3, 4, 1], "a": [1, 0, 0, 2, 0, *[-1] * 5, 0, 4, 1], "zz": [*[-1] * 5, 1, 1, 0, 2, 0, 0, 4, 1]}
