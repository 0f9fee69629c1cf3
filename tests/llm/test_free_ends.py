"""op10's passages against a plain edit distance whose ends are free."""

import random

from turnwise.llm import decontaminate


def least_distance(item, words):
    """Sellers' table: the least edit distance of item to any stretch of words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_dropped_and_added_words_cost_one_edit(spark, tmp_path):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(8, 50)))) for i in range(40)]
    docs, within = [], {}
    for i in range(240):
        item_id, text = rng.choice(items)
        item, bound = text.split(), decontaminate.edit_bound(len(text.split()))
        own = [*item]
        for _ in range(bound + (i % 8 == 0)):  # some are one edit too far
            p = rng.randrange(len(own))
            own[p : p + 1] = {0: [], 1: [own[p], "zz"], 2: ["zz"]}[i % 3]
        words = rng.choices(vocab, k=40) + own * (i % 5 > 0) + rng.choices(vocab, k=rng.choice([0, 40]))
        docs.append((i, " ".join(words)))
        for k, t in items:
            d = least_distance(t.split(), words)
            if d <= decontaminate.edit_bound(len(t.split())):
                within[i, k] = d
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = decontaminate.op10(spark, str(tmp_path)).collect()
    best = {}
    for r in out:
        stretch = docs[r.doc_id][1].split()[r.first_word : r.first_word + r.n_words]
        assert decontaminate.edit_distance(items[r.item_id][1].split(), stretch, 60) == r.distance
        best[r.doc_id, r.item_id] = min(r.distance, best.get((r.doc_id, r.item_id), 99))
    assert len(within) > 100 and best == within
