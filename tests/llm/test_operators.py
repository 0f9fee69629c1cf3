"""The numbered operators against brute-force versions, round trips and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pytest

from turnwise.llm import chat_format, decontaminate, embedding_dedup, html_extract, language_id, packing, simhash, token_counts, tokens, toxicity

DATA = "/root/testdata"


def components(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# 1, packing


def test_packed_pieces_give_back_every_token(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["alpha", "béta", "γ", "<|x"]) for _ in range(rng.choice([0, 3, 700, 1500]))), "hot" if i % 3 else f"s{i % 5}", i) for i in range(60)]
    docs += [(100, None, None, 0), (None, "x y", "a", 1)]
    out = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string, start int"), with_ids=True).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc_id, text, _, _ in docs:
        own = sorted(pieces[doc_id], key=lambda r: r.start)
        want = [*tokens._full(tokens.default_path()).encode(text or "", add_special_tokens=False).ids, 0]
        assert [x for r in own for x in r.ids] == want
        for r in own:
            assert r.doc_tokens == len(want) and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or s == len(sequences) - 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_windows_follow_the_target_mixture(spark):
    docs = [(i, "word " * 200, "ab"[i % 2]) for i in range(200)]
    out = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), shares={"a": 0.75, "b": 0.25}).where("sequence_id between 2 and 20")
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert 0.7 < got["a"] / (got["a"] + got["b"]) < 0.8


# 3, token counts


def test_totals_follow_deltas_and_repeated_batches_change_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "t", 5), ("a", "en", "t", 7), (None, "fr", "t", 1)], "source string, lang string, tokenizer string, n_tokens long")
    d = str(tmp_path / "state")
    assert token_counts.commit(spark, d, 0, token_counts.inserts(rows))
    assert not token_counts.commit(spark, d, 0, token_counts.inserts(rows))
    assert token_counts.commit(spark, d, 1, token_counts.deletes(rows.where("n_tokens = 7 or source is null")))
    assert [tuple(r) for r in token_counts.totals(spark, d, [0, 1, 1]).collect()] == [("a", "en", "t", 1, 5)]
    assert token_counts.totals(spark, d, []).count() == 0


# 4, toxicity


def test_folded_weights_equal_the_kernel():
    def features(s):
        out = {}
        for a, b, c, d in itertools.combinations(range(len(s)), 4):
            if d - a < toxicity.MAX_SPAN and a < toxicity.WINDOW - 3:
                u = s[a], s[b], s[c], s[d]
                out[u] = out.get(u, 0) + toxicity.DECAY ** (d - a - 3)
        return out

    rng = np.random.default_rng(0)
    x, z = (rng.integers(1, 4, toxicity.WINDOW + toxicity.MAX_SPAN).astype(np.uint8) for _ in range(2))
    fx, fz = features(x.tolist()), features(z.tolist())
    ids, vals = toxicity.stretch_features(z[None])
    weights = np.zeros(toxicity.ALPHABET**4, np.float32)
    np.add.at(weights, ids[0], vals[0])
    assert toxicity.stretch_scores(weights, x)[0] == pytest.approx(sum(v * fz.get(u, 0) for u, v in fx.items()), rel=1e-4)


def test_gapped_insults_are_found_and_clean_texts_pass():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 8)))
    bad = ["skumbag", "wretchix", "dolthead"]

    def text(toxic, insult=None):
        w = [word() for _ in range(30)]
        if toxic:
            w[rng.randrange(30)] = insult or rng.choice(bad)
        return " ".join(w)

    y = [i % 3 == 0 for i in range(600)]
    model = toxicity.Model([text(t) for t in y], [int(t) for t in y], 1 / 3)
    caught = model.scores([text(True, x) for x in ["skum-bag", "s.kumbag", "wretcxhix", "d o l t h e a d"] * 10])
    clean = model.scores([text(False) for _ in range(200)])
    assert (caught >= 0.3).mean() > 0.85 and (clean >= 0.3).mean() < 0.05
    assert len(model.scores([None, "", "?!", "x" * 100_000])) == 4


def test_held_out_toxicity(spark):
    out = toxicity.op4(spark, f"{DATA}/sf0.1").join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in out) / sum(r.toxic == 1 for r in out)
    wrong = sum(r.predicted == 1 and r.toxic == 0 for r in out) / sum(r.toxic == 0 for r in out)
    assert hit > 0.75 and wrong < 0.05


# 5, language ID


def test_phrases_equal_a_plain_greedy_parse():
    rng = random.Random(0)
    learned = [rng.randint(1, 3) for _ in range(60)]
    text = [rng.randint(1, 4) for _ in range(40)]
    known = {tuple(learned[i:j]) for i in range(60) for j in range(i + 1, 61)}
    count, phrase = 1, ()
    for c in text:
        if phrase + (c,) in known:
            phrase += (c,)
        else:
            count += 1
            phrase = (c,) if (c,) in known else ()
    a = language_id.SuffixAutomaton(learned, 8)
    assert a.phrases(np.array([text])).tolist() == [count]


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang")
    out = language_id.op5(spark, f"{DATA}/sf0.01").join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    rows = out.collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.93
    none = language_id.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "doc_id long, text string"), language_id.Model({}))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


# 6, SimHash


@pytest.mark.parametrize("limit", [16, 1])
def test_links_reach_all_fingerprints_within_two_bits(spark, limit):
    rng = random.Random(7)
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
    fps = sorted(set(fps))
    want = components(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    found = simhash.fingerprint_links(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long"), limit).collect()
    at = {simhash._signed(x): i for i, x in enumerate(fps)}
    for r in found:
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2
    assert components(len(fps), [(at[r.a], at[r.b]) for r in found]) == want


def test_fingerprints_equal_a_plain_count(spark):
    import xxhash

    def plain(t, k=3):
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    texts = [None, "", "One", "A b C d É É\nf g", "x y " * 500, "a\tb c"]
    rows = [(i, t, "e") for i, t in enumerate(texts)] + [(9, "One", "e"), (None, "One", "e")]
    out = {r.doc_id: r for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    assert len(out) == 8
    for i, t in enumerate(texts):
        assert out[i].fingerprint == f"{plain(t):016x}"
    assert out[1].component_id == 0 and out[9].component_id == 2 and out[None].component_id is None
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, _keep string"))
    assert kept.columns == ["doc_id", "text", "_keep"] and {r.doc_id for r in kept.collect()} == {0, 2, 3, 4, 5, None}
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 7, embeddings


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 32))
    x = centres[rng.integers(0, 30, 700)] + rng.normal(size=(700, 32)) * rng.choice([0.0, 0.05, 0.1, 0.14], size=(700, 1))
    x[:150] = centres[0] + rng.normal(size=(150, 32)) * 0.05
    labels = ["a" if i % 4 else "b" for i in range(700)]
    rows = [(i, x[i].tolist(), labels[i]) for i in range(700)]
    odd = [(700, None, "a"), (701, [0.0] * 32, "a"), (702, [float("nan")] * 32, "a"), (703, x[0].tolist(), None), (704, [None] + [1.0] * 31, "a"), (705, [], "a"), (706, [1.0, 2.0], "a")]
    got = {r.vec_id: r for r in embedding_dedup.embedding_links(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label string")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)) & ~np.eye(700, dtype=bool)
    missed = near.sum() - sum(got[i].n_links for i in range(700))
    assert 0 <= missed <= 0.002 * near.sum()
    want = components(700, zip(*np.nonzero(near), strict=True))
    assert sum(got[i].component_id != want[i] for i in range(700)) <= 2
    for i, _, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


# 8, chat formatting


def test_every_speaker_is_the_assistant_once(spark):
    rows = [("c", 0, "system", "be kind"), ("c", 1, "ann", "hi"), ("c", 2, "bob", None), ("c", 3, None, "hm"), ("d", 0, "system", "x"), (None, None, "ann", "lost")]
    out = {(r.conv_id, r.perspective): r for r in chat_format.rotate(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert set(out) == {("c", "ann"), ("c", "bob"), ("c", "unknown"), (None, "ann")}
    r = out["c", "ann"]
    begin, end = map(int, r.mask.split("-"))
    assert r.text[begin:end] == "hi" + chat_format.END and r.target_chars == end - begin
    assert "<|user name=bob|>" in r.text and "<|user name=ann|>" not in r.text


# 9, HTML


def test_article_stays_and_page_furniture_goes():
    body = "<p>" + "</p><p>".join(f"Sentence {i}, with a comma &amp; more words; it goes on, and on." for i in range(6)) + "</p>"
    page = f"<html><head><title>t</title><style>x</style></head><body><nav><ul><li><a href=a>Home</a></li></ul></nav><article><h1>Head</h1>{body}<p>Short.</p></article><div class='comments'><p>A reader says, well, something long, in fact, very long.</p></div><footer>Copyright</footer></body></html>"
    got = html_extract.extract(page).split("\n\n")
    assert got == ["Head", *[f"Sentence {i}, with a comma & more words; it goes on, and on." for i in range(6)], "Short."]
    assert [html_extract.extract(x) for x in (None, "", "<script>x</script>", "plain text")] == ["", "", "", "plain text"]


# 10, decontamination


def test_edited_passages_are_found_and_verified(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(10, 40)))) for i in range(40)] + [(40, None), (41, "a b")]
    docs, within = [], set()
    for i in range(120):
        w = rng.choices(vocab, k=80)
        own = rng.choice(items[:40])[1].split()
        item, bound = [*own], decontaminate.edit_bound(len(own))
        for _ in range(rng.randint(0, bound)):
            p = rng.randrange(len(item))
            item[p : p + 1] = rng.choice([[], ["zz"], [item[p], "zz"]])
        w = w[:40] + item * (i % 2) + w[40:]
        docs.append((i, " ".join(w), i))
        if any(decontaminate.edit_distance(own, w[s : s + len(own)], bound) <= bound for s in range(40 - bound, 41 + bound)):
            within.add(i)
    out = decontaminate.contaminated(spark.createDataFrame(docs + [(500, None, 0), (501, "", 0)], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    words = {i: decontaminate.words_of(t) for i, t, _ in docs}
    named = {i: decontaminate.words_of(t) for i, t in items}
    for r in out:
        n = len(named[r.item_id])
        assert decontaminate.edit_distance(named[r.item_id], words[r.doc_id][r.first_word : r.first_word + n], n) == r.distance <= decontaminate.edit_bound(n)
    hit = {r.doc_id for r in out}
    assert len(within) > 40 and hit <= within and len(hit) >= decontaminate.TARGET_RECALL * len(within)
    kept = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, _leak int"), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "_leak"] and kept.count() == 120 - len(hit)


def test_stretches_at_the_end_of_the_last_text_have_full_width():
    """The last sampled text is clean and unlike the others, so that its end scores as high as any of its stretches."""
    for size in range(1, 60):
        last = ("a fine day and a calm evening by the sea " * 2)[:size]
        texts = ["you dumb fool", "a fine day", "such a dumb fool", "a calm evening"] * 12 + [last]
        model = toxicity.Model(texts, [1, 0, 1, 0] * 12 + [0])
        assert np.isfinite(model.bias) and np.isfinite(model.weights).all()
