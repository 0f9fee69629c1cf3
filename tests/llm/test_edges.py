"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from turnwise.llm import chat_format, decontaminate, embedding_dedup, html_extract, language_id, line_dedup, packing, simhash, token_counts, toxicity

LONG = "a very long text of many words. " * 3000
ROWS = [
    (1, "one line of words that is long enough\nand a second line of words here", "en", "a", 70),
    (1, "one line of words that is long enough\nand a second line of words here", "en", "a", 70),  # repeated row
    (1, "another text under the same id, with a line that differs\nshort", "en", "b", 62),
    (2, None, "en", None, None), (3, "", None, "a", 0), (4, LONG, "en", "a", len(LONG)), (None, "a text without an id but with words", "en", "a", 35), (None, None, None, None, None),
    (5, "?! 12", "en", "a", 5),
]
#: Names that operators use inside, and some that their results have.
CLASH = ["_row", "fp", "node", "component", "label", "score", "toxic_score", "key", "line", "_dropped", "text_hash", "ids", "n_tokens", "position", "rank", "lang_pred", "_keep", "_nth", "_leak", "item_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def messy(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(2)
    for i, c in enumerate(CLASH):
        df = df.selectExpr("*", f"{i} as `{c}`")
    return df


@pytest.fixture(scope="module")
def nothing(messy):
    return messy.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (4, 1, 0), (4, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "a text without an id but with words"), (2, None), (3, ""), (4, "12"), (5, "no such words anywhere in there at all")], "item_id long, text string")


def test_packing(messy, nothing):
    out = packing.pack(messy).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.length)
    assert sum(by[2]) == 1 and sum(by[3]) == 1 and set(by) == {1, 2, 3, 4, 5, None}
    assert sorted(r.doc_tokens for r in packing.pack(messy.where("doc_id = 1")).where("start = 0").collect())[:2] and packing.pack(nothing).count() == 0


def test_line_dedup(messy, nothing):
    out = {(r.doc_id, r.text_hash): r.dropped for r in line_dedup.dropped_lines(messy).collect()}
    assert list(out.values()) == [] or all(out.values())
    assert line_dedup.dedup_lines(messy).columns == messy.columns and line_dedup.dedup_lines(messy).count() == len(ROWS)
    assert line_dedup.dropped_lines(nothing).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "the first line of this document is long"), (1, "short\nshort\nthe first line of this document is long!"), (1, None)]
    out = line_dedup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 1 and out[0].doc_id == 1 and out[0].dropped in ([0], [2])


def test_token_counts(messy, nothing, spark, tmp_path):
    counts = token_counts.counted(messy)
    assert counts.count() == 2 * len(ROWS) and counts.where("n_tokens = 0").count() >= 6 and token_counts.counted(nothing).count() == 0
    d = str(tmp_path / "s")
    twice = counts.unionByName(counts)
    revised = twice.selectExpr("named_struct('source', source, 'lang', lang, 'tokenizer', tokenizer, 'n_tokens', n_tokens) as before", "named_struct('source', source, 'lang', lang, 'tokenizer', tokenizer, 'n_tokens', n_tokens + 2) as after")
    assert token_counts.commit(spark, d, 0, token_counts.inserts(twice)) and token_counts.commit(spark, d, 1, revised)
    want = {tuple(r) for r in token_counts.totals(spark, d, [0, 1]).collect()}
    plain = {}
    for r in twice.collect():
        k = (r.source, r.lang, r.tokenizer)
        n, t = plain.get(k, (0, 0))
        plain[k] = (n + 1, t + r.n_tokens + 2)
    assert want == {(*k, *v) for k, v in plain.items()}
    assert token_counts.compact(spark, d, [0]) == 1
    assert not token_counts.commit(spark, d, 0, token_counts.inserts(twice))
    assert {tuple(r) for r in token_counts.totals(spark, d, [0, 1]).collect()} == want
    assert token_counts.compact(spark, d, [0, 1]) == 2 and {tuple(r) for r in token_counts.totals(spark, d, []).collect()} == want


def test_toxicity(messy, nothing, labels, spark):
    model = toxicity.fit(messy, labels)
    out = toxicity.score(messy, model)
    assert out.columns == [*messy.columns, "_toxic_score"] and out.where("_toxic_score between 0 and 1").count() == len(ROWS)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.score(messy, toxicity.fit(nothing, labels)).count() == len(ROWS)


def test_language_id(messy, nothing):
    model = language_id.fit(messy)
    out = language_id.identify(messy, model).collect()
    assert len(out) == len(ROWS) and all(r.lang_pred in ("en", "und") and 0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (2, 3, 5)} == {"und"}
    assert language_id.identify(nothing, model).count() == 0 and {r.lang_pred for r in language_id.identify(messy, language_id.fit(nothing)).collect()} == {"und"}


def test_simhash(messy, nothing):
    out = simhash.simhash_components(messy).collect()
    assert len(out) == len(ROWS) and {r.component_id for r in out if r.doc_id in (2, 3)} == {2} and all(r.component_id is None for r in out if r.doc_id is None)
    assert simhash.near_dedup(messy).columns == messy.columns and simhash.simhash_components(nothing).count() == 0


def test_embeddings(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, v, 1), (1, w, 1), (2, v, 1), (2, v, 1), (3, w, 1), (4, v, 2), (None, v, 1), (5, None, 1), (6, [float("inf"), 1.0, 0.0], 1), (7, [2.0, 0.001, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "0 as rep", "1 as key", "2 as copies", "3 as component")
    out = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.embedding_links(df).collect())
    assert out == sorted([("1", 3, "1", True), ("1", 1, "1", True), ("2", 3, "1", False), ("2", 3, "1", False), ("3", 1, "1", False), ("4", 0, "4", True), ("None", 0, "None", False), ("5", 0, "5", True), ("6", 0, "6", True), ("7", 3, "1", False)])
    assert embedding_dedup.embedding_links(df.where("false")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "ann", "hi"), (1, 0, "ann", "hi"), (1, 1, "bob", LONG), (2, None, "ann", ""), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "0 as perspective", "1 as mask", "2 as nth")
    assert chat_format.rotate(df).count() == 4 and chat_format.rotate(df.where("false")).count() == 0


def test_html(spark):
    rows = [(1, "u", "<p>Some text, here.</p>"), (1, "u", "<p>Some text, here.</p>"), (2, None, None), (None, "v", ""), (3, "w", "<p>" + LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    out = sorted((str(r.page_id), r.n_chars) for r in html_extract.extract_pages(df).collect())
    assert out == [("1", 16), ("1", 16), ("2", 0), ("3", len(LONG) - 1), ("None", 0)] and html_extract.extract_pages(df.where("false")).count() == 0


@pytest.mark.parametrize("free", [False, True])
def test_decontamination(messy, nothing, benchmark, free):
    out = sorted((str(r.doc_id), r.item_id, r.distance) for r in decontaminate.contaminated(messy, benchmark, free).collect())
    assert out == [("5", 4, 0), ("None", 1, 0)]
    assert decontaminate.contaminated(nothing, benchmark, free).count() == 0 and decontaminate.contaminated(messy, benchmark.where("false"), free).count() == 0
    kept = decontaminate.decontaminate(messy, benchmark, free)
    assert kept.columns == messy.columns and kept.count() == len(ROWS) - 1


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[1:]], ids=lambda s: s[0])
def test_stages(spark, messy, nothing, stage):
    name, f = stage
    out, none = f(spark, messy, SF), f(spark, nothing, SF)
    assert none.count() == 0
    if name == "packing":
        assert out.select("doc_id").distinct().count() == 6
    else:
        assert out.columns == messy.columns and 0 < out.count() <= len(ROWS)


def test_toxicity_stage(spark, messy):
    out = corpus_pipeline.STAGES[0][1](spark, messy, SF)
    assert out.columns == messy.columns and out.count() <= len(ROWS)
