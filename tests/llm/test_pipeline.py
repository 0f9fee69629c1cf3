"""The corpus pipeline: its stages take effect, keep columns, and end in packed pieces of what is left."""

import re

import corpus_pipeline
from turnwise.llm import _common as common
from turnwise.llm import chat_format

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_take_away(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows, chars = docs.columns, docs.count(), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        assert 0 < docs.count() <= rows
        rows = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == rows
    assert pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` <> `max(doc_tokens)`").count() == 0


def test_exact_copies_and_benchmark_passages_go(spark):
    docs = spark.createDataFrame(
        [(1, "some words that stand in one text and in its copy", "en", "a", 1), (2, "some words that stand in one text and in its copy", "en", "b", 1), (3, "before the answer to the third question is forty two of course after", "en", "a", 1), (4, None, "en", "a", 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [1, 3, 4]
    bench = spark.createDataFrame([(1, "The answer to the third question is forty two, of course!")], "item_id long, text string")
    from turnwise.llm import decontaminate

    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [1, 2, 4]


def test_chat_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    cur = con.execute(chat_format.OP8_SQL)
    names = [c[0] for c in cur.description]
    want = sorted(map(str, cur.fetchall()))
    got = sorted(str(tuple(r)) for r in chat_format.op8(spark, SF).select(*names).collect())
    assert got == want


def test_entry_survives_without_the_subpackage():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert len([k for k in __spark_entry__.queries() if re.match(r"op\d+_", k)]) == 10
