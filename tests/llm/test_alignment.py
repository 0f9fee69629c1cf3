"""Cross-tokenizer alignment against whole texts read by the libraries themselves."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from turnwise.llm import alignment, tokens

DATA = "/root/testdata"
HARD = [
    None, "", " ", "  ", "a", "a b", "a  b", " a", "a ", "\n", "a\n\nb", "a\tb c", "x" * 5000, "ab " * 4000, "It's 12 o'clock, isn't it?",
    "<|endoftext|>", "go <|endoftext|> on", "<s>a</s> <unk>", "▁", "a▁b c", "é é ﬁ", "日本語 テスト", "😀 👩‍👩‍👧 x", "a b c", "a b", "a ́b",
    "\x00 \x1c x \x1f y", "<0x41> b", "İstanbul ß ǅ", "a\r\n b", "١٢٣ ൭ x", "same words same words", "same words same words", "...!!! ,,, ...", "​ a ﻿",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(tokens.default_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def read(text, libraries):
    """(ids of A, of B, ends of A's tokens, of B's) of a whole text, or None where bytes differ."""
    a, b = libraries
    if not text:
        return None
    raw = f" {text}".encode()
    chars = {c: x for x, c in tokens._byte_chars().items()}
    ia, ib = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ia]
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    if b"".join(of_a) != raw or b"".join(of_b) != raw:
        return None
    return ia, ib, np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()


def plain(rows, libraries):
    docs, held = [(i, read(t, libraries)) for i, t in rows], Counter()
    links = []
    for _, x in docs:
        own = []
        if x:
            at = defaultdict(list)
            for i, e in zip(x[0], x[2], strict=True):
                at[e].append(i)
            own = [(i, j) for j, e in zip(x[1], x[3], strict=True) for i in at[e]]
        links.append(own)
        held.update(own)
    top = {}
    for (_, j), n in held.items():
        top[j] = max(top.get(j, 0), n)
    out = []
    for (i, x), own in zip(docs, links, strict=True):
        if not x:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted(set(x[2]) & set(x[3]))
        said, pa_, pb_ = [], 0, 0
        for c in cuts:
            ea, eb = x[2].index(c) + 1, x[3].index(c) + 1
            said.append(f"{','.join(map(str, x[0][pa_:ea]))}|{','.join(map(str, x[1][pb_:eb]))}")
            pa_, pb_ = ea, eb
        sha = hashlib.sha256(";".join(said).encode()).hexdigest()
        out.append((i, len(x[0]), len(x[1]), len(cuts), len(own), sum(held[k] == top[k[1]] for k in own), sum(held[k] for k in own), sha))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def run(docs):
    return sorted((tuple(r) for r in alignment.align(docs).select(*COLUMNS).collect()), key=str)


def test_odd_texts_and_repeated_rows_equal_whole_texts(spark, libraries):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(5, "a b"), (None, "a b"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, b int, postings string")
    assert run(docs) == plain(rows, libraries)


def test_query_equals_whole_texts(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD_ROWS", 3)  # so that common ids have many shards
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run(docs.repartition(7)) == plain(rows, libraries)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []


def test_chunks_give_what_whole_texts_do(libraries):
    path_b = public_tokenizers.path("piece_bpe_32k.model")
    memory = alignment._Memory(tokens.default_path(), path_b)
    assert memory.cut
    texts = [t for t in HARD if t]
    for numbers in (memory.number(texts), [n for t in texts for n in memory.number([t])]):
        counts, keys = memory.counts, memory.keys
        end = np.cumsum(counts[:, 3])
        for t, parts in zip(texts, numbers, strict=True):
            whole = alignment.align_text(t, tokens.default_path(), path_b)
            if whole is None:
                assert not counts[parts, 4].all()
            else:
                assert (*whole[:3], len(whole[4])) == tuple(counts[parts, :4].sum(0))
                assert whole[3] == ";".join(memory.said[i] for i in parts)
                assert whole[4] == [k for i in parts for k in keys[end[i] - counts[i, 3] : end[i]].tolist()]


def test_tokens_without_bytes_are_linked_where_they_end():
    ends, links = alignment.groups_of([1, 2, 3], [7, 8, 9], [2, 0, 1], [2, 1, 0])
    assert ends == [(2, 1), (3, 3)]
    assert links == [(0, 0), (1, 0), (2, 1), (2, 2)]


def test_multiplicities_beyond_16_bits_are_kept():
    pair, links, column = alignment._packed(np.array([5, 5, 9]), np.array([0, 3, 1]), np.array([200_000, 1, 2]))
    assert pair.tolist() == [5, 9] and links.tolist() == [200_001, 2]
    raw = [np.frombuffer(x.as_py(), "<u2").reshape(-1, 2).astype(int) for x in column]
    assert raw[0][raw[0][:, 0] == 0, 1].sum() == 200_000 and raw[0][raw[0][:, 0] == 3, 1].sum() == 1


def test_stream_is_read_in_any_cut_into_batches(monkeypatch):
    monkeypatch.setattr(alignment, "FLUSH", 3)
    post = lambda *x: np.array(x, "<u2").tobytes()
    rows = [(4, 9, None, None), (None, None, 1, post(0, 1, 2, 3)), (None, None, 2, post(0, 2)), (9, 9, None, None), (None, None, 1, post(0, 4, 1, 5)), (None, None, 2, post(0, 1))]
    want = {(1, 0): (4, 1 * 4 + 4 * 9), (1, 1): (5, 45), (1, 2): (0, 12), (2, 0): (1, 8 + 9)}
    names = ["count", "top", "block", "postings"]
    for step in (1, 2, 4, 6):
        parts = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[s : s + step], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names) for s in range(0, 6, step)]
        got = defaultdict(lambda: (0, 0))
        for b in alignment._contributions(iter(parts)):
            for r in b.to_pylist():
                for d, x, y in np.frombuffer(r["sums"], "<i8").reshape(-1, 3).tolist():
                    got[r["block"], d] = (got[r["block"], d][0] + x, got[r["block"], d][1] + y)
        assert got == want
