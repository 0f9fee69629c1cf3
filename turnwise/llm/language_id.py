"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton of labelled text recognises every substring of it. A text is
parsed greedily: a phrase runs on while the automaton still knows it, then the next phrase begins.
With c phrases over n symbols and T symbols of labelled text, c * log2(T) / n estimates the cross
entropy in bits a symbol; the language with the lowest wins. Symbols are the UTF-8 bytes of
lower-cased letters, with a space for any run of other characters, so that scripts of thousands of
letters keep them apart.

Whole texts are parsed. So that the parse of a long text advances as many array rows, it is started
in every block of ``BLOCK`` symbols at once, as if a phrase began there. A block is then parsed
again from the state in which the block before it ends, up to the first phrase that both parses
begin at one place: from there on they are the same. This is repeated for the blocks whose
beginning has changed, until none does. The count is that of one parse from end to end.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

UNDETERMINED = "und"
BLOCK = 128
#: Bounds of the labelled sample: documents and symbols a language, symbols a document, symbols of all
#: languages together (more languages get less each, so that the automata stay of a bounded size).
SAMPLE_DOCS, SAMPLE_SYMBOLS, SAMPLE_DOC_SYMBOLS, ALL_SYMBOLS = 96, 24_000, 1_000, 480_000
_GROUP_CHARS, MAX_BROADCAST = 2_000_000, 10_000


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(text: str) -> np.ndarray:
    """UTF-8 bytes of the lower-cased text with every run of non-letters as one space."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    cp = np.where(_letters()[cp], cp, np.uint32(32))
    gap = cp == 32
    cp = cp[~(gap & np.concatenate([[False], gap[:-1]]))]
    return np.frombuffer(cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)


class SuffixAutomaton:
    """Transitions of the suffix automaton of a symbol sequence as a dense table.

    State 0 stands for "no such substring" and state 1 is the start. The last column is padding,
    which leaves a state as it is.
    """

    def __init__(self, symbols: list[int], width: int):
        link, length = [0, 0], [0, 0]
        nexts: list[dict[int, int]] = [{}, {}]
        last = 1
        for c in symbols:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(1)
            p = last
            while p and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.table = np.zeros((len(nexts), width), np.int32)
        for s, d in enumerate(nexts):
            for c, t in d.items():
                self.table[s, c] = t
        self.table[:, width - 1] = np.arange(len(nexts))
        self.length = len(symbols)

    def _walk(self, cols: np.ndarray, state: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parse rows (the columns of cols) on from given states: (phrases begun, end states, where they begin).

        With known beginnings, a row's parse stops at the first that it shares, and its end state is -1.
        """
        width = np.int32(self.table.shape[1])
        flat = self.table.ravel()
        start = self.table[1].copy()
        start[start == 0] = 1
        count, begins = np.zeros(cols.shape[1], np.int32), np.zeros(cols.shape, bool)
        live = np.arange(cols.shape[1])
        out = state.copy()
        for i, col in enumerate(cols):
            here = col if known is None else col[live]
            new = flat[state * width + here]
            miss = new == 0
            if known is None:
                (at,) = np.nonzero(miss)
                begins[i, at] = True
                count[at] += 1
                new[at] = start[here[at]]
                state = new
            else:
                own = live[miss]
                count[own] += 1
                new[miss] = start[here[miss]]
                met = miss & known[i, live]
                out[live[met]] = -1
                # What the first parse begins after this place counts as before.
                count[live[met]] += known[i + 1 :, live[met]].sum(axis=0, dtype=np.int32)
                live, state = live[~met], new[~met]
                if not len(live):
                    return count, out, begins
        out[live] = state
        return count, out, begins

    def phrases(self, blocks: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """Phrases begun in each row of a matrix of symbols; first marks the rows that begin a text (by default all), the others go on from the row before."""
        first = np.ones(len(blocks), bool) if first is None else first
        cols = np.ascontiguousarray(blocks.T)
        count, end, begins = self._walk(cols, np.ones(len(blocks), np.int32), None)
        count += first
        guess = end.copy()
        todo = np.flatnonzero(~first)
        while len(todo):
            c, e, _ = self._walk(cols[:, todo], end[todo - 1], begins[:, todo])
            count[todo] = c
            e = np.where(e < 0, guess[todo], e)
            moved = todo[e != end[todo]] + 1
            end[todo] = e
            moved = moved[moved < len(first)]
            todo = moved[~first[moved]]
        return count


class Model:
    """Automata by language over the bytes that each language's sample holds."""

    def __init__(self, samples: dict[str, list[np.ndarray]]):
        self.langs = sorted(samples)
        self.automata, self.bytes = [], []
        most = min(SAMPLE_SYMBOLS, max(1_000, ALL_SYMBOLS // max(1, len(samples))))
        for lang in self.langs:
            s = np.concatenate([np.append(x, np.uint8(32)) for x in samples[lang]])[:most]
            seen = np.unique(s)
            number = np.zeros(256, np.uint8)
            number[seen] = np.arange(1, len(seen) + 1)
            self.bytes.append(number)
            self.automata.append(SuffixAutomaton(number[s].tolist(), len(seen) + 2))

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits a symbol of each text (rows) by each language (columns)."""
        n = np.array([len(x) for x in texts])
        blocks = -(-n // BLOCK)
        raw = np.zeros(blocks.sum() * BLOCK, np.uint8)
        pad = np.ones(len(raw), bool)
        at = (np.cumsum(blocks) - blocks) * BLOCK
        for i, x in zip(at, texts, strict=True):
            raw[i : i + len(x)] = x
            pad[i : i + len(x)] = False
        row = np.cumsum(blocks) - blocks
        first = np.zeros(blocks.sum(), bool)
        first[row] = True
        out = np.zeros((len(texts), len(self.langs)))
        for k, a in enumerate(self.automata):
            sym = self.bytes[k][raw].astype(np.int32)
            sym[pad] = a.table.shape[1] - 1
            c = a.phrases(sym.reshape(-1, BLOCK), first)
            out[:, k] = np.add.reduceat(c, row) * np.log2(max(2, a.length)) / n
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores; und and 0 for a text that is null or has no letter, or if nothing was learned."""
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        group: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, t in enumerate([*texts, None]):
            s = symbols(t) if t else np.zeros(0, np.uint8)
            if self.langs and (s != 32).any():
                group.append((i, s))
                size += len(s)
            if group and (size > _GROUP_CHARS or i == len(texts)):
                h = self.entropies([x for _, x in group])
                sure = np.exp2(-(h - h.min(axis=1, keepdims=True)) * np.minimum([[len(x)] for _, x in group], 64))
                for (j, _), line, p in zip(group, h, sure, strict=True):
                    langs[j] = self.langs[int(line.argmin())]
                    scores[j] = float(p.max() / p.sum())
                group, size = [], 0
        return langs, scores


def labelled_sample(docs: DataFrame) -> dict[str, list[np.ndarray]]:
    """At most SAMPLE_DOCS documents a language, the first by a hash of the id among those with letters."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    rank = (F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit(0xFFFFFF))) / F.lit(float(1 << 24))
    share = known.groupBy("lang").count().select(F.col("lang").alias("_lang"), (F.lit(3.0 * SAMPLE_DOCS) / F.col("count")).alias("_share"))
    share = C.materialize(share, "language-shares")
    # A row a language: sent to all tasks unless somebody has very many languages.
    share = F.broadcast(share) if share.count() <= MAX_BROADCAST else share
    drawn = known.join(share, F.col("lang") == F.col("_lang")).where(rank < F.col("_share"))
    rows = drawn.select("lang", rank.alias("rank"), F.col("doc_id").cast("string").alias("id"), F.substring("text", 1, 4 * SAMPLE_DOC_SYMBOLS).alias("text")).collect()
    out: dict[str, list[np.ndarray]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"], r["id"])):
        s = symbols(r["text"])[:SAMPLE_DOC_SYMBOLS]
        if (s != 32).any() and len(out.setdefault(r["lang"], [])) < SAMPLE_DOCS:
            out[r["lang"]].append(s)
    return {k: v for k, v in out.items() if v}


def fit(docs: DataFrame) -> Model:
    """Automata from a bounded sample of the rows of docs whose lang is known."""
    return Model(labelled_sample(docs))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with lang_pred and score (0 to 1) for every whole text.

    A null text and one without a letter are und with score 0; of languages that tie the first by
    name wins. Null ids pass through, repeated rows repeat, an empty table gives no rows and other
    columns are ignored.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(each, "doc_id long, lang_pred string, score double")


def held_out(column: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text leaves 1 when divided by 3. False for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5_language_id over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
