"""Toxicity by a subsequence string kernel SVM with Nystrom landmarks.

The kernel compares two strings by the character subsequences of length four that they share, each
weighted by DECAY to the span it covers; spans reach MAX_SPAN characters. A gapped or padded insult
("i-d-i-o-t", "idxiot") so still shares subsequences with the plain one. Instances are stretches of
WINDOW characters of labelled sentences: each toxic document gives its most suspicious stretches,
each clean one its own as hard negatives, and the choice is repeated with the model just learned
(multiple-instance learning, as labels are given per document).

Landmark stretches z_1..z_m span the Nystrom feature space: phi(x) = K(Z, Z)^(-1/2) k(Z, x), on
which a linear SVM with squared hinge loss is trained. Its decision value is a weighted sum of
kernel values with the landmarks, and the kernel is an inner product of subsequence weights, so the
sum folds into one weight per subsequence: sum_j beta_j K(z_j, x) = sum_u W_u phi_u(x). That table
(ALPHABET^4 numbers) scores every stretch of every whole text exactly as the SVM would, as array
look-ups. A document's margin is that of its highest stretch; a logistic curve turns it into a score.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

ALPHABET, WINDOW, DECAY, MAX_SPAN = 40, 9, 0.5, 6
THRESHOLD = 0.3
#: Bounds of the labelled sample: documents a class and characters a document.
SAMPLE_DOCS, SAMPLE_CHARS = 1_500, 10_000
LANDMARKS, ROUNDS = 160, 5
_PAD = 12
_GROUP_CHARS = 2_000_000


@functools.lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """For each code point: 1 to 26 for a to z, 27 to 39 for other letters, 0 for the rest."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) - 96 if len(low) == 1 and "a" <= low <= "z" else 27 + ord(low[0]) % 13
    return out


def symbols(text: str | None) -> np.ndarray:
    """Symbols of a text; a run of non-letters is one 0, and none stands between letters spelt out one by one."""
    s = _symbols()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = s == 0
    s = s[~(gap & np.concatenate([[False], gap[:-1]]))] if len(s) else s
    gap = np.concatenate([[True], s == 0, [True]])
    lone = np.concatenate([[False], ~gap[1:-1] & gap[:-2] & gap[2:], [False]])
    return s[~(gap[1:-1] & lone[:-2] & lone[2:])]


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end with padding on either side, and where each begins."""
    sizes = np.array([len(x) + _PAD for x in texts])
    at = _PAD + np.cumsum(sizes) - sizes
    out = np.zeros(_PAD + sizes.sum() + _PAD, np.uint8)
    for i, x in zip(at, texts, strict=True):
        out[i : i + len(x)] = x
    return out, at


def subsequence_ids(s: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """For each tuple of offsets: the kernel's weight and, at each position, the number of the subsequence."""
    x = np.concatenate([s.astype(np.int32), np.zeros(MAX_SPAN, np.int32)])
    n, k = len(s), np.int32(ALPHABET)
    for a in range(1, MAX_SPAN - 2):
        two = (x[:n] * k + x[a : a + n]) * k
        for b in range(a + 1, MAX_SPAN - 1):
            three = (two + x[b : b + n]) * k
            for c in range(b + 1, MAX_SPAN):
                yield DECAY ** (c - 3), three + x[c : c + n]


def stretch_scores(weights: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Decision values (without bias) of the stretches that begin at each position."""
    own = np.zeros(len(s), np.float32)
    for w, ids in subsequence_ids(s):
        own += np.float32(w) * weights[ids]
    total = np.concatenate([[0.0], np.cumsum(own, dtype=np.float64)])
    ends = np.minimum(np.arange(len(s)) + WINDOW - 3, len(s))
    return (total[ends] - total[:-1]).astype(np.float32)


def stretch_features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kernel's feature map of stretches (rows of symbols): numbers and weights of the subsequences that begin in each."""
    n = len(rows)
    flat = np.hstack([rows, np.zeros((n, 1), np.uint8)]).ravel()
    width, starts = rows.shape[1] + 1, WINDOW - 3
    ids, weights = [], []
    for w, x in subsequence_ids(flat):
        ids.append(x.reshape(n, width)[:, :starts])
        weights.append(np.full(starts, w, np.float32))
    out = np.hstack(ids)
    return out, np.where(out > 0, np.concatenate(weights), np.float32(0))


def self_kernel(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """K(x, x) of each stretch."""
    out = np.zeros(len(ids))
    for i in range(0, len(ids), 2000):
        same = ids[i : i + 2000, :, None] == ids[i : i + 2000, None, :]
        out[i : i + 2000] = np.einsum("nij,ni,nj->n", same, weights[i : i + 2000], weights[i : i + 2000])
    return out


class Model:
    """weights: one number per subsequence; bias; slope and offset of the logistic curve.

    Two thirds of the sample train the machine; the last third chooses the round whose machine is
    kept and sets the logistic curve, for which classes weigh as their ``rate`` among all labels.
    """

    def __init__(self, texts: list[str], toxic: list[int], rate: float | None = None):
        self.weights, self.bias = np.zeros(ALPHABET**4, np.float32), -1.0
        self.slope, self.offset = 1.0, -4.0
        y = np.array(toxic, bool)
        if y.all() or not y.any():
            return
        docs = [symbols(t) for t in texts]
        fold = np.arange(len(docs)) % 3 == 2
        own = [d for d, f in zip(docs, fold, strict=True) if not f]
        own_y = y[~fold]
        if own_y.all() or not own_y.any():
            own, own_y = docs, y
        s, at = joined(own)
        ends = np.append(at[1:], len(s) - _PAD)
        self.weights = self._odds(own, own_y)
        test, test_y = [d for d, f in zip(docs, fold, strict=True) if f], y[fold]
        if not len(test_y) or test_y.all() or not test_y.any():
            test, test_y = docs, y
        weight = np.where(test_y, (rate or y.mean()) / test_y.mean(), (1 - (rate or y.mean())) / (1 - test_y.mean()))
        seen: dict[bytes, int] = {}
        best_loss, kept = np.inf, (self.weights, self.bias, self.slope, self.offset)
        for round_ in range(ROUNDS):
            score = stretch_scores(self.weights, s)
            for t, a, e in zip(own_y, at, ends, strict=True):
                part = score[a - 2 : e - _PAD]
                if not len(part):
                    continue
                most = min(3, len(part))
                best = np.argpartition(-part, most - 1)[:most]
                top = float(part.max())
                for p in best[np.argsort(-part[best], kind="stable")].tolist():
                    # Stretches of a toxic document count as toxic only while they look it.
                    if t and (part[p] <= 0.6 * max(top, 0) or (round_ and part[p] + self.bias < -0.9)):
                        continue
                    key = s[a - 2 + p : a - 2 + p + WINDOW + MAX_SPAN].tobytes()
                    seen[key] = min(int(t), seen.get(key, 1))
            if all(seen.values()):
                break
            self._train(seen)
            loss = self._calibrate(self._margins(test), test_y, weight)
            if loss < best_loss:
                best_loss, kept = loss, (self.weights, self.bias, self.slope, self.offset)
        self.weights, self.bias, self.slope, self.offset = kept

    @staticmethod
    def _odds(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """First weights: log odds of contiguous subsequences that toxic documents have far beyond chance."""
        n = np.zeros((2, ALPHABET**4), np.float32)
        for d, t in zip(docs, y, strict=True):
            n[int(t), np.unique(next(subsequence_ids(np.concatenate([[0, 0], d, [0, 0]])))[1])] += 1
        size = np.array([[(~y).sum() + 1.0], [y.sum() + 1.0]])
        rate = (n + 0.5) / size
        expected = rate[0] * size[1]
        sure = (n[1] - expected) / np.sqrt(expected + 1) > 4
        return np.where(sure & (n[1] >= 3), np.log(rate[1] / rate[0]), 0).astype(np.float32)

    def _train(self, seen: dict[bytes, int]) -> None:
        keys = sorted(seen)
        y = np.array([seen[k] for k in keys])
        ids, vals = stretch_features(np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1))
        norm = self_kernel(ids, vals)
        # Landmarks: the stretches farthest from those already chosen of their class, two toxic for each clean one.
        table = np.zeros(ALPHABET**4, np.float32)
        near = [norm.copy(), norm.copy()]
        chosen: list[int] = []
        columns: list[np.ndarray] = []
        for j in range(min(LANDMARKS, len(keys))):
            side = 1 if j % 3 else 0
            own = np.flatnonzero(y == side)
            if not len(own):
                continue
            far = int(own[int(np.argmax(near[side][own]))])
            np.add.at(table, ids[far], vals[far])
            k = (table[ids] * vals).sum(1).astype(np.float64)
            table[ids[far]] = 0
            chosen.append(far)
            columns.append(k)
            near[side] = np.minimum(near[side], norm + norm[far] - 2 * k)
        k = np.stack(columns, axis=1)
        val, vec = np.linalg.eigh(k[chosen])
        keep = val > 1e-4 * val.max()
        root = vec[:, keep] / np.sqrt(val[keep])
        w, self.bias = _svm(k @ root, np.where(y == 1, 1.0, -1.0))
        beta = root @ w
        self.weights = np.zeros(ALPHABET**4, np.float32)
        for b, z in zip(beta, chosen, strict=True):
            np.add.at(self.weights, ids[z], np.float32(b) * vals[z])

    def _calibrate(self, margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        """Set the logistic curve; returns its weighted log loss."""
        a, b = 2.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            g, h = weight * (p - (y * 0.98 + 0.01)), weight * p * (1 - p) + 1e-6
            grad = np.array([(g * margin).mean() + 1e-3 * a, g.mean()])
            hess = np.array([[(h * margin * margin).mean() + 1e-3, (h * margin).mean()], [(h * margin).mean(), h.mean() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        self.slope, self.offset = float(max(a, 0.1)), float(b)
        p = np.clip(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))), 1e-6, 1 - 1e-6)
        return float((weight * -np.where(y, np.log(p), np.log(1 - p))).mean())

    def _margins(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(docs))
        first, size = 0, 0
        for i, d in enumerate(docs):
            size += len(d)
            if size > _GROUP_CHARS or i == len(docs) - 1:
                s, at = joined(docs[first : i + 1])
                # Stretches that begin in a text or just before it; those of the padding after it reach the next text.
                ranges = np.stack([at - 2, at + [max(1, len(x)) for x in docs[first : i + 1]]], axis=1).ravel()
                out[first : i + 1] = np.maximum.reduceat(stretch_scores(self.weights, s), ranges)[::2] + self.bias
                first, size = i + 1, 0
        return out

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The decision value of each text's highest stretch."""
        return self._margins([symbols(t) for t in texts])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps; classes weigh alike."""
    n, d = x.shape
    x1 = np.hstack([x, np.ones((n, 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * n * cost / n
    w = np.zeros(d + 1)
    ridge = np.full(d + 1, 1e-3)
    ridge[-1] = 1e-6
    for _ in range(40):
        slack = 1 - y * (x1 @ w)
        on = slack > 0
        grad = ridge * w - x1[on].T @ (weight[on] * y[on] * slack[on])
        hess = np.diag(ridge) + (x1[on] * weight[on, None]).T @ x1[on]
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def held_out(column: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 when divided by 4. False for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on at most SAMPLE_DOCS labelled documents a class, drawn by a hash of the id from rows not held out.

    Of labels that disagree on a doc_id the toxic one counts; rows without id, label or text are left out.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    rank = F.xxhash64(F.col("_id").cast("string")).bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(1 << 24))
    many = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    share = F.when(F.col("_toxic") == 1, 1.3 * SAMPLE_DOCS / max(1, many.get(1, 0))).otherwise(1.3 * SAMPLE_DOCS / max(1, many.get(0, 0)))
    drawn = known.where(rank < share)  # about 2.6 * SAMPLE_DOCS rows, whatever the table's size
    short = docs.where("text is not null").where(F.length("text") <= SAMPLE_CHARS)
    rows = short.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).join(F.broadcast(drawn), "_id").select("_id", "_toxic", "_text").collect()
    texts: list[str] = []
    toxic: list[int] = []
    size = {0: 0, 1: 0}
    for r in sorted(rows, key=lambda r: (r["_id"], r["_text"])):
        if size[r["_toxic"]] < SAMPLE_DOCS:
            size[r["_toxic"]] += 1
            texts.append(r["_text"])
            toxic.append(r["_toxic"])
    return Model(texts, toxic, many.get(1, 0) / max(1, sum(many.values())))


def score(docs: DataFrame, model: Model, column: str = "toxic_score") -> DataFrame:
    """docs with the score of each whole text (0 to 1) in a new last column, under the first of column, _column, __column and so on that docs lacks.

    Null and empty texts get the score of an empty stretch; null ids and repeated rows pass through,
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    column = C.own_name(docs, column)
    C.prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*names, column])

    from pyspark.sql import types as T

    names = docs.columns
    return docs.mapInArrow(each, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4_toxicity over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
