"""Quality scores by Naive Bayes support vectors.

Features are indicators of hashed n-grams over two streams of a text: its words
(orders 1 and 2) and their shapes (letter case, digits, signs, of which a run of
more than SIGN_RUN counts as so many; a repeat of the word before is a shape of
its own; orders 1, 2, 3, 4 and 8). N-grams of fewer than `least_texts` training texts
are left out. An indicator is
scaled by the log of the ratio in which the two classes have it, and a linear
hinge-loss model is fitted by dual coordinate descent. Margins become scores
between 0 and 1 by a logistic curve fitted on labelled texts kept back for it.

Labels come from a bounded sample: the `train_docs` labelled ids smallest by a
hash. Memory of the fit is bounded by train_docs times the number of buckets.

A null text is an empty one; it is scored from the bias alone. Null labels are
not learned. With no labels of one of the classes all scores are the share of
label 1 (1/2 without any labels). Rows are scored one by one, so repeats and
further columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.common import documents, fold, small_batches
from siltlog.llm.words import RowMemo, claim, distinct_chunks, pieces

BITS = 20
SIGN_RUN = 3
WORD_ORDERS, SHAPE_ORDERS = (1, 2), (1, 2, 3, 4, 8)
_RUN = re.compile(r"([^\W\d_]+)|(\d+)|(\W|_)\3*")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shape(chunk: str) -> str:
    out = []
    for m in _RUN.finditer(chunk):
        word, digits, _ = m.groups()
        if word:
            out.append("w" if word.islower() else "U" if word.isupper() and len(word) > 1 else "W" if word[:1].isupper() and word[1:].islower() or len(word) == 1 else "x")
        else:
            out.append("0" if digits else m[0][:SIGN_RUN])
    return "".join(out)


def _crc(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) for w in words], np.uint64)


class Features:
    """Distinct n-gram buckets of texts; hashes of chunks seen before are kept, up to a bound."""

    def __init__(self):
        self.memo = RowMemo(lambda new: (_crc([c.lower().strip(".,;:!?*&%$#|") for c in new]), _crc([shape(c) for c in new])))

    def grams(self, texts: pa.Array):
        """(text numbers, buckets) for each order, with repeats."""
        codes, sizes, distinct = distinct_chunks(texts)
        at, (words, shapes) = self.memo.rows(distinct)
        at = at[codes]
        doc = np.repeat(np.arange(len(texts)), sizes)
        words, shapes = words[at], shapes[at]
        if len(at) > 1:
            shapes[1:][(at[1:] == at[:-1]) & (doc[1:] == doc[:-1])] = 7
        for salt, stream, orders in ((1, words, WORD_ORDERS), (2, shapes, SHAPE_ORDERS)):
            h = np.full(len(stream), salt, np.uint64)
            for n in range(1, max(orders) + 1):
                size = len(stream) - n + 1
                if size <= 0:
                    break
                h = (h[:size] ^ stream[n - 1 :]) * _A
                h ^= h >> np.uint64(29)
                if n in orders:
                    ok = doc[:size] == doc[n - 1 :]
                    yield doc[:size][ok], ((h[ok] * _B + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)

    def distinct(self, texts: pa.Array) -> list[np.ndarray]:
        found = list(self.grams(texts))
        if not found:
            return [np.zeros(0, np.int64) for _ in texts]
        keys = np.unique(np.concatenate([d << BITS | b for d, b in found]))
        cuts = np.searchsorted(keys >> BITS, np.arange(len(texts) + 1))
        keys &= (1 << BITS) - 1
        return [keys[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Model:
    """Scale and weight of each bucket, bias, and the logistic curve over margins."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, bias: float, curve: tuple[float, float]):
        self.ratio, self.weights, self.bias, self.curve = ratio, weights, bias, curve

    def margins(self, features: Features, texts: pa.Array) -> np.ndarray:
        keys = [(d[hit] << BITS) | b[hit] for d, b in features.grams(texts) if (hit := self.ratio[b] != 0).any()]
        if not keys:
            return np.full(len(texts), self.bias)
        keys = np.unique(np.concatenate(keys))
        doc, bucket = keys >> BITS, keys & ((1 << BITS) - 1)
        norm = np.sqrt(np.bincount(doc, np.square(self.ratio[bucket]), len(texts)))
        return self.bias + np.bincount(doc, self.ratio[bucket] * self.weights[bucket], len(texts)) / np.maximum(norm, 1e-6)

    def scores(self, features: Features, texts: pa.Array) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.margins(features, texts) + b, -30, 30)))


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss; rows are unit-length scaled indicators."""
    norm = np.sqrt([max(1e-12, float(np.square(ratio[x]).sum())) for x in rows])
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    extra, rng = 0.5 / cost, np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            x = rows[k]
            scaled = ratio[x] / norm[k]
            gradient = y[k] * (w[x] @ scaled + bias) - 1 + extra * alpha[k]
            new = max(0.0, alpha[k] - gradient / (2.0 + extra))
            if new != alpha[k]:
                step = (new - alpha[k]) * y[k]
                w[x] += step * scaled
                bias += step
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, targets drawn in from 0 and 1 by the class sizes."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum(), (v * margin).sum()], [(v * margin).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def train(rows: list[np.ndarray], labels: list[int], cost: float = 1.0, epochs: int = 40, mix: float = 0.9, seed: int = 7, least_texts: int = 3) -> Model:
    """Fit on the bucket lists of labelled texts; every fourth text is kept back for the curve.

    N-grams in fewer than least_texts of the others are no features: their ratios are noise.
    """
    y = np.where(np.array(labels, np.int64) > 0, 1.0, -1.0)
    size = 1 << BITS
    if len(y) == 0 or (y > 0).all() or (y < 0).all():
        share = 0.5 if len(y) == 0 else float((y > 0).mean())
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size), np.zeros(size), 0.0, (1.0, float(np.log(share / (1 - share)))))
    back = np.arange(len(y)) % 4 == 3
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back[:] = False
    kept = [rows[k] for k in np.flatnonzero(~back)]
    yk = y[~back]
    counts = {s: np.ones(size) for s in (1.0, -1.0)}
    seen = np.zeros(size, np.int64)
    for x, s in zip(kept, yk, strict=True):
        counts[s][x] += 1
        seen[x] += 1
    p, q = counts[1.0], counts[-1.0]
    n_pos, n_neg = (yk > 0).sum() + 2, (yk < 0).sum() + 2
    ratio = np.where(seen >= least_texts, np.log((p / n_pos) / (q / n_neg)), 0.0)
    w, bias = _descend(kept, yk, ratio, cost, epochs, seed)
    used = ratio != 0
    flat = np.abs(w[used]).mean() if used.any() else 0.0
    w = np.where(used, (1 - mix) * flat + mix * w, 0.0)
    held = np.flatnonzero(back) if back.any() else np.arange(len(y))
    margins = np.array([bias + w[x] @ ratio[x] / max(1e-6, np.sqrt(np.square(ratio[x]).sum())) for x in (rows[k] for k in held)])
    return Model(ratio, w, bias, _logistic(margins, y[held]))


def _extract(batches):
    features = Features()
    for batch in pieces(batches):
        found = features.distinct(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], ["doc_id", "quality", "buckets"])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 4000) -> Model:
    """Fit on the texts of docs for the train_docs labels with the smallest hash of doc_id."""
    picked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .orderBy(F.xxhash64(F.lit(41), "doc_id"), "doc_id", "quality")
        .limit(train_docs)
    )
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    found = sorted(rows.mapInArrow(_extract, "doc_id long, quality int, buckets array<int>").collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["quality"]))
    return train([np.array(r["buckets"], np.int64) for r in found], [r["quality"] for r in found])


_KEPT: list[Features] = []


def _features() -> Features:
    """The worker's own; tasks share what it keeps."""
    claim("quality", _KEPT.clear)
    if not _KEPT:
        _KEPT.append(Features())
    return _KEPT[0]


def _scorer(model):
    def run(batches):
        features = _features()
        for batch in pieces(batches):
            found = model.value.scores(features, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: one weight a bucket
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scorer(shared), "doc_id long, score double")


def held_out():
    return fold(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 5) == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
