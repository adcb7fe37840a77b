"""Language identification of mixed texts.

A chunk of text between blanks is cut into runs of letters of one script. The
script ranges narrow the candidates to the languages seen with that script in
training (at least SCRIPT_SHARE of a language's letters); hashed character n-grams
of orders 1 to 3 (with word ends) give each candidate a log-probability, averaged
over the orders, and not less than the best one's by more than FLOOR. A Viterbi
pass over the chunk scores with a penalty for each switch labels spans; the
language with most letters is the prediction, and its share of all letters the
score.

The model is fitted on a bounded sample: about `train_docs` labelled texts per
language, picked by a hash of the id. Its size is bounded by the number of
n-gram buckets times the number of languages.

Null texts, and texts without letters (numerals are none), are `und` with score 0.
Letters of a script that no learned language has count for no language, so they
lower the score; a text of only such letters gets the first learned language with
score 0.
Null languages are not learned. Ties go to the language first in order. With
nothing to learn from, every text is `und`. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
import re
import uuid
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.common import documents, fold, small_batches
from siltlog.llm.words import RowMemo, chunks, claim, distinct_chunks, pieces

#: First code points of script ranges, in order; letters outside all others are "other".
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "other"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "other"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = [s for s, _ in SCRIPTS]
NAMES = sorted({n for _, n in SCRIPTS})
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
BUCKETS = 1 << 17
ORDERS = 3
#: A language is a candidate for a script that at least this share of its letters is in.
SCRIPT_SHARE = 0.01
#: How far behind the best one a word can put a language, and as much again a script it is no candidate for.
FLOOR = -40.0


def script_of(char: str) -> str:
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(char)) - 1][1]


def runs(chunk: str) -> list[tuple[str, str]]:
    """(script, lower-case letters) of each run of letters of one script."""
    if chunk.isascii() or _LATIN.fullmatch(chunk):
        return [("latin", w.lower()) for w in _LATIN.findall(chunk)]
    out = []
    for kind, run in groupby(chunk, lambda c: script_of(c) if c.isalpha() else None):
        if kind:
            out.append((kind, "".join(run).lower()))
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, and for each the number of its word."""
    joined = "\x01" + "\x01".join(words) + "\x01"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = code == 1
    owner = np.cumsum(ends) - 1
    buckets, owners, h = [], [], np.zeros(len(code), np.uint64)
    inner = np.zeros(len(code), bool)  # whether a word end lies inside the gram
    for n in range(ORDERS):
        size = len(code) - n
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x9E3779B1) + code[n:] + np.uint64(n + 1)
        if n > 1:
            inner = inner[:size] | ends[n - 1 : n - 1 + size]
        else:
            inner = inner[:size]
        ok = ~inner & (~ends[:size] if n == 0 else np.ones(size, bool))
        if n:
            ok &= ~(ends[:size] & ends[n : n + size] & (n == 1))
        at = np.flatnonzero(ok)
        mixed = h[at] * np.uint64(0xD6E8FEB86659FD93)
        buckets.append((mixed >> np.uint64(40)) & np.uint64(BUCKETS - 1))
        owners.append(np.minimum(owner[at], len(words) - 1))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _count(batches):
    """(lang, bucket, n) of the texts of a partition; bucket -1 - k counts letters of script k."""
    tables: dict[str, np.ndarray] = {}
    for batch in pieces(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = [r for c in chunks(text) for r in runs(c)]
            if not found:
                continue
            table = tables.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
            np.add.at(table, grams([w for _, w in found])[0], 1)
            for script, word in found:
                table[BUCKETS + NAMES.index(script)] += len(word)
    for lang, table in tables.items():
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(table[at])], ["lang", "bucket", "n"])


class Model:
    """Learned languages, their n-gram log-probabilities and the scripts they are written in."""

    def __init__(self, counts: list[tuple[str, int, int]], penalty: float = 8.0):
        self.key = uuid.uuid4().hex
        self.langs = sorted({lang for lang, _, _ in counts})
        self.penalty = np.float32(penalty)
        table = np.zeros((BUCKETS + len(NAMES), len(self.langs)), np.float64)
        for lang, bucket, n in counts:
            table[bucket, self.langs.index(lang)] = n
        total = table[:BUCKETS].sum(0)
        self.logs = (np.log((table[:BUCKETS] + 0.5) / (total + 0.5 * BUCKETS)) / ORDERS).astype(np.float32)
        letters = table[BUCKETS:]
        self.scripts = letters >= np.maximum(1, SCRIPT_SHARE * letters.sum(0))

    def score(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each chunk: its score by language, its letters, and those of a learned script."""
        scores, letters, known = np.zeros((len(new), len(self.langs)), np.float32), np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        words, owners, barred = [], [], []
        for k, chunk in enumerate(new):
            for script, word in runs(chunk):
                letters[k] += len(word)
                s = NAMES.index(script)
                if not self.scripts[s].any():
                    continue
                known[k] += len(word)
                words.append(word)
                owners.append(k)
                barred.append(s)
        if words:
            at, word_of = grams(words)
            by_word = np.stack([np.bincount(word_of, self.logs[at, j], len(words)) for j in range(len(self.langs))], 1)
            by_word -= by_word.max(1, keepdims=True)
            by_word = np.maximum(by_word, FLOOR) + FLOOR * ~self.scripts[barred]
            np.add.at(scores, owners, by_word.astype(np.float32))
        return scores, letters, known

    def viterbi(self, emit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Language of each row of emit, for texts that follow each other with these sizes."""
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = np.argsort(-sizes, kind="stable")
        sizes, starts = sizes[order], starts[order]
        out = np.zeros(len(emit), np.int8 if len(self.langs) < 128 else np.int16)
        if not len(emit):
            return out
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        alpha = emit[starts[: active[0]]].copy()
        moved, best = np.zeros(emit.shape, bool), np.zeros(len(emit), np.int16)
        for t in range(1, len(active)):
            n = active[t]
            a = alpha[:n]
            top, at = a.max(1), starts[:n] + t
            jump = (top - self.penalty)[:, None]
            best[at] = a.argmax(1)
            moved[at] = a < jump
            alpha[:n] = np.maximum(a, jump) + emit[at]
        state = np.zeros(active[0], np.int64)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            at = starts[:n] + t
            begun = sizes[:n] == t + 1
            if begun.any():
                state[:n][begun] = alpha[:n][begun].argmax(1)
            out[at] = state[:n]
            if t:
                state[:n] = np.where(moved[at, state[:n]], best[at], state[:n])
        return out


def fit(docs: DataFrame, train_docs: int = 400, penalty: float = 8.0) -> Model:
    """Fit on about train_docs texts per language of docs(doc_id, text, lang)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string"), "text", (F.shiftrightunsigned(F.xxhash64(F.lit(29), "doc_id"), 1).cast("double") / float(2**63)).alias("_u")
    )
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).collect()
    if not sizes:
        return Model([], penalty)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, train_docs / r["_n"]))])
    picked = labelled.where(F.col("_u") < share[F.col("lang")]).select("lang", "text").repartition(4)
    counts = picked.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    return Model([(r["lang"], r["bucket"], r["n"]) for r in counts], penalty)


class Labeller:
    """Labels texts; scores of chunks seen before are kept, in at most MEMO bytes."""

    MEMO = 64 << 20

    def __init__(self, model: Model):
        self.model = model
        self.memo = RowMemo(model.score, max(10, min(20, int(math.log2(self.MEMO / (36 + 4 * len(model.langs)))))))

    def spans(self, texts: pa.Array):
        """For all chunks of all texts: their numbers by text, languages, letters, letters of learned scripts."""
        codes, sizes, distinct = distinct_chunks(texts)
        at, (scores, letters, seen) = self.memo.rows(distinct)
        at = at[codes]
        return sizes, self.model.viterbi(scores[at], sizes), letters[at], seen[at]


_KEPT: dict[str, Labeller] = {}


def _labeller(model: Model) -> Labeller:
    """The worker's labeller for a model; tasks of one job share what it keeps."""
    claim("langid", _KEPT.clear)
    if model.key not in _KEPT:
        _KEPT.clear()
        _KEPT[model.key] = Labeller(model)
    return _KEPT[model.key]


def _predict(labeller: Labeller, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted language, score and number of spans of each text."""
    model = labeller.model
    k = len(model.langs)
    if not k:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), np.int64)
    sizes, langs, letters, seen = labeller.spans(texts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    share = np.bincount(doc * k + langs, seen, len(texts) * k).reshape(-1, k)
    total = np.bincount(doc, letters, len(texts))
    ends = np.flatnonzero((np.diff(langs) != 0) & (np.diff(doc) == 0))
    top = share.argmax(1)
    pred = [model.langs[j] if n else "und" for j, n in zip(top, total, strict=True)]
    return pred, share[np.arange(len(texts)), top] / np.maximum(total, 1), np.bincount(doc[ends], minlength=len(texts)) + 1


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and the number of spans of each text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets times languages

    def run(batches):
        labeller = _labeller(shared.value)
        for batch in pieces(batches):
            pred, score, spans = _predict(labeller, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.int64())], ["doc_id", "lang_pred", "score", "n_spans"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans long")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text has a predicted language with a score of at least `least`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = _labeller(shared.value)
        for batch in pieces(batches):
            pred, score, _ = _predict(labeller, batch.column("text"))
            yield batch.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def label_spans(text: str, model: Model) -> list[tuple[str, str]]:
    """(language, text) of the spans of one text, its chunks joined by single blanks."""
    if not model.langs:
        return [("und", text)]
    _, langs, _, _ = Labeller(model).spans(pa.array([text]))
    out: list[tuple[str, list[str]]] = []
    for chunk, lang in zip(chunks(text), langs, strict=True):
        if not out or out[-1][0] != model.langs[lang]:
            out.append((model.langs[lang], []))
        out[-1][1].append(chunk)
    return [(lang, " ".join(x)) for lang, x in out]


def held_out():
    return fold(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 4) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    return identify(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "n_spans")
