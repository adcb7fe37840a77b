import math
import random

import numpy as np
import pyarrow as pa

from siltlog.llm import quality


def _good(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "an", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def _bad(rng, n):
    kind = rng.randrange(3)
    words = _good(rng, n).split()
    return " ".join([words[0]] * n if kind == 0 else [w + rng.choice(["***", "%%%"]) for w in words] if kind == 1 else [w.upper() + "!!" for w in words])


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(1)
    rows = [(k, _bad(rng, rng.randrange(8, 80)) if k % 4 == 0 else _good(rng, rng.randrange(3, 80)), int(k % 4 != 0)) for k in range(800)]
    docs = spark.createDataFrame([(i, t, -1) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 600] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    found = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    right = sum((found[i] >= 0.3) == bool(q) for i, _, q in rows if i >= 600)
    assert right >= 195 and all(0 <= s <= 1 for s in found.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " "), (None, "Same text."), (4, "Same text."), (5, "w " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert got[1] == got[2] == got[3] and got[None] == got[4] and len(got) == 6
    assert quality.score(odd.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for labels, want in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert abs(quality.score(docs, model).first().score - want) < 1e-5


def test_dual_descent_reaches_the_least_loss():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    ratio = rng.normal(size=30)
    w, bias = quality._descend(rows, y, ratio, 1.0, 2000, 1)

    def loss(w, b):
        m = [1 - s * (w[x] @ ratio[x] / np.sqrt(np.square(ratio[x]).sum()) + b) for x, s in zip(rows, y)]
        return 0.5 * (w @ w + b * b) + sum(max(0, v) ** 2 for v in m)

    least = loss(w, bias)
    assert all(loss(w + d[:30], bias + d[30]) > least - 1e-3 for d in rng.normal(scale=0.05, size=(200, 31)))


def test_ratios_and_margins_equal_plain_counts():
    rng = random.Random(9)
    texts = [(_good if k % 3 else _bad)(rng, 12) for k in range(80)]
    labels = [int(k % 3 > 0) for k in range(80)]
    features = quality.Features()
    rows = features.distinct(pa.array(texts))
    assert [x.tolist() for x in rows] == [quality.Features().distinct(pa.array([t]))[0].tolist() for t in texts]  # batches do not matter
    model = quality.train(rows, labels)
    kept = [(set(x.tolist()), y) for k, (x, y) in enumerate(zip(rows, labels)) if k % 4 != 3]
    n = {y: sum(1 for _, z in kept if z == y) + 2 for y in (0, 1)}
    for b in sorted({b for x, _ in kept for b in x}):
        have = {y: sum(1 for x, z in kept if z == y and b in x) for y in (0, 1)}
        want = math.log((have[1] + 1) / n[1] / ((have[0] + 1) / n[0])) if sum(have.values()) >= 3 else 0
        assert abs(model.ratio[b] - want) < 1e-9
    for text, x, margin in zip(texts, rows, model.margins(features, pa.array(texts))):
        norm = math.sqrt(sum(model.ratio[b] ** 2 for b in x)) or 1
        assert abs(margin - model.bias - sum(model.ratio[b] * model.weights[b] for b in x) / norm) < 1e-9, text
