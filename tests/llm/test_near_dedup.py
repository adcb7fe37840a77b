import random
import re

from siltlog.llm import components as graph
from siltlog.llm import near_dedup
from siltlog.llm.common import Scratch
from siltlog.llm.components import components


def _set(text, size):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def _want(rows, size):
    sets = [_set(t, size) for _, t in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    first = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            first[c] = min(first.get(c, i), i)
    return sorted(((i is not None, i or 0), len(s), first.get(c)) for (i, _), s, c in zip(rows, sets, comp))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(8)
    rows, hot = [], [f"w{rng.randrange(400)}" for _ in range(60)]
    for k in range(160):
        if k % 2:
            words = list(hot)  # one large group, not all of whose members are alike
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        else:
            words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(12))]
        rows.append((rng.randrange(10_000), rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(20_000 + k, t) for k, (_, t) in enumerate(rng.sample(rows, 40))]
    rows += [(None, "a b c d"), (30_000, None), (30_001, ""), (30_002, " \n"), (30_003, "One"), (30_004, "one"), (30_003, "One"), (30_005, "É é"), (30_006, "é é")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, cid int, keys int")
    for size in (1, 2):
        found = near_dedup.near_duplicates(docs, shingle=size).collect()
        got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id) for r in found)
        assert got == _want(rows, size)
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_one_bucket_of_many_members(spark):
    rng = random.Random(3)
    hot = [f"w{k}" for k in range(50)]
    rows = []
    for k in range(5000):
        words = list(hot)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(50)] = f"x{k}y{rng.randrange(9)}"
        rows.append((k + 1, " ".join(words)))
    rows.append((0, " ".join(hot)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()
    sets = {i: set(t.split()) for i, t in rows}
    near = {i for i, s in sets.items() if 100 * len(s & set(hot)) >= 80 * len(s | set(hot))}
    assert {r.doc_id for r in found if r.component_id == 0} >= near and len(near) > 4000


def test_pairs_at_the_threshold(spark):
    rng, rows = random.Random(4), []
    for k in range(400):  # 16 of 20 words in common, then 15 of 19
        for n, i in ((18, 10 * k), (17, 10 * k + 5)):
            words = [f"v{k}x{n}y{x}" for x in range(n + 2)]
            rows += [(i, " ".join(words[:n])), (i + 1, " ".join(words[2:]))]
    rng.shuffle(rows)
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()}
    assert all(found[10 * k + 1] == 10 * k for k in range(400))
    assert all(found[10 * k + 6] == 10 * k + 6 for k in range(400))


def test_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "HELD", 4)  # else partitions as small as these join up all that they hold
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(400, 400)]
    comp = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    found = {r.node: r.root for r in components(Scratch(spark, "test"), "found", spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {n: c for n, c in comp.items() if n != c}
