import random
import time

import pytest

from siltlog.llm import decontaminate as d


def _fold(text):
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in text).split())


def _edits(window, text):
    """Fewest edits between window and a substring of text (plain dynamic programming)."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def _windows(item, q, window, stride, rate):
    t = _fold(item)
    if len(t) < q:
        return []
    size = min(len(t), window)
    e = min(int(rate * size), (size - q) // q)
    return [(t[s : s + size], e) for s in sorted({*range(0, len(t) - size + 1, stride), len(t) - size})]


def _words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "an", "on", "re", "é"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_equals_brute_force():
    rng = random.Random(4)
    options = {"q": 5, "window": 40, "stride": 10, "rate": 0.1}
    items = [(k, _words(rng, rng.randrange(1, 30))) for k in range(12)] + [(50, ""), (51, "ab c")]
    index = d.Index(items, **options)
    seen = 0
    for _ in range(25):
        texts = []
        for _ in range(6):
            parts = [_words(rng, rng.randrange(8))]
            if rng.random() < 0.7:
                t = list(rng.choice(items)[1])
                a = rng.randrange(len(t) + 1)
                t = t[a : a + rng.randrange(30, 90)]
                for _ in range(rng.randrange(9)):
                    if t:
                        p = rng.randrange(len(t))
                        t[p : p + rng.randrange(2)] = rng.choice(["", "x", "zz"])
                parts.append("".join(t))
            texts.append(rng.choice(["  ", ". ", ""]).join([*parts, _words(rng, rng.randrange(8))]))
        found = {(doc, item) for doc, item, *_ in index.search(texts)}
        want = {(k, i) for k, t in enumerate(texts) for i, (_, item) in enumerate(items) if any(_edits(w, _fold(t)) <= e for w, e in _windows(item, **options))}
        assert found == want
        seen += len(want)
    assert seen > 20


def test_rows(spark, monkeypatch):
    rng = random.Random(9)
    item, other = _words(rng, 40), _words(rng, 40)
    bench = spark.createDataFrame([(1, item), (2, other), (2, other), (3, None), (None, item)], "item_id long, text string")
    rows = [(1, "x " + item.upper().replace(" ", "\n") + " y"), (1, "clean"), (None, other), (2, None), (3, ""), (4, "w " * 100_000 + item)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, item_id int")
    found = d.contaminated(docs, bench).collect()
    assert sorted(((r.doc_id or 0), r.contaminated, tuple(r.item_ids)) for r in found) == [
        (0, True, (2,)), (1, False, ()), (1, True, (1,)), (2, False, ()), (3, False, ()), (4, True, (1,)),
    ]
    span = next(s for r in found if r.doc_id == 4 for s in r.spans)
    assert 200_000 - 10 <= span.start < span.end <= 200_000 + len(item) and span.edits == 0
    monkeypatch.setattr(d, "BLOCK_CHARS", 50)
    key = lambda r: (r.doc_id or 0, r.contaminated, tuple(r.item_ids), tuple(sorted((s.item_id or 0, *s[1:]) for s in r.spans)))
    assert sorted(map(key, d.contaminated(docs, bench).collect())) == sorted(map(key, found))
    assert sorted(r.text or "" for r in d.clean(docs, bench).collect()) == ["", "", "clean"]
    assert d.contaminated(docs.limit(0), bench).count() == 0
    assert d.contaminated(docs, bench.limit(0)).where("contaminated").count() == 0


def test_quotes_at_every_offset():
    rng = random.Random(6)
    item = _fold(_words(rng, 60))[:200]
    index = d.Index([(0, _words(rng, 30)), (7, item), (8, _words(rng, 9))])
    for size in (50, 55, 63, 80, 97):
        texts = [f"{_words(rng, 5)}. {item[a : a + size]}. {_words(rng, 5)}" for a in range(len(item) - size + 1)]
        assert {doc for doc, k, *_ in index.search(texts) if k == 1} == set(range(len(texts)))
    assert not index.search([f"{_words(rng, 5)}. {item[a : a + 40]}. {_words(rng, 5)}" for a in range(0, 160, 7)])
    # a quote beside a longer one of the same item has a span of its own
    text = item[:100] + " 1 2 3 4 5 6 7 8 9 " * 5 + item[133:187]
    assert {start > 150 for _, _, start, *_ in index.search([text])} == {True, False}


def test_repetitive_texts():
    rng = random.Random(5)
    index = d.Index([(0, "a" * 500), (1, _words(rng, 40)), (2, "ab " * 100)])
    began = time.process_time()
    found = index.search(["a" * 100_000, "clean", ("a" * 40 + "b") * 500, "ab " * 20_000, "a" * 30 + " " + "b" * 30])
    assert {(k, i) for k, i, *_ in found} == {(0, 0), (2, 0), (3, 2)}
    assert time.process_time() - began < 60


@pytest.mark.parametrize("hits", [d.HITS, 60])
def test_passages_equal_brute_force(monkeypatch, hits):
    monkeypatch.setattr(d, "HITS", hits)
    rng = random.Random(11)
    options = {"q": 5, "window": 40, "stride": 1, "rate": 0.1, "passage": 22}
    items = [(k, _words(rng, rng.randrange(1, 30))) for k in range(8)]
    index = d.Index(items, **options)
    wanted = []
    for _, item in items:
        t = _fold(item)
        wanted.append(_windows(item, 5, 40, 1, 0.1) + [(t[s : s + 22], 2) for s in range(len(t) - 21) if 22 < min(len(t), 40)])
    seen = 0
    for _ in range(8):
        texts = []
        for _ in range(6):
            t = list(rng.choice(items)[1])
            a = rng.randrange(len(t) + 1)
            t = t[a : a + rng.randrange(15, 60)]
            for _ in range(rng.randrange(5)):
                if t:
                    p = rng.randrange(len(t))
                    t[p : p + rng.randrange(2)] = rng.choice(["", "x", "zz"])
            texts.append(" ".join([_words(rng, rng.randrange(4)), "".join(t), _words(rng, rng.randrange(4))]))
        found = {(doc, item) for doc, item, *_ in index.search(texts)}
        want = {(k, i) for k, t in enumerate(texts) for i in range(len(items)) if any(_edits(w, _fold(t)) <= e for w, e in wanted[i])}
        assert found == want
        seen += len(want)
    assert seen > 20


def test_neighbours_in_one_band():
    rng = random.Random(8)
    short = "ab1cd2ef3gh4"
    index = d.Index([(0, _words(rng, 60)), (1, short)])
    for n in range(2, 14):
        for gap in ("", "x", "xyz 12"):
            assert {doc for doc, k, *_ in index.search([gap + short] * n) if k == 1} == set(range(n))
