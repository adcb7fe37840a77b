import random

import numpy as np

from siltlog.llm import langid

BITS = {"en": ["the", "ing", "tion", "and", "er", "wh"], "de": ["sch", "ung", "keit", "der", "ein", "ß"], "ru": ["ст", "ов", "ени", "про"]}


def _text(rng, lang, n):
    return " ".join("".join(rng.choice(BITS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def _model(spark, rng):
    rows = [(k, _text(rng, lang, 60), lang) for k, lang in enumerate(["en", "de", "ru"] * 30)] + [(1000, "x", None), (1001, None, "en")]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_predictions_and_edge_cases(spark):
    rng = random.Random(3)
    model = _model(spark, rng)
    assert model.langs == ["de", "en", "ru"]
    texts = [(k, _text(rng, lang, 20), lang) for k, lang in enumerate(["en", "de", "ru"] * 40)]
    odd = [(900, None, "und"), (901, "", "und"), (902, "12 34 !? _", "und"), (905, "½ ²", "und"), (906, "①the² Ⅷ", "en"), (None, _text(rng, "de", 9), "de"), (903, "漢字", "de"), (903, "漢字", "de"), (904, _text(rng, "en", 60_000), "en")]
    docs = spark.createDataFrame([(i, t, "nope", 1) for i, t, _ in texts + odd], "doc_id long, text string, lang_pred string, score int")
    rows = langid.identify(docs, model).collect()
    assert sorted(((r.doc_id or -1), r.lang_pred) for r in rows) == sorted(((i or -1), lang) for i, _, lang in texts + odd)
    assert all(0 <= r.score <= 1 for r in rows) and {r.score for r in rows if r.doc_id in (900, 901, 902, 903, 905)} == {0.0}
    assert langid.keep_identified(docs, model).count() == len(texts) + 3
    assert langid.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.Model([])).collect()} == {"und"}


def test_spans(spark):
    rng = random.Random(4)
    model = _model(spark, rng)
    parts = [("en", _text(rng, "en", 15)), ("de", _text(rng, "de", 12)), ("ru", _text(rng, "ru", 10)), ("en", _text(rng, "en", 9))]
    assert langid.label_spans(" \n".join(t for _, t in parts), model) == parts


def test_viterbi_equals_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    model = langid.Model([("a", 1, 1), ("b", 2, 1), ("c", 3, 1)], penalty=1.5)
    sizes = np.array([0, 1, 6, 4, 6, 0, 3])
    emit = rng.normal(size=(sizes.sum(), 3)).astype(np.float32)
    path, at = model.viterbi(emit, sizes), 0
    score = lambda e, p: sum(e[k][j] for k, j in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
    for n in sizes:
        e = emit[at : at + n]
        best = max((score(e, p) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert abs(score(e, path[at : at + n].tolist()) - best) < 1e-4
        at += n


def test_word_scores_equal_plain_counts(spark):
    rng = random.Random(6)
    rows = [(k, _text(rng, lang, 20), lang) for k, lang in enumerate(["en", "de"] * 20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def pieces(word):  # with word ends from order 2 on, which count as one letter
        w = "\x01" + word + "\x01"
        return [*word, *[w[k : k + 2] for k in range(len(w) - 1)], *[w[k : k + 3] for k in range(len(w) - 2)]]

    bucket, counts = {}, {lang: {} for lang in model.langs}
    for _, text, lang in rows:
        for word in text.split():
            found, owner = langid.grams([word])
            assert len(found) == len(pieces(word)) and set(owner) == {0}
            for g, b in zip(pieces(word), found.tolist()):
                assert bucket.setdefault(g, b) == b
                counts[lang][b] = counts[lang].get(b, 0) + 1
    new = ["thing", "keitung", "zzz", "the-schön", "ein"]
    scores, letters, known = model.score(new)
    for word, got in zip(new, scores):
        want = np.zeros(2)
        for _, run in langid.runs(word):
            at = [np.log((np.array([counts[lang].get(b, 0) for lang in model.langs]) + 0.5) / (np.array([sum(counts[lang].values()) for lang in model.langs]) + 0.5 * langid.BUCKETS)) for b in langid.grams([run])[0].tolist()]
            one = np.sum(at, 0) / langid.ORDERS
            want += np.maximum(one - one.max(), langid.FLOOR)
        assert np.allclose(got, want, atol=1e-3), word
    assert letters.tolist() == known.tolist() == [5, 7, 3, 8, 3]
