import random

import corpus_pipeline as cp
from siltlog.llm import pieces

LANGS = {"en": "the of and ing tion er th on", "de": "der die und ung keit sch ein pf"}


def _text(rng, lang, n):
    bits = LANGS[lang].split()
    return " ".join("".join(rng.choice(bits) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_run(spark, tmp_path):
    rng = random.Random(12)
    rows = [(k, _text(rng, lang, rng.randrange(60, 200)), lang) for k, lang in enumerate(["en", "de"] * 30)]
    passage = _text(rng, "en", 40)
    long = rows[0][1].split()
    long[5] = "changed"
    rows += [
        (100, " ".join(long), "en"), (101, rows[1][1], "de"), (102, rows[2][1] + " " + passage, "en"),
        (103, rows[4][1][::-1] + ' token = "40d78a45c418324758e099eb7cb89bc0f5fa9f62" ' + rows[6][1], "en"), (104, "1234 5678", None), (105, None, "en"), (106, "", None),
    ]
    docs = spark.createDataFrame([(i, t, lang, None, len(t or ""), "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, passage), (8, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    want = {k for k in range(60)} | {103}
    assert set(out) == want
    model = pieces.load(cp.public_tokenizers.path("piece_bpe_32k.model"))
    for i, t, _ in rows:
        if i in out:
            said = t.replace("40d78a45c418324758e099eb7cb89bc0f5fa9f62", "[REDACTED]")
            assert out[i].ids == model.encode(said) and out[i].round_trip, i
    for _, stage in cp.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == list(cp.COLUMNS) and [f.dataType for f in found.schema] == [docs.schema[c].dataType for c in cp.COLUMNS]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_one_of_equal_rows_stays(spark, tmp_path):
    text = "a b c d e f g h i j"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, "x y z u v w q"), (None, "x y z u v w q"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = [(r.doc_id, r.text) for r in cp.near(spark, docs, "").collect()]
    assert sorted(found, key=str) == sorted([(1, text), (None, "x y z u v w q"), (3, None), (4, "")], key=str)
