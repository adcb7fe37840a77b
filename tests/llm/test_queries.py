"""The registered queries, against their SQL or against plain Python on a small table."""

import hashlib
import json
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from siltlog.llm import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def rows():
    con = duckdb.connect()
    found = con.execute(f"select doc_id, text, lang from '{DATA}/documents.parquet' order by doc_id").fetchall()
    quality = dict(con.execute(f"select doc_id, quality from '{DATA}/labels.parquet'").fetchall())
    return [(i, t or "", lang, quality.get(i)) for i, t, lang in found]


def _results(spark, name):
    df = QUERIES[name](spark, DATA)
    return df.columns, {r.doc_id: r for r in df.collect()}


def _fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    want = sorted(str([r[k] for k in at]) for r in want.fetchall())
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    assert sorted(str(list(r)) for r in df.select(*columns).collect()) == want


def test_quality(spark, rows):
    columns, found = _results(spark, "op1_nbsvm_quality")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and set(found) == {i for i, *_ in rows}
    assert all(r.held_out == (_fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in found.items())
    told = [(found[i].predicted, q) for i, _, _, q in rows if q is not None and found[i].held_out]
    assert sum(p == q for p, q in told) >= 0.8 * len(told)  # few labels here; 0.99 and more where there are thousands


def test_language(spark, rows):
    columns, found = _results(spark, "op3_langid_spans")
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and set(found) == {i for i, *_ in rows}
    assert all(r.held_out == (_fold(i, 4) == 2) and 0 <= r.score <= 1 for i, r in found.items())
    assert all((found[i].lang_pred == "und") == (not any(c.isalpha() for c in t)) for i, t, *_ in rows)
    told = [(found[i].lang_pred, lang) for i, t, lang, _ in rows if lang is not None and found[i].held_out and found[i].lang_pred != "und"]
    assert sum(p == lang for p, lang in told) >= 0.97 * len(told)


def test_decontamination(spark, rows):
    _, found = _results(spark, "op2_qgram_decontamination")
    bench = [t for (t,) in duckdb.execute(f"select text from '{DATA}/benchmark.parquet'").fetchall() if t]
    fold = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split())
    whole = [fold(t) for t in bench]
    for i, t, *_ in rows:
        if any(b in fold(t) for b in whole if len(b) >= 10):
            assert found[i].contaminated, i
    assert 0 < sum(r.contaminated for r in found.values()) < len(rows) / 2


def test_pieces(spark, rows):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    _, found = _results(spark, "op4_sentencepiece")
    for i, t, *_ in rows:
        assert found[i].ids == lib.encode(t) and found[i].n_pieces == len(found[i].ids) and found[i].round_trip
        assert found[i].ids_crc32 == zlib.crc32(np.array(found[i].ids, "<u4").tobytes()) and found[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_fingerprints(spark, rows):
    _, found = _results(spark, "op6_one_permutation_minhash")
    shingles = lambda t: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := t.split()) >= 5 else {tuple(w)}
    alike = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    off = []
    for (i, t, *_), (_, other, *_) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 4
        edited = t[: len(t) - n] + other[:n]
        assert found[i].n_chars == len(t) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [found[i].near_edited - alike(t, edited), found[i].near_next - alike(t, other)]
    assert max(map(abs, off)) < 0.25 and abs(np.mean(off)) < 0.02
    assert len({r.fingerprint for r in found.values()}) == len({" ".join(t.split()) for _, t, *_ in rows})


def test_secrets(spark, rows):
    _, found = _results(spark, "op9_forest_secret_scan")
    assert set(found) == {i for i, *_ in rows}
    for i, t, *_ in rows:
        r = found[i]
        assert r.n_candidates == len(r.findings) and r.n_secrets == sum(f.secret for f in r.findings)
        if not r.n_secrets:
            assert r.redacted_sha256 == hashlib.sha256(t.encode()).hexdigest()
        if "AKIA" in t and "EXAMPLE" not in t:
            assert r.n_secrets


def test_token_files(spark, rows):
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    _, found = _results(spark, "op10_token_orc")
    start = 0
    for i, t, *_ in rows:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        r = found[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_plans_of_native_queries_have_no_python(spark):
    for name in ("op5_stratified_sharding", "op6_one_permutation_minhash", "op9_forest_secret_scan"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in ("Python", "Arrow", "Pandas") if x in plan], json.dumps(name)
