import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from siltlog.llm import fingerprints as fp


def _shingles(text, size=5):
    w = (text or "").split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def test_likeness_of_texts(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        a = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice([30, 300, 2000]))]
        b = list(a)
        for _ in range(rng.randrange(len(a) // 10)):
            b[rng.randrange(len(b))] = f"z{rng.randrange(10_000)}"
        rows.append((k, " ".join(a), " ".join(b), len(_shingles(" ".join(a)) & _shingles(" ".join(b))) / len(_shingles(" ".join(a)) | _shingles(" ".join(b)))))
    df = spark.createDataFrame(rows, "k int, a string, b string, j double")
    df = fp.fingerprint(fp.fingerprint(df, "a", "fa"), "b", "fb")
    off = [r.e - r.j for r in df.select("j", fp.likeness(F.col("fa"), F.col("fb")).alias("e")).collect()]
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.2


def test_short_and_equal_texts(spark):
    texts = ["", None, "  ", "a", "a ", "a b c d", "x " * 3000, "x " * 3000]
    df = fp.fingerprint(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text", "f")
    f = [r.f for r in df.orderBy("k").collect()]
    assert f[0] == f[1] == f[2] and f[3] == f[4] and f[6] == f[7] and len({f[0], f[3], f[5], f[6]}) == 4
    assert {len(x) for x in f} == {256}
    assert fp.fingerprint(df.limit(0), "text", "f").count() == 0


@pytest.mark.parametrize("ranges, most", [(1000, 20_000), (4, 30)])
def test_next_rows(spark, monkeypatch, ranges, most):
    monkeypatch.setattr(fp, "RANGES", ranges)
    monkeypatch.setattr(fp, "MOST_ROWS", most)
    rng = random.Random(1)
    ids = [None, None, 7, 7, *[None] * 150, *[350] * 300, *rng.sample(range(-5000, 10**12), 900), *range(300)]
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").withColumn("_h", F.xxhash64("text"))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r._h))
    want = {a.text: b.text for a, b in zip(rows, rows[1:] + rows[:1])}
    found = fp.with_next(docs, ["text"]).collect()
    assert len(found) == len(ids) and {r.text: r.next_text for r in found} == want


def test_query(spark, tmp_path):
    texts = ["áé😀 b c d e f g h", "1 2 3 4 5 6 7 8 9", None, "", "last one"]
    spark.createDataFrame([(10 - k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, fingerprint int").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in fp.query(spark, str(tmp_path)).collect()}
    ordered = [(10 - k, t or "") for k, t in enumerate(texts)][::-1]
    for k, (i, t) in enumerate(ordered):
        n, other = len(t) // 4, ordered[(k + 1) % len(ordered)][1]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + other[:n]).encode()).hexdigest()


def _plain(text, bins, bits, size):
    """The fingerprint by loops."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in (text or "").split()]

    def run(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        return signed(h)

    hashes = [run(words[k : k + size]) for k in range(len(words) - size + 1)] if len(words) >= size else [run(words)]
    least = {}
    for h in hashes:
        b = (h >> (64 - (bins.bit_length() - 1))) + bins // 2
        least[b] = min(h, least.get(b, h))
    tables, out = fp._looks(bins, fp.LOOKS), []
    for i in range(bins):
        b = next((x for x in [i, *[t[i] for t in tables]] if x in least), None)
        if b is None:
            order = lambda x: signed(xxhash.xxh64_intdigest(struct.pack("<i", x), xxhash.xxh64_intdigest(struct.pack("<i", i), xxhash.xxh64_intdigest(struct.pack("<i", 11), 42))))
            b = min(least, key=lambda x: (order(x), x))
        out.append(format(least[b] & (1 << bits) - 1, f"0{bits // 4}x"))
    return "".join(out)


@pytest.mark.parametrize("bins, bits, size", [(128, 8, 5), (16, 4, 2)])
def test_equals_plain_loops(spark, bins, bits, size):
    rng = random.Random(4)
    texts = ["", None, "a", "a b", *[" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 80))) for _ in range(40)]]
    df = fp.fingerprint(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text", "f", bins, bits, size)
    for r in df.collect():
        assert r.f == _plain(texts[r.k], bins, bits, size), texts[r.k]
