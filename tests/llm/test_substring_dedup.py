import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siltlog.llm import bwt, substring_dedup


def test_transform_and_merge():
    rng = random.Random(2)
    for _ in range(30):
        shards = [b"".join(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) + b"\xff" for _ in range(rng.randrange(1, 5))) for _ in range(3)]
        done = [bwt.transform(np.frombuffer(s, np.uint8)) for s in shards]
        rows, common = bwt.merge([t for t, _ in done], 6)
        heads = [(s * 9)[o : o + 6] for s, (_, order) in zip(shards, done) for o in order.tolist()]
        merged = [heads[r] for r in rows.tolist()]
        assert sorted(rows.tolist()) == list(range(len(heads))) and merged == sorted(heads)
        prefix = lambda a, b: next((k for k in range(6) if a[k] != b[k]), 6)
        assert common.tolist() == [0] + [prefix(a, b) for a, b in zip(merged, merged[1:])]


def _want(rows, length):
    order = [(i if i is not None else 2**63 - 1, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in order:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for (raw, _), (i, t) in zip(rows, order):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\x01" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((raw is not None, raw or 0, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["the", "ça", "alpha", "beta", "x", "oméga", "of"]) + str(rng.randrange(40)) for _ in range(n))
    passages = [words(rng.randrange(8, 40)) for _ in range(8)]
    ids, rows = rng.sample(range(10_000), 150), []
    for i in ids:
        bits = [words(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            p = passages[0] if rng.random() < 0.5 else rng.choice(passages)
            a = rng.randrange(len(p))
            bits += [p[a : a + rng.randrange(40, 200)], words(rng.randrange(6))]
        rows.append((i, rng.choice([" ", "\n", ""]).join(bits)))
    rows += [(20_000 + k, t) for k, (_, t) in enumerate(rng.sample(rows, 20))]
    rows += [(5_000_000, "a" * 400), (5_000_001, "a" * 399 + "b"), (5_000_002, "é" * 100), (1, "é" * 99 + "e")]
    rows += [rows[0], rows[3], (None, rows[5][1]), (None, "short"), (6, None), (7, ""), (rows[7][0], rows[8][1])]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, tid int, first int")
    monkeypatch.setattr(substring_dedup, "MERGED", 500)
    for length, hot, local in ((50, 4096, 64), (50, 3, 64), (50, 4096, 2), (24, 10, 5)):
        found = substring_dedup.removed_repeats(docs, length=length, hot=hot, local=local).collect()
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
        assert got == _want(rows, length), (length, hot, local)


def test_empty(spark):
    assert substring_dedup.removed_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_in_common_by_chance_make_no_places():
    """Texts that share less than half a string beside a minimizer have nothing to be compared; those that share a string have."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrase, passage = letters(24), letters(50)
    rows = [(k, letters(60) + phrase + letters(60)) for k in range(300)] + [(k, letters(80) + passage + letters(80)) for k in range(300, 310)]
    batch = pa.RecordBatch.from_pydict({"tid": pa.array([k for k, _ in rows], pa.int64()), "text": [t for _, t in rows]})
    for hot, local in ((4096, 1000), (5, 1000)):
        scanned = pa.Table.from_batches(substring_dedup._scan(50, 1, local)(iter([batch])))
        places = substring_dedup._repeated(hot, 1)(scanned)
        assert set(places.column("tid").to_pylist()) == set(range(300, 310))
        assert all((p < 0) == (hot == 5) for p in places.column("place").to_pylist())


def test_slices_of_a_task_share_rows():
    """A task makes a row for each range and bucket, not one for each of these and each slice."""
    rng = random.Random(10)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)) for _ in range(10)] * 2
    batches = [pa.RecordBatch.from_pydict({"tid": pa.array([k], pa.int64()), "first": pa.array([k], pa.int64()), "text": [t], "places": pa.array([[]], pa.list_(pa.int64()))}) for k, t in enumerate(texts)]
    scanned = pa.Table.from_batches(substring_dedup._scan(50, 7, 64)(iter(batches)))
    assert scanned.num_rows == 7
    found = [substring_dedup._repeated(4096, 7)(scanned.filter(pc.equal(scanned["r"], r))) for r in range(7)]
    places = {}
    for k, p in zip(*(np.concatenate([f.column(c).to_numpy() for f in found]).tolist() for c in ("tid", "place")), strict=True):
        places.setdefault(k, []).append(p)
    assert set(places) == set(range(20))
    full = [b.set_column(3, "places", pa.array([places[k]], pa.list_(pa.int64()))) for k, b in enumerate(batches)]
    dealt = pa.Table.from_batches(substring_dedup._cut(50, 5)(iter(full)))
    assert sorted(dealt["bucket"].to_pylist()) == [0, 1, 2, 3, 4]
    gone = [x for b in range(5) for x in substring_dedup._search(50, 5)(dealt.filter(pc.equal(dealt["bucket"], b))).to_pylist()]
    for k in range(10, 20):
        spans = sorted((x["a"], x["b"]) for x in gone if x["tid"] == k)
        assert spans[0][0] == 0 and max(b for _, b in spans) == 30_000 and all(a[1] >= b[0] for a, b in zip(spans, spans[1:]))
    assert not [x for x in gone if x["tid"] < 10]
