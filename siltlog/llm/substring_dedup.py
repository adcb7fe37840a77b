"""Exact removal of long strings that an earlier document holds, by merged transforms.

A byte goes if a string of `length` bytes over it also starts in a document with
a smaller doc_id. Rows with equal texts are one text of the smallest id; their
later copies go whole (from `length` bytes on), so copies cost a row each.

Every string of `length` bytes has a minimizer: its GRAM-byte piece with the
smallest hash. Equal strings have equal minimizers, so texts are cut into
stretches of neighbouring strings with one minimizer, and a stretch only matters
if its minimizer is found in two texts, and with it, at one side, another piece
half a string away: what two texts have in common by chance is rarely so long, so
the share of stretches that matter does not grow with the number of texts. Those
stretches are dealt out by the minimizer. Where one is in more texts than `hot`, or in more than `local` of a
slice, its strings are dealt out one by one by a hash of the whole string
instead. Before that, equal ones within a slice are put together: all but those of
the smallest id are sure to go, so a line that a third of all documents hold
makes a row a slice in one bucket, not one a document.

In each bucket equal stretches are put together too (the smallest id tells which
of them go whole). Different ones of a minimizer that agree in half of a string
beside it form shards whose Burrows-Wheeler transforms are merged by interleave
refinement up to `length` bytes; the intervals of merged rows with so many bytes
in common are the repeated strings, and the smallest id of an interval tells which
of them go. A stretch that differs from all others of its minimizer by more, or
has no others, has nothing to be merged with.

Null texts are empty, and empty texts lose nothing. A null id is larger than all
others. Rows with equal ids and different texts do not remove from each other.
Further columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm import bwt
from siltlog.llm.common import Scratch, Sieve, documents, parts, settle, small_batches
from siltlog.llm.words import gather, pieces, trim

GRAM, LENGTH, SHARDS = 16, 50, 4
HOT, LOCAL = 4096, 64  # texts, in all and in one slice, from which on a minimizer is hot
MERGED = 100_000  # bytes that are merged at once, and more only for one minimizer
RANGE_BYTES, BUCKET_BYTES = 12 << 20, 1_500_000  # of texts whose minimizers, and of stretches that, meet in one task
HELD = 16 << 20  # bytes that a task holds before it deals them out: slice by slice, rows would grow with the square of the input
NO_ID = 2**63 - 1
_M = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFF)


def join_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text starts (and the last ends)."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    h, w = (data.astype(np.uint64) + np.uint64(1)) * _M, 1
    while w < GRAM:
        h = (h[:-w] ^ (h[:-w] >> np.uint64(31))) * _M + (h[w:] ^ (h[w:] >> np.uint64(29)))
        w *= 2
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


def stretches(data: np.ndarray, starts: np.ndarray, length: int):
    """(first start, last start, text number, minimizer position, minimizer hash, all gram hashes) of neighbouring strings with one minimizer."""
    none = np.zeros(0, np.int64)
    span = length - GRAM + 1
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = gram_hashes(data)
    least, w = (h & ~_LOW) | (np.arange(len(h), dtype=np.uint64) & _LOW), 1
    while 2 * w <= span:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if w < span:
        least = np.minimum(least[: len(least) - (span - w)], least[span - w :])
    valid = np.zeros(len(least) + 1, bool)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= length:
            valid[a : b - length + 1] = True
    valid = valid[:-1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & new)
    last = np.append(first[1:], len(least)) - 1
    text = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(last, starts[text + 1] - length)
    at = first + ((least[first] - first.astype(np.uint64)) & _LOW).astype(np.int64)
    return first, last, text, at, h[at], h


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all lowest bytes first: those above are mostly zeros, which a shuffle packs well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _scan(length: int, ranges: int, local: int):
    """Minimizers of texts, in rows by hash range.

    One in over `local` texts of a slice is known to be repeated, and hot: its
    range gets just the hash, once, and its places go to a row beyond the ranges.
    """

    def row(r, tids, texts, h, pos, beside):
        cuts = _runs(texts)
        return (int(r), tids[texts[cuts[:-1]]].astype("<i8").tobytes(), _planes(np.diff(cuts)), h.astype("<u4").tobytes(), _planes(pos), beside.tobytes())

    def flush(held, tids):
        r, text, low, pos, beside = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((text, r))
        r, text, low, pos, beside = r[order], text[order], low[order], pos[order], beside[order]
        cuts = _runs(r)
        return [row(r[a], tids, text[a:b], low[a:b], pos[a:b], beside[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def run(batches):
        held, tids, size = [], np.zeros(0, np.int64), 0
        for batch in pieces(batches, 2_000_000):
            data, starts = join_bytes(pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist())
            first, last, text, at, h, grams = stretches(data, starts, length)
            if not len(at):
                continue
            order = np.argsort(h, kind="stable")
            beside = _beside(first, last, at, grams, length)[order]
            h, text, pos = h[order], text[order], (at - starts[text])[order]
            del first, last, at, grams
            begins = _runs(h)
            fresh = np.ones(len(h), np.int64)
            fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            often = np.add.reduceat(fresh, begins[:-1]) > local
            hot = np.repeat(often, np.diff(begins))
            tid, rows = batch.column("tid").to_numpy(), []
            r, low = ((h >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64), h & np.uint64(0xFFFFFFFF)
            if often.any():
                told = begins[:-1][often]
                for x in np.unique(r[told]):
                    rows.append((int(x), b"", b"", low[told[r[told] == x]].astype("<u4").tobytes(), b"", b""))
                by = np.flatnonzero(hot)[np.argsort(text[hot], kind="stable")]
                rows.append(row(ranges + int(h[0] % np.uint64(ranges)), tid, text[by], low[by], pos[by], beside[:0]))
            cold = ~hot
            held.append((r[cold], text[cold] + len(tids), low[cold].astype("<u4"), pos[cold], beside[cold]))
            tids = np.concatenate([tids, tid])
            size += 28 * int(cold.sum()) + 8 * len(tid)
            if size > HELD:
                rows += flush(held, tids)
                tids, size = tids[:0], 0
            yield pa.RecordBatch.from_pylist([dict(zip(_SCAN.names, x, strict=True)) for x in rows], schema=_SCAN)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(_SCAN.names, x, strict=True)) for x in flush(held, tids)], schema=_SCAN)

    return run


_SCAN = pa.schema([("r", pa.int32()), ("tids", pa.binary()), ("n", pa.binary()), ("hash", pa.binary()), ("pos", pa.binary()), ("beside", pa.binary())])


def _beside(first: np.ndarray, last: np.ndarray, at: np.ndarray, grams: np.ndarray, length: int) -> np.ndarray:
    """16 bits of the pieces half a string to the left and to the right of each minimizer; 0 where the stretch does not reach there.

    Equal strings have their minimizer at the same place, in one half or the
    other: they agree in one of these two, and both stretches reach there.
    """
    side = -(-(length - GRAM) // 2)
    out = np.zeros((len(at), 2), "<u2")
    for k, place, ok in ((0, at - side, at - first >= side), (1, at + side, at + side + GRAM <= last + length)):
        out[ok, k] = np.maximum(grams[place[ok]] >> np.uint64(48), np.uint64(1))
    return out


def _shared(h: np.ndarray, beside: np.ndarray, tid: np.ndarray) -> np.ndarray:
    """Whether another text has the same minimizer and the same piece beside it."""
    key = h.astype(np.uint64) << np.uint64(16) | beside
    order = np.lexsort((tid, key))
    key, tid = key[order], tid[order]
    cuts = _runs(key)
    out = np.zeros(len(h), bool)
    if len(h):
        out[order] = np.repeat(tid[cuts[:-1]] != tid[cuts[1:] - 1], np.diff(cuts))
    return out


def _repeated(hot: int, ranges: int):
    """Places of the minimizers of one range that are in two texts, with an equal piece beside them; those of hot ones are told by their complement."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        full = [x for x in rows if x["pos"]]
        joined = lambda key, kind: np.frombuffer(b"".join([x[key] for x in full]), kind)
        whole = lambda key: np.concatenate([_unplanes(x[key]) for x in full] or [np.zeros(0, np.int64)])
        tid, h, pos = np.repeat(joined("tids", "<i8"), whole("n")), joined("hash", "<u4"), whole("pos")
        if rows[0]["r"] >= ranges:
            return pa.table({"tid": pa.array(tid, pa.int64()), "place": pa.array(-1 - pos, pa.int64())})
        told = np.frombuffer(b"".join([x["hash"] for x in rows if not x["pos"]]), "<u4")
        beside = joined("beside", "<u2").reshape(-1, 2)
        order = np.lexsort((tid, h))
        tid, h, pos, beside = tid[order], h[order], pos[order], beside[order]
        known = np.isin(h, told)
        keep = known.copy()
        begins = _runs(h)
        maybe = ~known & np.repeat(tid[begins[:-1]] != tid[begins[1:] - 1], np.diff(begins)) if len(h) else keep
        for k in (0, 1):
            some = np.flatnonzero(maybe & (beside[:, k] > 0))
            keep[some[_shared(h[some], beside[some, k], tid[some])]] = True
        tid, h, pos, known = tid[keep], h[keep], pos[keep], known[keep]
        begins = _runs(h)
        fresh = np.ones(len(h), np.int64)
        fresh[1:] = (h[1:] != h[:-1]) | (tid[1:] != tid[:-1])
        texts = np.add.reduceat(fresh, begins[:-1]) if len(h) else np.zeros(0, np.int64)
        often = known | np.repeat(texts > hot, np.diff(begins))
        out = pa.table({"tid": pa.array(tid, pa.int64()), "place": pa.array(np.where(often, -1 - pos, pos), pa.int64())})
        del order, tid, h, pos, beside, known, keep, begins, maybe, fresh, texts, often
        trim()
        return out

    return run


_CUT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("tids", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary()), ("lead", pa.binary()), ("data", pa.binary()), ("n", pa.int32())])
_ALONE = 255  # lead of a string that is dealt out by itself


def _cut(length: int, buckets: int):
    """Stretches of repeated minimizers and strings of hot ones, in rows by bucket.

    Of equal ones of a slice, those of larger ids are sure to go; beyond the
    buckets, their places are passed on without their bytes.
    """

    def flush(held, surely):
        if not held:
            return
        into, tid, ids, start, size = (np.concatenate(x) for x in zip(*surely, strict=True))
        surely.clear()
        order = np.argsort(into, kind="stable")
        into, tid, ids, start, size = into[order], tid[order], ids[order], start[order], size[order]
        cuts = _runs(into)
        rows = [(int(into[x]), b"", tid[x:y].astype("<i8").tobytes(), ids[x:y].astype("<i8").tobytes(), _planes(start[x:y]), _planes(size[x:y]), b"", b"", 0) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        bucket, key, tid, ids, start, size, lead, data = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        begins = np.cumsum(size) - size
        order = np.argsort(bucket, kind="stable")
        cuts = _runs(bucket[order])
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            k = order[x:y]
            text = pa.compress(gather(data, begins[k], size[k]).tobytes(), "zstd", asbytes=True)
            rows.append((int(bucket[k[0]]), key[k].astype("<u8").tobytes(), tid[k].astype("<i8").tobytes(), ids[k].astype("<i8").tobytes(), _planes(start[k]), _planes(size[k]), lead[k].tobytes(), text, int(size[k].sum())))
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist([dict(zip(_CUT.names, r, strict=True)) for r in rows], schema=_CUT)
                rows = []
        yield pa.RecordBatch.from_pylist([dict(zip(_CUT.names, r, strict=True)) for r in rows], schema=_CUT)
        trim()

    def run(batches):
        held, surely, full = [], [], 0
        for batch in pieces(batches, 2_000_000):
            data, starts = join_bytes(pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist())
            first, last, text, at, h, grams = stretches(data, starts, length)
            lists = batch.column("places")
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            own = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            flat = flat[ends[0] : ends[-1]]
            hot = flat < 0
            told = starts[own] + np.where(hot, -1 - flat, flat)
            cold_at, hot_at = np.isin(at, told[~hot]), np.isin(at, told[hot])
            n = (last - first + 1)[hot_at]
            w = np.repeat(first[hot_at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            mixed = np.zeros(len(w), np.uint64)
            for k in [*range(0, length - GRAM, GRAM), length - GRAM]:
                mixed = (mixed ^ grams[w + k]) * _M
                mixed ^= mixed >> np.uint64(29)
            a, t = np.concatenate([first[cold_at], w]), np.concatenate([text[cold_at], np.repeat(text[hot_at], n)])
            size = np.concatenate([last[cold_at] + length, w + length]) - a
            key = np.concatenate([h[cold_at], mixed])
            lead = np.concatenate([(at - first)[cold_at], np.full(len(w), _ALONE)])
            if not len(a):
                continue
            tid, ids = batch.column("tid").to_numpy()[t], batch.column("first").to_numpy()[t]
            blob, seen = data.tobytes(), {}
            number = np.array([seen.setdefault(blob[x:y], len(seen)) for x, y in zip(a.tolist(), (a + size).tolist(), strict=True)], np.int64)
            least = np.full(len(seen), NO_ID)
            np.minimum.at(least, number, ids)
            sure = ids > least[number]
            # places that are sure to go, put together where they touch
            gone = np.flatnonzero(sure)
            gone = gone[np.argsort(a[gone], kind="stable")]
            until = np.maximum.accumulate((a + size)[gone]) if len(gone) else gone
            new = np.ones(len(gone), bool)
            new[1:] = (a[gone][1:] > until[:-1]) | (t[gone][1:] != t[gone][:-1])
            lo = gone[new]
            hi = until[np.append(np.flatnonzero(new)[1:], len(gone)) - 1] if len(gone) else lo
            surely.append((buckets + tid[lo] % buckets, tid[lo], ids[lo], a[lo] - starts[t[lo]], hi - a[lo]))
            left = np.flatnonzero(~sure)
            a, size = a[left], size[left]
            bucket = (key[left] >> np.uint64(20)).astype(np.int64) % buckets
            held.append((bucket, key[left], tid[left], ids[left], a - starts[t[left]], size, lead[left].astype(np.uint8), gather(data, a, size)))
            full += int(size.sum()) + 49 * len(left) + 40 * len(lo)
            if full > HELD:
                yield from flush(held, surely)
                full = 0
        yield from flush(held, surely)

    return run


def repeated_starts(strings: list[bytes], ids: np.ndarray, length: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Of these different strings: (number of the string, start) of all `length` bytes that also start in a string with a smaller id, in order."""
    parts_ = [p for p in (range(k, len(strings), shards) for k in range(shards)) if len(p)]
    texts, owner, offset = [], [], []
    for p in parts_:
        text = np.frombuffer(b"".join([strings[k] + bytes([bwt.END]) for k in p]), np.uint8)
        size = np.array([len(strings[k]) + 1 for k in p])
        texts.append(bwt.transform(text))
        owner.append(np.repeat(np.fromiter(p, np.int64), size))
        offset.append(np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size))
    base = np.cumsum([0] + [len(o) for o in owner])
    orders = np.concatenate([order + b for (_, order), b in zip(texts, base, strict=False)])
    rows, common = bwt.merge([t for t, _ in texts], length)
    place = orders[rows]
    owner, offset = np.concatenate(owner)[place], np.concatenate(offset)[place]
    size = np.array([len(s) for s in strings])
    whole = offset + length <= size[owner]
    of = np.where(whole, ids[owner], NO_ID)
    cut = np.flatnonzero(common < length)  # intervals of rows with `length` bytes in common
    least = np.repeat(np.minimum.reduceat(of, cut), np.diff(np.append(cut, len(of))))
    hit = whole & (least < of)
    order = np.lexsort((offset[hit], owner[hit]))
    return owner[hit][order], offset[hit][order]


def _sharing(strings: list[bytes], key: np.ndarray, lead: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the strings that may have `length` bytes in common with another of their key, those of a key side by side.

    Such bytes hold the minimizer and, to its left or to its right, half of what
    else they have: the strings agree in one of these two longer pieces.
    """
    side = -(-(length - GRAM) // 2)
    data, starts = join_bytes(strings)
    m = np.arange(len(strings))
    found = [m[lead == _ALONE]]
    parts_ = []
    for salt, begin in ((1, lead - side), (2, lead)):
        ok = (lead != _ALONE) & (begin >= 0) & (begin + side + GRAM <= np.diff(starts))
        bytes_ = data[(starts[:-1] + begin)[ok, None] + np.arange(side + GRAM)].astype(np.uint64)
        mixed = (bytes_ + np.uint64(salt)) @ _POWERS[: side + GRAM]
        parts_.append((m[ok], (mixed ^ key[ok] ^ (mixed >> np.uint64(31))) * _M))
    number, mixed = (np.concatenate(x) for x in zip(*parts_, strict=True))
    _, group, n = np.unique(mixed, return_inverse=True, return_counts=True)
    kept = np.unique(np.concatenate([*found, number[n[group] > 1]]))
    kept = kept[np.argsort(key[kept], kind="stable")]
    cuts = _runs(key[kept])
    return kept[np.repeat(np.diff(cuts) > 1, np.diff(cuts))]


_POWERS = np.cumprod(np.full(64, _M, np.uint64))


def _search(length: int, buckets: int):
    """Removed stretches (tid, id, a, b) of one bucket."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        joined = lambda key, kind: np.frombuffer(b"".join([x[key] for x in rows]), kind)
        tid, doc = joined("tids", "<i8"), joined("ids", "<i8")
        start, sizes = (np.concatenate([_unplanes(x[key]) for x in rows]) for key in ("starts", "sizes"))
        if rows[0]["bucket"] >= buckets:
            return _spans(tid, doc, start, start + sizes)
        blob = b"".join([pa.decompress(x["data"], x["n"], "zstd", asbytes=True) for x in rows])
        seen: dict[bytes, int] = {}
        ends = np.cumsum(sizes)
        number = np.array([seen.setdefault(blob[x:y], len(seen)) for x, y in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], np.int64)
        del blob
        strings = list(seen)
        least = np.full(len(strings), NO_ID)
        np.minimum.at(least, number, doc)
        later = doc > least[number]  # equal to a stretch of an earlier document
        out = [(tid[later], doc[later], start[later], (start + sizes)[later])]
        key, lead = np.zeros(len(strings), np.uint64), np.zeros(len(strings), np.int64)
        key[number], lead[number] = joined("keys", "<u8"), joined("lead", np.uint8)
        mixed = _sharing(strings, key, lead, length)
        own = np.flatnonzero(~later)
        own = own[np.argsort(number[own], kind="stable")]
        ends = np.searchsorted(number[own], np.arange(len(strings) + 1))
        # all strings of a key are merged together; so many keys at once as fill a cache
        total = np.cumsum([len(strings[k]) for k in mixed])
        cuts = _runs(key[mixed])
        at = 0
        while at < len(mixed):
            full = np.searchsorted(total, (total[at - 1] if at else 0) + MERGED)
            end = int(cuts[np.searchsorted(cuts, max(full, at + 1))])
            part = mixed[at:end]
            string, hit = repeated_starts([strings[k] for k in part], least[part], length)
            at = end
            if not len(hit):
                continue
            new = np.ones(len(hit), bool)
            new[1:] = (string[1:] != string[:-1]) | (hit[1:] - hit[:-1] > length)
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(hit)) - 1
            of, a, b = part[string[lo]], hit[lo], hit[hi] + length
            n = ends[of + 1] - ends[of]
            row = gather(own, ends[of], n)
            out.append((tid[row], doc[row], start[row] + np.repeat(a, n), start[row] + np.repeat(b, n)))
        return _spans(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return run


def _spans(*columns: np.ndarray) -> pa.Table:
    return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(("tid", "id", "a", "b"), columns, strict=True)})


def _remove(batches):
    for batch in pieces(batches):
        rows = []
        for id_, tid, text, spans in zip(batch.column("_id").to_pylist(), batch.column("tid").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, kept, removed, runs, at = text.encode("utf-8", "surrogatepass"), [], 0, 0, 0
            for s in sorted((s["a"], s["b"]) for s in spans):
                if s[1] <= at and runs:
                    continue
                if s[0] > at or not runs:
                    runs += 1
                    kept.append(data[at : s[0]])
                    removed += s[1] - s[0]
                else:
                    removed += s[1] - at
                at = s[1]
            kept.append(data[at:])
            rows.append({"id": id_, "tid": tid, "n_removed": removed, "n_spans": runs, "kept_sha256": hashlib.sha256(b"".join(kept)).hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("tid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def removed_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, local: int = LOCAL) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "repeat")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumns({"tid": F.xxhash64("text"), "_id": F.coalesce("doc_id", F.lit(NO_ID))})
    described = texts.select("doc_id", "_id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha"))
    base = scratch.write("base", described)
    # texts are told apart by all of their hash; tid only names them shortly, and goes with the first id
    firsts = scratch.write("firsts", base.groupBy("sha").agg(F.min("_id").alias("first"), F.min("tid").alias("tid"), F.min("n_bytes").alias("n")))
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, -(-total // RANGE_BYTES))
    scanned = texts.where(F.octet_length("text") >= length).select("tid", "text").mapInArrow(_scan(length, ranges, local), "r int, tids binary, n binary, hash binary, pos binary, beside binary")
    places = scratch.write("places", scanned.groupBy("r").applyInArrow(_repeated(hot, ranges), "tid long, place long"))
    settle(spark)
    buckets = max(parts(spark), -(-places.count() * 70 // BUCKET_BYTES))
    wanted = places.groupBy("tid").agg(F.collect_set("place").alias("places")).join(firsts, "tid").select(F.col("tid").alias("_tid"), F.col("first"), "places")
    wanted = scratch.write("wanted", wanted)
    maybe, _ = Sieve(scratch, "sieve", wanted.select("first", "_tid")).split(texts, ["_id", "tid"])
    chosen = maybe.join(wanted, (F.col("_id") == F.col("first")) & (F.col("tid") == F.col("_tid"))).select("_id", "tid", "first", "text", "places")
    repeats = base.groupBy("_id", "tid").count().where("count > 1").limit(1).count() > 0
    if repeats:  # rows equal in id and text: the join has them together already
        chosen = chosen.dropDuplicates(["_id", "tid"])
    strings = chosen.drop("_id").mapInArrow(_cut(length, buckets), "bucket int, keys binary, tids binary, ids binary, starts binary, sizes binary, lead binary, data binary, n int")
    spans = scratch.write("spans", strings.groupBy("bucket").applyInArrow(_search(length, buckets), "tid long, id long, a long, b long"))
    scratch.drop("places", "wanted", "sieve")
    settle(spark)
    names = scratch.write("names", spans.select("id", "tid").distinct())
    maybe, _ = Sieve(scratch, "sieve", names).split(texts, ["_id", "tid"])
    spans = spans.groupBy("tid", "id").agg(F.collect_list(F.struct("a", "b")).alias("spans")).select(F.col("tid").alias("_tid"), "id", "spans")
    hit = maybe.join(spans, (F.col("_id") == F.col("id")) & (F.col("tid") == F.col("_tid"))).select("_id", "tid", "text", "spans")
    hit = hit.dropDuplicates(["_id", "tid"]) if repeats else hit
    removed = scratch.write("removed", hit.mapInArrow(_remove, "id long, tid long, n_removed long, n_spans long, kept_sha256 string"))
    scratch.drop("spans", "names", "sieve")
    settle(spark)
    told = firsts.join(removed.withColumnRenamed("tid", "_tid"), (F.col("first") == F.col("id")) & (F.col("tid") == F.col("_tid")), "left")
    told = scratch.write("told", told.select(F.col("sha").alias("_sha"), "first", "n_removed", "n_spans", "kept_sha256"))
    scratch.drop("firsts", "removed")
    copy = (F.col("_id") > F.col("first")) & (F.col("n_bytes") >= length)
    kept = (F.col("_id") == F.col("first")) & F.col("n_removed").isNotNull()
    return base.join(told, base["sha"] == told["_sha"]).select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(kept, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).when(kept, F.col("n_spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(kept, F.col("kept_sha256")).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(documents(spark, sf_dir))
