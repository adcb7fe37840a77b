"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are folded (letters and digits in lower case, every
run of other characters one blank). Items are cut into windows of `window`
folded characters and of `passage`, one each `stride` characters (every position)
and one at the end; an item shorter than a window is one. A text is contaminated
if one of its substrings is within the edit budget of a window: int(rate * size)
edits, and less by what leaves the q-grams of a short one too few to tell. A
window with e edits keeps at least length - q + 1 - q * e of its q-grams, on
diagonals that differ by 2e at most. So the q-grams a text shares are counted in
overlapping diagonal bands of two such widths, bands that meet the bound stay, and
an alignment confined to the band and the text decides. This finds exactly the
texts and items that the definition names.

Windows each COARSE characters are tried first. Where one matches, the passage is
told by it, and q-grams in it are not counted again; all windows are tried on the
rest, so each passage has a span, but not each window of it.

Items go to the executors in blocks of bounded size, however large the
benchmark. Items of fewer than q folded characters match nothing, as do null
items and null or empty texts. Repeated items and rows count each by itself;
null ids stay; further columns are left out; empty tables give no rows, or only
clean ones.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.common import Scratch, documents, small_batches
from siltlog.llm.words import claim, pieces

Q, WINDOW, PASSAGE, STRIDE, RATE = 10, 80, 50, 1, 0.08
COARSE, PART = 20, 10
BLOCK_CHARS = 4_000_000
HITS = 1_000_000  # shared q-grams that are looked at together
SPACE, STOP = 32, 0


def _fold_table() -> np.ndarray:
    table = np.full(1 << 16, SPACE, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalnum():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of all texts, each followed by STOP; where each text starts; positions in the joined texts."""
    if not _TABLE:
        _TABLE.append(_fold_table())
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    code = np.zeros(sizes.sum(), np.uint32)
    ends = np.cumsum(sizes) - 1
    inner = np.ones(len(code), bool)
    inner[ends] = False
    code[inner] = np.concatenate(raw) if raw else code[:0]
    high = code >= 1 << 16
    out = _TABLE[0][np.minimum(code, 0xFFFF)]
    if high.any():
        out[high] = [c if chr(c).isalnum() else SPACE for c in code[high].tolist()]
    out[ends] = STOP
    blank = out == SPACE
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    if len(keep):
        keep[0] = True
    at = np.flatnonzero(keep)
    return out[at], np.concatenate([[0], np.searchsorted(at, ends) + 1])[:-1], at


def gram_hashes(code: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position (those that run over the end are left out)."""
    size = max(0, len(code) - q + 1)
    h = np.zeros(size, np.uint64)
    for k in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += code[k : k + size]
    return h * np.uint64(0xD6E8FEB86659FD93)


def _within(points: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which points lie in one of these spans (begin, end)."""
    begins, ends = (np.array(x) for x in zip(*sorted(set(spans)), strict=True))
    at = np.searchsorted(begins, points, "right") - 1
    return (at >= 0) & (points < np.maximum.accumulate(ends)[np.maximum(at, 0)])


class Index:
    """Windows and q-grams of a block of items."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], q: int = Q, window: int = WINDOW, stride: int = STRIDE, rate: float = RATE, passage: int = PASSAGE):
        self.q, self.ids = q, [i for i, _ in items]
        code, starts, _ = fold([t or "" for _, t in items])
        ends = np.append(starts[1:], len(code))[: len(starts)] - 1
        self.code = code
        windows, gram_at, gram_item = [], [], []
        self.first, self.sizes = np.zeros(len(items), np.int64), np.zeros((2, len(items)), np.int64)
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            while a < b and code[a] == SPACE:
                a += 1
            while a < b and code[b - 1] == SPACE:
                b -= 1
            n = b - a
            if n < q:
                continue
            gram_at.append(np.arange(a, b - q + 1))
            gram_item.append(np.full(n - q + 1, k))
            size = min(n, window)
            self.first[k] = a
            for kind, size, e in ((0, size, min(int(rate * size), (size - q) // q)), (1, passage, max(0, min(int(rate * passage), (passage - 2 * q) // q)))):
                if kind == 0 or q <= size < min(n, window):
                    self.sizes[kind, k] = size
                    at = np.unique(np.append(np.arange(a, b - size + 1, stride), b - size))
                    coarse = ((at - a) % max(stride, COARSE) == 0) | (at == b - size)
                    windows.append(np.stack([np.full(len(at), k), at, np.full(len(at), size), np.full(len(at), e), np.full(len(at), kind), coarse], 1))
        self.windows = np.concatenate(windows).astype(np.int64) if windows else np.zeros((0, 6), np.int64)
        numbers = [[np.flatnonzero((self.windows[:, 4] == kind) & (self.windows[:, 5] >= coarse)) for kind in (0, 1)] for coarse in (0, 1)]
        self.sets = [[(w, self.windows[w, 1]) for w in kinds] for kinds in numbers]  # of all and of coarse ones, by kind, in order of their starts
        gram_at = np.concatenate(gram_at) if gram_at else np.zeros(0, np.int64)
        self.most_edits = int(self.windows[:, 3].max(initial=0))
        self.width = 2 * self.most_edits + 1
        self.least = int((self.windows[:, 2] - q + 1 - q * self.windows[:, 3]).min(initial=1 << 30))
        hashes = gram_hashes(code, q)[gram_at] if len(gram_at) else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], gram_at[order]
        self.item = (np.concatenate(gram_item) if gram_item else gram_at)[order]
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self.hashes >> np.uint64(64 - self.BITS)] = True

    def places(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of q-grams that items hold, and where in self.at those of each begin and end."""
        h = gram_hashes(code, self.q)
        pos = np.flatnonzero(self.seen[h >> np.uint64(64 - self.BITS)])
        a = np.searchsorted(self.hashes, h[pos], "left")
        b = np.searchsorted(self.hashes, h[pos], "right")
        return pos[b > a], a[b > a], b[b > a]

    def exact(self, code: np.ndarray) -> dict[int, list[int]]:
        """By item: starts of unedited windows in these texts (of all texts that hold a run of one character, these are very many)."""
        found: dict[int, set] = {}
        for size in np.unique(self.windows[:, 2]).tolist():
            mine = self.windows[self.windows[:, 2] == size]
            of_items, of_texts = gram_hashes(self.code, size)[mine[:, 1]], gram_hashes(code, size)
            pairs = np.unique(np.stack([of_items, mine[:, 0].astype(np.uint64)], 1), axis=0)
            pos = np.flatnonzero(np.isin(of_texts, pairs[:, 0]))
            a, b = (np.searchsorted(pairs[:, 0], of_texts[pos], side) for side in ("left", "right"))
            place = np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
            for item in np.unique(pairs[place, 1]).tolist():
                found.setdefault(int(item), set()).update((p, size) for p in np.repeat(pos, b - a)[pairs[place, 1] == item].tolist())
        return {item: sorted(x) for item, x in found.items()}

    def banded(self, code: np.ndarray, starts: np.ndarray, places: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text position, number in self.at, band, text) of shared q-grams, for bands in which an item and a text share enough; band k starts at diagonal k * width."""
        pos, a, b = places
        pos, gram = np.repeat(pos, b - a), np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        doc = np.searchsorted(starts, pos, "right") - 1
        diagonal = pos - self.at[gram] + len(self.code)  # never negative
        band = diagonal // self.width
        span = (len(code) + len(self.code)) // self.width + 2
        # bands k and k - 1 both reach over two widths
        twice = np.concatenate([band, band - (band > 0)])
        keys = (np.tile(self.item[gram] * len(starts) + doc, 2)) * span + twice
        order = np.argsort(keys, kind="stable")
        cut = np.flatnonzero(np.diff(keys[order], prepend=-1))
        count = np.diff(np.append(cut, len(keys)))
        left = order[np.repeat(count >= self.least, count)]
        one = left % max(1, len(pos))
        return pos[one], gram[one], twice[left], doc[one]

    def candidates(self, gram: np.ndarray, band: np.ndarray, doc: np.ndarray, coarse: int) -> np.ndarray:
        """Rows (window, band, text) for which enough of these q-grams lie in one band."""
        item, at = self.item[gram], self.at[gram]
        out = []
        for kind, (number, start) in enumerate(self.sets[coarse]):
            size = self.sizes[kind, item]
            low = np.searchsorted(start, np.maximum(at + self.q - size, self.first[item]), "left")
            n = np.where(size > 0, np.maximum(np.searchsorted(start, at, "right") - low, 0), 0)
            window = number[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            place = band * (int(doc.max(initial=0)) + 1) + doc
            places, place = np.unique(place, return_inverse=True)
            keys, count = np.unique(window * max(1, len(places)) + np.repeat(place, n), return_counts=True)
            window, place = keys // max(1, len(places)), places[keys % max(1, len(places))] if len(keys) else keys
            w = self.windows[window]
            ok = count >= w[:, 2] - self.q + 1 - self.q * w[:, 3]
            docs = int(doc.max(initial=0)) + 1
            out.append(np.stack([window[ok], place[ok] // docs, place[ok] % docs], 1))
        return np.concatenate(out)

    def plausible(self, code: np.ndarray, starts: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Those of these (window, band, text) whose whole PART-character parts do not by themselves need more edits than the budget.

        Each part is aligned once for all windows that hold it, in the same band cells: a lower bound.
        """
        if not len(found):
            return found
        _, place = np.unique(found[:, 1] * len(starts) + found[:, 2], return_inverse=True)
        w = self.windows[found[:, 0]]
        begin, end = -(-w[:, 1] // PART), (w[:, 1] + w[:, 2]) // PART
        n = np.maximum(end - begin, 0)
        row = np.repeat(np.arange(len(found)), n)
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        _, one, back = np.unique(place[row] * (len(self.code) // PART + 1) + part, return_index=True, return_inverse=True)
        edits, _ = self.align(code, starts, part[one] * PART, np.full(len(one), PART), found[row[one], 1], found[row[one], 2])
        return found[np.bincount(row, edits[back], len(found)) <= w[:, 3]]

    def verify(self, code: np.ndarray, starts: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of these (window, band, text): the fewest edits of the window against a substring of the text, and where that ends."""
        w = self.windows[found[:, 0]]
        return self.align(code, starts, w[:, 1], w[:, 2], found[:, 1], found[:, 2])

    def align(self, code: np.ndarray, starts: np.ndarray, begin: np.ndarray, length: np.ndarray, band: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The fewest edits of these stretches of the items against substrings of these texts in these bands, and where they end."""
        stops = np.append(starts[1:], len(code))
        edits, ends = np.full(len(begin), 1 << 20), np.zeros(len(begin), np.int64)
        e = self.most_edits
        breadth = 2 * self.width + 2 * e
        for a in range(0, len(begin), 20_000):
            part = slice(a, a + 20_000)
            start, size = begin[part], length[part]
            low = start + band[part] * self.width - len(self.code) - e  # text position of band cell 0 before the first character
            cells = np.arange(breadth)
            cost = np.zeros((len(start), breadth + 1), np.int32)
            cost[:, -1] = 1 << 20
            for i in range(int(size.max(initial=0))):
                going = i < size
                at = low[:, None] + i + cells
                ok = (at >= starts[doc[part], None]) & (at < stops[doc[part], None])
                char = np.where(ok, code[np.clip(at, 0, len(code) - 1)], STOP)
                want = self.code[np.minimum(start + i, len(self.code) - 1)]
                differ = (char != want[:, None]) + (char == STOP) * (1 << 16)
                new = np.minimum(cost[:, :-1] + differ, cost[:, 1:] + 1)
                step = cells + (np.cumsum(char == STOP, 1) << 16)  # a gap never runs over the end of a text
                new = np.minimum.accumulate(new - step, 1) + step
                cost[:, :-1] = np.where(going[:, None], np.minimum(new, 1 << 20), cost[:, :-1])
            best = cost[:, :-1].argmin(1)
            edits[part] = cost[np.arange(len(start)), best]
            ends[part] = low + size + best
        return edits, ends

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, start, end, edits) of each matching window, positions in code points of the text.

        At most about HITS shared q-grams are looked at together: texts that repeat
        what items repeat are first rid of the unedited windows that they hold, then
        cut into stretches that overlap by more than a window.
        """
        if not len(self.windows) or not texts:
            return []
        code, starts, at = fold(texts)
        first, out = at[starts], set()
        places = pos, a, b = self.places(code)
        if (b - a).sum() <= HITS:
            return sorted(self._search(code, starts, at, first, np.arange(len(texts)), places))
        for item, found in self.exact(code).items():
            told = -1
            for p, size in found:
                if p >= told:  # spans that do not overlap
                    k, told = int(np.searchsorted(starts, p, "right")) - 1, p + size
                    out.add((k, item, int(at[p] - first[k]), int(at[told - 1] - first[k]) + 1, 0))
            open_ = ~((self.item[a] == item) & (self.item[b - 1] == item) & _within(pos, [(p, p + size) for p, size in found]))
            pos, a, b = pos[open_], a[open_], b[open_]
        # stretches of texts, and groups of them
        reach = 2 * (int(self.windows[:, 2].max()) + self.most_edits + self.q)
        stops, groups, total = np.append(starts[1:], len(code)), [[]], 0
        load = np.concatenate([[0], np.cumsum(np.bincount(pos, b - a, len(code)).astype(np.int64))])
        for k, (x, stop) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            while True:
                y = min(stop, max(x + 2 * reach, int(np.searchsorted(load, load[x] + HITS, "right")) - 1))
                more = int(load[y] - load[x])
                if total + more > HITS and groups[-1]:
                    groups.append([])
                    total = 0
                groups[-1].append((k, x, y))
                total += more
                if y == stop:
                    break
                x = y - reach
        for group in groups:
            part = np.concatenate([code[x:y] if code[y - 1] == STOP else np.append(code[x:y], STOP) for _, x, y in group]).astype(code.dtype)
            places_of = np.concatenate([at[x:y] if code[y - 1] == STOP else np.append(at[x:y], at[y - 1] + 1) for _, x, y in group])
            sizes = np.array([y - x + int(code[y - 1] != STOP) for _, x, y in group])
            begin = np.cumsum(sizes) - sizes
            mine = [np.flatnonzero((pos >= x) & (pos < y - self.q + 1)) for _, x, y in group]
            shifted = np.concatenate([pos[m] - x + s for m, (_, x, _), s in zip(mine, group, begin, strict=True)])
            mine = np.concatenate(mine)
            number = np.array([k for k, _, _ in group])
            out |= self._search(part, begin, places_of, first[number], number, (shifted, a[mine], b[mine]))
        return sorted(out)

    def _search(self, code: np.ndarray, starts: np.ndarray, at: np.ndarray, first: np.ndarray, number: np.ndarray, places: tuple) -> set:
        """search() of folded texts with these numbers, of which places() told the shared q-grams."""
        out = set()
        pos, gram, band, doc = self.banded(code, starts, places)
        for coarse in (1, 0):
            found = self.plausible(code, starts, self.candidates(gram, band, doc, coarse))
            edits, ends = self.verify(code, starts, found)
            ok = edits <= self.windows[found[:, 0], 3]
            told: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for (window, _, k), e, end in zip(found[ok].tolist(), edits[ok].tolist(), ends[ok].tolist(), strict=True):
                item, _, size = self.windows[window, :3].tolist()
                last = max(0, end - 1)
                begin = max(int(starts[k]), last + 1 - size)
                told.setdefault((k, item), []).append((begin, last + 1))
                out.add((int(number[k]), item, int(at[begin] - first[k]), int(at[last] - first[k]) + 1, e))
            if coarse and told:
                item = self.item[gram]
                pair = doc * len(self.ids) + item
                open_ = np.ones(len(pos), bool)
                for (k, i), spans in told.items():
                    mine = np.flatnonzero(pair == k * len(self.ids) + i)
                    open_[mine[_within(pos[mine], spans)]] = False
                pos, gram, band, doc = pos[open_], gram[open_], band[open_], doc[open_]
        return out


SCHEMA = "doc_id long, contaminated boolean, item_ids array<long>, spans array<struct<item_id:long,start:int,end:int,edits:int>>"


def _searcher(index):
    def run(batches):
        claim("decontaminate")
        ix = index.value
        for batch in pieces(batches, 2_000_000):
            found: dict[int, list] = {}
            for doc, item, start, end, edits in ix.search([t or "" for t in batch.column("text").to_pylist()]):
                found.setdefault(doc, []).append({"item_id": ix.ids[item], "start": start, "end": end, "edits": edits})
            rows = [found.get(k, []) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([bool(r) for r in rows]),
                    pa.array([sorted({s["item_id"] for s in r if s["item_id"] is not None}) for r in rows], pa.list_(pa.int64())),
                    pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))),
                ],
                ["doc_id", "contaminated", "item_ids", "spans"],
            )

    return run


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of about BLOCK_CHARS characters."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    n = -(-total // BLOCK_CHARS) or 1
    return [items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]


def _index(part: DataFrame, options: dict):
    """A block of items, indexed on the driver: its size is bounded."""
    rows = part.orderBy("item_id", "text").collect()
    return part.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in rows], **options))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, item_ids and spans, one row for each row of docs.

    With several blocks rows are numbered and written once, each block's hits are
    written by these numbers, and its index is let go before the next one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = blocks(benchmark)
    if len(parts) == 1:
        return rows.mapInArrow(_searcher(_index(parts[0], options)), SCHEMA)
    scratch = Scratch(docs.sparkSession, "benchmark")
    rows = scratch.write("rows", rows.withColumn("row", F.monotonically_increasing_id()))
    found = []
    for k, part in enumerate(parts):
        index = _index(part, options)
        hits = rows.select(F.col("row").alias("doc_id"), "text").mapInArrow(_searcher(index), SCHEMA)
        found.append(scratch.write(f"hits-{k}", hits.where("contaminated").select(F.col("doc_id").alias("_row"), "item_ids", "spans")))
        index.unpersist()
    hits = reduce(DataFrame.unionAll, found)
    hits = hits.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    joined = rows.select("row", "doc_id").join(hits, F.col("row") == F.col("_row"), "left")
    none = F.array().cast("array<long>")
    return joined.select("doc_id", F.col("_row").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("spans", F.array().cast(hits.schema["spans"].dataType)).alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated; with several blocks of the benchmark, what one leaves is written for the next."""

    def keeper(index):
        def run(batches):
            claim("decontaminate")
            for batch in pieces(batches, 2_000_000):
                hit = {k for k, *_ in index.value.search([t or "" for t in batch.column("text").to_pylist()])}
                yield batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))

        return run

    small_batches(docs.sparkSession)
    scratch, parts = Scratch(docs.sparkSession, "clean"), blocks(benchmark)
    for k, part in enumerate(parts):
        index = _index(part, options)
        docs = docs.mapInArrow(keeper(index), docs.schema)
        if k < len(parts) - 1:
            docs = scratch.write(f"rest-{k}", docs)
            scratch.drop(f"rest-{k - 1}")
            index.unpersist()
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
