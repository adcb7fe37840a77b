"""Distinct chunks of texts, and a bounded memo of what a tokenizer makes of each."""

from __future__ import annotations

import ctypes
import gc
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: str.split() also cuts at these four, which tokenizers do not count as blanks.
_NOT_BLANK = re.compile("[\x1c-\x1f]")
_CHUNK = re.compile("[^ \t\n\r]+")
#: Longer chunks are encoded each time: keeping them would cost memory and save little.
_LONG = 64


def chunks(text: str) -> list[str]:
    """The blank-free chunks of a text, in order."""
    return _CHUNK.findall(text) if _NOT_BLANK.search(text) else text.split()


_OWNER: list = [None, None]


def claim(name: str, drop=None) -> None:
    """Say whose tables this worker keeps from now on; those of the one before are dropped.

    Python workers outlive tasks and serve one operator after another, so what
    one of them keeps would otherwise stay beside what the next one needs.
    """
    if _OWNER[0] not in (None, name):
        if _OWNER[1] is not None:
            _OWNER[1]()
        gc.collect()
        trim()
    _OWNER[:] = name, drop


def numbered(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the lists of strings of each text: the number of each non-empty string, how many a text has, and the distinct strings."""
    coded = parts.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    ends = parts.offsets.to_numpy()
    ends = ends - ends[0]
    none = pc.index(distinct, "").as_py()
    if none >= 0:
        full = codes != none
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        codes = codes[full]
    return codes, np.diff(ends).astype(np.int64), distinct


def distinct_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """numbered() for the blank-free chunks of texts; a null text has none."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
        return numbered(pa.array([chunks(t) for t in texts.to_pylist()], pa.list_(pa.string())))
    return numbered(pc.utf8_split_whitespace(texts))


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at starts, one after the other."""
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


_POWERS = [np.cumprod(np.full(_LONG + 1, m, np.uint64)) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string of up to _LONG bytes, and the lengths of all."""
    if isinstance(words, pa.LargeStringArray):
        words = words.cast(pa.string())
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, "<i4", len(words) + 1, words.offset * 4).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1) if data else np.zeros(0, np.uint64)
    ends -= ends[0]
    sizes = np.diff(ends)
    place = np.minimum(np.arange(len(data)) - np.repeat(ends[:-1], sizes), _LONG)
    out = []
    for p in _POWERS:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * p[place], dtype=np.uint64)])
        h = (total[ends[1:]] - total[ends[:-1]]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    return *out, sizes


class Numbers:
    """Numbers strings as they are first seen, up to a bound; strings are told apart by 126 bits of hashes, not kept."""

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.reset()

    def reset(self):
        self.count = 0
        self.first, self.second, self.number = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def full(self, more: int) -> bool:
        return self.count + more > (2 << self.bits) // 3

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of distinct strings, and where those are that were not known before, in the order of their numbers.

        Long strings are not kept, nor more than there is room for: they come last among the new, with numbers that the next call gives away again.
        """
        a, b, sizes = _hashes(words)
        out, fresh = np.empty(len(words), np.int64), []
        kept = sizes <= _LONG
        if self.full(len(words)):  # one text can hold more than all slots, which would leave none free to end the search
            kept &= np.cumsum(kept) <= (2 << self.bits) // 3 - self.count
        todo = np.flatnonzero(kept)
        slot, mask = (a[todo] >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(todo):
            at = self.first[slot]
            hit = (at == a[todo]) & (self.second[slot] == b[todo])
            out[todo[hit]] = self.number[slot[hit]]
            free = at == 0
            t, s = todo[free], slot[free]
            self.number[s] = t  # of several strings that find one free slot, the last one gets it
            won = self.number[s] == t
            t, s = t[won], s[won]
            self.first[s], self.second[s] = a[t], b[t]
            out[t] = self.number[s] = np.arange(self.count, self.count + len(t))
            self.count += len(t)
            fresh.append(t)
            left = ~hit
            left[np.flatnonzero(free)[won]] = False
            todo, slot = todo[left], (slot[left] + 1) & mask
        rest = np.flatnonzero(~kept)
        out[rest] = np.arange(self.count, self.count + len(rest))
        return out, np.concatenate([*fresh, rest]).astype(np.int64)


class RowMemo:
    """Rows of arrays for strings; make maps a list of strings to arrays with a row for each."""

    def __init__(self, make, bits: int = 20):
        self.make, self.numbers, self.arrays = make, Numbers(bits), None

    def rows(self, distinct: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """The row of each of these distinct strings, and the arrays."""
        if self.numbers.full(len(distinct)):
            self.numbers.reset()
            self.arrays = None
        at, new = self.numbers.look(distinct)
        arrays = self.arrays
        if len(new) or arrays is None:
            more = self.make(distinct.take(pa.array(new)).to_pylist())
            arrays = list(more) if arrays is None else [np.concatenate(x) for x in zip(arrays, more, strict=True)]
            self.arrays = [x[: self.numbers.count] for x in arrays]
        return at, arrays


_LIBC: list = []


def trim() -> None:
    """Give freed memory back to the system: a worker waits for its next task with what it really holds."""
    if not _LIBC:
        try:
            _LIBC.append(ctypes.CDLL(None).malloc_trim)
        except (AttributeError, OSError):  # another C library
            _LIBC.append(lambda _: None)
    pa.default_memory_pool().release_unused()
    _LIBC[0](0)


class ChunkMemo:
    """Ids of strings as 32-bit integers; encode maps a list of strings to their ids, one after the other, and how many each has."""

    def __init__(self, encode, bits: int = 20):
        self.encode, self.numbers = encode, Numbers(bits)
        self.reset()

    def reset(self):
        self.numbers.reset()
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def ids(self, codes: np.ndarray, sizes: np.ndarray, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts whose strings these are, and where each text starts (and the last ends)."""
        if self.numbers.full(len(distinct)):
            self.reset()
        at, new = self.numbers.look(distinct)
        flat, starts, lengths = self.flat, self.starts, self.sizes
        if len(new):
            more, n = self.encode(distinct.take(pa.array(new)).to_pylist())
            ends = np.cumsum(n, dtype=np.int64) + len(flat)
            flat, starts, lengths = np.concatenate([flat, more]), np.concatenate([starts, ends - n]), np.concatenate([lengths, n.astype(np.int32)])
            kept = self.numbers.count
            self.flat, self.starts, self.sizes = flat[: starts[kept] if kept < len(starts) else len(flat)], starts[:kept], lengths[:kept]
        at = at[codes]
        n = lengths[at]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return gather(flat, starts[at], n), ends[np.concatenate([[0], np.cumsum(sizes)])]


def pieces(batches, limit: int = 1_500_000):
    """Slices of Arrow batches whose texts hold about `limit` bytes at most (or one row); memory is trimmed now and then, and after the last."""
    done = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end
            done += 1
            if done % 4 == 0:
                trim()
    trim()
