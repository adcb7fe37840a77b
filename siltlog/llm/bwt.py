"""Burrows-Wheeler transforms of byte-string collections, and their merging.

Strings are joined, each followed by END, and taken as one cyclic text. Shards
are sorted on their own; merging never sorts suffixes again: the interleave of
the shards' rows is refined round by round. After round k it is the order by the
first k bytes, and rows that agree in them form one block. Blocks only ever split,
so the round in which one begins is the common prefix with the row before, and
the intervals of rows between shorter common prefixes are the repeated strings.
"""

from __future__ import annotations

import numpy as np

#: A byte that no UTF-8 text holds.
END = 0xFF


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the rotations of a cyclic byte text that is no repetition, by prefix doubling."""
    n = len(text)
    wide = np.concatenate([text, np.resize(text, 8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k : k + n]
    depth = 8
    while True:
        order = np.argsort(key)
        new = np.zeros(n, np.int64)
        ordered = key[order]
        new[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1 or depth >= 2 * n:
            return order
        key = (rank.astype(np.uint64) << np.uint64(32)) | np.roll(rank, -depth).astype(np.uint64)
        depth *= 2


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Burrows-Wheeler transform, suffix array) of a cyclic byte text."""
    order = suffix_array(text)
    return text[order - 1], order


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shard transforms up to `depth` bytes of context.

    Returns the row of the joined transforms that stands at each place, and the
    common prefix of that row and the one before it (0 for the first), up to
    `depth`: the round in which a block begins tells where its prefix ends.
    """
    chars, n = np.concatenate(transforms), sum(map(len, transforms))
    before = np.empty(n, np.int32)  # the row, in its shard, of the rotation that begins one byte earlier
    base = 0
    for t in transforms:
        before[base + np.argsort(t, kind="stable")] = np.arange(base, base + len(t), dtype=np.int32)
        base += len(t)
    block, rows = np.zeros(n, np.int32), np.arange(n, dtype=np.int32)
    common = np.full(n, depth, np.int32)
    common[:1] = 0
    for k in range(depth):
        here = chars[rows]
        order = np.argsort(here, kind="stable")
        here, block, rows = here[order], block[order], before[rows[order]]
        begins = np.ones(n, bool)
        begins[1:] = (here[1:] != here[:-1]) | (block[1:] != block[:-1])
        common[begins & (common > k)] = k
        block = np.cumsum(begins, dtype=np.int32)
        if begins.all():
            break
    return rows, common
