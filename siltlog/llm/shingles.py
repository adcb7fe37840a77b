"""Sets of hashed word shingles and their MinHash signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from siltlog.llm.words import numbered

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """Distinct hashes of runs of `size` words.

    Words are runs of characters other than blank and U+0009 to U+000D, with
    A-Z lower-cased. Fewer words than `size` make one shingle; no words, none.
    """

    def __init__(self, size: int):
        self.size = size

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """Sorted hashes of the shingles of each text; a null text has none."""
        codes, sizes, distinct = numbered(pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
        digest = xxhash.xxh3_64_intdigest
        h = np.array([digest(w) for w in distinct.cast(pa.binary()).to_pylist()], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
        ends, out = np.concatenate([[0], np.cumsum(sizes)]).tolist(), []
        runs = self._mix([h[k : len(h) - self.size + 1 + k] for k in range(self.size)]) if len(h) >= self.size else h[:0]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a >= self.size:
                s = np.sort(runs[a : b - self.size + 1])
                out.append(s[np.append(True, s[1:] != s[:-1])])
            else:
                out.append(self._mix([h[k : k + 1] for k in range(a, b)]) if b > a else h[:0])
        return out

    @staticmethod
    def _mix(words: list[np.ndarray]) -> np.ndarray:
        s = np.full(len(words[0]), len(words), np.uint64)
        for h in words:
            s = (s ^ h) * _A
            s ^= s >> np.uint64(32)
        return s * _B


class Signer:
    """Minima of `count` universal hash functions over a set, as 32-bit numbers."""

    def __init__(self, count: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**63, count, dtype=np.uint64)

    def sign(self, items: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.uint64(2**64 - 1))
        for at in range(0, len(items), 512):
            part = items[at : at + 512, None] * self.a
            part += self.b
            np.minimum(out, part.min(0), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray, rows: int) -> list[int]:
    """One signed 64-bit key a band of `rows` minima; the number of the band is part of it."""
    bands = signature.reshape(-1, rows)
    return [xxhash.xxh3_64_intdigest(b.tobytes(), seed=k) - (1 << 63) for k, b in enumerate(bands)]
