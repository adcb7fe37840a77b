"""SentencePiece encoding and decoding by a Viterbi pass shared between prefixes.

Distinct marked words (a blank becomes U+2581 at the front of the word after it)
are sorted, which lays their trie out depth-first: a word starts from the forward
scores of the prefix it has in common with the word before it, and only the rest
of its positions are computed. Two kinds of model are covered:

* unigram: every piece is an edge, and the forward score of a position is the best
  sum of piece scores;
* BPE: an edge is allowed only after a piece beside which it would stay unmerged.
  A sequence is what merging gives exactly if each two neighbours are such a
  pair, so one path is left at each position, and the ids equal the library's.

The trie of pieces is walked along the word (with a step to the longest end that
begins a piece where it has no child), so a position looks only at pieces that
end there.

Both hold for every prefix on its own, which is what makes sharing exact.
Characters outside the vocabulary become byte pieces, or the unknown id.

A null or empty text has no ids. U+2581 in a text decodes as a blank; any other
text decodes to itself. Rows are treated one by one, so repeats, nulls in other
columns and further columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.common import documents, small_batches
from siltlog.llm.words import ChunkMemo, claim, numbered
from siltlog.llm.words import pieces as slices

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
_SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")


class PieceModel:
    """Encoder and decoder for a SentencePiece model file without normalizing rules."""

    def __init__(self, data: bytes, most: int = 250_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("the model has normalizing rules that are not covered")
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is not covered")
        self.names: list[str] = [p.piece for p in proto.pieces]  # characters outside the vocabulary come after, as they are met
        kinds, self.value = [p.type for p in proto.pieces], [p.score for p in proto.pieces]
        del proto
        self.ids = {p: i for i, (p, kind) in enumerate(zip(self.names, kinds, strict=True)) if kind in (NORMAL, USER)}
        if any(MARK in p.lstrip(MARK) or "\n" in p and len(p) > 1 for p in self.ids):
            raise ValueError("pieces that cross blanks are not covered")
        self.scores = {p: self.value[i] for p, i in self.ids.items()}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(self.names, kinds, strict=True)) if kind == BYTE}
        self.lowest = min(self.scores.values()) - 10
        self.table = [p.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b"" for p, kind in zip(self.names, kinds, strict=True)]
        for b, i in self.bytes.items():
            self.table[i] = bytes([b])
        self.table[self.unknown] = " ⁇ ".encode()
        self.blob = pa.array(self.table, pa.binary())
        self.most = most
        self.size = len(self.names)
        self.lengths = list(map(len, self.names))
        self.outside: dict[str, int] = {}
        self.beside: dict[int, bool] = {}
        self.edges = dict(self.ids)
        if self.kind == BPE:  # pieces that merging never arrives at make no edges
            self.edges = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}
        self.states = {p[:k]: -1 for p in self.edges for k in range(len(p) + 1)} | {"": 0}
        self.alphabet = {c for p in self.edges for c in p}
        self.texts, self.steps, self.ends = [""], [{}], [()]
        self.memo = ChunkMemo(self._encode_words, bits=19)

    def merge(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, leftmost first among equals, until none is a piece."""
        parts, scores, none = list(text), self.scores, float("-inf")
        pairs = [scores.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) != none:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = scores.get(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = scores.get(parts[at] + parts[at + 1], none)
        return parts

    def stays(self, left: int, right: int) -> bool:
        """Whether merging leaves these two pieces as they are, side by side."""
        if len(self.beside) > self.most:
            self.beside.clear()
        a, b = self.names[left], self.names[right]
        found = self.beside[left << 24 | right] = self.merge(a + b) == [a, b]
        return found

    def _step(self, state: int, char: str) -> int:
        """The state after one more character: the longest end of the text so far that begins a piece."""
        if char not in self.alphabet:
            return 0
        text = self.texts[state] + char
        while text not in self.states:
            text = text[1:]
        found = self.states[text]
        if found < 0:
            found = self.states[text] = len(self.texts)
            self.texts.append(text)
            self.steps.append({})
            self.ends.append(tuple((self.edges[text[k:]], len(text) - k) for k in range(len(text)) if text[k:] in self.edges))
        self.steps[state][char] = found
        return found

    def _outside(self, char: str) -> int:
        if char not in self.outside:
            self.outside[char] = len(self.names)
            self.names.append(char)
            self.lengths.append(1)
            self.value.append(self.lowest)
        return self.outside[char]

    def _forward(self, word: str, start: int, states: list, best: list, last: list) -> None:
        """Forward scores and last pieces of the positions of a word from start on."""
        steps, ends, value, beside, merging = self.steps, self.ends, self.value, self.beside, self.kind == BPE
        state = states[start - 1]
        for i in range(start, len(word) + 1):
            char = word[i - 1]
            state = steps[state].get(char) or self._step(state, char)
            piece = -1
            for p, n in ends[state]:
                before = last[i - n]
                if merging and before >= 0:
                    ok = beside.get(before << 24 | p)
                    if not (self.stays(before, p) if ok is None else ok):
                        continue
                score = best[i - n] + value[p]
                if piece < 0 or score > top:
                    top, piece = score, p
                if merging:  # no other edge can be allowed
                    break
            if piece < 0:
                piece = self._outside(char)
                top = best[i - 1] + self.lowest
            states.append(state)
            best.append(top)
            last.append(piece)

    def segment(self, words: list[str]):
        """The piece numbers of each of these sorted, distinct words."""
        states, best, last, before, lengths = [0], [0.0], [-1], "", self.lengths
        for word in words:
            n, most = 0, min(len(word), len(before))
            while n < most and word[n] == before[n]:
                n += 1
            del states[n + 1 :], best[n + 1 :], last[n + 1 :]
            self._forward(word, n + 1, states, best, last)
            before, i, out = word, len(word), []
            while i:
                p = last[i]
                out.append(p)
                i -= lengths[p]
            out.reverse()
            yield out

    def numbers(self, parts: list[int]) -> list[int]:
        """Ids of pieces: those of the vocabulary are their own, others become bytes, or a run of them the unknown id."""
        out = []
        for k, p in enumerate(parts):
            if p < self.size:
                out.append(p)
            elif self.bytes:
                out += [self.bytes[b] for b in self.names[p].encode()]
            elif not (k and parts[k - 1] >= self.size):
                out.append(self.unknown)
        return out

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(len(words)), key=words.__getitem__)
        found: list = [None] * len(words)
        for k, parts in zip(order, self.segment([words[k] for k in order]), strict=True):
            found[k] = parts if not self.outside or max(parts) < self.size else self.numbers(parts)
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts without nulls, and where each text starts (and the last ends)."""
        return self.memo.ids(*_marked_words(texts))

    def encode(self, text: str) -> list[int]:
        return self.encode_texts(pa.array([text]))[0].tolist()

    def decode_texts(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes | memoryview]:
        """UTF-8 of the texts of ids that start, and end, at these places."""
        joined = self.blob.take(pa.array(ids))
        _, at, data = joined.buffers()
        at = np.frombuffer(at, "<i4", len(ids) + 1, 0)[ends].tolist() if len(ids) else [0] * len(ends)
        data, out = memoryview(data or b""), []
        for a, b in zip(at[:-1], at[1:], strict=True):
            out.append(data[a + 1 : b] if data[a : a + 1] == b" " else data[a:b])
        return out

    def decode(self, ids) -> str:
        table = self.table
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(2)
def load(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def _marked_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """numbered() for the marked words of texts: a word with the marks before it, a line end, or marks with no word after."""
    odd = pc.match_substring_regex(texts, f"  |^ |{MARK}").to_numpy(zero_copy_only=False)
    cut = next(c for c in map(chr, range(0x110000)) if c not in f"\n{MARK}" and not pc.any(pc.match_substring(texts, c)).as_py())
    marked = pc.replace_substring(texts, " ", cut + MARK)
    marked = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", MARK), marked, "")
    marked = pc.replace_substring(marked, "\n", f"{cut}\n{cut}")
    if odd.any():
        own = [cut.join(_SEGMENT.findall(MARK + t.replace(" ", MARK))) for t in texts.filter(pa.array(odd)).to_pylist()]
        marked = pc.replace_with_mask(marked, pa.array(odd), pa.array(own, marked.type))
    return numbered(pc.split_pattern(marked, cut))


def _encoder(path: str):
    def run(batches):
        claim("pieces", load.cache_clear)
        model = load(path)
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            flat, ends = model.encode_texts(texts)
            raw = [x.as_buffer() for x in texts.cast(pa.binary())]
            decoded = model.decode_texts(flat, ends)
            same = [d == memoryview(r) for d, r in zip(decoded, raw, strict=True)]
            decoded = [d if s else bytes(d).decode("utf-8", "replace").encode() for d, s in zip(decoded, same, strict=True)]
            data, at = memoryview(flat.astype("<u4")).cast("B"), (4 * ends).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view("<i4"))),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                    pa.array(same, pa.bool_()),
                ],
                ["doc_id", "ids", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return run


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32, decoded_sha256 (of the decoded text), round_trip."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encoder(model_path), schema)


def _decoder(path: str):
    def run(batches):
        model = load(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if i is None else model.decode(i) for i in ids], pa.string())], ["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(_decoder(model_path), "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
