"""Token ids in ORC files: encode, write in id order, read back, look documents up.

Documents are ranged by doc_id, sorted within each range, encoded and written as
ORC: integer run-length encoding for the ids, row indexes, and a Bloom filter on
doc_id, so that a lookup prunes stripes by metadata and a full read takes each
stripe in its own task. Column `row` is a document's place in its file.

A null text is an empty one (just the end id). Null ids come first. Rows with
equal ids are ordered by a hash of their text; equal rows are interchangeable.
An empty table makes no rows. Further columns of the input are left out.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltlog.llm.common import documents, drop_path, parts, scratch_path, small_batches, spool, text_bytes
from siltlog.llm.words import ChunkMemo, claim, distinct_chunks, pieces

FILE_BYTES = 128 << 20  # of planned input, a file
SCHEMA = "row int, doc_id long, ids array<int>"
#: Characters for which the pattern below equals the tokenizer's own normalizing and splitting.
_OTHER = r"[^!-~À-ÖØ-öø-ÿ]|<\|"
_OTHER_OR_BLANK = r"[^ \t\n\r!-~À-ÖØ-öø-ÿ]|<\|"
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


class WordEncoder:
    """Ids of chunks by a tokenizer whose words never cross blanks.

    Chunks of plain letters, digits and signs are cut into words here and each
    word goes to the tokenizer's model once; all other chunks go through the
    whole tokenizer.
    """

    def __init__(self, path: str, most: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.plain = _is_word_bpe(json.loads(self.whole.to_str()))
        self.most, self.known = most, {}

    def lowered(self, texts: pa.Array) -> pa.Array:
        """Texts, in lower case where that changes no id: it makes fewer distinct chunks."""
        if not self.plain:
            return texts
        return pc.if_else(pc.match_substring_regex(texts, _OTHER_OR_BLANK), texts, pc.utf8_lower(texts))

    def word(self, word: str) -> list[int]:
        if len(self.known) > self.most:
            self.known.clear()
        ids = self.known[word] = _tokenize(self.whole.model, word)
        return ids

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and how many each has."""
        known, word, out, sizes, rest = self.known, self.word, [], [], []
        other = pc.match_substring_regex(pa.array(chunks, pa.string()), _OTHER).to_pylist() if self.plain else [True] * len(chunks)
        for k, chunk in enumerate(chunks):
            if other[k]:
                rest.append((k, len(out)))
                sizes.append(0)
                continue
            before = len(out)
            for w in _WORDS(chunk.lower()):
                out += known.get(w) or word(w)
            sizes.append(len(out) - before)
        flat, sizes = np.array(out, np.uint32), np.array(sizes, np.int64)
        if not rest:
            return flat, sizes
        # the rest goes in between
        found = self.whole.encode_batch_fast([chunks[k] for k, _ in rest], add_special_tokens=False)
        parts, before = [], 0
        for (k, at), e in zip(rest, found, strict=True):
            parts += [flat[before:at], np.array(e.ids, np.uint32)]
            before, sizes[k] = at, len(e.ids)
        return np.concatenate([*parts, flat[before:]]), sizes


#: Byte-level BPE writes a byte as a printable character: itself, or the next one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict.fromkeys(_PRINTABLE) | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_BYTES = {b: chr(b if c is None else c) for b, c in _BYTES.items()}


def _tokenize(model, word: str) -> list[int]:
    if not word.isascii():
        word = "".join([_BYTES[b] for b in word.encode()])
    return [t.id for t in model.tokenize(word)]


def _is_word_bpe(spec: dict) -> bool:
    """Whether the tokenizer's description says: compose, one blank for blanks, lower case; cut by the words pattern; byte-level BPE."""
    steps = [(x["type"], x.get("pattern", {}).get("Regex"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space")) for k in ("normalizer", "pre_tokenizer") for x in ((spec[k] or {}).get(f"{k}s") or (spec[k] or {}).get("pretokenizers") or [])]
    want = [("NFC", None, None, None, None), ("Replace", r"\s+", None, None, None), ("Lowercase", None, None, None, None), ("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "Removed", True, None), ("ByteLevel", None, None, None, False)]
    special = all(t["special"] and t["content"].startswith("<|") for t in spec["added_tokens"])
    return steps == want and special and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]


@lru_cache(2)
def _memo(path: str) -> ChunkMemo:
    return ChunkMemo(WordEncoder(path))


def _encoder(path: str, end_id: int):
    def run(batches):
        claim("tokens", _memo.cache_clear)
        memo, row = _memo(path), 0
        for batch in pieces(batches):
            codes, sizes, distinct = distinct_chunks(memo.encode.lowered(pc.fill_null(batch.column("text"), "")))
            flat, offsets = memo.ids(codes, sizes, distinct)
            ids = np.insert(flat, offsets[1:], np.uint32(end_id))
            offsets = (offsets + np.arange(len(offsets))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows, dtype=np.int32)), batch.column("doc_id"), lists], ["row", "doc_id", "ids"])
            row += batch.num_rows

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, stripe_bytes: int = 16 << 20) -> None:
    """Encode docs(doc_id, text) and write their ids under path, in ascending doc_id order over the files."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("_h"))
    n_files = max(parts(spark), -(-text_bytes(texts) // FILE_BYTES))
    ranged = (
        texts.repartitionByRange(n_files, "doc_id", "_h")
        .sortWithinPartitions("doc_id", "_h")
    )
    (
        ranged.select("doc_id", "text")
        .mapInArrow(_encoder(tokenizer_path, end_id), SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", 1000)
        .option("compression", "lz4")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """row, doc_id, ids and the file a document lies in; the part numbers of files ascend as ids do."""
    return spark.read.schema(SCHEMA).orc(path).select("row", "doc_id", "ids", F.col("_metadata.file_name").alias("file"))


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The ids of one document; stripes are skipped by their statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id") == doc_id).select("doc_id", "ids")


def _checksums(batches):
    for batch in batches:
        lists = batch.column("ids")
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("row"), batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
            ["file", "row", "doc_id", "n_tokens", "ids_crc32"],
        )


def part_number(file: Column) -> Column:
    """The number in the name of a part file; names alone do not sort by it from 100,000 files on."""
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("long")


def layout(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens() returns."""
    rows = spool(tokens.mapInArrow(_checksums, "file string, row int, doc_id long, n_tokens long, ids_crc32 long"), "token-rows")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n")).withColumn("_part", part_number(F.col("file")))
    files = files.select("file", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", inner).join(files, "file").select("doc_id", (F.col("_base") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    found = layout(read_tokens(spark, path))
    drop_path(spark, path)  # layout() has read the files and holds its own rows
    return found
