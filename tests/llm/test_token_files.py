import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from siltlog.llm import token_files  # noqa: E402
from siltlog.llm.words import ChunkMemo, distinct_chunks  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a\x1cb c\x85d\xa0e f　g ΑΣ ΣΑΣ'S don't <|endoftext|> x<|endoftext|>y é ́ İ 1234 ½  ́",
    "ß\tﬁ \x0b\x0c z​q", "Ａ b   c 가각", "It's THEY'RE 'LL café's x÷y×z", "q" * 5000, "1<|2 <|startoftext|>3",
]


def _want(lib, text):
    return [*lib.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_the_library():
    lib, memo = tokenizers.Tokenizer.from_file(PATH), ChunkMemo(token_files.WordEncoder(PATH))
    assert memo.encode.plain
    rng = random.Random(2)
    bits = ["the", "Ing", "É", "ß", "!", "12", "-", "\n", " ", "'s", "un", "ally", "日", "ﬁ", "́", "|", "ÿ"]
    for text in ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(1500)]:
        texts = memo.encode.lowered(pa.array([text]))
        assert memo.ids(*distinct_chunks(texts))[0].tolist() == _want(lib, text)[:-1], text
    ids, ends = memo.ids(*distinct_chunks(pa.array([*ODD, None])))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [_want(lib, t)[:-1] for t in [*ODD, None]]


def test_a_full_memo_starts_anew():
    lib, memo = tokenizers.Tokenizer.from_file(PATH), ChunkMemo(token_files.WordEncoder(PATH, most=50), bits=8)
    rng = random.Random(4)
    for _ in range(60):
        texts = [" ".join("".join(rng.choice("aeidnts'-É1") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(12))) + " " + "z" * rng.choice([0, 64, 65, 300]) for _ in range(8)]
        ids, ends = memo.ids(*distinct_chunks(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [_want(lib, t)[:-1] for t in texts]


def test_part_numbers_order_files(spark):
    names = [f"part-{k:05d}-x.c000.orc" for k in (99_999, 100_000, 7, 10_000, 100_001)]
    rows = spark.createDataFrame([(n,) for n in names], "file string").orderBy(token_files.part_number(F.col("file"))).collect()
    assert [int(r.file.split("-")[1]) for r in rows] == [7, 10_000, 99_999, 100_000, 100_001]


def test_files_round_trip(spark, tmp_path):
    lib = tokenizers.Tokenizer.from_file(PATH)
    rows = [(5, "b", 1), (None, None, 2), (3, "x y z " * 4000, 3), (3, "other", 4), (9, None, 5), *[(10 + k, t, k) for k, t in enumerate(ODD)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    token_files.write_tokens(docs, str(tmp_path / "t"), PATH)
    files = token_files.read_tokens(spark, str(tmp_path / "t"))
    found = sorted((r for r in token_files.layout(files).collect()), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i))
    start, left = 0, {}
    for i, t, _ in rows:
        left.setdefault(i, []).append(_want(lib, t))
    for r in found:
        assert r.start == start
        start += r.n_tokens
        ids = next(x for x in left[r.doc_id] if len(x) == r.n_tokens and zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        left[r.doc_id].remove(ids)
    assert token_files.lookup(spark, str(tmp_path / "t"), 5).first().ids == _want(lib, "b")
    token_files.write_tokens(docs.limit(0), str(tmp_path / "e"), PATH)
    assert token_files.layout(token_files.read_tokens(spark, str(tmp_path / "e"))).count() == 0


def test_lookups_skip_by_indexes_and_bloom_filters(spark, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_tokens(spark.range(0, 40_000, 1).selectExpr("id * 2 as doc_id", "concat('word ', id) as text"), path, PATH)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = sorted((tmp_path / "t").glob("*.orc"))
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(files[0])), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() >= 1 and reader.getNumberOfRows() > 3000
    stripe = reader.getStripes().get(0)
    streams = {str(x.getKind()) for x in _streams(reader, stripe)}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= streams

    def read(doc_id):
        df = token_files.lookup(spark, path, doc_id)
        found, plan = df.collect(), df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return len(found), sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))

    assert read(24_680)[0] == 1 and 0 < read(24_680)[1] <= 1000  # one group of rows of 40,000
    absent = [read(k)[1] for k in range(10_001, 10_041, 2)]  # within the range of a group, so its statistics do not tell
    assert sum(x == 0 for x in absent) >= 15


def _streams(reader, stripe):
    rows = reader.rows()
    try:
        return list(rows.readStripeFooter(stripe).getStreamsList())
    finally:
        rows.close()
