import random
import zlib
from collections import Counter, defaultdict

from siltlog.llm import sharding


def test_counts_slots_and_mixture(spark):
    rng = random.Random(7)
    rows = [(rng.choice([k, None]) if k % 50 == 0 else k, rng.choice(["é" * k, None, "same"]), rng.choice(["hot"] * 5 + ["a", "b", None]), 3) for k in range(997)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    found = sharding.interleave(docs, 8).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.stratum or "") for r in found) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s or "") for i, t, s, _ in rows)
    shards = defaultdict(list)
    for r in found:
        shards[r.shard].append(r)
    assert sorted(shards) == list(range(8)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    total = Counter(r.stratum for r in found)
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        mix = Counter(r.stratum for r in members)
        assert all(abs(mix[s] - n / 8) <= 1 + len(total) * n / len(rows) for s, n in total.items())
    again = {(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.interleave(docs.repartition(5), 8).collect()}
    assert again == {(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found}
    assert sharding.interleave(docs.limit(0)).count() == 0
    few = sharding.interleave(docs.limit(3), 8).collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few)
