"""Near-duplicate documents: MinHash banding, verification, connected components.

A document is the set of its distinct word shingles. Two documents are linked if
their sets have a Jaccard likeness of `percent` / 100 or more.

1. Equal sets form a class, and only classes go on; copies cost one row each.
2. Many universal hash minima in bands of `rows` give candidate classes. At the
   threshold a pair is missed with probability (1 - 0.8^rows)^bands, 2e-5 here.
3. In each bucket the members are checked against its smallest one, the pivot,
   on their full sets. Links are joined to components.
4. Where a bucket still holds several components, members of others than the
   pivot's are checked against all members of such buckets of that component, in
   blocks: a block against a block is one product of two incidence matrices, and
   gives at most one link for each two components. So no candidate is left out,
   and no bucket is expanded into rows for all its pairs.
5. Components over all links by alternating large-star and small-star.

Classes are told apart by 128-bit hashes of their sets, shingles by 64-bit ones.
Null and empty texts, and texts of blanks only, have no shingles and are linked
with nothing. Rows with equal ids are documents of their own; a null id is larger
than all others and never names a component of more than itself. Further columns
are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.common import Scratch, Sieve, documents, settle, small_batches
from siltlog.llm.components import components
from siltlog.llm.shingles import Shingler, Signer, band_keys
from siltlog.llm.words import claim, pieces, trim

ROWS, BANDS = 6, 36
BLOCK, SALTS = 32, 64  # members of a block; parts into which the blocks of a component are dealt
COLUMNS = 50_000  # of an incidence matrix at once


def _classes(sets: list[np.ndarray]) -> list[pa.Array]:
    """128-bit hashes of sets, as two columns."""
    found = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2)
    return [pa.array(found[:, k].view(np.int64)) for k in (0, 1)]


def _describe(shingle: int, rows: int, bands: int):
    def run(batches):
        claim("near_dedup")
        shingler, signer = Shingler(shingle), Signer(rows * bands)
        for batch in pieces(batches):
            sets = shingler.sets(batch.column("text"))
            keys = [band_keys(signer.sign(s), rows) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), *_classes(sets), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "c1", "c2", "keys"],
            )

    return run


def _payload(shingle: int):
    def run(batches):
        claim("near_dedup")
        shingler = Shingler(shingle)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([*_classes(shingler.sets(batch.column("text"))), batch.column("text")], ["c1", "c2", "text"])

    return run


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= percent * (len(a) + len(b) - both)


def _verify(percent: int, shingle: int):
    def run(batches):
        claim("near_dedup")
        shingler = Shingler(shingle)
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            coded = [batch.column(c).dictionary_encode() for c in ("text_a", "text_b")]
            a, b = (shingler.sets(c.dictionary) for c in coded)
            keep = pa.array([_alike(a[x], b[y], percent) for x, y in zip(*(c.indices.to_pylist() for c in coded), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("b").filter(keep), batch.column("a").filter(keep)], ["u", "v"])
        trim()

    return run


def _check(pairs: DataFrame, payload: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links (u, v) among pairs (a, b)."""
    a = payload.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = payload.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verify(percent, shingle), "u long, v long")


def _in_common(sets: list[np.ndarray], n: int) -> np.ndarray:
    """How many items each of the first n sets has in common with each of the others."""
    flat, out = np.concatenate(sets), np.zeros((n, len(sets) - n), np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, item = np.unique(flat, return_inverse=True)
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    for at in range(0, int(item[-1]) + 1 if len(item) else 0, COLUMNS):
        a, b = np.searchsorted(item, (at, at + COLUMNS))
        there = np.zeros((len(sets), COLUMNS), np.float32)
        there[owner[a:b], item[a:b] - at] = 1
        out += (there[:n] @ there[n:].T).astype(np.int64)
    return out


def _compare_blocks(percent: int, shingle: int):
    """Links (u, v) between the members of two blocks that are not yet joined, one for each two components."""

    def run(batches):
        claim("near_dedup")
        shingler = Shingler(shingle)
        for batch in batches:
            found = {}
            for k in range(batch.num_rows):
                left, right = (batch.column(c)[k].values for c in ("left", "right"))
                node, comp = (np.concatenate([left.field(c).to_numpy(), right.field(c).to_numpy()]) for c in ("node", "comp"))
                sets, n = shingler.sets(pa.concat_arrays([left.field("text"), right.field("text")])), len(left)
                size, both = np.array([len(s) for s in sets]), _in_common(sets, n)
                ok = (both * 100 >= percent * (size[:n, None] + size[None, n:] - both)) & (comp[:n, None] != comp[None, n:])
                for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                    a, b = (comp[i], node[i]), (comp[n + j], node[n + j])
                    found.setdefault((min(a, b)[0], max(a, b)[0]), (max(a[1], b[1]), min(a[1], b[1])))
            u, v = zip(*found.values(), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        trim()

    return run


def _across(scratch: Scratch, members: DataFrame, joined: DataFrame, payload: DataFrame, percent: int, shingle: int) -> DataFrame | None:
    """Links (u, v) between members of one bucket that are not yet joined, as many as join them."""
    labelled = members.where("m > 2").join(joined, members["node"] == joined["node"], "left").select("band", members["node"], "pivot", F.coalesce("root", members["node"]).alias("comp"))
    mixed = scratch.write("mixed", labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band"))
    rest = scratch.write("rest", labelled.join(mixed, "band"))
    if not rest.limit(1).count():
        return None
    core = rest.where("node = pivot").select("band", F.col("comp").alias("core"))
    around = scratch.write("around", rest.join(core, "band").select("core", "node", "comp").distinct())
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    sizes = around.groupBy("core").agg(F.count(F.lit(1)).alias("m")).select("core", blocks.alias("blocks"), F.least(blocks, F.lit(SALTS)).alias("salts"))
    dealt = around.join(sizes, "core").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.join(payload, "node").select("core", "comp", "salts", "block", F.struct("node", "comp", "text").alias("x"))
    left = dealt.where("comp <> core").groupBy("core", "salts", "block").agg(F.collect_list("x").alias("left"))
    left = left.select("core", "left", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = dealt.groupBy("core", "salts", "block").agg(F.collect_list("x").alias("right")).select("core", "right", (F.col("block") % F.col("salts")).alias("salt"))
    found = left.join(right, ["core", "salt"]).select("left", "right").mapInArrow(_compare_blocks(percent, shingle), "u long, v long")
    found = scratch.write("later", found.distinct())
    scratch.drop("mixed", "rest", "around")
    return found


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash, link_group, kept: one row for each row of docs(doc_id, text).

    link_group names the component also where all its ids are null; it is null for empty sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    described = texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_describe(shingle, rows, bands), "doc_id long, text_hash long, n_shingles long, c1 long, c2 long, keys array<long>")
    base = scratch.write("base", described)
    # an empty set is no class: its rows stay apart
    classes = base.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"))
    classes = scratch.write("classes", classes.select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "first", "keys"))
    banded = classes.select("node", F.explode("keys").alias("band"))
    buckets = scratch.write("buckets", banded.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    members = scratch.write("members", banded.join(buckets, "band"))
    scratch.drop("buckets")
    pairs = scratch.write("pairs", members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    settle(spark)
    # texts of the classes in any bucket
    wanted = scratch.write("wanted", classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), F.col("first").alias("doc_id")))
    found, _ = Sieve(scratch, "sieve", wanted.select("doc_id")).split(texts, ["doc_id"])
    found = found.mapInArrow(_payload(shingle), "c1 long, c2 long, text string")
    found = found.join(wanted.drop("doc_id"), (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2"))).select("node", "text")
    payload = scratch.write("payload", found.dropDuplicates(["node"]))
    scratch.drop("wanted", "sieve")
    settle(spark)
    links = scratch.write("links", _check(pairs, payload, percent, shingle))
    joined = components(scratch, "joined", links)
    scratch.drop("pairs", "links")
    settle(spark)
    later = _across(scratch, members, joined, payload, percent, shingle)
    if later is not None:
        joined = components(scratch, "again", joined.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(later))
    scratch.drop("members", "payload", "later")
    labelled = classes.join(joined, classes["node"] == joined["node"], "left").select("c1", "c2", "first", F.coalesce("root", classes["node"]).alias("link_group"))
    labelled = scratch.write("labels", labelled)
    scratch.drop("classes", *[f"{name}-{k}" for name in ("joined", "again") for k in (0, 1)])
    least = scratch.write("least", labelled.groupBy("link_group").agg(F.min("first").alias("component_id")))
    named = scratch.write("named", labelled.join(least, "link_group").select(F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), "component_id", "link_group"))
    scratch.drop("labels", "least")
    settle(spark)
    full = base.where("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "c1", "c2")
    out = full.join(named, (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2"))).select("doc_id", "n_shingles", "component_id", "text_hash", "link_group")
    empty = base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("long").alias("link_group"))
    return out.unionAll(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without all but one of each component; rows equal in id and text count as one.

    Only the rows that may go, told by a table of bits, are joined with those that do; all others pass.
    """
    scratch = Scratch(docs.sparkSession, "one")
    found = scratch.write("found", near_duplicates(docs, **options).select("doc_id", "text_hash", "link_group", "kept"))
    ids = ["doc_id", "text_hash"]
    one = found.where("kept and link_group is not null").groupBy("link_group").agg(F.min(F.struct(*ids)).alias("x")).select("link_group", F.col("x.doc_id").alias("_id"), F.col("x.text_hash").alias("_hash"))
    told = found.where("link_group is not null").join(one, "link_group")
    gone = told.where(~(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))).select(*ids).distinct()
    gone = scratch.write("gone", gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    repeated = scratch.write("repeated", found.groupBy(*ids).count().where("count > 1").select(*ids))
    keyed = docs.withColumns({"_i": F.col("doc_id").cast("long"), "_h": F.xxhash64(F.col("text").cast("string"))})
    unsure, sure = Sieve(scratch, "sieve", gone.unionAll(repeated)).split(keyed, ["_i", "_h"])
    unsure = unsure.join(gone, unsure["_i"].eqNullSafe(gone["_id"]) & (unsure["_h"] == gone["_hash"]), "left_anti")
    if repeated.limit(1).count():
        unsure = unsure.dropDuplicates(["_i", "_h"])
    return sure.select(*docs.columns).unionAll(unsure.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=2).select("doc_id", "n_shingles", "component_id", "kept")
