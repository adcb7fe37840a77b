"""Proportional stratified interleaving into shards.

Rows are shuffled by a seeded hash and ranked within their source; a row's
fractional rank (rank - 1/2) / rows-of-source places it on one line for all
sources, which is cut into equal pieces. Row counts of shards differ by at most
one, and a shard's count of a source with share p of all rows, of k sources, is
off its even part by at most 1 + k * p.

Ranks over a source or the whole table never need the source in one task: rows
fall into about sqrt(n) buckets by hash (or fractional rank), bucket counts are
summed up into offsets, and row_number works inside a bucket only.

Null sources are a source of their own; a null text counts as no bytes; null
ids and repeated rows are placed like any other (equal rows are interchangeable;
those without an id are counted and numbered, so that very many equal ones do not
fall into one bucket). An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltlog.llm.common import documents, spool


HEX = 15  # digits of the hash that orders rows


def _bucket(unit, n_buckets: int):
    """Bucket of a number in [0, 1); monotone, so bucket order is number order."""
    return F.least(F.floor(unit * n_buckets), F.lit(n_buckets - 1)).cast("int")


def _offsets(counts: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("_all"))


def interleave(docs: DataFrame, n_shards: int = 8, seed: int = 17, stratum: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, stratum, shard, slot; row counts of shards at most one apart."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("")).alias("_s"),
    )
    # rows without an id are what they show, and how often: numbers tell equal ones apart
    none = rows.where(F.col("doc_id").isNull()).groupBy("doc_id", "size", "text_crc32", "_s").agg(F.count(F.lit(1)).alias("_n"))
    none = none.withColumn("_k", F.explode(F.expr("sequence(0L, (_n - 1) div 1000)"))).repartition("_s", "text_crc32", "_k")
    none = none.withColumn("_k", F.explode(F.expr("sequence(_k * 1000 + 1, least(_n, _k * 1000 + 1000))")))
    named = rows.where(F.col("doc_id").isNotNull()).withColumn("_name", F.col("doc_id").cast("string"))
    rows = named.unionByName(none.withColumn("_name", F.concat(F.lit("none "), F.col("_k").cast("string"))).drop("_n", "_k"))
    digest = F.md5(F.encode(F.concat_ws("|", F.lit(str(seed)), F.col("_name"), F.col("text_crc32").cast("string")), "UTF-8"))
    rows = spool(rows.withColumn("_h", F.conv(F.substring(digest, 1, HEX), 16, 10).cast("long")).drop("_name"), "shard-rows")
    total = rows.count()
    n_buckets = max(1, math.isqrt(total))
    rows = rows.withColumn("_b", _bucket(F.col("_h").cast("double") / float(16**HEX), n_buckets))
    starts = _offsets(rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n")), ["_s"])
    local = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "text_crc32", "size"))
    ranked = (
        rows.withColumn("_r", local)
        .join(starts, ["_s", "_b"])
        .withColumn("_unit", (F.col("_before") + F.col("_r") - 0.5) / F.col("_all"))
        .select("doc_id", "size", "text_crc32", "_s", "_h", "_unit", _bucket(F.col("_unit"), n_buckets).alias("_b"))
    )
    ends = _offsets(ranked.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")), [])
    order = Window.partitionBy("_b").orderBy("_unit", "_s", "_h", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("_r", F.row_number().over(order)).join(ends, "_b").withColumn("_at", F.col("_before") + F.col("_r") - 1)
    shard = F.expr(f"_at * {n_shards} div _all")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.when(F.col("_s") != "", F.substring("_s", 2, 2**31 - 1)).alias("stratum"),
        "shard",
        (F.col("_at") - F.expr(f"(shard * _all + {n_shards - 1}) div {n_shards}")).cast("long").alias("slot"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "stratum"
    )
