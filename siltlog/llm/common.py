"""What the operators of this subpackage share: input, scratch tables, small helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.words import trim


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without one gets a folder of its own (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="siltlog-")
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; the JVM deletes it when it ends."""
    path = f"{shared_dir(spark)}/siltlog-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def spool(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Makes Spark delete the shuffle files of a query as it ends; what is written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables in the shared folder, by name, to be dropped after their last reader."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        self.drop(name)
        path = self.paths[name] = scratch_path(self.spark, f"{self.tag}-{name}")
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                drop_path(self.spark, self.paths.pop(name))


#: Arrow batches of at most so many rows and bytes bound what a Python worker holds.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, for rows may hold long texts; results are lazy, so it stays so."""
    for k, most in BATCHES.items():
        now = spark.conf.get(k)
        size = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(now)))
        if size <= 0 or size > most:
            spark.conf.set(k, str(most))


class Sieve:
    """A bit for each hash of some keys, in a table of at most MOST / 64 rows: which rows cannot be among them, without a shuffle."""

    MOST = 1 << 25

    def __init__(self, scratch: Scratch, name: str, keys: DataFrame):
        n = keys.count()
        self.size = 1 << min(max(12, (32 * n).bit_length()), self.MOST.bit_length() - 1)
        placed = keys.select(self.place(keys.columns).alias("_at"))
        bits = placed.selectExpr("_at div 64 as _word", "shiftleft(1L, cast(_at % 64 as int)) as _bit").groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
        self.bits = scratch.write(name, bits)

    def place(self, columns: list[str]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.size))

    def split(self, df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
        """(rows that may be among the keys, rows that are not); columns are those of the keys, in their order."""
        placed = df.withColumn("_at", self.place(columns)).join(F.broadcast(self.bits), F.expr("_at div 64 = _word"), "left")
        there = F.expr("coalesce(_bits & shiftleft(1L, cast(_at % 64 as int)), 0L) <> 0")
        return placed.where(there).select(*[placed[c] for c in df.columns]), placed.where(~there).select(*[placed[c] for c in df.columns])


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % k


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """About how large df's texts are: the planner's estimate where it has one (for files, what they take: nothing is read), else their sum."""
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return planned if planned < 1 << 60 else df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def settle(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are over: Spark deletes them once their plans are collected. Freed memory goes back to the system."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()
