"""Which files were read, and which are as they were then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "name string, dt timestamp_ntz, bytes long, records long"


def upsert(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """One row a file; a new row takes the place of an old one."""
    both = ledger.select("name", "dt", "bytes", "records", F.lit(0).alias("_new")).unionByName(new.select("name", "dt", "bytes", "records", F.lit(1).alias("_new")))
    return both.groupBy("name").agg(F.max_by(F.struct("dt", "bytes", "records"), "_new").alias("_r")).select("name", "_r.*")


def file_info(ledger: DataFrame, name: str) -> DataFrame:
    return ledger.where(F.col("name") == name).select("dt", "bytes", "records")


def changed(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Lines of files whose time or size differs from the ledger, or that it does not hold."""
    old = ledger.select(F.col("name").alias("file"), F.col("dt").alias("file_dt"), F.col("bytes").alias("file_bytes"))
    return lines.join(old, ["file", "file_dt", "file_bytes"], "left_anti")
