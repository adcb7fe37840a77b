"""The star schema: entries with ids, and one table of values for each text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltlog.operators.purge import ENTRY

DIMENSIONS = ("vhost", "url", "ref", "ua")
_AT = (1 << 33) - 1  # the bits of monotonically_increasing_id() that number the rows of a partition


def numbered(rows: DataFrame, by: tuple[str, ...], path: str, start: int = 0) -> DataFrame:
    """rows with id from start + 1 in the order of `by`; they are written to path.

    Rows are ranged by `by`, so no file or value is one task's alone, and numbered
    within their range; the ranges before (one row each) move the numbers on.
    """
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = rows.sparkSession.read.schema(placed.schema).parquet(path).withColumn("_p", F.shiftright("_m", 33))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", before.alias("_before"))
    at = F.col("_m").bitwiseAND(F.lit(_AT)) + F.col("_before") + start + 1
    return placed.join(F.broadcast(ranges), "_p").withColumn("id", at.cast("long")).drop("_m", "_p", "_before")  # as many rows as ranges


def first_values(rows: DataFrame) -> DataFrame:
    """dim, value, and the first id of each value of the dimensions."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("value")) for c in DIMENSIONS]))
    return rows.select("id", pairs.alias("x")).groupBy("x.dim", "x.value").agg(F.min("id").alias("first"))


def facts(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Entries of rows with ids: values become the ids of the dimension tables."""
    for c in DIMENSIONS:
        rows = rows.join(tables[c].select(F.col("id").alias(f"id_{c}"), F.col("value").alias(c)), c)
    return rows.select("id", "dt", "ip", "http", "was_rd", *[f"id_{c}" for c in DIMENSIONS], F.to_date("dt").alias("day"))


def resolved(tables: dict[str, DataFrame], entries: DataFrame | None = None) -> DataFrame:
    """Entries with the values of all four dimensions."""
    df = tables["entries"] if entries is None else entries
    for c in DIMENSIONS:
        df = df.join(tables[c].select(F.col("id").alias(f"id_{c}"), F.col("value").alias(c)), f"id_{c}")
    return df


def records_at(tables: dict[str, DataFrame], dt) -> DataFrame:
    """The records of one second, in the order they came in."""
    at = F.lit(dt).cast("timestamp_ntz")
    return resolved(tables, tables["entries"].where((F.col("day") == F.to_date(at)) & (F.col("dt") == at))).orderBy("id")


def hits_for_ip(tables: dict[str, DataFrame], ip: str) -> DataFrame:
    return tables["entries"].where(F.col("ip") == ip).agg(F.count("http").alias("hits"))


def without_stored(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that the store does not hold yet (all stored columns equal)."""
    return rows.join(stored.select(*ENTRY), list(ENTRY), "left_anti")
