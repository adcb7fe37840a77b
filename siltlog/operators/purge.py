"""Rejected addresses and what is left without them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltlog.operators.parse import truncate
from siltlog.operators.rules import ACCEPT, BLOCK, IGNORE

ENTRY = ("dt", "ip", "http", "was_rd", "vhost", "url", "ref", "ua")
REDIRECTS = (301, 302)


def rejected_ips(judged: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(ip, blocked) of every address with an ignored or blocked line, and of those known before; one block is enough."""
    found = judged.where(F.col("verdict").isin(IGNORE, BLOCK)).select("ip", (F.col("verdict") == BLOCK).alias("blocked"))
    if known is not None:
        found = found.unionByName(known.select("ip", "blocked"))
    return found.groupBy("ip").agg(F.max("blocked").alias("blocked"))


def purge(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows without any of a rejected address, wherever they stand."""
    return rows.join(rejected.select("ip"), "ip", "left_anti")


def purged_counts(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    return rows.join(rejected, "ip").groupBy("ip", "blocked").agg(F.count(F.lit(1)).alias("n_rows"))


def mark_redirects(rows: DataFrame) -> DataFrame:
    """was_rd: the address's line before this one in the file was a redirect, and this one is none."""
    before = F.lag("http").over(Window.partitionBy("file", "ip").orderBy("line_key"))
    return rows.withColumn("was_rd", F.coalesce(before.isin(*REDIRECTS), F.lit(False)) & ~F.col("http").isin(*REDIRECTS))


def dedupe(rows: DataFrame) -> DataFrame:
    """The first row, by file and line, of those equal in all stored columns."""
    first = Window.partitionBy(*ENTRY).orderBy("file", "line_key")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def accepted(judged: DataFrame, rejected: DataFrame) -> DataFrame:
    """Accepted lines of addresses that are not rejected, with was_rd, values cut; repeats are still in."""
    rows = purge(judged.where(F.col("verdict") == ACCEPT), rejected)
    return truncate(mark_redirects(rows))


def file_counters(judged: DataFrame) -> DataFrame:
    return judged.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("parsed").cast("long")).alias("n_parsed"), F.sum((F.col("verdict") == ACCEPT).cast("long")).alias("n_accepted"))


def blocklist(rejected: DataFrame) -> DataFrame:
    """Blocked addresses with their numbers; those that are no address have a null one."""
    from siltlog.functions.net import ip_to_long

    return rejected.where("blocked").select("ip", ip_to_long(F.col("ip")).alias("ip_num"))


def write_blocklist(rejected: DataFrame, path: str) -> None:
    """One address a line in numeric order, over the part files in order."""
    blocklist(rejected).orderBy(F.col("ip_num").asc_nulls_last(), "ip").select("ip").write.mode("overwrite").text(path)


def new_blocked(rejected: DataFrame, told: DataFrame) -> DataFrame:
    """Blocked addresses that were not told of yet."""
    return rejected.where("blocked").select("ip").join(told.select("ip"), "ip", "left_anti")
