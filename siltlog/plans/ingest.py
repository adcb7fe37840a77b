"""Lines to the star schema, as one declarative plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.operators import ledger as ledgers
from siltlog.operators.parse import parse
from siltlog.operators.purge import accepted, dedupe, file_counters, rejected_ips
from siltlog.operators.rules import Ruleset, judge
from siltlog.sources.logs import file_vhosts, read_lines


@dataclass
class Frames:
    """What one run makes of its lines. Nothing is computed before it is asked for."""

    judged: DataFrame
    rejected: DataFrame
    accepted: DataFrame
    entries: DataFrame


def ingest(lines: DataFrame, rules: Ruleset, vhosts: DataFrame | None = None, known: DataFrame | None = None, staged: str | None = None) -> Frames:
    """Parse, judge, reject addresses (those of `known` too), mark redirects and deduplicate.

    With `staged`, judged rows are written to that path and read from there, so
    lines are parsed once, however many tables are made of them.
    """
    judged = judge(parse(lines, vhosts), rules)
    if staged is not None:
        judged.drop("value").write.parquet(staged)
        judged = judged.sparkSession.read.schema(judged.drop("value").schema).parquet(staged)
    rejected = rejected_ips(judged, known)
    rows = accepted(judged, rejected)
    return Frames(judged, rejected, rows, dedupe(rows))


def ingest_files(
    spark: SparkSession, paths: str | list[str], rules: Ruleset, pattern: str = "access.log", ledger: DataFrame | None = None, known: DataFrame | None = None, staged: str | None = None
) -> tuple[Frames, DataFrame]:
    """Frames of log files, and the ledger rows (name, dt, bytes, records) of the files read.

    With a ledger, files that are as it says are left out.
    """
    lines = read_lines(spark, paths, pattern)
    if ledger is not None:
        lines = ledgers.changed(lines, ledger)
    lines, vhosts = file_vhosts(lines)
    frames = ingest(lines, rules, vhosts, known, staged)
    sizes = lines.groupBy(F.col("file").alias("name")).agg(F.max("file_dt").alias("dt"), F.max("file_bytes").alias("bytes"))
    counts = file_counters(frames.judged).select(F.col("file").alias("name"), F.col("n_accepted").alias("records"))
    return frames, sizes.join(counts, "name").select("name", "dt", "bytes", "records")
