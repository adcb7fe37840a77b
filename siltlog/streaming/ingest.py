"""Incremental ingest: a file stream whose batches go through the same plan.

Each trigger takes the files that are new; redirect state never crosses a file,
so a batch needs no state of earlier ones. Entries are appended to the star schema
without rows the store holds already, rejected addresses are kept for later
batches, and stored rows of theirs go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltlog.operators.purge import rejected_ips
from siltlog.operators.rules import Ruleset
from siltlog.plans.ingest import ingest
from siltlog.plans.scratch import delete
from siltlog.plans.store import rejected_view, take
from siltlog.sources.logs import file_vhosts


def stream(spark: SparkSession, logs: str, store: str, rules: Ruleset, pattern: str = "*access.log*", files_per_trigger: int = 100) -> StreamingQuery:
    """Read all new files of a folder into the store, then stop."""

    def each(batch: DataFrame, _: int) -> None:
        key = F.struct("block", F.monotonically_increasing_id().alias("at"))
        lines, vhosts = file_vhosts(batch.select("file", key.alias("line_key"), "value"))
        spark, staged = batch.sparkSession, f"{store}/judged-{uuid.uuid4().hex}"
        frames = ingest(lines, rules, vhosts, rejected_view(spark, store), staged)
        take(spark, store, frames.entries, rejected_ips(frames.judged))
        delete(spark, staged)

    source = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).text(logs)
    lines = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return lines.writeStream.foreachBatch(each).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
