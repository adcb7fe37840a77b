"""One run over a folder of logs into a store folder, as the command line starts it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.operators import ledger as ledgers
from siltlog.operators.purge import file_counters, new_blocked, rejected_ips, write_blocklist
from siltlog.operators.rules import Ruleset
from siltlog.plans.ingest import ingest_files
from siltlog.plans.scratch import delete
from siltlog.plans.store import entries_view, rejected_view, stored, take
from siltlog.sources.logs import preload, seed_rules


@dataclass
class Config:
    """Where logs, rules and the store are, and what a run does."""

    logs: str
    store: str
    rules: str
    pattern: str = "access.log"
    exclude: list[int] = field(default_factory=list)
    secondary: bool = False
    timestamps: bool = False
    known: str | None = None
    save: str | None = None


def read_ledger(spark: SparkSession, store: str) -> DataFrame:
    """The ledger's last version."""
    rows = stored(spark, f"{store}/ledger", ledgers.SCHEMA + ", v long")
    last = rows.agg(F.max("v")).first()[0]
    return rows.where(F.col("v") == last).drop("v") if last is not None else rows.drop("v")


def write_ledger(spark: SparkSession, store: str, new: DataFrame) -> None:
    """A new version with the new rows in place of old ones; it is read before it is there, so old versions stay whole."""
    last = stored(spark, f"{store}/ledger", ledgers.SCHEMA + ", v long").agg(F.max("v")).first()[0] or 0
    ledgers.upsert(read_ledger(spark, store), new).withColumn("v", F.lit(last + 1).cast("long")).write.mode("append").partitionBy("v").parquet(f"{store}/ledger")


def run(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """Ingest what is new into the star schema, and tell: entries, rejected, blocked since before, counters by file."""
    seed_rules(config.rules)
    rules = Ruleset.load(config.rules, config.exclude, config.secondary)
    told = rejected_view(spark, config.store)
    preloaded = preload(spark, config.known) if config.known else None
    known = told if preloaded is None else told.unionByName(preloaded)
    staged = f"{config.store}/judged-{uuid.uuid4().hex}"
    frames, files = ingest_files(spark, config.logs, rules, config.pattern, read_ledger(spark, config.store) if config.timestamps else None, known, staged)
    found = rejected_ips(frames.judged, preloaded)
    kept = f"{config.store}/told/{uuid.uuid4().hex}"
    new_blocked(found, told.where("blocked")).write.parquet(f"{kept}/new_blocked")  # before rejected_ips grows, of which it is the difference
    file_counters(frames.judged).write.parquet(f"{kept}/files")
    take(spark, config.store, frames.entries, found)
    write_ledger(spark, config.store, files)
    delete(spark, staged)
    rejected = rejected_view(spark, config.store)
    if config.save:
        write_blocklist(rejected, config.save)
    return {"entries": entries_view(spark, config.store), "rejected": rejected, "new_blocked": spark.read.schema("ip string").parquet(f"{kept}/new_blocked"), "files": spark.read.parquet(f"{kept}/files")}
