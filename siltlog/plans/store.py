"""The store: a star schema in Parquet under one folder, which grows run by run.

entries/day=.../ holds the facts, dims/dim=.../ the values of the dimensions,
last/ the highest ids given so far, rejected_ips/ the addresses rejected by any
run. Appending gives new values and rows the next ids; what is stored keeps its
own. Purging rewrites only the days that hold a rejected address.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.operators.purge import ENTRY, purge
from siltlog.operators.rules import Ruleset
from siltlog.operators.star import DIMENSIONS, facts, first_values, numbered, resolved, without_stored
from siltlog.plans.ingest import Frames, ingest
from siltlog.plans.scratch import delete, exists, scratch
from siltlog.sources.derived import access_log

TABLES = ("entries", *DIMENSIONS)
FACTS = "id long, dt timestamp_ntz, ip string, http int, was_rd boolean, id_vhost long, id_url long, id_ref long, id_ua long, day date"
#: The rules that the derived log is read with.
RULES = Ruleset(ip=["10.4.52.4", "10.1.104.8"], url=[r"/wp\-admin"], ref=[r"\Wsemalt"], ua=[r"[bB]ot[^a-zA-Z]"], vhost=["^admin"], net=["114.134.184.0/21"])
_BUILT: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    dims = stored(spark, f"{path}/dims", "id long, value string, dim string")
    return {"entries": stored(spark, f"{path}/entries", FACTS)} | {c: dims.where(F.col("dim") == c).select("id", "value") for c in DIMENSIONS}


def _last(spark: SparkSession, path: str) -> dict[str, int]:
    """The highest id of each table so far."""
    rows = stored(spark, f"{path}/last", "name string, id long").groupBy("name").agg(F.max("id").alias("id")).collect()
    return dict.fromkeys(TABLES, 0) | {r["name"]: r["id"] for r in rows}


def append(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Store rows (file, line_key and the stored columns) that are not there yet.

    Values go in before the entries that name them; a run that dies between
    leaves values without entries, which do no harm, and can be run again.
    """
    staged = f"{path}/staged-{uuid.uuid4().hex}"
    fresh, last = rows.select("file", "line_key", *ENTRY), _last(spark, path)
    if last["entries"]:
        fresh.write.parquet(f"{staged}/rows")
        fresh = spark.read.schema(fresh.schema).parquet(f"{staged}/rows")
        first, until = fresh.agg(F.min(F.to_date("dt")), F.max(F.to_date("dt"))).first()
        tables = read(spark, path)
        held = tables["entries"].where(F.col("day").between(F.lit(first), F.lit(until)))  # other days need not be read
        fresh = without_stored(fresh, resolved(tables, held))
    ided = numbered(fresh, ("file", "line_key"), f"{staged}/ided", last["entries"])
    values = first_values(ided)
    if any(last[c] for c in DIMENSIONS):
        values = values.join(stored(spark, f"{path}/dims", "id long, value string, dim string").select("dim", "value"), ["dim", "value"], "left_anti")
    values = numbered(values, ("dim", "first"), f"{staged}/values")
    ends = {r["dim"]: r for r in values.groupBy("dim").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}  # a row a dimension
    moved = F.lit(0)
    for c, r in ends.items():
        moved = F.when(F.col("dim") == c, last[c] - r["lo"] + 1).otherwise(moved)
    values.select((F.col("id") + moved).alias("id"), "value", "dim").write.mode("append").partitionBy("dim").parquet(f"{path}/dims")
    new = facts(ided, read(spark, path)).hint("rebalance", F.col("day")).sortWithinPartitions("day", "ip")
    new.write.mode("append").partitionBy("day").parquet(f"{path}/entries")
    n = ided.agg(F.max("id")).first()[0] or last["entries"]
    high = [("entries", n), *[(c, last[c] + r["hi"] - r["lo"] + 1) for c, r in ends.items()]]
    spark.createDataFrame(high, "name string, id long").coalesce(1).write.mode("append").parquet(f"{path}/last")
    delete(spark, staged)


def rejected_view(spark: SparkSession, path: str) -> DataFrame:
    return stored(spark, f"{path}/rejected_ips", "ip string, blocked boolean").groupBy("ip").agg(F.max("blocked").alias("blocked"))


def entries_view(spark: SparkSession, path: str) -> DataFrame:
    """Stored entries, with their values, of addresses that no run has rejected."""
    return purge(resolved(read(spark, path)), rejected_view(spark, path)).select(*ENTRY)


def take(spark: SparkSession, path: str, entries: DataFrame, rejected: DataFrame) -> None:
    """What a run found goes into the store: rejected addresses, then new entries; stored rows of those addresses go."""
    rejected.write.mode("append").parquet(f"{path}/rejected_ips")
    append(spark, path, entries)
    purge_ip(spark, path, rejected)


def purge_ip(spark: SparkSession, path: str, rejected: DataFrame) -> int:
    """Rewrite the days of entries that hold rejected addresses; the number of rows that went."""
    entries = stored(spark, f"{path}/entries", FACTS)
    held = entries.join(rejected.select("ip").distinct(), "ip", "left_semi").groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a day
    if not held:
        return 0
    days, new = [r["day"] for r in held], f"{path}/staged-{uuid.uuid4().hex}"
    purge(entries.where(F.col("day").isin(days)), rejected).write.parquet(new)  # apart first: the days are read while they are replaced
    left = spark.read.schema(FACTS).parquet(new)
    left.hint("rebalance", F.col("day")).sortWithinPartitions("day", "ip").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/entries")
    for day in set(days) - {r["day"] for r in left.select("day").distinct().collect()}:
        delete(spark, f"{path}/entries/day={day}")
    delete(spark, new)
    return sum(r["n"] for r in held)


def derived_frames(spark: SparkSession, sf_dir: str, rules: Ruleset = RULES, staged: str | None = None) -> Frames:
    return ingest(access_log(spark, sf_dir), rules, staged=staged)


def built(spark: SparkSession, rows: DataFrame) -> dict[str, DataFrame]:
    """The star schema of these rows in a folder of its own, repeats among them kept."""
    path = scratch(spark, "star")
    append(spark, path, rows)
    return read(spark, path)


def derived_store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The star schema of the derived log, written once a session and read from then on."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        path = scratch(spark, "store")
        frames = derived_frames(spark, sf_dir, staged=f"{path}/judged")
        take(spark, path, frames.entries, frames.rejected)
        _BUILT[key] = path
    return read(spark, _BUILT[key])


def write_jdbc(tables: dict[str, DataFrame], url: str, properties: dict[str, str] | None = None, mode: str = "append") -> None:
    """Copy the tables to a database by its JDBC address; its driver must be on the class path."""
    for name in TABLES:
        tables[name].write.jdbc(url, name, mode, properties or {})


def read_jdbc(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> dict[str, DataFrame]:
    return {n: spark.read.jdbc(url, n, properties=properties or {}) for n in TABLES}
