"""Named queries over the derived access log, with the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.functions.dates import display, months_before
from siltlog.functions.net import ip_to_long, network_address
from siltlog.operators import ledger, purge, star
from siltlog.operators.parse import parse, rejects, truncate
from siltlog.operators.rules import BENIGN, SECONDARY, judge
from siltlog.plans import oracle, reports
from siltlog.plans.ingest import ingest, ingest_files
from siltlog.plans.scratch import scratch
from siltlog.plans.store import RULES, built, derived_frames, derived_store, entries_view, rejected_view, take
from siltlog.sources.derived import access_log
from siltlog.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
LINE = ("file", "line_key", "vhost", "ip", "dt", "url", "http", "ref", "ua")
PLACE = ("file", "line_key")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From events to lines to the star schema to a report."""
    return reports.q15(derived_store(spark, sf_dir), reports.Settings())


def _parsed(spark, d):
    return parse(access_log(spark, d))


def _prefixed(spark, d):
    lines = access_log(spark, d)
    time = F.regexp_extract("value", r"\[([^ ]+)", 1)
    shifted = F.date_format(F.to_timestamp(time, "dd/MMM/yyyy:HH:mm:ss") + F.expr("interval 1 second"), "yyyy-MM-dd HH:mm:ss")
    return parse(lines.withColumn("value", F.concat(shifted, F.lit("+0000 [HTTPChannel,1,10.0.0.1] "), F.col("value")))).select(*LINE)


def _broken(spark, d):
    lines = access_log(spark, d)
    return rejects(parse(lines.withColumn("value", F.when(F.col("line_key") % 10 == 0, F.concat(F.lit("oops "), "value")).otherwise(F.col("value"))))).select(*PLACE)


def _default_vhost(spark, d):
    lines = access_log(spark, d).withColumn("value", F.when(F.col("line_key") % 4 == 0, F.regexp_replace("value", r"^(\S+) \S+ -", r"$1 - -")).otherwise(F.col("value")))
    vhosts = spark.createDataFrame([("access.log.0", "files.example.com")], "file string, file_vhost string")
    return parse(lines, vhosts).groupBy("file", "vhost").agg(F.count(F.lit(1)).alias("n"))


def _matching(kind: str) -> Query:
    return lambda spark, d: _parsed(spark, d).where(F.col("parsed") & RULES.matches(kind)).select(*PLACE)


def _told(frames) -> DataFrame:
    return frames.rejected.where("blocked").where(ip_to_long(F.col("ip")) % 2 == 0)


def _raw_store(spark, d):
    return built(spark, derived_frames(spark, d).accepted)


def _files(spark, d) -> str:
    """The derived log as one text file a log, each in a folder of its own."""
    path, lines = scratch(spark, "logs"), access_log(spark, d)
    for k in range(5):
        lines.where(F.col("file") == f"access.log.{k}").coalesce(1).sortWithinPartitions("line_key").select("value").write.text(f"{path}/{k}")
    return path


def _each(path: str) -> list[str]:
    return [f"{path}/{k}" for k in range(5)]


def _log(file) -> Column:
    """The log's name, from the path of its text file."""
    return F.concat(F.lit("access.log."), F.regexp_extract(file, r"/(\d)/[^/]*$", 1))


def _ledger(spark, d):
    _, rows = ingest_files(spark, _each(_files(spark, d)), RULES, pattern="part-")
    return rows.select(_log(F.col("name")).alias("name"), "bytes", "records")


def _incremental(spark, d):
    path = _each(_files(spark, d))
    _, rows = ingest_files(spark, path, RULES, pattern="part-")
    again, _ = ingest_files(spark, path, RULES, pattern="part-", ledger=rows.where(_log(F.col("name")).isin("access.log.1", "access.log.3")))
    return purge.file_counters(again.judged).withColumn("file", _log(F.col("file")))


def _two_runs(spark, d):
    """The store after two runs: the first three logs, then the others."""
    store, lines = scratch(spark, "runs"), access_log(spark, d)
    for k, part in enumerate((lines.where("file <= 'access.log.2'"), lines.where("file > 'access.log.2'"))):
        frames = ingest(part, RULES, known=rejected_view(spark, store) if k else None, staged=f"{store}/judged-{k}")
        take(spark, store, frames.entries, purge.rejected_ips(frames.judged))
    return entries_view(spark, store)


def _stream(spark, d):
    store = scratch(spark, "stream")
    query = streaming.stream(spark, f"{_files(spark, d)}/*", store, RULES, pattern="part-*", files_per_trigger=2)
    query.awaitTermination()
    return entries_view(spark, store)


def queries() -> dict[str, Query]:
    frames, store = derived_frames, derived_store
    found: dict[str, Query] = {
        "parse_clf": lambda s, d: _parsed(s, d).select(*LINE),
        "parse_prefixed": _prefixed,
        "parse_rejects": _broken,
        "vhost_default": _default_vhost,
        "truncate_values": lambda s, d: truncate(_parsed(s, d), 9).select(*LINE),
        "match_ip": _matching("ip"),
        "match_net": _matching("net"),
        "match_url": _matching("url"),
        "match_ref": _matching("ref"),
        "match_ua": _matching("ua"),
        "match_vhost": _matching("vhost"),
        "secondary_skip": lambda s, d: _parsed(s, d).where(F.col("url").rlike(SECONDARY)).select(*PLACE),
        "exclude_codes": lambda s, d: _parsed(s, d).where(~F.col("http").isin(404, 302)).select(*PLACE),
        "benign_bot": lambda s, d: _parsed(s, d).where(F.col("url").isin(*BENIGN)).select(*PLACE),
        "verdict_chain": lambda s, d: frames(s, d).judged.select(*PLACE, "verdict"),
        "verdict_chain_options": lambda s, d: judge(_parsed(s, d), replace(RULES, secondary=True, exclude=[404])).select(*PLACE, "verdict"),
        "rejected_ips": lambda s, d: frames(s, d).rejected,
        "reject_totals": lambda s, d: frames(s, d).rejected.agg(F.count(F.lit(1)).alias("rejected"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0)).alias("blocked")),
        "blocked_ips_sorted": lambda s, d: purge.blocklist(frames(s, d).rejected).orderBy(F.col("ip_num").asc_nulls_last(), "ip"),
        "new_blocked_ips": lambda s, d: purge.new_blocked(frames(s, d).rejected, _told(frames(s, d))),
        "purged_counts": lambda s, d: purge.purged_counts(frames(s, d).judged, frames(s, d).rejected),
        "file_counters": lambda s, d: purge.file_counters(frames(s, d).judged),
        "was_redirect": lambda s, d: frames(s, d).accepted.select(*PLACE, "was_rd"),
        "entries_flat": lambda s, d: frames(s, d).entries.select(*purge.ENTRY),
        "dedupe_entries": lambda s, d: frames(s, d).entries.select(*PLACE),
        "entries_star": lambda s, d: star.resolved(store(s, d)).select("id", *purge.ENTRY),
        "hits_for_ip": lambda s, d: star.hits_for_ip(store(s, d), "10.6.78.6"),
        "records_at_dt": lambda s, d: star.records_at(store(s, d), store(s, d)["entries"].agg(F.max("dt")).first()[0]).select("id", *purge.ENTRY),
        "distinct_ips": lambda s, d: store(s, d)["entries"].select("ip").distinct(),
        "distinct_times": lambda s, d: store(s, d)["entries"].select("dt").distinct(),
        "count_ips": lambda s, d: store(s, d)["entries"].agg(F.countDistinct("ip").alias("n")),
        "not_stored_yet": lambda s, d: star.without_stored(frames(s, d).accepted, star.resolved(store(s, d)).where("http <> 404")).select(*PLACE),
        "ip_to_long": lambda s, d: _parsed(s, d).select("ip").distinct().select("ip", ip_to_long(F.col("ip")).alias("n"), ip_to_long(F.regexp_replace("ip", r"\.\d+$", "")).alias("n_short")),
        "cidr_network": lambda s, d: _parsed(s, d).select("ip").distinct().select("ip", network_address(ip_to_long(F.col("ip")), 21).alias("net")),
        "month_distance": lambda s, d: _parsed(s, d).groupBy(months_before(F.lit("2024-03-05").cast("timestamp_ntz"), F.col("dt")).alias("months")).agg(F.count(F.lit(1)).alias("n")),
        "dt_format": lambda s, d: _parsed(s, d).groupBy(display(F.col("dt")).alias("minute")).agg(F.count(F.lit(1)).alias("n")),
        "file_ledger": _ledger,
        "incremental_skip": _incremental,
        "streaming_ingest": _stream,
        "star_incremental": _two_runs,
        "ledger_upsert": lambda s, d: ledger.upsert(
            _parsed(s, d).groupBy(F.col("file").alias("name")).agg(F.min("dt").alias("dt"), F.count(F.lit(1)).alias("bytes"), F.lit(0).cast("long").alias("records")),
            _parsed(s, d).where("file > 'access.log.2'").groupBy(F.col("file").alias("name")).agg(F.max("dt").alias("dt"), F.count(F.lit(1)).alias("bytes"), F.lit(1).cast("long").alias("records")),
        ),
        "q01_duplicate_entries_raw": lambda s, d: reports.q01(_raw_store(s, d), reports.Settings()),
    }
    for c in star.DIMENSIONS:
        found[f"dim_{c}"] = lambda s, d, c=c: store(s, d)[c].select("id", "value")
    for name, report in reports.REPORTS.items():
        found[name] = lambda s, d, report=report: report(store(s, d), reports.Settings())
        found[f"{name}_sql"] = lambda s, d, name=name: reports.run_sql(store(s, d), name)
    return found


def oracle_sql() -> dict[str, str]:
    return oracle.texts()
