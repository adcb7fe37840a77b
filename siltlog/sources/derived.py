"""An access log derived from the events table, for tests, queries and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, line_key, value: four files cut from events in order, and a fifth that repeats every 50th line."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.count()
    u, k = F.col("user_id"), F.regexp_extract("props", r'"k": *(\d+)', 1).try_cast("int")
    div = lambda a, b: F.floor(a / b)
    low = lambda c: c.cast("string")
    ip = F.when(u % 25 == 1, F.concat(F.lit("114.134."), low(184 + div(u, 256) % 8), F.lit("."), low(u % 256))).otherwise(
        F.concat(F.lit("10."), low(u % 7), F.lit("."), low((u * 13) % 256), F.lit("."), low(u % 256))
    )
    http = F.when(F.col("event_type") == "error", 404).when(F.col("event_type") == "signup", 302).otherwise(200)
    vhost = F.when(u % 30 == 11, "admin.example.com").when(k % 3 == 0, "WWW.Example.com").otherwise("blog.example.org")
    url = (
        F.when((u % 10 == 3) & (k < 10), F.concat(F.lit("/wp-admin/"), low(k)))
        .when((u % 20 == 7) & (k == 50), "/robots.txt")
        .when(k % 5 == 0, F.concat(F.lit("/pics/"), low(k), F.lit(".jpg")))
        .when(k % 7 == 0, "/main.css")
        .otherwise(F.concat(F.lit("/en/"), low(k), F.lit(".html")))
    )
    ref = F.when((u % 20 == 9) & (k < 5), "http://x.semalt.com/").when(k % 2 == 0, "-").otherwise(F.concat(F.lit("http://r.example.net/"), low(k % 10)))
    ua = F.when(u % 10 == 5, "Googlebot/2.1 (+http://g/)").otherwise(F.concat(F.lit("Mozilla/5.0 (v"), low(u % 4), F.lit(")")))
    line = F.concat(
        ip, F.lit(" "), vhost, F.lit(" - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), url, F.lit(' HTTP/1.1" '), low(http), F.lit(' 10 "'), ref, F.lit('" "'), ua, F.lit('"')
    )
    lines = events.select(F.expr(f"event_id * 4 div {max(n, 1)}").cast("int").alias("_no"), F.col("event_id").alias("line_key"), line.alias("value"))
    again = lines.where(F.col("line_key") % 50 == 0).withColumn("_no", F.lit(4))
    return lines.unionAll(again).select(F.concat(F.lit("access.log."), F.col("_no").cast("string")).alias("file"), "line_key", "value")
