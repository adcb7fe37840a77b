"""Log lines to columns. Lines that no pattern fits are kept as rejects, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltlog.functions.dates import clf_timestamp
from siltlog.functions.net import let

PREFIX = r"^(\d{4}-\d{2}-\d{2})[\sT](\d{2}:\d{2}:\d{2})\+\d+\s+\[.+?\]\s+(.+)\s*$"
LINE = (
    r"^(\d{1,3}(?:\.\d{1,3}){3})\s+([\w\-.]+)\s+-\s+\[(.+?)\]\s+\"([A-Z]+)\s+(\S+)\s+[^\s\"]+\""
    r"\s+(\d{3})\s+(\d+|-)\s+\"(.+?)\"\s+\"(.+?)\"\s*$"
)
VALUES = ("vhost", "url", "ref", "ua")
#: Stands between the groups that one pattern match yields; lines are freed of it first.
CUT = "\u0001"
FIELDS = ("parsed", "vhost", "ip", "dt", "url", "http", "ref", "ua", "verb", "bytes")


def _groups(text: Column, pattern: str, n: int, first: str = "") -> Column:
    """The n groups of a pattern in one match: an array of n parts, or of another number if it does not fit."""
    return F.split(F.regexp_replace(text, pattern, first + CUT.join(f"${k}" for k in range(1, n + 1))), CUT, -1)


def fields(line: Column) -> Column:
    """Struct of FIELDS of a line; the pattern is matched once."""

    def head(p: Column) -> Column:
        # with a prefix: its date, its time, the rest; else just the line
        has = F.size(p) == 3
        before = F.concat_ws(" ", F.get(p, F.lit(0)), F.get(p, F.lit(1))).try_cast("timestamp_ntz")
        body = F.element_at(p, -1)
        return F.struct(has.alias("has"), F.when(has, before).alias("before"), _groups(body, LINE, 9).alias("g"))

    def row(h: Column) -> Column:
        g = lambda k: F.get(h["g"], F.lit(k - 1))
        fits = F.size(h["g"]) == 9
        only = lambda c: F.when(fits, c)
        dt = only(F.when(h["has"], h["before"]).otherwise(clf_timestamp(g(3))))
        return let(
            dt,
            lambda t: F.struct(
                (fits & t.isNotNull()).alias("parsed"), only(F.lower(g(2))).alias("vhost"), only(g(1)).alias("ip"), t.alias("dt"), only(g(5)).alias("url"),
                only(g(6).try_cast("int")).alias("http"), only(g(8)).alias("ref"), only(g(9)).alias("ua"), only(g(4)).alias("verb"), only(g(7).try_cast("long")).alias("bytes"),
            ),
        )

    free = F.translate(F.coalesce(line, F.lit("")), CUT, "\ufffd")
    return let(let(_groups(free, PREFIX, 3), head), row)


def parse(lines: DataFrame, vhosts: DataFrame | None = None, line: str = "value") -> DataFrame:
    """lines with FIELDS; parsed tells whether a line fits.

    A time in front of the line wins over the one in it. vhosts(file, file_vhost)
    names the host of lines that have none. The fields come out of a generator,
    so that no filter on them is pushed below it and matched again.
    """
    df = lines.select("*", F.inline(F.array(fields(F.col(line)))))
    if vhosts is None:
        return df
    host = F.when(F.col("vhost") == "-", F.coalesce("file_vhost", F.lit("-"))).otherwise(F.col("vhost"))
    return df.join(vhosts, "file", "left").withColumn("vhost", host).drop("file_vhost")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("parsed")).select("file", "line_key", "value")


def truncate(df: DataFrame, width: int = 255) -> DataFrame:
    """Values longer than the store keeps are cut before anything compares them."""
    return df.withColumns({c: F.left(F.col(c), F.lit(width)) for c in VALUES})
