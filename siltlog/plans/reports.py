"""The eighteen reports over the star schema, as DataFrame code and as SQL text.

`now` is the parameter as_of. Where a limit could cut through equal rows, the
remaining columns break the tie. Dimension joins carry no hint: their size is the
planner's to check.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Settings:
    """What a site fills in: its host (for patterns, dots escaped), two picture URLs and the day of the report."""

    host: str = r"example\.com"
    picture: str = "/pics/15.jpg"
    everyone: str = "/pics/15.jpg"
    as_of: str = "2024-01-31 00:00:00"


#: Page parts, and files that are no pages.
ASSETS = r"\.(jpg|png|gif|ico|css)"
FILES = r"\.(jpe?g|gif|png|ico|txt|css|ttf|woff|eot.)$"
Tables = dict[str, DataFrame]


def _with(t: Tables, *dims: str, entries: DataFrame | None = None) -> DataFrame:
    df = t["entries"] if entries is None else entries
    for d in dims:
        df = df.join(t[d].select(F.col("id").alias(f"id_{d}"), F.col("value").alias(d)), f"id_{d}")
    return df


def _today(s: Settings) -> Column:
    return F.to_date(F.lit(s.as_of))


def _since(t: Tables, s: Settings, days: int) -> DataFrame:
    """Entries of the last so many days: only their partitions are read."""
    return t["entries"].where(F.col("day") > F.date_sub(_today(s), days))


YR, MO, DAY = F.year, F.month, F.dayofmonth
_ymd = lambda *names: [{"YR": YR, "MO": MO, "DAY": DAY}[n]("dt").alias(n) for n in names]
_uniques = lambda: F.countDistinct("ip").alias("N")


def _count(df: DataFrame, agg: Column, *keys: Column) -> DataFrame:
    return df.groupBy(*keys).agg(agg)


def q01(t: Tables, s: Settings) -> DataFrame:
    """Pairs of rows that are equal in all but the id (none in a deduplicated store)."""
    e = t["entries"]
    e = e.drop("day")
    keys = [c for c in e.columns if c != "id"]
    a, b = e.select(*[F.col(c).alias(f"{c}_1") for c in e.columns]), e.select(*[F.col(c).alias(f"{c}_2") for c in e.columns])
    on = F.col("id_1") != F.col("id_2")
    for c in keys:
        on = on & (F.col(f"{c}_1") == F.col(f"{c}_2"))
    return a.join(b, on)


def _latest(df: DataFrame, n: int = 1000) -> DataFrame:
    return df.orderBy(F.desc("dt"), F.desc("id")).limit(n)


def q02(t: Tables, s: Settings) -> DataFrame:
    top = _latest(_with(t, "url").where((F.col("http") != 404) & ~F.col("url").rlike(r"\.(css|ico)$")))
    df = _latest(_with(t, "vhost", "ref", "ua", entries=top))  # what else is shown of the rows that are
    return df.select(F.col("dt").alias("DT"), F.col("ip").alias("IP"), "http", F.col("was_rd").alias("RD"), F.col("vhost").alias("VHOST"), F.col("url").alias("URL"), F.left("ref", F.lit(80)).alias("REF"), F.left("ua", F.lit(80)).alias("UA"))


def q03(t: Tables, s: Settings) -> DataFrame:
    recent = t["entries"].where(F.col("day") >= F.trunc(F.add_months(_today(s), -1), "month"))
    df = _with(t, "vhost", "url", entries=recent).where(F.col("vhost").rlike(rf"(www\.)?{s.host}") & (F.col("http") != 404) & F.col("url").rlike(r"/pics/.+\.(jpg|png)$"))
    return _count(df, _uniques(), *_ymd("YR", "MO", "DAY"), F.col("url").alias("URL")).select("YR", "MO", "DAY", "N", "URL").orderBy(F.desc("YR"), F.desc("MO"), F.desc("DAY"), F.desc("N"), "URL")


def q04(t: Tables, s: Settings) -> DataFrame:
    df = _with(t, "url").where((F.col("http") != 404) & F.col("url").rlike(r"/pics/.+\.(jpg|png)$"))
    return _count(df, _uniques(), *_ymd("YR", "MO"), F.col("url").alias("URL")).select("YR", "MO", "N", "URL").orderBy(F.desc("YR"), F.desc("MO"), F.desc("N"), "URL").limit(1000)


def q05(t: Tables, s: Settings) -> DataFrame:
    df = _with(t, "vhost", "url", entries=_since(t, s, 366)).where(F.col("url").rlike(r"\.html$") & (F.col("http") != 404))
    df = _count(df, _uniques(), *_ymd("YR", "MO"), F.col("vhost").alias("VHOST"), F.col("url").alias("URL")).where("N > 5")
    return df.select("YR", "MO", "N", "VHOST", "URL").orderBy("VHOST", F.desc("YR"), F.desc("MO"), F.desc("N"), "URL")


def q06(t: Tables, s: Settings) -> DataFrame:
    df = _with(t, "vhost").where(~F.col("vhost").rlike("[0-9]"))
    return _count(df, F.count("ip").alias("N"), F.col("vhost").alias("HOST")).select("N", "HOST").orderBy(F.desc("N"), "HOST")


def q07(t: Tables, s: Settings) -> DataFrame:
    df = _latest(_with(t, "vhost", "url", "ua", "ref", entries=_latest(t["entries"])))
    cut = lambda c, n: F.left(c, F.lit(n)).alias(c.upper())
    return df.select(F.col("dt").alias("DT"), F.col("ip").alias("IP"), "http", cut("vhost", 40), cut("url", 60), cut("ua", 60), cut("ref", 60))


def q08(t: Tables, s: Settings) -> DataFrame:
    df = _with(t, "vhost", "url", "ref", entries=_since(t, s, 10)).where(F.col("http").between(200, 300) & ~F.col("url").rlike(FILES)).orderBy("vhost", F.desc("dt"), "id")
    return df.select(*_ymd("YR", "MO"), F.col("ip").alias("IP"), F.col("vhost").alias("VHOST"), F.col("url").alias("URL"), F.col("was_rd").alias("RD"), F.col("ref").alias("REFERRER"))


def q09(t: Tables, s: Settings) -> DataFrame:
    df = _with(t, "vhost", "url", entries=_since(t, s, 180)).where(F.col("url").rlike(r"\.html$") & (F.col("http") != 404))
    df = _count(df, _uniques(), *_ymd("YR", "MO", "DAY"), F.col("vhost").alias("VHOST"), F.col("url").alias("URL"))
    return df.select("YR", "MO", "DAY", "N", "VHOST", "URL").orderBy(F.desc("YR"), F.desc("MO"), F.desc("DAY"), F.desc("N"), "VHOST", "URL")


def q10(t: Tables, s: Settings) -> DataFrame:
    df = _with(t, "vhost", "url", "ua", "ref").where(F.col("vhost").rlike(rf"(www\.)?{s.host}") & (F.col("url") == s.picture) & (F.col("http") != 404))
    return df.select(*_ymd("YR", "MO", "DAY"), F.col("ua").alias("USER_AGENT"), F.col("ref").alias("REFERRER")).orderBy(F.desc("YR"), F.desc("MO"), F.desc("DAY"), "USER_AGENT", "REFERRER")


def q11(t: Tables, s: Settings) -> DataFrame:
    month = t["entries"].where(F.col("day").between(F.trunc(_today(s), "month"), F.last_day(_today(s))))
    df = _with(t, "ref", "url", entries=month).where((F.col("http") != 404) & (F.col("url") == s.everyone))
    return df.select(*_ymd("YR", "MO", "DAY"), F.col("ip").alias("IP"), F.col("ref").alias("REFERRER")).orderBy(F.desc("YR"), F.desc("MO"), F.desc("DAY"), "IP", "REFERRER").limit(1000)


def q12(t: Tables, s: Settings) -> DataFrame:
    df = _with(t, "url", entries=_since(t, s, 300)).where((F.col("http") != 404) & ~F.col("url").rlike(ASSETS))
    return _count(df, F.countDistinct("id_url").alias("N"), F.col("ip").alias("IP")).where("N > 10").select("N", "IP").orderBy(F.desc("N"), "IP")


def q13(t: Tables, s: Settings) -> DataFrame:
    df = _with(t, "ua", "url").where((F.col("http") == 404) & ~F.col("url").like("/favicon%") & ~F.col("url").like("/apple-%"))
    return _count(df, F.countDistinct("id_url").alias("N"), F.col("ua").alias("UA")).where("N > 2").select("N", "UA").orderBy(F.desc("N"), "UA")


def q14(t: Tables, s: Settings) -> DataFrame:
    return _count(_with(t, "vhost"), _uniques(), F.col("vhost").alias("VHOST")).select("N", "VHOST").orderBy(F.desc("N"), "VHOST").limit(100)


def _visits(t: Tables, s: Settings) -> DataFrame:
    return _with(t, "vhost", "url").where(F.col("vhost").rlike(rf"^(www\.)?{s.host}") & (F.col("http") != 404) & ~F.col("url").rlike(ASSETS))


def q15(t: Tables, s: Settings) -> DataFrame:
    df = _count(_visits(t, s), _uniques(), F.col("url").alias("URL"), *_ymd("YR", "MO")).where("N > 1")
    return df.select("YR", "MO", "N", "URL").orderBy(F.desc("YR"), F.desc("MO"), F.desc("N"), "URL")


def q16(t: Tables, s: Settings) -> DataFrame:
    df = _count(_visits(t, s), F.countDistinct("id_url").alias("N"), F.col("ip").alias("IP"), *_ymd("YR", "MO")).where("N > 1")
    return df.select("YR", "MO", "N", "IP").orderBy(F.desc("YR"), F.desc("MO"), F.desc("N"), "IP")


def q17(t: Tables, s: Settings) -> DataFrame:
    df = _with(t, "vhost", "url").where(F.col("vhost").rlike(rf"(www\.)?{s.host}") & (F.col("http") != 404) & F.col("url").rlike(r"/pics/.+\.jpg"))
    df = _count(df, _uniques(), *_ymd("YR", "MO"), F.col("url").alias("URL")).where("N > 10")
    return df.select("YR", "MO", "N", "URL").orderBy(F.desc("YR"), F.desc("MO"), F.desc("N"), "URL")


def q18(t: Tables, s: Settings) -> DataFrame:
    df = _with(t, "url").where((F.col("http") == 404) & ~F.col("url").rlike("^/(apple|favicon)"))
    return _count(df, _uniques(), F.col("url").alias("URL")).where("N > 1").select("N", "URL").orderBy(F.desc("N"), "URL")


REPORTS: dict[str, Callable[[Tables, Settings], DataFrame]] = {
    "q01_duplicate_entries": q01, "q02_entries": q02, "q03_images_current_month": q03, "q04_images": q04, "q05_monthly_hits_by_url": q05, "q06_numeric_vhost": q06,
    "q07_recent_entries": q07, "q08_recent_hits": q08, "q09_recent_html_hits": q09, "q10_referrer_on_image": q10, "q11_referrer": q11, "q12_prolific_visitors": q12,
    "q13_ua_with_many_404": q13, "q14_unique_ip_on_vhost": q14, "q15_unique_visitors_by_url": q15, "q16_unique_visitors": q16, "q17_uniques_on_image": q17, "q18_urls_on_404": q18,
}


def sql(name: str, s: Settings | None = None, dialect: str = "spark") -> str:
    """A report as SQL over entries, vhost, url, ref and ua, for Spark or DuckDB."""
    s = s or Settings()
    duck = dialect == "duckdb"
    rx = lambda c, p: f"regexp_matches({c}, '{p}')" if duck else f"({c} rlike r'{p}')"
    part = lambda f: f"cast({f}(e.dt) as int)"
    yr, mo, day = f"{part('year')} AS YR", f"{part('month')} AS MO", f"{part('day')} AS DAY"
    now = f"TIMESTAMP '{s.as_of}'" if duck else f"TIMESTAMP_NTZ '{s.as_of}'"
    # Spark's store is partitioned by day
    since = lambda n: f"date_diff('day', e.dt, {now}) < {n}" if duck else f"e.day > date_sub(DATE({now}), {n})"
    months = f"12 * (year({now}) - year(e.dt)) + month({now}) - month(e.dt) < 2" if duck else f"e.day >= trunc(add_months({now}, -1), 'month')"
    month = f"year(e.dt) = year({now}) AND month(e.dt) = month({now})" if duck else f"e.day BETWEEN trunc({now}, 'month') AND last_day({now})"
    dims = lambda *d, of="entries": f"FROM {of} e " + " ".join(f"JOIN {x} ON e.id_{x} = {x}.id" for x in d)
    ip, n_ip, n_url = "e.ip AS IP", "count(DISTINCT e.ip) AS N", "count(DISTINCT e.id_url) AS N"
    ok, vhost, url, ref, ua = "e.http <> 404", "vhost.value", "url.value", "ref.value", "ua.value"
    group = lambda cols, keys, tail, where, *d: f"SELECT {cols} {dims(*d)} WHERE {where} GROUP BY {keys} {tail}"
    pics, host = rx(url, r"/pics/.+\.(jpg|png)$"), rx(vhost, rf"(www\.)?{s.host}")
    visits = f"{rx(vhost, rf'^(www\.)?{s.host}')} AND {ok} AND NOT {rx(url, ASSETS)}"
    page = r"\.(css|ico)$"
    y, m, d = part("year"), part("month"), part("day")
    both = ("id", "dt", "ip", "http", "was_rd", "id_vhost", "id_url", "id_ref", "id_ua")
    texts = {
        "q01": f"SELECT {', '.join(f'a.{c} AS {c}_1, b.{c} AS {c}_2' for c in both)} FROM entries a JOIN entries b ON a.id <> b.id AND {' AND '.join(f'a.{c} = b.{c}' for c in both[1:])}",
        "q02": f"SELECT e.dt AS DT, {ip}, e.http AS http, e.was_rd AS RD, {vhost} AS VHOST, e.url AS URL, left({ref}, 80) AS REF, left({ua}, 80) AS UA {dims('vhost', 'ua', 'ref', of=f'(SELECT e.*, {url} AS url {dims("url")} WHERE {ok} AND NOT {rx(url, page)} ORDER BY e.dt DESC, e.id DESC LIMIT 1000)')} ORDER BY e.dt DESC, e.id DESC",
        "q03": group(f"{yr}, {mo}, {day}, {n_ip}, {url} AS URL", f"{y}, {m}, {d}, {url}", "ORDER BY YR DESC, MO DESC, DAY DESC, N DESC, URL", f"{host} AND {ok} AND {months} AND {pics}", "vhost", "url"),
        "q04": group(f"{yr}, {mo}, {n_ip}, {url} AS URL", f"{y}, {m}, {url}", "ORDER BY YR DESC, MO DESC, N DESC, URL LIMIT 1000", f"{ok} AND {pics}", "url"),
        "q05": group(f"{yr}, {mo}, {n_ip}, {vhost} AS VHOST, {url} AS URL", f"{y}, {m}, {vhost}, {url}", "HAVING count(DISTINCT e.ip) > 5 ORDER BY VHOST, YR DESC, MO DESC, N DESC, URL", f"{rx(url, r'\.html$')} AND {ok} AND {since(366)}", "vhost", "url"),
        "q06": group(f"count(e.ip) AS N, {vhost} AS HOST", vhost, "ORDER BY N DESC, HOST", f"NOT {rx(vhost, '[0-9]')}", "vhost"),
        "q07": f"SELECT e.dt AS DT, {ip}, e.http AS http, left({vhost}, 40) AS VHOST, left({url}, 60) AS URL, left({ua}, 60) AS UA, left({ref}, 60) AS REF {dims('vhost', 'url', 'ua', 'ref', of='(SELECT * FROM entries ORDER BY dt DESC, id DESC LIMIT 1000)')} ORDER BY e.dt DESC, e.id DESC",
        "q08": f"SELECT {yr}, {mo}, {ip}, {vhost} AS VHOST, {url} AS URL, e.was_rd AS RD, {ref} AS REFERRER {dims('vhost', 'url', 'ref')} WHERE {since(10)} AND e.http BETWEEN 200 AND 300 AND NOT {rx(url, FILES)} ORDER BY {vhost}, e.dt DESC, e.id",
        "q09": group(f"{yr}, {mo}, {day}, {n_ip}, {vhost} AS VHOST, {url} AS URL", f"{y}, {m}, {d}, {vhost}, {url}", "ORDER BY YR DESC, MO DESC, DAY DESC, N DESC, VHOST, URL", f"{rx(url, r'\.html$')} AND {ok} AND {since(180)}", "vhost", "url"),
        "q10": f"SELECT {yr}, {mo}, {day}, {ua} AS USER_AGENT, {ref} AS REFERRER {dims('vhost', 'url', 'ua', 'ref')} WHERE {host} AND {url} = '{s.picture}' AND {ok} ORDER BY YR DESC, MO DESC, DAY DESC, USER_AGENT, REFERRER",
        "q11": f"SELECT {yr}, {mo}, {day}, {ip}, {ref} AS REFERRER {dims('ref', 'url')} WHERE {ok} AND {month} AND {url} = '{s.everyone}' ORDER BY YR DESC, MO DESC, DAY DESC, IP, REFERRER LIMIT 1000",
        "q12": group(f"{n_url}, {ip}", "e.ip", "HAVING count(DISTINCT e.id_url) > 10 ORDER BY N DESC, IP", f"{ok} AND NOT {rx(url, ASSETS)} AND {since(300)}", "url"),
        "q13": group(f"{n_url}, {ua} AS UA", ua, "HAVING count(DISTINCT e.id_url) > 2 ORDER BY N DESC, UA", f"e.http = 404 AND {url} NOT LIKE '/favicon%' AND {url} NOT LIKE '/apple-%'", "ua", "url"),
        "q14": group(f"{n_ip}, {vhost} AS VHOST", vhost, "ORDER BY N DESC, VHOST LIMIT 100", "true", "vhost"),
        "q15": group(f"{yr}, {mo}, {n_ip}, {url} AS URL", f"{url}, {y}, {m}", "HAVING count(DISTINCT e.ip) > 1 ORDER BY YR DESC, MO DESC, N DESC, URL", visits, "vhost", "url"),
        "q16": group(f"{yr}, {mo}, {n_url}, {ip}", f"e.ip, {y}, {m}", "HAVING count(DISTINCT e.id_url) > 1 ORDER BY YR DESC, MO DESC, N DESC, IP", visits, "vhost", "url"),
        "q17": group(f"{yr}, {mo}, {n_ip}, {url} AS URL", f"{y}, {m}, {url}", "HAVING count(DISTINCT e.ip) > 10 ORDER BY YR DESC, MO DESC, N DESC, URL", f"{host} AND {ok} AND {rx(url, r'/pics/.+\.jpg')}", "vhost", "url"),
        "q18": group(f"{n_ip}, {url} AS URL", url, "HAVING count(DISTINCT e.ip) > 1 ORDER BY N DESC, URL", f"e.http = 404 AND NOT {rx(url, '^/(apple|favicon)')}", "url"),
    }
    return texts[name[:3]]


def run_sql(tables: Tables, name: str, s: Settings | None = None) -> DataFrame:
    """A report by its SQL text, over temporary views of the tables."""
    spark = tables["entries"].sparkSession
    for n, df in tables.items():
        df.createOrReplaceTempView(n)
    return spark.sql(sql(name, s))
