import datetime as dt
import gzip
import random

import pytest
from pyspark.sql import functions as F

from siltlog.operators import ledger, purge, star
from siltlog.operators.parse import parse, rejects
from siltlog.operators.rules import Ruleset, csv_ints
from siltlog.plans import store
from siltlog.plans.ingest import ingest, ingest_files
from siltlog.sources.logs import preload, read_lines, rule_lines, seed_rules
from siltlog.streaming.ingest import stream

T = "20/Feb/2015:05:57:23 +0000"


def line(ip="1.2.3.4", vhost="site.com", url="/", http=200, ref="-", ua="ua", when=T):
    return f'{ip} {vhost} - [{when}] "GET {url} HTTP/1.1" {http} 10 "{ref}" "{ua}"'


def test_line_styles(spark):
    plain = line(vhost="Site.COM", url="/A", ua='quote " inside')
    rows = [
        (1, plain), (2, "2015-02-20 05:57:24+0000 [HTTPChannel,1,1.2.3.4] " + plain), (3, "2017-12-08T15:43:31+0000 [-] " + plain), (4, "2015-02-20 05:57:24-0500 [-] " + plain),
        (5, "2015-04-02 20:07:41+0000 [-] Starting factory"), (6, ""), (7, None), (8, line(ref="")), (9, line(vhost="site.com:80")), (10, line(ip="::1")), (11, line(when="31/Feb/2015:00:00:00 +0000")),
        (12, line(ip="999.1.1.1")), (13, "bad\x01" * 8 + "x"), (14, "2015-13-40 05:57:24+0000 [-] " + plain),
    ]
    df = spark.createDataFrame(rows, "line_key int, value string").withColumn("file", F.lit("f"))
    got = {r.line_key: r for r in parse(df).collect()}
    assert {k for k, r in got.items() if r.parsed} == {1, 2, 3, 12}
    assert (got[1].vhost, got[1].ip, got[1].url, got[1].http, got[1].ref, got[1].ua, got[1].verb, got[1].bytes) == ("site.com", "1.2.3.4", "/A", 200, "-", 'quote " inside', "GET", 10)
    assert [got[k].dt for k in (1, 2, 3)] == [dt.datetime(2015, 2, 20, 5, 57, 23), dt.datetime(2015, 2, 20, 5, 57, 24), dt.datetime(2017, 12, 8, 15, 43, 31)]
    assert rejects(parse(df)).count() == 10


def _sequential(files, rules):
    """The same by a loop over lines: verdicts, then redirect memory, purge and first-of-equals."""
    import re

    verdicts, bad = [], {}
    for f, rows in files:
        memory = set()
        for k, (ip, vhost, url, http, ref, ua) in enumerate(rows):
            was = False
            if ip in rules.ip:
                v = "ignore"
            elif re.search(rules.url[0], url) or re.search(rules.ref[0], ref):
                v = "block"
            elif http in rules.exclude:
                v = "skip"
            elif re.search(rules.ua[0], ua):
                v = "ignore"
            else:
                if http in (301, 302):
                    memory.add(ip)
                elif ip in memory:
                    memory.remove(ip)
                    was = True
                v = "block" if re.search(rules.vhost[0], vhost) else "ignore" if url == "/robots.txt" else "accept"
            if v in ("ignore", "block"):
                bad[ip] = bad.get(ip, False) or v == "block"
            verdicts.append((f, k, v, (ip, vhost, url, http, ref, ua, was)))
    kept = [x[3] for x in verdicts if x[2] == "accept" and x[3][0] not in bad]
    return bad, list(dict.fromkeys(kept))


def test_against_a_loop(spark, tmp_path):
    rng = random.Random(11)
    rules = Ruleset(ip=["10.0.0.1"], url=["/wp"], ref=["spam"], ua=["[bB]ot"], vhost=["^admin"], exclude=[500])
    files = []
    for f in "ab":
        rows = [
            (f"10.0.0.{rng.randrange(40)}", rng.choice(["x.com"] * 60 + ["admin.x.com"]), rng.choice(["/a", "/b"] * 40 + ["/wp", "/robots.txt"]), rng.choice([200, 302, 301, 404, 500]), rng.choice(["-"] * 90 + ["spam"]), rng.choice(["ua"] * 90 + ["Bot"]))
            for _ in range(400)
        ]
        files.append((f, rows))
    lines = [(f, k, line(ip, v, u, h, r, a)) for f, rows in files for k, (ip, v, u, h, r, a) in enumerate(rows)]
    frames = ingest(spark.createDataFrame(lines, "file string, line_key int, value string"), rules)
    bad, kept = _sequential(files, rules)
    assert {r.ip: r.blocked for r in frames.rejected.collect()} == bad
    got = sorted((r.ip, r.vhost, r.url, r.http, r.ref, r.ua, r.was_rd) for r in frames.entries.collect())
    assert got == sorted(kept) and any(r[-1] for r in got)
    store.append(spark, str(tmp_path / "store"), frames.entries)
    tables = store.read(spark, str(tmp_path / "store"))
    assert [r.id for r in tables["entries"].orderBy("id").collect()] == list(range(1, len(kept) + 1))
    assert star.resolved(tables).count() == len(kept) and star.hits_for_ip(tables, got[0][0]).first().hits == sum(g[0] == got[0][0] for g in got)


def test_ids_stay_and_go_on(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *x: ingest(spark.createDataFrame([(f, k, line(ip, url=u)) for f, k, ip, u in x], "file string, line_key int, value string"), Ruleset(url=["/wp"]))
    one = rows(("a", 2, "1.1.1.2", "/b"), ("a", 1, "1.1.1.1", "/a"), ("b", 0, "1.1.1.3", "/a"))
    store.take(spark, path, one.entries, one.rejected)
    told = lambda: ({r.ip: r.id for r in store.read(spark, path)["entries"].collect()}, {r.value: r.id for r in store.read(spark, path)["url"].collect()})
    assert told() == ({"1.1.1.1": 1, "1.1.1.2": 2, "1.1.1.3": 3}, {"/a": 1, "/b": 2})
    store.take(spark, path, one.entries, one.rejected)  # again: nothing is new
    two = rows(("c", 0, "1.1.1.3", "/wp"), ("c", 1, "1.1.1.1", "/a"), ("c", 2, "1.1.1.4", "/c"), ("c", 3, "1.1.1.4", "/a"), ("c", 4, "1.1.1.5", "/b"))
    store.take(spark, path, two.entries, two.rejected)
    assert told() == ({"1.1.1.1": 1, "1.1.1.2": 2, "1.1.1.4": 5, "1.1.1.5": 6}, {"/a": 1, "/b": 2, "/c": 3})  # 1.1.1.3 went; 4 and 5 are the two rows of 1.1.1.4
    entries = spark.read.parquet(f"{path}/entries")
    assert entries.select("id").distinct().count() == entries.count() == 5
    assert sorted((r.ip, r.url) for r in store.entries_view(spark, path).collect()) == [("1.1.1.1", "/a"), ("1.1.1.2", "/b"), ("1.1.1.4", "/a"), ("1.1.1.4", "/c"), ("1.1.1.5", "/b")]
    assert not [x for x in (tmp_path / "store").iterdir() if x.name.startswith("staged")]


def test_jdbc_round_trip(spark, tmp_path):
    frames = ingest(spark.createDataFrame([("a", 1, line(url="/x")), ("a", 2, line(url="/y", ref="http://r/"))], "file string, line_key int, value string"), Ruleset())
    store.append(spark, str(tmp_path / "store"), frames.entries)
    tables, url = store.read(spark, str(tmp_path / "store")), f"jdbc:derby:{tmp_path}/db;create=true"
    store.write_jdbc(tables, url, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    back = store.read_jdbc(spark, url, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    for name in store.TABLES:
        assert sorted(map(tuple, back[name].select(*tables[name].columns).collect())) == sorted(map(tuple, tables[name].collect()))


def test_address_rules_need_four_groups(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("1.2.3",), ("5",)], "ip string")
    match = lambda *rules: sorted(r.ip for r in df.where(Ruleset(ip=list(rules)).matches("ip")).collect())
    assert match("1.2.3", "5", " 1.2.3.4 ", "") == ["1.2.3.4"] and match() == [] and match("1.2.3") == []


def test_files_ledger_stream_and_blocklist(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "access.log.1").write_text("#; my.site.org\n" + line(vhost="-") + "\n" + line(url="/b") + "\n")
    with gzip.open(logs / "access.log.2.gz", "wt") as f:
        f.write(line(ip="5.5.5.5", url="/wp-admin/x") + "\n" + line(ip="5.5.5.5") + "\n" + line(ip="6.6.6.6") + "\n")
    (logs / "other.txt").write_text("no log")
    with pytest.raises(FileNotFoundError):
        read_lines(spark, str(tmp_path), "access.log")
    rules_dir = str(tmp_path / "rules")
    assert seed_rules(rules_dir) and not seed_rules(rules_dir)
    rules = Ruleset.load(rules_dir)
    assert rules.url == rule_lines(rules_dir, "url") and "/wp-(admin|login|config)" in rules.url and csv_ints("404, 500,") == [404, 500]
    frames, rows = ingest_files(spark, str(logs), rules)
    assert sorted((r.vhost, r.ip, r.url) for r in frames.entries.collect()) == [("my.site.org", "1.2.3.4", "/"), ("site.com", "1.2.3.4", "/b"), ("site.com", "6.6.6.6", "/")]
    seen = ledger.upsert(spark.createDataFrame([], ledger.SCHEMA), rows)
    assert sorted(r.records for r in seen.collect()) == [2, 2]
    left, _ = ingest_files(spark, str(logs), rules, ledger=seen.where("name like '%log.1'"))
    assert left.judged.select("file").distinct().count() == 1
    (tmp_path / "known").write_text("# list\n6.6.6.6\n\n")
    known, _ = ingest_files(spark, str(logs), rules, known=preload(spark, str(tmp_path / "known")))
    assert {r.ip: r.blocked for r in known.rejected.collect()} == {"5.5.5.5": True, "6.6.6.6": True}
    purge.write_blocklist(known.rejected, str(tmp_path / "blocked"))
    assert [r.value for r in spark.read.text(str(tmp_path / "blocked")).collect()] == ["5.5.5.5", "6.6.6.6"]
    path = str(tmp_path / "store")
    store.take(spark, path, frames.entries, frames.rejected)
    assert store.purge_ip(spark, path, spark.createDataFrame([("6.6.6.6",)], "ip string")) == 1
    assert store.read(spark, path)["entries"].count() == 2
    assert store.purge_ip(spark, path, spark.createDataFrame([("6.6.6.6",)], "ip string")) == 0
    for _ in range(2):
        stream(spark, str(logs), str(tmp_path / "live"), rules).awaitTermination()
        assert store.entries_view(spark, str(tmp_path / "live")).count() == 3
    (logs / "access.log.3").write_text(line(ip="6.6.6.6", url="/wp-admin/") + "\n" + line(ip="7.7.7.7") + "\n" + line(url="/b") + "\n")
    stream(spark, str(logs), str(tmp_path / "live"), rules).awaitTermination()
    assert sorted(r.ip for r in store.entries_view(spark, str(tmp_path / "live")).collect()) == ["1.2.3.4", "1.2.3.4", "7.7.7.7"]
