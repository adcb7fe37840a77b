import datetime as dt
import ipaddress
import random

from pyspark.sql import functions as F

from siltlog.functions.dates import clf_timestamp, display, months_before
from siltlog.functions.net import collapse, ip_in, ip_to_long, network_address, parse_network


def test_ip_to_long(spark):
    rows = [("1.2.3.4", 16909060), ("10.1", 10 * 2**24 + 1), ("7", 7 * 2**24), ("1.2.3", 2**24 + 2 * 256 + 3), ("256.1.1.1", None), ("a.b.c.d", None), ("1.2.3.4.5", None), ("", None), (None, None), ("1..2.3", None)]
    df = spark.createDataFrame(rows, "ip string, want long")
    assert [(r.ip, r.n) for r in df.select("ip", ip_to_long(F.col("ip")).alias("n")).collect()] == rows


def test_networks(spark):
    rng = random.Random(5)
    rules = ["109.207.200.0/21", "109.227.64.0/18 comment", "10.0.0.0/8", "10.0.0.0/24", "1.2.3.4", "300.1.1.1/8", "1.1.1.1/33"]
    found = [n for n in map(parse_network, rules) if n]
    assert len(found) == 4 and len(collapse(found)) == 3
    nets = [ipaddress.ip_network((net, bits)) for net, bits in found]
    ips = ["109.207.200.0", "109.207.201.10", "109.227.67.33", "109.206.250.240", "10.0.0.9", "10.255.1.1", "11.0.0.0"] + [str(ipaddress.ip_address(rng.randrange(2**32))) for _ in range(300)]
    got = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", ip_in(F.col("ip"), found).alias("hit"), network_address(ip_to_long(F.col("ip")), 21).alias("net")).collect()
    for r in got:
        a = ipaddress.ip_address(r.ip)
        assert r.hit == any(a in n for n in nets) and r.net == int(ipaddress.ip_network(f"{r.ip}/21", strict=False).network_address)
    assert not spark.createDataFrame([("999.1.1.1",)], "ip string").select(ip_in(F.col("ip"), found).alias("h")).first().h


def test_times(spark):
    rows = [("20/Feb/2015:05:57:23 +0000", dt.datetime(2015, 2, 20, 5, 57, 23)), ("1/Mar/2016:00:00:00 -0400", dt.datetime(2016, 3, 1)), ("31/Feb/2015:00:00:00 +0000", None), ("01/feb/2015:00:00:00", None), ("junk", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, want timestamp_ntz").select(clf_timestamp(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    one = spark.sql("select timestamp_ntz'2023-11-30 23:59:00' a, timestamp_ntz'2024-01-31 00:00:00' b").select(months_before(F.col("b"), F.col("a")).alias("m"), display(F.col("a")).alias("s")).first()
    assert (one.m, one.s) == (2, "2023-11-30+23:59")
