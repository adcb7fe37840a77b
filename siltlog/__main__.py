"""Command line: python -m siltlog [options] STORE LOGS."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from siltlog.operators.rules import csv_ints
from siltlog.plans.run import Config, run


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="siltlog", description="Read access logs into a store, without rows of rejected addresses.")
    p.add_argument("store", help="folder of the store")
    p.add_argument("logs", help="log file, or folder of log files")
    p.add_argument("-e", "--exclude", default="", help="HTTP codes to leave out, separated by commas")
    p.add_argument("-d", "--rules", default="rules", help="folder of rule files; stock rules are copied there if missing")
    p.add_argument("-y", "--secondary", action="store_true", help="leave out page parts such as pictures and style sheets")
    p.add_argument("-t", "--timestamps", action="store_true", help="leave out files that are as the ledger says")
    p.add_argument("-f", "--known", help="file of addresses to block from the start")
    p.add_argument("-s", "--save", help="folder for the list of blocked addresses")
    p.add_argument("-p", "--pattern", default="access.log", help="part of the names of log files")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("siltlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = run(spark, Config(a.logs, a.store, a.rules, a.pattern, csv_ints(a.exclude), a.secondary, a.timestamps, a.known, a.save))
    for row in out["files"].orderBy("file").toLocalIterator():
        print(f"{row['file']}: {row['n_lines']} lines, {row['n_parsed']} parsed, {row['n_accepted']} accepted")
    print(f"{out['rejected'].count()} addresses rejected, {out['rejected'].where('blocked').count()} blocked; {out['entries'].count()} entries stored")


if __name__ == "__main__":
    main()
