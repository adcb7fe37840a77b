"""Access-log files and rule files."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = r"^[#;]*\s*(\S+\.\S+)\s*$"


def read_lines(spark: SparkSession, paths: str | list[str], pattern: str = "access.log") -> DataFrame:
    """file, line_key, value and the files' time and size of all lines of plain or gzip logs.

    A directory is searched for names that contain `pattern`; a file is taken as
    it is. line_key orders the lines of a file and is made right at the scan.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    fs = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = fs(p)
        system = path.getFileSystem(conf)
        if not system.exists(path):
            raise FileNotFoundError(p)
        if system.getFileStatus(path).isDirectory():
            found += [s.getPath().toString() for s in system.listStatus(path) if s.isFile() and pattern in s.getPath().getName()]
        else:
            found.append(path.toString())
    if not found:
        raise FileNotFoundError(f"no log file with {pattern!r} in its name in {', '.join(paths)}")
    lines = spark.read.text(sorted(found))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("line_key"),
        "value",
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("file_dt"),
        F.col("_metadata.file_size").alias("file_bytes"),
    )


def file_vhosts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines without header lines, file and vhost of files whose first line names one)."""
    first = lines.groupBy("file").agg(F.min(F.struct("line_key", "value")).alias("first"))
    name = F.regexp_extract("first.value", HEADER, 1)
    inner = name.rlike(r"^[^.].*\.[^.]") & (F.col("first.value").rlike(HEADER))
    heads = first.where(inner).select("file", F.lower(name).alias("file_vhost"), F.col("first.line_key").alias("_head"))
    rest = lines.join(heads.select("file", "_head"), "file", "left").where(F.col("_head").isNull() | (F.col("line_key") != F.col("_head"))).drop("_head")
    return rest, heads.select("file", "file_vhost")


def rule_lines(directory: str, extension: str) -> list[str]:
    """Lines of all rule files of an extension, without blank and comment lines."""
    out = []
    for name in sorted(os.listdir(directory)):
        if name.endswith(f".{extension}"):
            out += _lines(Path(directory, name).read_text(encoding="utf-8"))
    return out


def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def seed_rules(directory: str, stock: str | None = None) -> list[str]:
    """Copy stock rule files that are not in the directory yet; the names copied."""
    stock = stock or str(Path(__file__).parent / "rules")
    os.makedirs(directory, exist_ok=True)
    missing = [n for n in sorted(os.listdir(stock)) if not os.path.exists(os.path.join(directory, n))]
    for name in missing:
        shutil.copyfile(os.path.join(stock, name), os.path.join(directory, name))
    return missing


def preload(spark: SparkSession, path: str) -> DataFrame:
    """(ip, blocked) of an address list, one a line; blank and # lines are skipped."""
    value = F.trim("value")
    return spark.read.text(path).where((value != "") & ~value.startswith("#")).select(value.alias("ip"), F.lit(True).alias("blocked")).distinct()
