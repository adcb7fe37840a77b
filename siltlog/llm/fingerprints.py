"""One-permutation MinHash fingerprints, by DataFrame functions alone.

Words are hashed, each run of `shingle` words gives one 64-bit hash (a text with
fewer words is one shingle), and that hash is used once: its top bits choose one
of `bins` bins, and a bin keeps its smallest hash. Sorting the hashes puts bins
next to each other, so the first of each bin is its minimum. An empty bin takes
the value of another by optimal densification: bin i looks at bins h(i, 1),
h(i, 2), ... until one is filled, the same bins for every text; after a few fixed
looks the first filled bin in an order of its own settles it. The low `bits` bits
of all bins are packed as hexadecimal digits. Of two fingerprints, the share c
of equal digits overstates the likeness, as digits of different values agree by
chance; (c - p) / (1 - p) with p = 2^-bits corrects it, cut at 0.

Words are separated by blanks. A null text is an empty one; all texts without
words share one fingerprint. Equal texts have equal fingerprints. Rows with the
same id follow each other in the order of a hash of their text; null ids come
first. An empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltlog.llm.common import documents

BINS, BITS, SHINGLE, LOOKS = 128, 8, 5, 6
RANGES, FINE, LEAST_ROWS, MOST_ROWS = 1000, 200, 200, 20_000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+", -1), lambda w: w != "")


def _shingles(words: Column, size: int) -> Column:
    """Hash of each run of `size` words; of all words if there are fewer."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    runs = F.transform(F.sequence(F.lit(1), F.size("_wh") - (size - 1)), lambda i: F.xxhash64(*[F.element_at("_wh", i + k) for k in range(size)]))
    return hashes, F.when(F.size("_wh") >= size, runs).otherwise(F.array(F.xxhash64(F.col("_wh"))))


def _looks(bins: int, looks: int, seed: int = 5) -> list[list[int]]:
    rng = random.Random(seed)
    return [[rng.randrange(bins) for _ in range(bins)] for _ in range(looks)]


def fingerprint(df: DataFrame, text: str, out: str, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """df with column `out`: the packed fingerprint of column `text`."""
    if bits not in (4, 8) or bins & (bins - 1):
        raise ValueError("bits must be 4 or 8 and bins a power of two")
    shift = 64 - int(math.log2(bins))
    keep = [c for c in df.columns if c != out]
    words, runs = _shingles(_words(F.coalesce(F.col(text), F.lit(""))), shingle)
    hashed = df.withColumn("_wh", words).withColumn("_sh", F.sort_array(runs))
    # sorted as signed numbers, so the bin of a hash is its top bits with the sign turned: bins come in order too
    place = lambda h: (F.shiftright(h, shift) + bins // 2).cast("int")
    firsts = F.filter(F.col("_sh"), lambda h, i: (i == 0) | (place(h) != place(F.get("_sh", i - 1))))
    filled = hashed.withColumn("_f", firsts)
    filled = filled.withColumn("_m", F.map_from_arrays(F.transform("_f", place), F.transform("_f", lambda h: h)))
    filled = filled.withColumn("_v", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.try_element_at("_m", i)))
    tables = _looks(bins, LOOKS)
    last = lambda i: F.element_at("_m", F.array_min(F.transform(F.map_keys("_m"), lambda b: F.struct(F.xxhash64(F.lit(11), i, b).alias("h"), b.alias("b")))).getField("b"))
    dense = F.transform(
        F.col("_v"),
        lambda v, i: F.coalesce(v, *[F.get("_v", F.get(F.array(*[F.lit(x) for x in t]), i)) for t in tables], last(i)),
    )
    digits = bits // 4
    packed = F.array_join(F.transform(dense, lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND((1 << bits) - 1))), digits, "0")), "")
    return filled.withColumn(out, packed).select(*keep, out)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated share of shingles in common of two fingerprints, corrected for chance."""
    digits = bits // 4
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.substr(a, i * digits + 1, F.lit(digits)) == F.substr(b, i * digits + 1, F.lit(digits))))
    chance = 2.0**-bits
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (same / bins - chance) / (1 - chance)))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<c> of the row next in ascending doc_id (after the last: the first) for each column.

    docs has doc_id and _h (the order of equal ids). Rows fall into up to RANGES
    ranges of doc_id by quantiles, and where these would be large, each of them into
    up to FINE by its own quantiles (of _h, if it holds one id or none). The first
    row of each range also goes to the range before, so no range needs another and
    none holds the whole table, nor all rows of one id.
    """
    n = docs.count()
    if n == 0:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    quantiles = lambda c, k: F.percentile_approx(c, [i / k for i in range(1, k)] or [0.5], 10_000)
    below = lambda bounds, c: F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col(c))), F.lit(0))
    ranges = max(1, min(RANGES, n // LEAST_ROWS))
    cuts = sorted(set(docs.select(quantiles("doc_id", ranges)).first()[0] or [])) if ranges > 1 else []  # at most RANGES numbers
    part = below(F.array(*[F.lit(c).cast("long") for c in cuts]), "doc_id") if cuts else F.lit(0)
    placed = docs.withColumn("_part", F.when(F.col("doc_id").isNull(), -1).otherwise(part))
    fine = min(FINE, -(-n // (ranges * MOST_ROWS)))
    if fine > 1:
        one = F.min("doc_id").eqNullSafe(F.max("doc_id"))
        finer = placed.groupBy("_part").agg(one.alias("_one"), F.when(one, quantiles("_h", fine)).otherwise(quantiles("doc_id", fine)).alias("_cuts"))
        placed = placed.join(F.broadcast(finer), "_part")  # as many rows as ranges, of FINE numbers
        placed = placed.withColumn("_part", F.col("_part") * fine + F.when(F.col("_one"), below(F.col("_cuts"), "_h")).otherwise(below(F.col("_cuts"), "doc_id"))).drop("_one", "_cuts")
    key = F.struct(F.coalesce(F.col("doc_id").isNotNull().cast("int"), F.lit(0)).alias("v"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("d"), F.col("_h").alias("h"))
    whole = Window.partitionBy(F.lit(0))
    firsts = placed.groupBy("_part").agg(F.min(key).alias("_first"))
    firsts = firsts.withColumn("_before", F.coalesce(F.lag("_part").over(whole.orderBy("_part")), F.max("_part").over(whole)))
    placed = placed.join(F.broadcast(firsts), "_part")  # as many rows as ranges
    ghost = F.when(key == F.col("_first"), F.col("_before"))
    twice = F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("ghost")), F.struct(ghost.alias("p"), F.lit(1).alias("ghost")))
    rows = placed.withColumn("_to", F.explode(F.filter(twice, lambda t: t["p"].isNotNull()))).withColumns({"_part": F.col("_to.p"), "_ghost": F.col("_to.ghost")})
    w = Window.partitionBy("_part").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "_h")
    out = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return out.where("_ghost = 0").drop("_part", "_first", "_before", "_ghost", "_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("_h", F.xxhash64("text"))
    marked = with_next(fingerprint(docs, "text", "fingerprint"), ["text", "fingerprint"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    marked = marked.withColumn("edited", edited).withColumn("n_chars", n.cast("long")).withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)).drop("text", "next_text", "_h")
    return fingerprint(marked, "edited", "edited_fingerprint").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
