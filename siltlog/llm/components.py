"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.llm.common import Scratch, settle

#: Nodes that a partition joins up by itself before it passes its edges on.
HELD = 200_000


def _contract(batches):
    """Edges (larger, smaller node) that tie the same nodes as those of the partition, stars of up to HELD nodes."""
    above: dict[int, int] = {}

    def top(x):
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    def told():
        out = [(x, top(x)) for x in above]
        above.clear()
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                above[max(a, b)] = min(a, b)
        if len(above) > HELD:
            yield told()
    yield told()


def _round(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Large-star, then small-star.

    Large-star ties every larger neighbour of a node to the smallest of the node
    and its neighbours; small-star ties a node and its smaller neighbours to the
    smallest of them. The smallest are written first, so that a join at a node
    with very many neighbours is between two plain scans and can be split.
    """
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.write("least", both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    down = scratch.write("large", both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    least = scratch.write("least2", down.groupBy("u").agg(F.min("v").alias("m")))
    tied = down.join(least, "u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge up, or only edges down."""
    sides = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return sides.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").limit(1).count() == 0


def components(scratch: Scratch, name: str, edges: DataFrame) -> DataFrame:
    """Table `name` of node and root (the smallest node of its component) for every node of edges(u, v) but the roots.

    Loops and repeated edges do not matter. Partitions first join up what they
    hold. Each round is written to the shared folder, so lineage stays short;
    the number of rounds grows with the log of the number of nodes.
    """
    now, after = f"{name}-0", f"{name}-1"
    edges = scratch.write(now, edges.where("u <> v").select("u", "v").mapInArrow(_contract, "u long, v long").distinct())
    while not _all_stars(edges):
        edges = scratch.write(after, _round(scratch, edges))
        scratch.drop(now, "least", "large", "least2")
        settle(scratch.spark)
        now, after = after, now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
