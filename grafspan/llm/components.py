"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, stage: Stage, most_rounds: int = 60) -> DataFrame:
    """Links (a, b) of any comparable type to (node, root): root is the smallest node of the component.

    Each round ties the larger neighbours of every node, then its smaller ones, to the smallest of
    them. Edges never grow in number, and stop changing when every node hangs on its root, after
    O(log n) rounds in practice. Minima are pre-aggregated, and a node of many neighbours costs one
    split of a shuffled join. Nothing but a count and a checksum reaches the driver.
    """
    edges = stage.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _mark(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after, old = stage.write(small, "edges"), edges
        edges, now = after, _mark(after)
        stage.drop(old)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
