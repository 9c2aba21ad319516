"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import drop, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    over = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return over.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``edges`` (two long columns).

    A null end drops its edge; loops, repeated and reversed edges change nothing; no edges give no rows. Each round
    is a shuffle of the edges, written to the shared folder, and the number of rounds grows with the logarithm of the
    number of nodes. Nothing is gathered on the driver but a count and a checksum.
    """
    a, b = edges.columns
    current = (
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    current, before = written(current, "edges"), None
    while True:
        after = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            break
        before = after
        following = written(_small_star(_large_star(current).distinct()).distinct(), "edges")
        drop(current)
        current = following
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select("v", "v").distinct()
    )
