"""Connected components of links that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlume.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of ``edges`` (a, b).

    Stars are contracted in alternating steps: every node first hands its larger
    neighbours to the smallest node it knows, then itself and its smaller ones.
    The number of rounds grows with the logarithm of the longest chain. Each
    round is a written table, so a lost executor costs a re-read. Loops and
    repeated links are harmless; an empty table gives none.
    """
    stars = materialize(_down(edges), "components")
    size = _summary(stars)
    while True:
        stars = materialize(_small_star(_large_star(stars)), "components")
        now = _summary(stars)
        if now == size:
            break
        size = now
    roots = stars.select(F.col("low").alias("node")).distinct()
    return (
        stars.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component"))
        .unionByName(roots.withColumn("component", F.col("node")))
    )


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()


def _summary(stars: DataFrame) -> tuple[int, int]:
    row = stars.agg(
        F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("high", "low")), F.lit(0))
    ).first()
    return row[0], row[1]


def _large_star(stars: DataFrame) -> DataFrame:
    """Links from each node's larger neighbours to the smallest node it knows."""
    least = stars.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
    # A node that only has larger neighbours is itself the smallest it knows.
    up = stars.select(F.col("low").alias("node"), F.col("high").alias("other"))
    moved = up.join(least, "node", "left").select(
        F.col("other").alias("high"), F.coalesce("least", "node").alias("low")
    )
    kept = least.select(F.col("node").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(kept).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Links from each node and its smaller neighbours to the smallest of them."""
    least = stars.groupBy("high").agg(F.min("low").alias("least"))
    moved = stars.join(least, "high").where("low <> least").select(
        F.col("low").alias("high"), F.col("least").alias("low")
    )
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()
