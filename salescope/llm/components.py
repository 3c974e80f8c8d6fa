"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from salescope.llm.common import stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(links: DataFrame) -> DataFrame:
    """(a, b, least): every link from both ends, with the least of a's neighbours and a itself."""
    sides = _both_ways(links)
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("least"))
    return sides.join(least, "a")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of a link reaches. ``links`` has (a, b), any order.

    Alternating star operations: every round hooks the neighbours of a node to its least
    neighbour, first the larger ones, then the smaller. Each is a partial sum and a join, so a node
    with very many links is no task of its own; each round is stored, so lineage stays short.
    """
    current = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        large = _least(current).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        hooked = down.join(least, "a").select(F.col("b").alias("x"), F.col("least").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("least").alias("y")))
        current = stored(hooked.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
    raise RuntimeError("the components did not settle")
