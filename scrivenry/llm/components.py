"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, paths_of, stage_table


def _linked(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links of long ids -> (node, component), component the smallest id reachable.

    Nodes without a link to another node are absent. Null ids are ignored, repeated links and loops are harmless,
    no links give an empty table. The rounds needed grow with the logarithm of the longest chain; if ``rounds`` don't
    suffice it raises rather than return parts of components. Each round shuffles the links only; a node of any degree is met by an
    aggregation and a join, never by one task that holds all its neighbours.
    """
    now = stage_table(_linked(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()), "links")
    mark = None
    for step in range(rounds + 1):
        if step == rounds:
            raise RuntimeError(f"links aren't stars after {rounds} rounds")
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _linked(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        before, now = now, stage_table(_linked(small), "links")
        drop(before.sparkSession, *paths_of(before))
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select("component").distinct().select(F.col("component").alias("node"), "component"))
