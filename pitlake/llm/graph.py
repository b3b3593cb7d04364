"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.functions.landing import land


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs in any direction, with repeats and self links -> (node, component).

    The component is the smallest node reachable; only nodes of a link between two different nodes
    are returned. Every step is an aggregate (combined before its shuffle) and an equi-join, so a node
    with a third of all links is split by the adaptive skew join. Each round is landed; the number of
    rounds grows with the logarithm of the longest chain. Null ends are dropped; an empty table gives none.
    """
    edges = land(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u > v").distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u > v").distinct()
        )
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = land(
            large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct(),
            "links",
        )
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("u").cast("decimal(38,0)")).alias("u"),
            F.sum(F.col("v").cast("decimal(38,0)")).alias("v"),
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
