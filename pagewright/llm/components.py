"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import materialize, release


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """``node``, ``component`` (the smallest node of the component) for every node of ``links``.

    Links are undirected; self links, repeated links and nulls are ignored (a node
    that only has such links has no row). Each round replaces every neighbourhood by a
    star at its smallest node; a hub with very many neighbours costs a partial
    aggregate and a join, never a list. Ends when a round changes nothing.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") > F.col("v")).distinct()
    edges = materialize(edges, "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_m, "u")
        star = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_m.select("u", F.col("m").alias("v")))
        edges, old = materialize(star.where(F.col("u") > F.col("v")).distinct(), "edges"), edges
        release(old)
        # One row per round: how many links there are and a checksum of them.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
