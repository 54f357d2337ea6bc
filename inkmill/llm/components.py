"""Connected components by alternating large-star and small-star steps, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, partitions, settle


def _to_least(edges: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """edges (u, v) with the least neighbour m of u. Ids with over `hot` neighbours, few by its choice, are looked up without dealing their edges by id."""
    hubs = F.broadcast(least.where(F.col("d") > hot).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("d") <= hot).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): for each id in a link, the smallest id that it can reach.

    Neighbours are counted and their least found by partial sums. An id of more neighbours than an eighth of a mean partition of
    links is a hub: there are at most 16 for each partition, and their edges stay where they are.
    """
    edges = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    seen, n = None, partitions(links.sparkSession)
    while True:
        # The same edges as before: as many, with the same two sums of 64-bit hashes.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", F.lit(7), "u"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen, hot = now, max(1000, now[0] // (8 * n))
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("d"))
        large = settle(_to_least(both.where("v > u"), least, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
        small = _to_least(large, least, hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        new = settle(small.distinct(), "edges")
        forget(edges, large)
        edges = new
