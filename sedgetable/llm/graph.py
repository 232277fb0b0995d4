"""Connected components of a link table by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sedgetable.llm.words import stored


def _towards_minimum(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with the least of u and all its v; combined before the shuffle, joined with skew handling."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` of every linked node; the root is the least node of its component.

    Large star: neighbours above u point to the least neighbour of u. Small star:
    those below do. Both keep the components, and edges end as stars around the
    least nodes. Self links and nulls are ignored. Every round is written to the
    shared folder, so a lost executor costs one round at most.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = stored(links.filter(F.col(a) != F.col(b)).select(high, low).distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = _towards_minimum(down)
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = stored(out.filter("u != v").distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
