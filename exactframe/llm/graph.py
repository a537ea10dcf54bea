"""Connected components of a link table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, nodes_of: DataFrame, larger: bool) -> DataFrame:
    """One star step. ``nodes_of`` holds (u, v): the neighbours v that u looks at. Everyone's smallest neighbour takes its place."""
    least = nodes_of.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = nodes_of.join(least, "u")
    if larger:
        return moved.filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = moved.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.filter("u != m").select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id that occurs in ``links`` (its columns a, b) with the smallest id it can reach.

    Alternates the large-star and small-star steps of Kiveris et al. (SoCC 2014) until the edges stand still. A
    hub's edges are never gathered: minima are combined before the shuffle, and the join back can be split.
    Null ends, loops and repeated links change nothing; no links give an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(edges, both, True).distinct()
        small = stored(_star(large, large, False).distinct(), "edges")
        discard(edges)
        edges = small
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
