"""Connected components of a link table, by alternating stars: a round per doubling of the reach, not one per link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.session import cut_lineage


def _towards_smallest(edges: DataFrame, own: bool) -> DataFrame:
    """Links every node's neighbours to the smallest of them and itself; own: its smaller neighbours and itself, else its larger ones."""
    if own:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("_low"))
    moved = (seen if own else seen.where("b > a")).join(smallest, "a").select(F.col("b").alias("a"), F.col("_low").alias("b"))
    if own:
        moved = moved.unionByName(smallest.select("a", F.col("_low").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node with a link to another one, the smallest node that links lead to.

    Links of a node to itself and links with a NULL end count for nothing; without links the result is empty.
    """
    edges = cut_lineage(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    mark, known = (F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))), None
    while (now := tuple(edges.agg(*mark).first())) != known and now[0]:
        known, edges = now, cut_lineage(_towards_smallest(_towards_smallest(edges, own=False), own=True))
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
