"""Connected components of links as DataFrames, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glazier.llm.common import stored, tasks_for

EDGES = 100_000  # links a task writes, at most that many where shuffle partitions allow


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link, and that to a node without any: then the links name the components."""
    ends = edges.union(edges.select(F.col("v").alias("u"), "v")).groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return ends.filter("low <> high").limit(1).count() == 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) with u > v.  Large: every greater neighbour of a node is linked to the
    node's least neighbour; small: every lesser one (and the node)."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """(id, component) of every node of ``links``; a component is named by its least id.  With ``rows``, the number
    of links, the rounds are written by as many tasks as so many links need.

    Each round is written to the shared folder, so a lost executor repeats one round only.  Rounds
    end when all links are stars; their number grows with the logarithm of the components' size.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    while True:
        starred = _star(_star(edges, large=True), large=False)
        if rows is not None:
            starred = starred.coalesce(tasks_for(links.sparkSession, rows, EDGES))
        edges = stored(starred, "stars")
        if _settled(edges):
            break
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
