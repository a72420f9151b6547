"""Connected groups of items that share nodes, for work that must stay in order inside a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glazier.plans.session import forget, stored


def _hook(links: DataFrame, both_ways: bool) -> DataFrame:
    """Links (high, low) after every node told its neighbours of the least node it knows.

    ``both_ways``: all greater neighbours of a node move to its least neighbour (so does a root's whole
    group); otherwise a node's lesser neighbours and itself do."""
    known = links
    if both_ways:
        known = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = known.groupBy("high").agg(F.min("low").alias("least"))
    told = known.join(least, "high")
    if both_ways:
        moved = told.filter("low > high").select(F.col("low").alias("high"), F.least("least", "high").alias("low"))
    else:
        moved = told.filter("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low")).unionByName(
            least.select("high", F.col("least").alias("low")))
    return moved.distinct()


def connected_groups(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of every node's connected group, given (item, node) pairs of longs.

    An item's nodes hang on its least one.  Rounds of the two star steps then hang every node on the least node
    of its group; their number grows with the logarithm of the longest path.  A round is written to the
    shared folder in place of the one before; rounds end when the links stay the same."""
    edges = stored(edges.select("item", "node").distinct(), "edges")
    first = edges.groupBy("item").agg(F.min("node").alias("low"))
    links = stored(edges.join(first, "item").filter("node <> low").select(F.col("node").alias("high"), "low").distinct(), "links")
    mark = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low") % 1_000_003)).first()
        if now == mark or not now[0]:
            break
        mark = now
        before, links = links, stored(_hook(_hook(links, both_ways=True), both_ways=False), "links")
        forget(before)
    nodes = edges.select("node").distinct()
    return nodes.join(links, F.col("node") == F.col("high"), "left").select(
        "node", F.coalesce("low", "node").alias("label"))
