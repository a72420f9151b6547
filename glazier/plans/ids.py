"""Dense new ids without a single-partition window.

Rows are range-sorted on a unique key and that one sorted copy is written to the
shared folder: a second evaluation of a range sort may cut its partitions
elsewhere.  Each partition of the copy is counted (one row per partition), the
counts become offsets with a window over those few rows, and the offsets are
broadcast back: their size is bounded by the partition count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glazier.plans.session import cut_lineage

_IDX_BITS = 33  # monotonically_increasing_id = partition index << 33 | row index


def assign_dense_ids(df: DataFrame, order_cols: list, start, id_col: str = "id") -> DataFrame:
    """Give ``df`` ids start+1, start+2, ... in ``order_cols`` order.

    ``order_cols`` must be unique per row, so the order (and the ids) are the
    same when a lost partition is recomputed.  Gives each row of ``df`` exactly
    one id.  ``start`` is an int or a
    scalar Column (e.g. the current max id as a scalar subquery)."""
    start_col: Column = start if isinstance(start, Column) else F.lit(start)
    ordered = cut_lineage(df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id()))
    ordered = (ordered.withColumn("_pid", F.shiftright("_mid", _IDX_BITS))
               .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << _IDX_BITS) - 1))))
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = ordered.join(F.broadcast(offsets), "_pid")
    new_id = (F.coalesce(start_col.cast("long"), F.lit(0).cast("long")) + F.col("_off") + F.col("_idx") + 1)
    return out.withColumn(id_col, new_id).drop("_mid", "_pid", "_idx", "_off")
