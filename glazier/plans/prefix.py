"""Running sums per key that spread a hot key over all tasks.

A window over one key sorts all rows of that key in one task.  Here rows are first cut into ranges of (key, order)
with the same number of rows each, so a hot key takes several cuts and a cut holds many small keys.  A window per
(cut, key) gives the sum inside the cut; the cuts' totals, one row per cut and key, give the sum of
the cuts before.  A key has at most as many totals as there are cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glazier.plans.session import stored

CUT = "range_cut"


def cut_ranges(df: DataFrame, keys: list[str], order: list[str], cuts: int | None = None) -> DataFrame:
    """``df`` written once in ranges of (keys, order), with the range's number in ``range_cut``.  The ranges are
    fixed by that one written copy: a second sampling might cut elsewhere."""
    cuts = cuts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(cuts, *keys, *order).withColumn(CUT, F.spark_partition_id()), "ranges")


def sums_before(df: DataFrame, keys: list[str], order: list[str], **values: Column) -> DataFrame:
    """``df`` (from ``cut_ranges``, any rows left out) with a column per value: its sum over the key's earlier
    rows, 0 for the first.  ``order`` is unique within a key; keys are not null."""
    inside = Window.partitionBy(CUT, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(CUT).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(CUT, *keys).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    before = totals.select(CUT, *keys, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in values])
    summed = df.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()})
    return (summed.join(before, [CUT, *keys]).withColumns({n: F.col(n) + F.col(f"{n}_before") for n in values})
            .drop(*[f"{n}_before" for n in values]))
