"""L14 for deep pages: an order index that turns page n into one range read and knows the total.

``OFFSET`` sorts and skips every row before the page.  The index is a written copy of the sort keys in ranges of the
order, with every row's place in its range; beside it stands one row per range with the
range's number of rows.  Ranges that follow each other share a folder of about ``ROWS_PER_FOLDER`` rows, so small
ranges do not make as many tasks and files.  A page lies in one range, or in few that touch; only their folders are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glazier.operators.listings import _page_arg, invoice_history
from glazier.plans.session import stored
from glazier.sources.tables import Tables

ROWS_PER_RANGE = 100_000
ROWS_PER_FOLDER = 100_000
_FOLDER_BITS = 32  # range_no = folder << 32 | range in the folder
_PLACE_BITS = 33  # monotonically_increasing_id = partition index << 33 | row index


@dataclass(frozen=True)
class OrderIndex:
    """``starts``: rows before each range and after the last; one number per range is held by the driver."""
    path: str
    ranges: tuple[int, ...]
    starts: tuple[int, ...]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def pages(self, limit) -> int:
        return -(-self.total // _page_arg(limit, 10))


def build_order_index(df: DataFrame, order: list[Column], path: str, rows_per_range: int = ROWS_PER_RANGE) -> OrderIndex:
    """Write the index of ``df`` in ``order`` to the new folder ``path``.  ``order`` must be unique per row.

    The rows are computed once; they are counted first, so a range holds at most ``rows_per_range`` rows and a folder
    about as many as it should at every size.  Range and place are written in one pass: a range sort evaluated again
    might cut elsewhere."""
    df = stored(df, "order-keys")
    folders = max(1, -(-df.count() // max(rows_per_range, ROWS_PER_FOLDER)))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    first = F.shiftleft(F.spark_partition_id().cast("long"), _FOLDER_BITS)
    (df.repartitionByRange(folders, *order).sortWithinPartitions(*order)
     .withColumns({"folder": F.spark_partition_id(), "at": at})
     .withColumns({"range_no": first + F.expr(f"at div {int(rows_per_range)}"), "place": F.col("at") % rows_per_range}).drop("at")
     .write.partitionBy("folder").parquet(f"{path}/rows"))
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    rows.groupBy("range_no").agg(F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(f"{path}/counts")
    return open_order_index(df.sparkSession, path)


def open_order_index(spark: SparkSession, path: str) -> OrderIndex:
    counts = sorted((r["range_no"], r["rows"]) for r in spark.read.parquet(f"{path}/counts").collect())  # one row a range
    return OrderIndex(path, tuple(n for n, _ in counts), tuple(accumulate((rows for _, rows in counts), initial=0)))


def indexed_page(spark: SparkSession, index: OrderIndex, page_no=None, limit=None) -> DataFrame:
    """The rows of a page in order, with their ``position`` in the listing (from 0)."""
    p, n = _page_arg(page_no, 1), _page_arg(limit, 10)
    low, high = (p - 1) * n, p * n
    met = [k for k in range(len(index.ranges)) if index.starts[k] < high and index.starts[k + 1] > low]
    rows = spark.read.parquet(f"{index.path}/rows")
    wanted, position = F.lit(False), F.lit(0).cast("long")
    for k in met:
        inside = F.col("range_no") == index.ranges[k]
        first, last = max(low - index.starts[k], 0), high - index.starts[k]
        wanted = wanted | (inside & (F.col("place") >= first) & (F.col("place") < last))
        position = F.when(inside, F.col("place") + index.starts[k]).otherwise(position)
    folders = sorted({index.ranges[k] >> _FOLDER_BITS for k in met})
    return (rows.filter(F.col("folder").isin(folders) & wanted if met else F.lit(False))
            .withColumn("position", position).orderBy("position").drop("folder", "range_no", "place"))


def index_invoice_history(t: Tables, path: str, store_id: int | None = None, rows_per_range: int = ROWS_PER_RANGE) -> OrderIndex:
    """The order index of L13: invoices with an item of a known product, latest first."""
    inv = t.invoices if store_id is None else t.invoices.filter(F.col("store_id") == store_id)
    known = t.invoice_items.join(t.products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    shown = inv.select("invoice_id", "created_at").join(known.select("invoice_id"), "invoice_id", "left_semi")
    return build_order_index(shown, [F.col("created_at").desc_nulls_first(), F.col("invoice_id").desc()], path, rows_per_range)


def indexed_invoice_history(t: Tables, index: OrderIndex, page_no=None, limit=None, store_id: int | None = None) -> DataFrame:
    """A page of L13 through its index: the page's ids, then their headers and items only."""
    page = indexed_page(t.invoices.sparkSession, index, page_no, limit)
    ids = [r["invoice_id"] for r in page.select("invoice_id").collect()]  # one page
    mine = F.col("invoice_id").isin(ids) if ids else F.lit(False)
    return invoice_history(t.with_(invoices=t.invoices.filter(mine), invoice_items=t.invoice_items.filter(mine)), store_id)
