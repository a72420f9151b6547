"""Dashboards kept fresh by the batches of T1, without reading the invoices again.

Each batch adds small partial sums, in the folders of its batch id beside its bills:

* sales: revenue and bills per (store, day) of the bill, so a late bill counts on its own day;
* stock: rows, units and empty rows per store, as the change the batch made;
* units: units sold per (store, product).

Partials merge by adding up.  Every ``COMPACT_EVERY`` batches they are written out whole; a reader takes the last
whole set and the changes since.  D1, D3, D6 and D7 follow from the partials alone; D5 begins at an
instant, so it also reads the invoices of that one day.

D4b keeps the leaders of every store: its first ``n * SPARE`` products with their totals, and a bound, a (total,
product) place below which every other product ranks.  After a batch a product outside can have at most the
bound's total and what the batch sold of it.  Only those that could reach the n-th place that way are
counted again, from the unit partials; the others raise the bound, and leaders below it are given up.
Quantities are never negative, so leaders only rise and the first n always stay known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glazier.functions.rules import money
from glazier.operators.reports import _cond_sum, _day_and_month, as_of_col
from glazier.plans.session import at_once
from glazier.sources.tables import Tables

COMPACT_EVERY = 20
SPARE = 4      # leaders kept per place shown
TOP = 5
KEYS = {"sales": ["store_id", "day"], "stock": ["store_id"], "units": ["store_id", "product_id"]}


# --- partial sums --------------------------------------------------------------------------------------

def sales_partials(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy("store_id", F.to_date("created_at").alias("day")).agg(
        F.sum("grand_total").cast("decimal(38,2)").alias("revenue"), F.count("invoice_id").alias("bills"))


def stock_partials(inventory: DataFrame, sign: int = 1) -> DataFrame:
    return inventory.groupBy("store_id").agg(
        (F.count("product_id") * sign).alias("products"), (F.sum("available_stock") * sign).alias("units"),
        (F.count_if(F.col("available_stock") <= 0) * sign).alias("empty"))


def unit_partials(items: DataFrame, invoices: DataFrame) -> DataFrame:
    return (items.select("invoice_id", "product_id", "quantity").join(invoices.select("invoice_id", "store_id"), "invoice_id")
            .groupBy("store_id", "product_id").agg(F.sum("quantity").alias("sold")))


def merged(parts: DataFrame, kind: str) -> DataFrame:
    sums = [F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in parts.columns if c not in KEYS[kind]]
    return parts.groupBy(*KEYS[kind]).agg(*sums).select(parts.columns)


def _paths(base: str, kind: str, batch_id: int) -> list[str]:
    """The whole set and the changes that make up a kind of partials after a batch."""
    start = batch_id - batch_id % COMPACT_EVERY
    return [f"{base}/{kind}_partials/whole={start}"] + [f"{base}/{kind}_partials/change={b}" for b in range(start + 1, batch_id + 1)]


def partials(spark: SparkSession, out_dir: str, batch_id: int) -> dict[str, DataFrame]:
    """Sales, stock and unit partials after a committed batch."""
    out = {}
    for kind in KEYS:
        whole, *changes = _paths(out_dir.rstrip("/"), kind, batch_id)
        rows = spark.read.parquet(whole)
        if changes:
            rows = merged(rows.unionByName(spark.read.schema(rows.schema).parquet(*changes)), kind)
        out[kind] = rows
    return out


def write_partials(t: Tables, out_dir: str, batch_id: int, invoices: DataFrame, items: DataFrame, before: DataFrame,
                   after: DataFrame) -> None:
    """The partials of one batch: its ``invoices`` and ``items``, and the stock rows it changed as they were
    and are.  A batch that is run again replaces its own folders only."""
    spark, base = invoices.sparkSession, out_dir.rstrip("/")
    change = {"sales": sales_partials(invoices), "units": unit_partials(items, invoices),
              "stock": merged(stock_partials(after).unionByName(stock_partials(before, -1)), "stock")}
    if batch_id % COMPACT_EVERY == 0:
        if batch_id:
            start = partials(spark, base, batch_id - 1)
        else:
            start = {"sales": sales_partials(t.invoices), "stock": stock_partials(t.inventory),
                     "units": unit_partials(t.invoice_items, t.invoices)}
        change = {k: merged(start[k].unionByName(rows), k) for k, rows in change.items()}

    def write(kind: str) -> None:
        change[kind].write.mode("overwrite").parquet(_paths(base, kind, batch_id)[-1])

    def write_units() -> None:
        write("units")
        write_leaders(spark, base, batch_id)

    at_once(write_units, lambda: write("sales"), lambda: write("stock"))


# --- the leaders of D4b -----------------------------------------------------------------------------------

def _ranked(totals: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("store_id").orderBy(F.col("sold").desc(), F.col("product_id").asc())
    return totals.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def _leaders(base: str, batch_id: int) -> str:
    return f"{base}/leaders/batch={batch_id}"


_LAST = 2**31 - 1  # no product outside: the bound is below all


def write_leaders(spark: SparkSession, base: str, batch_id: int, n: int = TOP) -> None:
    """The leaders after a batch, from those before it and what the batch sold.  Whole sets count all totals."""
    kept = n * SPARE
    whole, *changes = _paths(base, "units", batch_id)
    if changes:
        rows = _moved_leaders(spark, _leaders(base, batch_id - 1), whole, changes, n)
    else:
        rows = spark.read.parquet(whole).withColumns({"bound": F.lit(0).cast("long"), "bound_id": F.lit(_LAST)})
    rows = _ranked(rows, kept)
    last = Window.partitionBy("store_id")
    cut = F.max(F.when(F.col("place") == kept, F.struct("sold", "product_id"))).over(last)
    rows = rows.withColumn("cut", cut).withColumns({"bound": F.coalesce("cut.sold", "bound"),
                                                    "bound_id": F.coalesce("cut.product_id", "bound_id")})
    rows.select("store_id", "product_id", "sold", "place", "bound", "bound_id").write.mode("overwrite").parquet(
        _leaders(base, batch_id))


def _moved_leaders(spark: SparkSession, leaders: str, whole: str, changes: list[str], n: int) -> DataFrame:
    """Known totals and the bound after the last of ``changes``, before the cut to the leaders kept."""
    before = spark.read.parquet(leaders)
    sold = spark.read.parquet(changes[-1]).withColumnRenamed("sold", "more")
    known = before.select("store_id", "product_id", F.col("sold").alias("was")).join(
        sold, ["store_id", "product_id"], "full").withColumn("more", F.coalesce("more", F.lit(0)))
    now = known.filter("was is not null").select("store_id", "product_id", (F.col("was") + F.col("more")).alias("sold"))
    bounds = before.select("store_id", F.col("bound"), "bound_id").distinct()
    nth = _ranked(now, n).groupBy("store_id").agg(F.max(F.when(F.col("place") == n, F.col("sold"))).alias("nth"))
    outside = (known.filter("was is null").join(bounds, "store_id", "left").join(nth, "store_id", "left")
               .withColumn("most", F.coalesce("bound", F.lit(0)) + F.col("more"))
               .withColumn("doubtful", F.col("most") >= F.coalesce("nth", F.lit(0))))
    totals = spark.read.parquet(whole).unionByName(spark.read.parquet(*changes))
    counted = merged(totals.join(outside.filter("doubtful").select("store_id", "product_id"), ["store_id", "product_id"],
                                 "left_semi"), "units")
    skipped = outside.filter("not doubtful").groupBy("store_id").agg(F.max("most").alias("skipped"))
    rows = (now.unionByName(counted).join(bounds, "store_id", "left").join(skipped, "store_id", "left")
            .withColumns({"bound": F.coalesce("bound", F.lit(0)), "bound_id": F.coalesce("bound_id", F.lit(_LAST))}))
    raised = F.col("skipped") >= F.col("bound")
    rows = rows.withColumns({"bound_id": F.when(raised, F.lit(-1)).otherwise(F.col("bound_id")),
                             "bound": F.when(raised, F.col("skipped")).otherwise(F.col("bound"))})
    return rows.filter((F.col("sold") > F.col("bound")) | ((F.col("sold") == F.col("bound")) & (F.col("product_id") <= F.col("bound_id"))))


def top_products_by_store(spark: SparkSession, out_dir: str, batch_id: int, products: DataFrame, n: int = TOP) -> DataFrame:
    """D4b after a batch, from the leaders."""
    rows = spark.read.parquet(_leaders(out_dir.rstrip("/"), batch_id)).filter(F.col("place") <= n)
    named = rows.join(products.select(F.col("id").alias("product_id"), "product_name"), "product_id")
    return named.select("store_id", F.col("place").cast("int").alias("rank"), "product_id", "product_name",
                        F.col("sold").cast("long").alias("total_sold"))


# --- reports from partials ------------------------------------------------------------------------------

def _days(as_of) -> tuple[Column, Column]:
    return _day_and_month(F.col("day").cast("timestamp_ntz"), as_of)


def master_summary(parts: dict[str, DataFrame], t: Tables, as_of) -> DataFrame:
    """D1 from sales partials and the (small) catalogue tables."""
    today, month = _days(as_of)
    active = t.glass_categories.filter("status").select(F.col("id").alias("category_id"))
    products = t.products.join(active, "category_id").select(F.count("id").cast("long")).scalar()
    stores = t.stores.filter("status").select(F.count("store_id").cast("long")).scalar()
    return parts["sales"].agg(
        money(_cond_sum(today, F.col("revenue"))).alias("today_revenue"),
        money(_cond_sum(month, F.col("revenue"))).alias("month_revenue"),
        F.coalesce(F.sum("bills"), F.lit(0)).cast("long").alias("total_bills"),
    ).select("*", products.alias("total_products"), stores.alias("total_stores"))


def branch_performance(parts: dict[str, DataFrame], t: Tables) -> DataFrame:
    """D3 from sales partials."""
    revenue = parts["sales"].groupBy("store_id").agg(money(F.coalesce(F.sum("revenue"), F.lit(0))).alias("total_revenue"))
    return (revenue.join(t.stores.select("store_id", "store_name"), "store_id")
            .orderBy(F.col("total_revenue").desc_nulls_first(), "store_id").select("store_id", "store_name", "total_revenue"))


def monthly_revenue(parts: dict[str, DataFrame], invoices: DataFrame, as_of, months: int = 6) -> DataFrame:
    """D5 from the days after the first, and the ``invoices`` of the first day from its instant on."""
    since = as_of_col(as_of) - F.expr(f"INTERVAL {int(months)} MONTHS")
    next_day = F.date_add(F.to_date(since), 1)
    days = parts["sales"].filter(F.col("day") >= next_day).select("day", "revenue")
    first = invoices.filter((F.col("created_at") >= since) & (F.col("created_at") < next_day.cast("timestamp_ntz")))
    rows = days.unionByName(first.select(F.to_date("created_at").alias("day"), F.col("grand_total").cast("decimal(38,2)").alias("revenue")))
    return (rows.groupBy(F.date_trunc("month", F.col("day").cast("timestamp_ntz")).alias("month_start"))
            .agg(money(F.coalesce(F.sum("revenue"), F.lit(0))).alias("revenue")).orderBy("month_start")
            .select(F.date_format("month_start", "MMM yyyy").alias("month"), "revenue"))


def _by_store(parts: dict[str, DataFrame], as_of) -> DataFrame:
    today, month = _days(as_of)
    return parts["sales"].groupBy("store_id").agg(
        money(F.coalesce(F.sum("revenue"), F.lit(0))).alias("total_revenue"),
        money(_cond_sum(month, F.col("revenue"))).alias("month_revenue"),
        money(_cond_sum(today, F.col("revenue"))).alias("today_revenue"), F.sum("bills").cast("long").alias("total_bills"))


def store_summary(parts: dict[str, DataFrame], t: Tables, as_of) -> DataFrame:
    """D6 from sales and stock partials."""
    stock = parts["stock"].select("store_id", F.col("products").alias("total_products"), F.col("units").alias("total_stock_units"),
                                  F.col("empty").alias("out_of_stock_count"))
    rows = t.stores.select("store_id").join(_by_store(parts, as_of), "store_id", "left").join(stock, "store_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in
              ("total_bills", "total_products", "total_stock_units", "out_of_stock_count")]
    return rows.select("store_id", *[F.coalesce(c, F.lit(0)).cast("decimal(38,2)").alias(c)
                                     for c in ("today_revenue", "month_revenue")], *counts)


def store_wise_revenue(parts: dict[str, DataFrame], t: Tables, as_of) -> DataFrame:
    """D7 from sales partials."""
    active = t.stores.filter("status").select("store_id", "store_name")
    zero = F.lit(0)
    return (active.join(_by_store(parts, as_of), "store_id", "left")
            .select("store_id", "store_name", money(F.coalesce("total_revenue", zero)).alias("total_revenue"),
                    money(F.coalesce("month_revenue", zero)).alias("current_month_revenue"),
                    money(F.coalesce("today_revenue", zero)).alias("today_revenue"))
            .orderBy(F.col("total_revenue").desc_nulls_first(), "store_id"))
