"""Dashboard reports (D1-D7, D4b) over whole tables.

Rules of thumb applied throughout:
* aggregate the fact table first, then join the (smaller) result to names;
* "now" is an explicit ``as_of`` argument, so a report repeats;
* one conditional aggregate instead of several scans of the same table;
* joins carry no hint: AQE broadcasts a side only when its runtime size is
  under ``spark.sql.autoBroadcastJoinThreshold`` and keeps a sort-merge join
  otherwise.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glazier.functions.rules import money
from glazier.sources.tables import Tables


def as_of_col(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, (_dt.datetime, _dt.date)):
        as_of = as_of.isoformat(sep=" ") if isinstance(as_of, _dt.datetime) else as_of.isoformat()
    return F.lit(str(as_of)).cast("timestamp_ntz")


def _day_and_month(created_at: Column, as_of) -> tuple[Column, Column]:
    now = as_of_col(as_of)
    is_today = F.to_date(created_at) == F.to_date(now)
    month_start = F.date_trunc("month", now)
    # Same calendar month as "now", written as a range on the raw column.
    is_month = (created_at >= month_start) & (created_at < month_start + F.expr("INTERVAL 1 MONTH"))
    return is_today, is_month


def _cond_sum(cond: Column, amount: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, amount).otherwise(F.lit(0))), F.lit(0))


def master_summary(t: Tables, as_of) -> DataFrame:
    """One row of headline numbers for the head office."""
    inv = t.invoices
    is_today, is_month = _day_and_month(F.col("created_at"), as_of)
    total_products = (t.products.join(t.glass_categories.filter(F.col("status") == F.lit(True)),
                                      t.products.category_id == t.glass_categories.id)
                      .select(F.count(t.products.id).cast("long")).scalar())
    total_stores = (t.stores.filter(F.col("status") == F.lit(True))
                    .select(F.count("store_id").cast("long")).scalar())
    return inv.agg(
        money(_cond_sum(is_today, F.col("grand_total"))).alias("today_revenue"),
        money(_cond_sum(is_month, F.col("grand_total"))).alias("month_revenue"),
        F.count("invoice_id").cast("long").alias("total_bills"),
    ).select("*", total_products.alias("total_products"), total_stores.alias("total_stores"))


def low_stock_alerts(t: Tables, store_id: int | None = None) -> DataFrame:
    """Stock at or below its minimum (NULLs never match), lowest first."""
    inv = t.inventory.filter(F.col("available_stock") <= F.col("minimum_stock"))
    if store_id is not None:
        inv = inv.filter(F.col("store_id") == F.lit(store_id))
    p = t.products.select(F.col("id").alias("product_id"), "product_name", "color", "thickness")
    out = inv.select("store_id", "product_id", "available_stock", "minimum_stock").join(p, "product_id")
    cols = ["product_name", "color", "thickness", "available_stock", "minimum_stock"]
    if store_id is None:
        cols = ["store_id"] + cols
    return (out.orderBy(F.col("available_stock").asc_nulls_last(), "store_id", "product_id")
            .select(*cols))


def branch_performance(t: Tables) -> DataFrame:
    """D3: revenue per store that has sales (inactive stores included), highest first."""
    rev = t.invoices.groupBy("store_id").agg(money(F.coalesce(F.sum("grand_total"), F.lit(0)))
                                             .alias("total_revenue"))
    return (rev.join(t.stores.select("store_id", "store_name"), "store_id")
            .orderBy(F.col("total_revenue").desc_nulls_first(), "store_id")
            .select("store_id", "store_name", "total_revenue"))


def top_products(t: Tables, n: int = 5, store_id: int | None = None) -> DataFrame:
    """Best sellers by units, per product id (same-name products stay apart).
    The top-k is the feature: Spark plans it as TakeOrderedAndProject after a
    partial+final hash aggregate."""
    items = t.invoice_items.select("invoice_id", "product_id", "quantity")
    if store_id is not None:
        inv = t.invoices.filter(F.col("store_id") == F.lit(store_id)).select("invoice_id")
        items = items.join(inv, "invoice_id")
    sold = items.groupBy("product_id").agg(F.sum("quantity").cast("long").alias("total_sold"))
    named = sold.join(t.products.select(F.col("id").alias("product_id"), "product_name"), "product_id")
    return (named.orderBy(F.col("total_sold").desc_nulls_first(), "product_id")
            .limit(n).select("product_id", "product_name", "total_sold"))


def top_products_by_store(t: Tables, n: int = 5) -> DataFrame:
    """The store form of D4 for every store at once.

    Units are summed per (store, product) first; the per-store top-n uses
    ``row_number`` so Spark inserts a partial WindowGroupLimit before the
    shuffle, and each map task forwards at most n rows per store."""
    items = t.invoice_items.select("invoice_id", "product_id", "quantity")
    inv = t.invoices.select("invoice_id", "store_id")
    sold = (items.join(inv, "invoice_id")
            .groupBy("store_id", "product_id").agg(F.sum("quantity").cast("long").alias("total_sold")))
    named = sold.join(t.products.select(F.col("id").alias("product_id"), "product_name"), "product_id")
    w = Window.partitionBy("store_id").orderBy(F.col("total_sold").desc(), F.col("product_id").asc())
    return (named.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n)
            .select("store_id", F.col("rank").cast("int").alias("rank"), "product_id",
                    "product_name", "total_sold"))


def monthly_revenue(t: Tables, as_of, store_id: int | None = None, months: int = 6) -> DataFrame:
    """Revenue per calendar month since ``as_of`` minus ``months`` months.

    The first bucket is a partial month and there is no upper bound, so later
    rows count too; months without sales are absent.  Ordered by month."""
    since = as_of_col(as_of) - F.expr(f"INTERVAL {int(months)} MONTHS")
    inv = t.invoices.filter(F.col("created_at") >= since)
    if store_id is not None:
        inv = inv.filter(F.col("store_id") == F.lit(store_id))
    return (inv.groupBy(F.date_trunc("month", "created_at").alias("month_start"))
            .agg(money(F.coalesce(F.sum("grand_total"), F.lit(0))).alias("revenue"))
            .orderBy("month_start")
            .select(F.date_format("month_start", "MMM yyyy").alias("month"), "revenue"))


def store_summary(t: Tables, as_of, store_id: int | None = None) -> DataFrame:
    """Per-store dashboard tiles for every store (or one; zeros for an unknown one)."""
    is_today, is_month = _day_and_month(F.col("created_at"), as_of)
    inv, stock, stores = t.invoices, t.inventory, t.stores.select("store_id")
    if store_id is not None:
        inv = inv.filter(F.col("store_id") == F.lit(store_id))
        stock = stock.filter(F.col("store_id") == F.lit(store_id))
        # One row for the store asked for, known or not.
        stores = stores.sparkSession.range(1).select(F.lit(store_id).cast(stores.schema["store_id"].dataType).alias("store_id"))
    sales = inv.groupBy("store_id").agg(
        money(_cond_sum(is_today, F.col("grand_total"))).alias("today_revenue"),
        money(_cond_sum(is_month, F.col("grand_total"))).alias("month_revenue"),
        F.count("invoice_id").cast("long").alias("total_bills"))
    units = stock.groupBy("store_id").agg(
        F.count("product_id").cast("long").alias("total_products"),
        F.coalesce(F.sum("available_stock"), F.lit(0)).cast("long").alias("total_stock_units"),
        F.count_if(F.col("available_stock") <= 0).cast("long").alias("out_of_stock_count"))
    zero_money = F.lit(0).cast("decimal(38,2)")
    return (stores.join(sales, "store_id", "left").join(units, "store_id", "left")
            .select("store_id",
                    F.coalesce("today_revenue", zero_money).alias("today_revenue"),
                    F.coalesce("month_revenue", zero_money).alias("month_revenue"),
                    F.coalesce("total_bills", F.lit(0).cast("long")).alias("total_bills"),
                    F.coalesce("total_products", F.lit(0).cast("long")).alias("total_products"),
                    F.coalesce("total_stock_units", F.lit(0).cast("long")).alias("total_stock_units"),
                    F.coalesce("out_of_stock_count", F.lit(0).cast("long")).alias("out_of_stock_count")))


def store_wise_revenue(t: Tables, as_of) -> DataFrame:
    """Every active store with total, this-month and today revenue
    (zeros for stores without sales), highest total first.

    Invoices are reduced to one row per store (partial + final aggregate)
    before the left join, so only #stores rows reach the join."""
    is_today, is_month = _day_and_month(F.col("created_at"), as_of)
    sales = t.invoices.groupBy("store_id").agg(
        F.sum("grand_total").alias("total"),
        F.sum(F.when(is_month, F.col("grand_total")).otherwise(F.lit(0))).alias("month"),
        F.sum(F.when(is_today, F.col("grand_total")).otherwise(F.lit(0))).alias("today"))
    active = t.stores.filter(F.col("status") == F.lit(True)).select("store_id", "store_name")
    zero = F.lit(0)
    return (active.join(sales, "store_id", "left")
            .select("store_id", "store_name",
                    money(F.coalesce("total", zero)).alias("total_revenue"),
                    money(F.coalesce("month", zero)).alias("current_month_revenue"),
                    money(F.coalesce("today", zero)).alias("today_revenue"))
            .orderBy(F.col("total_revenue").desc_nulls_first(), "store_id"))


def master_dashboard(t: Tables, as_of) -> dict[str, DataFrame]:
    """The head-office dashboard: five lazy DataFrames over the same tables."""
    return {"summary": master_summary(t, as_of), "low_stock_alerts": low_stock_alerts(t),
            "branch_performance": branch_performance(t), "top_products": top_products(t),
            "monthly_revenue": monthly_revenue(t, as_of)}


def store_dashboard(t: Tables, as_of, store_id: int) -> dict[str, DataFrame]:
    """One store's dashboard (the store forms of D2, D4, D5, D6)."""
    return {"summary": store_summary(t, as_of, store_id),
            "low_stock_alerts": low_stock_alerts(t, store_id),
            "top_products": top_products(t, 5, store_id),
            "monthly_revenue": monthly_revenue(t, as_of, store_id)}
