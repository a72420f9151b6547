"""Listings and nested reports.

Nested outputs are built child-first: the child table is reduced to one
array per parent key (``collect_list`` after a partial aggregate), then
joined to the parent, instead of joining first and grouping by every parent
column.  Array order is made deterministic by sorting on leading key fields
and projecting the payload back out, all in native expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glazier.functions.rules import (billing_dimension, effective_max_discount, money, role_is,
                                     stock_status, stock_value, zero_if_null)
from glazier.sources.tables import Tables

DEFAULT_PAGE, DEFAULT_LIMIT = 1, 10


def _sorted_payload(keys: list[Column], payload: Column) -> Column:
    """collect_list of ``payload`` ordered by ``keys`` (NULLs first)."""
    key_fields = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    collected = F.sort_array(F.collect_list(F.struct(*key_fields, payload.alias("v"))))
    return F.transform(collected, lambda x: x["v"])


def _store_discount_cols(prefix_default: str = "default_max_discount") -> list[Column]:
    return [F.coalesce(F.col(prefix_default), F.lit(0)).cast("decimal(5,2)").alias("default_max_discount"),
            F.col("override_max_discount"),
            effective_max_discount("override_max_discount", "default_max_discount")
            .alias("effective_max_discount")]


def inventory_listing(t: Tables) -> DataFrame:
    """L1: every stock row with product, store and category (all inner joins),
    stock status, stock value and the effective discount limit."""
    i, p, s, c = t.inventory, t.products, t.stores, t.glass_categories
    j = (i.join(p.select(F.col("id").alias("p_id"), "product_name", "product_image", "category_id", "color",
                         "thickness", F.col("length").alias("p_length"), F.col("width").alias("p_width"),
                         "dimension_unit", F.col("area").alias("p_area"), "unit"),
                F.col("product_id") == F.col("p_id"))
         .join(s.select(F.col("store_id").alias("s_id"), "store_name", "store_location", "default_max_discount"),
               F.col("store_id") == F.col("s_id"))
         .join(c.select(F.col("id").alias("c_id"), "category_name"), F.col("category_id") == F.col("c_id")))
    return (j.orderBy("store_name", "category_name", "product_name", "id")
            .select("id", "store_id", "store_name", "store_location",
                    "product_id", "product_name", "product_image",
                    F.col("c_id").alias("category_id"), "category_name", "color", "thickness",
                    zero_if_null("p_length", "decimal(10,2)").alias("length"),
                    zero_if_null("p_width", "decimal(10,2)").alias("width"),
                    "dimension_unit",
                    zero_if_null("p_area", "decimal(10,4)").alias("area"), "unit",
                    zero_if_null("purchase_rate", "decimal(12,2)").alias("purchase_rate"),
                    zero_if_null("selling_rate", "decimal(12,2)").alias("selling_rate"),
                    "available_stock", "minimum_stock",
                    stock_status("available_stock", "minimum_stock").alias("stock_status"),
                    zero_if_null(stock_value("available_stock", "selling_rate"), "decimal(23,2)")
                    .alias("stock_value"),
                    "updated_at", *_store_discount_cols()))


def inventory_summary(t: Tables) -> DataFrame:
    """L2: one row of stock totals over stock rows whose store exists.

    The two distinct counts are separate scalar subqueries, each a partial
    (map-side) dedup of one key, instead of one Expand that triples every
    row into the shuffle."""
    i = t.inventory.join(t.stores.select("store_id"), "store_id", "left_semi")
    a, m = F.col("available_stock"), F.col("minimum_stock")
    n_products = i.select(F.count_distinct("product_id").cast("long")).scalar()
    n_stores = i.select(F.count_distinct("store_id").cast("long")).scalar()
    return i.agg(
        F.count(F.lit(1)).cast("long").alias("total_inventory_records"),
        F.coalesce(F.sum(a), F.lit(0)).cast("long").alias("total_stock_units"),
        money(F.coalesce(F.sum(stock_value(a, "selling_rate")), F.lit(0))).alias("total_stock_value"),
        money(F.coalesce(F.sum(stock_value(a, "purchase_rate")), F.lit(0))).alias("total_purchase_value"),
        F.count_if(a <= 0).cast("long").alias("out_of_stock_count"),
        F.count_if((a > 0) & (a <= m)).cast("long").alias("low_stock_count"),
        F.count_if(a > m).cast("long").alias("in_stock_count"),
    ).select(F.col("total_inventory_records"), n_products.alias("total_unique_products"),
             n_stores.alias("total_stores_with_stock"), "total_stock_units", "total_stock_value",
             "total_purchase_value", "in_stock_count", "low_stock_count", "out_of_stock_count")


def available_inventory(t: Tables, store_id: int | None = None) -> DataFrame:
    """L3: sellable stock (> 0) with product, category and store (inner joins)."""
    i = t.inventory.filter(F.col("available_stock") > 0)
    if store_id is not None:
        i = i.filter(F.col("store_id") == F.lit(store_id))
    j = (i.join(t.products.select(F.col("id").alias("p_id"), "product_name", "category_id", "color", "thickness",
                                  "length", "width", "dimension_unit", "area", "unit"),
                F.col("product_id") == F.col("p_id"))
         .join(t.glass_categories.select(F.col("id").alias("c_id"), "category_name"),
               F.col("category_id") == F.col("c_id"))
         .join(t.stores.select(F.col("store_id").alias("s_id"), "default_max_discount"),
               F.col("store_id") == F.col("s_id")))
    cols = ["id", "product_id", "product_name", "category_name", "color", "thickness",
            zero_if_null("length", "decimal(10,2)").alias("length"),
            zero_if_null("width", "decimal(10,2)").alias("width"), "dimension_unit",
            zero_if_null("area", "decimal(10,4)").alias("area"), "unit",
            zero_if_null("selling_rate", "decimal(12,2)").alias("selling_rate"), "available_stock",
            *_store_discount_cols()]
    if store_id is None:
        cols = ["store_id"] + cols
    return j.orderBy("category_name", "thickness", "id").select(*cols)


def master_inventory(t: Tables) -> DataFrame:
    """L4: every stock row with product and store; no category join, so rows
    of uncategorised products are kept."""
    j = (t.inventory
         .join(t.products.select(F.col("id").alias("p_id"), "product_name", "color", "thickness", "length",
                                 "width", "dimension_unit", "area", "unit"),
               F.col("product_id") == F.col("p_id"))
         .join(t.stores.select(F.col("store_id").alias("s_id"), "store_name", "default_max_discount"),
               F.col("store_id") == F.col("s_id")))
    return (j.orderBy("store_name", "product_name", "id")
            .select("id", "store_id", "store_name", "product_id", "product_name", "color", "thickness",
                    "length", "width", "dimension_unit", "area", "unit", "available_stock", "minimum_stock",
                    zero_if_null("purchase_rate", "decimal(12,2)").alias("purchase_rate"),
                    zero_if_null("selling_rate", "decimal(12,2)").alias("selling_rate"),
                    "updated_at", *_store_discount_cols()))


def _product_cols(p: DataFrame) -> list[Column]:
    return [F.col(f"p.{c}").alias(c) for c in p.columns]


def _with_brackets(cols: list[Column]) -> list[Column]:
    return cols + [billing_dimension(F.col("p.length")).alias("billing_length"),
                   billing_dimension(F.col("p.width")).alias("billing_width")]


def product_catalog(t: Tables) -> DataFrame:
    """Products with category name, billing brackets and the stores that
    stock them (empty array when none), newest first."""
    stock = (t.inventory.groupBy("product_id")
             .agg(_sorted_payload([F.col("store_id"), F.col("available_stock"), F.col("selling_rate")],
                                  F.struct("store_id", "available_stock", "selling_rate"))
                  .alias("store_inventory")))
    p = t.products.alias("p")
    c = t.glass_categories.select(F.col("id").alias("c_id"), "category_name")
    empty = F.array().cast(stock.schema["store_inventory"].dataType)
    j = p.join(c, F.col("p.category_id") == F.col("c_id"), "left").join(
        stock, F.col("p.id") == stock.product_id, "left")
    return (j.orderBy(F.col("p.created_at").desc_nulls_first(), F.col("p.id"))
            .select(*_with_brackets(_product_cols(t.products)), "category_name",
                    F.coalesce("store_inventory", empty).alias("store_inventory")))


def product_detail(t: Tables, ids=None) -> DataFrame:
    """Product detail with category name/description, brackets and every
    store's rates, stock, minimum and last update (empty array when none)."""
    inv = t.inventory
    p = t.products
    if ids is not None:
        keys = ids if isinstance(ids, DataFrame) else p.sparkSession.createDataFrame(
            [(int(x),) for x in ids], "id int")
        p = p.join(keys.select(F.col(keys.columns[0]).cast("int").alias("id")), "id", "left_semi")
        inv = inv.join(keys.select(F.col(keys.columns[0]).cast("int").alias("product_id")),
                       "product_id", "left_semi")
    fields = ["store_id", "purchase_rate", "selling_rate", "available_stock", "minimum_stock", "updated_at"]
    stock = inv.groupBy("product_id").agg(
        _sorted_payload([F.col("store_id")], F.struct(*fields)).alias("store_inventory"))
    c = t.glass_categories.select(F.col("id").alias("c_id"), "category_name",
                                  F.col("description").alias("category_description"))
    empty = F.array().cast(stock.schema["store_inventory"].dataType)
    j = p.alias("p").join(c, F.col("p.category_id") == F.col("c_id"), "left").join(
        stock, F.col("p.id") == stock.product_id, "left")
    return j.select(*_with_brackets(_product_cols(t.products)), "category_name", "category_description",
                    F.coalesce("store_inventory", empty).alias("store_inventory"))


def store_products(t: Tables, store_id: int | None = None) -> DataFrame:
    """The products a store stocks (inner), with category (left), rates,
    stock and ``assigned_at``; most recently updated first."""
    i = t.inventory
    if store_id is not None:
        i = i.filter(F.col("store_id") == F.lit(store_id))
    i = i.select(F.col("store_id").alias("i_store_id"), F.col("product_id").alias("i_product_id"),
                 F.col("purchase_rate").alias("i_purchase_rate"), F.col("selling_rate").alias("i_selling_rate"),
                 F.col("available_stock").alias("i_available_stock"),
                 F.col("minimum_stock").alias("i_minimum_stock"), F.col("updated_at").alias("assigned_at"))
    c = t.glass_categories.select(F.col("id").alias("c_id"), "category_name",
                                  F.col("description").alias("category_description"))
    j = (i.join(t.products.alias("p"), F.col("i_product_id") == F.col("p.id"))
         .join(c, F.col("p.category_id") == F.col("c_id"), "left"))
    cols = _with_brackets(_product_cols(t.products)) + [
        "category_name", "category_description", F.col("i_purchase_rate").alias("purchase_rate"),
        F.col("i_selling_rate").alias("selling_rate"), F.col("i_available_stock").alias("available_stock"),
        F.col("i_minimum_stock").alias("minimum_stock"), "assigned_at"]
    if store_id is None:
        cols = [F.col("i_store_id").alias("store_id")] + cols
    return j.orderBy(F.col("assigned_at").desc_nulls_first(), "i_store_id", "i_product_id").select(*cols)


def active_categories(t: Tables) -> DataFrame:
    """Active categories by name."""
    return t.glass_categories.filter(F.col("status") == F.lit(True)).orderBy("category_name", "id")


def store_list(t: Tables) -> DataFrame:
    """Stores without their discount column, newest first."""
    return (t.stores.orderBy(F.col("created_at").desc_nulls_first(), "store_id")
            .select("store_id", "store_email", "store_name", "store_location", "status", "created_at"))


def store_admin_list(t: Tables) -> DataFrame:
    """Store admins, active and inactive, newest first (no password)."""
    return (t.users.filter(role_is("role", "store"))
            .orderBy(F.col("created_at").desc_nulls_first(), "id")
            .select("id", "store_id", "full_name", "username", "email", "role", "status", "created_at"))


def store_admin_profiles(t: Tables) -> DataFrame:
    """Active store admins with their store (left join)."""
    u = t.users.filter(role_is("role", "store") & (F.col("status") == F.lit(True)))
    s = t.stores.select(F.col("store_id").alias("s_store_id"), "store_name", "store_email", "store_location",
                        F.col("status").alias("store_status"))
    return (u.join(s, u.store_id == s.s_store_id, "left")
            .select(F.col("id").alias("user_id"), "full_name", "username", "email", "role",
                    F.col("status").alias("user_status"), F.col("created_at").alias("user_created_at"),
                    F.col("s_store_id").alias("store_id"), "store_name", "store_email", "store_location",
                    "store_status"))


def master_admin_profiles(t: Tables) -> DataFrame:
    """Active master admins (either spelling)."""
    return (t.users.filter(role_is("role", "master") & (F.col("status") == F.lit(True)))
            .select(F.col("id").alias("user_id"), "full_name", "username", "email", "role",
                    F.col("status").alias("user_status"), F.col("created_at").alias("user_created_at")))


ITEM_FIELDS = ("product_id", "product_name", "category", "thickness", "length", "width", "charged_dimension",
               "color", "area", "unit", "quantity", "unit_price", "discount_percent", "charged_rate",
               "total_price")


def invoice_history(t: Tables, store_id: int | None = None) -> DataFrame:
    """One row per invoice with its items; sides and area fall back to the
    product's, category id as text ('N/A' when none).  Invoices without items
    (or whose items' products are gone) do not appear.  Newest first.

    Items are joined to products and collected per invoice *before* meeting
    the invoice headers, so the header join sees one row per invoice."""
    inv = t.invoices
    items = t.invoice_items
    if store_id is not None:
        inv = inv.filter(F.col("store_id") == F.lit(store_id))
        items = items.join(inv.select("invoice_id"), "invoice_id", "left_semi")
    p = t.products.select(F.col("id").alias("p_id"), "product_name", "category_id", "thickness",
                          F.col("length").alias("p_length"), F.col("width").alias("p_width"), "color",
                          F.col("area").alias("p_area"), "unit")
    # Lines meet their invoice as plain rows, each value once; they are nested behind that shuffle.
    keys = ("product_id", "quantity", "unit_price", "discount_percent", "total_price", "charged_rate", "length", "width",
            "area", "charged_dimension")
    of_product = {"product_name": F.col("product_name"), "category": F.coalesce(F.col("category_id").cast("string"), F.lit("N/A")),
                  "thickness": F.col("thickness"), "shown_length": F.coalesce("length", "p_length"),
                  "shown_width": F.coalesce("width", "p_width"), "color": F.col("color"),
                  "shown_area": F.coalesce("area", "p_area"), "unit": F.col("unit")}
    lines = (items.join(p, items.product_id == p.p_id)
             .select("invoice_id", *keys, *[c.alias(name) for name, c in of_product.items()]).repartition("invoice_id"))
    per_invoice = lines.groupBy(F.col("invoice_id").alias("it_invoice_id")).agg(
        F.sort_array(F.collect_list(F.struct(*keys, *of_product))).alias("lines"))
    line = lambda x: F.struct(*[x[f"shown_{c}" if f"shown_{c}" in of_product else c].alias(c) for c in ITEM_FIELDS])
    per_invoice = per_invoice.select("it_invoice_id", F.transform("lines", line).alias("items"))
    cols = ["invoice_id", "customer_name", "customer_phone", "sub_total", "grand_total", "created_at", "items"]
    if store_id is None:
        cols.insert(1, "store_id")
    return (inv.join(per_invoice, inv.invoice_id == per_invoice.it_invoice_id)
            .orderBy(F.col("created_at").desc_nulls_first(), F.col("invoice_id").desc())
            .select(*cols))


def invoice_history_page(t: Tables, page_no=None, limit=None, store_id: int | None = None) -> DataFrame:
    """L14 over L13: the page's invoices first, then their items only.

    Invoices with an item of a known product are sorted and cut to the page on their headers; the at most
    ``limit`` ids found then filter both scans."""
    inv = t.invoices if store_id is None else t.invoices.filter(F.col("store_id") == F.lit(store_id))
    known = t.invoice_items.join(t.products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    shown = inv.select("invoice_id", "created_at").join(known.select("invoice_id"), "invoice_id", "left_semi")
    order = [F.col("created_at").desc_nulls_first(), F.col("invoice_id").desc()]
    ids = [r["invoice_id"] for r in page(shown, order, page_no, limit).collect()]  # one page
    mine = F.col("invoice_id").isin(ids) if ids else F.lit(False)
    return invoice_history(t.with_(invoices=inv.filter(mine), invoice_items=t.invoice_items.filter(mine)), store_id)


def _page_arg(value, default: int) -> int:
    # The leading integer counts, as in "3abc" or "2.5".
    found = re.match(r"\s*([+-]?\d+)", str(value)) if value is not None else None
    if not found:
        return default
    n = int(found[1])
    if n < 0:
        raise ValueError(f"page and limit must not be negative, got {value!r}")
    return n or default


def page(df: DataFrame, order: list, page_no=DEFAULT_PAGE, limit=DEFAULT_LIMIT) -> DataFrame:
    """One page of an ordered listing (OFFSET (page-1)*limit, LIMIT limit).
    0 or unparsable arguments mean the defaults (1 and 10)."""
    p, n = _page_arg(page_no, DEFAULT_PAGE), _page_arg(limit, DEFAULT_LIMIT)
    return df.orderBy(*order).offset((p - 1) * n).limit(n)


def page_after(df: DataFrame, order: list[tuple[str, bool]], after: dict | None, limit=DEFAULT_LIMIT) -> DataFrame:
    """L14, keyset form: the ``limit`` rows that follow the cursor ``after``
    (the sort-key values of the last row shown) in ``order`` = [(column,
    ascending)].  The predicate is pushed to the scan, so a deep page costs
    the same as the first one (OFFSET has to sort and skip all rows before).
    The sort keys must be unique and non-NULL."""
    n = _page_arg(limit, DEFAULT_LIMIT)
    sort = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]
    if not after:
        return df.orderBy(*sort).limit(n)
    cond = None
    for k in range(len(order) - 1, -1, -1):
        c, asc = order[k]
        step = (F.col(c) > F.lit(after[c])) if asc else (F.col(c) < F.lit(after[c]))
        cond = step if cond is None else (step | ((F.col(c) == F.lit(after[c])) & cond))
    return df.filter(cond).orderBy(*sort).limit(n)


def page_info(counted: DataFrame, page_no=DEFAULT_PAGE, limit=DEFAULT_LIMIT) -> DataFrame:
    """Total rows of ``counted`` (the base the caller counts), current
    page and number of pages."""
    p, n = _page_arg(page_no, DEFAULT_PAGE), _page_arg(limit, DEFAULT_LIMIT)
    return counted.agg(F.count(F.lit(1)).cast("long").alias("total_records")).select(
        "total_records", F.lit(p).alias("current_page"),
        F.ceil(F.col("total_records") / F.lit(n)).cast("long").alias("total_pages"))


def lookup(df: DataFrame, column: str, keys: DataFrame, key_column: str | None = None,
           ignore_case: bool = False) -> DataFrame:
    """Bulk key lookup (left-semi join of ``df`` with a key DataFrame).
    With ``ignore_case`` wanted keys are also trimmed; stored ones are not."""
    key_column = key_column or keys.columns[0]
    k = keys.select(F.col(key_column).alias("_lookup_key")).distinct()
    left = F.col(column)
    if ignore_case:
        left, k = F.lower(left), k.select(F.lower(F.trim("_lookup_key")).alias("_lookup_key")).distinct()
    return df.join(k, left == F.col("_lookup_key"), "left_semi")

