"""Named queries for the driver: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as _Window

from glazier import oracle_sql
from glazier.operators import reports
from glazier.sources.fixtures import FIXTURE_AS_OF, retail_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark, sf_dir):
    return retail_tables(spark, sf_dir)


# --- D: dashboards -----------------------------------------------------------
register("store_wise_revenue")(lambda s, d: reports.store_wise_revenue(_t(s, d), FIXTURE_AS_OF))
register("master_summary")(lambda s, d: reports.master_summary(_t(s, d), FIXTURE_AS_OF))
register("low_stock_alerts")(lambda s, d: reports.low_stock_alerts(_t(s, d)))
register("branch_performance")(lambda s, d: reports.branch_performance(_t(s, d)))
register("top_products")(lambda s, d: reports.top_products(_t(s, d)))
register("top_products_by_store")(lambda s, d: reports.top_products_by_store(_t(s, d)))
register("monthly_revenue")(lambda s, d: reports.monthly_revenue(_t(s, d), FIXTURE_AS_OF))
register("store_summary")(lambda s, d: reports.store_summary(_t(s, d), FIXTURE_AS_OF))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["store_wise_revenue"](spark, sf_dir)


ORACLE: dict[str, str] = oracle_sql.SQL

# --- L: listings and nested reports ------------------------------------------
from glazier.operators import listings as _L  # noqa: E402
from pyspark.sql import functions as _F  # noqa: E402

for _name in ("inventory_listing", "inventory_summary", "available_inventory", "master_inventory",
              "product_catalog", "product_detail", "store_products", "active_categories", "store_list",
              "store_admin_list", "store_admin_profiles", "master_admin_profiles", "invoice_history"):
    register(_name)((lambda fn: lambda s, d: fn(_t(s, d)))(getattr(_L, _name)))

register("invoice_history_page")(lambda s, d: _L.invoice_history_page(_t(s, d), 2, 10))
register("inventory_listing_page")(lambda s, d: _L.page(
    _L.inventory_listing(_t(s, d)), ["store_name", "category_name", "product_name", "id"], 3, 10))
register("invoice_page_info")(lambda s, d: _L.page_info(_t(s, d).invoices, 1, 10))


def _lookup_users(s, d):
    t = _t(s, d)
    return _L.lookup(t.users, "username", t.stores.filter(_F.col("status")).select("store_name"))


register("lookup_users_by_username")(_lookup_users)

# --- E: row rules ------------------------------------------------------------------
from glazier.functions import rules as _R  # noqa: E402


def _product_sizes(s, d):
    p = _t(s, d).products
    bl, bw = _R.billing_dimension("length"), _R.billing_dimension("width")
    return p.select("id", bl.alias("billing_length"), bw.alias("billing_width"),
                    _R.area(bl, bw, "dimension_unit", "unit").alias("billing_area"),
                    _R.area("length", "width", "dimension_unit", "unit").alias("sheet_area"))


def _inventory_rules(s, d):
    t = _t(s, d)
    j = t.inventory.join(t.stores.select("store_id", "default_max_discount"), "store_id", "left")
    return j.select("id", _R.stock_status("available_stock", "minimum_stock").alias("stock_status"),
                    _R.stock_value("available_stock", "selling_rate").alias("stock_value"),
                    _R.effective_max_discount("override_max_discount", "default_max_discount")
                    .alias("effective_max_discount"))


register("product_billing_sizes")(_product_sizes)
register("inventory_stock_rules")(_inventory_rules)
register("user_roles")(lambda s, d: _t(s, d).users.select(
    "id", _R.role_is("role", "master").alias("is_master"), _R.role_is("role", "store").alias("is_store_admin")))
register("category_keys")(lambda s, d: _t(s, d).glass_categories.select(
    "id", _R.category_key("category_name").alias("category_key")))

# --- B: bills ----------------------------------------------------------------------
from glazier.operators import billing as _B  # noqa: E402


def _bill_lines(s, d):
    t = _t(s, d)
    return _B.prepare_bill_lines(t.bill_requests, t)


def _clean_lines(s, d):
    lines = _bill_lines(s, d)
    # One window over the bill: the requests are checked and priced once.  Lines without a bill stand alone.
    dirty = _F.col("invalid_reason").isNotNull() | _F.col("static_reason").isNotNull()
    lines = lines.withColumn("dirty", _F.max(dirty).over(_Window.partitionBy("bill_id")))
    return lines.filter(_F.col("bill_id").isNull() | ~_F.col("dirty")).drop("dirty")


register("bill_line_checks")(lambda s, d: _bill_lines(s, d).select(
    "bill_id", "line_no", "store_id", "product_id", "quantity", "invalid_reason", "found", "start_stock",
    "max_discount", "applied_discount", "static_reason"))
register("bill_line_prices")(lambda s, d: _bill_lines(s, d).select(
    "bill_id", "line_no", "line_length", "line_width", "line_billing_length", "line_billing_width", "line_area",
    _F.col("base_total").cast("decimal(38,6)").alias("base_total"),
    _F.col("discount_amount").cast("decimal(38,10)").alias("discount_amount"),
    _F.col("final_total").cast("decimal(38,10)").alias("final_total"), "total_price"))
register("bill_quote_headers")(lambda s, d: _B.build_invoices(_clean_lines(s, d)))
register("bill_quote_items")(lambda s, d: _B.build_invoice_items(_clean_lines(s, d)))
register("stock_after_quotes")(lambda s, d: _B.apply_stock(_t(s, d).inventory, _clean_lines(s, d)))


def _receipts(s, d):
    t = _t(s, d)
    return _B.bill_receipts(t.invoices, t.invoice_items, t.products)


register("bill_receipts")(_receipts)
register("post_bills_decisions")(lambda s, d: _B.post_bills(_t(s, d)).decisions)
register("post_bills_invoices")(lambda s, d: _B.post_bills(_t(s, d)).invoices)
register("post_bills_stock")(lambda s, d: _B.post_bills(_t(s, d)).inventory)

# --- W: change-set jobs ----------------------------------------------------------------
from glazier.operators import changes as _W  # noqa: E402
from glazier.sources.fixtures import change_feeds as _feeds  # noqa: E402


def _w(fn):
    """Register a change-set job under its name: (tables, feeds) -> DataFrame."""
    def deco(build):
        register(fn)(lambda s, d: build(_t(s, d), _feeds(s, d)))
        return build
    return deco


@_w("upsert_inventory")
def _q_upsert(t, f):
    return _W.upsert_inventory(t.inventory, f["inventory_changes"]).table


_INV_FIELDS = ["purchase_rate", "selling_rate", "available_stock", "minimum_stock"]


@_w("patch_inventory")
def _q_patch(t, f):
    return _W.patch_rows(t.inventory, f["inventory_patches"], ["store_id", "product_id"], _INV_FIELDS).table


@_w("patch_inventory_rejects")
def _q_patch_rej(t, f):
    return _W.patch_rows(t.inventory, f["inventory_patches"], ["store_id", "product_id"], _INV_FIELDS).rejects


@_w("set_store_discount")
def _q_disc(t, f):
    return _W.set_store_discount(t.stores, f["store_discount_changes"]).table


@_w("set_store_discount_rejects")
def _q_disc_rej(t, f):
    return _W.set_store_discount(t.stores, f["store_discount_changes"]).rejects


@_w("set_discount_override")
def _q_override(t, f):
    return _W.set_discount_override(t.inventory, f["override_changes"]).table


@_w("delete_inventory")
def _q_del_inv(t, f):
    return _W.delete_inventory(t.inventory, f["inventory_delete_keys"]).table


@_w("delete_inventory_rejects")
def _q_del_inv_rej(t, f):
    return _W.delete_inventory(t.inventory, f["inventory_delete_keys"]).rejects


@_w("delete_products")
def _q_del_prod(t, f):
    return _W.delete_products(t, f["product_delete_ids"]).table


@_w("delete_products_rejects")
def _q_del_prod_rej(t, f):
    return _W.delete_products(t, f["product_delete_ids"]).rejects


@_w("delete_categories")
def _q_del_cat(t, f):
    return _W.delete_categories(t, f["category_delete_ids"]).table


@_w("delete_categories_rejects")
def _q_del_cat_rej(t, f):
    return _W.delete_categories(t, f["category_delete_ids"]).rejects


@_w("deactivate_stores")
def _q_deact(t, f):
    return _W.deactivate_stores(t.stores, f["store_deactivate_ids"]).table


@_w("insert_categories")
def _q_ins_cat(t, f):
    return _W.insert_categories(t.glass_categories, f["category_inserts"]).table


@_w("resolve_category")
def _q_resolve(t, f):
    return _W.resolve_category(f["category_requests"], t.glass_categories).table.select(
        "seq", "resolved_category_id")


@_w("insert_users")
def _q_ins_users(t, f):
    return _W.insert_users(t.users, f["user_inserts"]).extra["new_users"]


@_w("reassign_admins")
def _q_reassign(t, f):
    return _W.reassign_admins(t.users, f["user_reassignments"]).table


register("constraint_violations")(lambda s, d: _W.constraint_violations(_t(s, d)))


@_w("insert_products")
def _q_ins_prod(t, f):
    return _W.insert_products(t, f["product_inserts"]).extra["new_products"]


@_w("update_store_products")
def _q_edit(t, f):
    return _W.update_store_products(t, f["store_product_edits"]).table


@_w("create_stores_with_admins")
def _q_signup(t, f):
    return _W.create_stores_with_admins(t, f["store_signups"]).extra["new_stores"]

# --- T: streaming --------------------------------------------------------------------
from glazier.plans.session import (  # noqa: E402
    at_once as _at_once, shared_path as _shared, shuffles_dropped as _shuffles_dropped, stored as _stored)
from glazier.streaming import streams as _S  # noqa: E402


def _stream_daily_revenue(s, d):
    n_stores = s.read.parquet(f"{d.rstrip('/')}/supplier.parquet").count()
    out, ckpt = _shared(s, "t2-tiles"), _shared(s, "t2-ckpt")
    _S.run_daily_revenue(_S.sales_stream(s, d, n_stores), out, ckpt)
    return _S.current_tiles(s, out)


# The time ranges the demo stream replays, one micro-batch each.
STREAM_BOUNDS = ["1997-01-01", "1999-01-01", "2001-01-01"]


def _replayed(s, t, name, post):
    """Post the bill requests by ``post(tables, stream)``, one time range after the other.  The tables that every
    micro-batch reads are derived from the driver's once."""
    names = ("stores", "products", "inventory")
    with _shuffles_dropped(s):
        t = t.with_(**dict(zip(names, _at_once(*[lambda n=n: _stored(getattr(t, n), n) for n in names]))))
    _S.stage_bill_requests(t.bill_requests, _shared(s, name), STREAM_BOUNDS,
                           lambda staged: post(t, _S.bill_request_stream(s, staged, files_per_trigger=None)))
    return t


def _stream_post_bills(s, d):
    out, ckpt = _shared(s, "t1-out"), _shared(s, "t1-ckpt")
    _replayed(s, _t(s, d), "t1-requests", lambda t, bills: _S.run_post_bills(t, bills, out, ckpt))
    return s.read.parquet(f"{out}/decisions")


register("stream_daily_revenue")(_stream_daily_revenue)
register("stream_post_bills")(_stream_post_bills)


def _violations_raw(s, d):
    """W16 over tables with the raw feeds appended without any checks."""
    from glazier.sources.tables import conform
    t, f = _t(s, d), _feeds(s, d)
    raw_users = f["user_inserts"].select(
        _F.col("seq").cast("int").alias("id"), "store_id", "full_name", "username", "email", "role",
        _F.lit(True).alias("status"), "created_at", _F.col("created_at").alias("updated_at"))
    raw_inv = f["inventory_changes"].select(
        _F.col("seq").alias("id"), "store_id", "product_id", "purchase_rate", "selling_rate", "available_stock",
        "minimum_stock", _F.col("changed_at").alias("created_at"), _F.col("changed_at").alias("updated_at"))
    t2 = t.with_(users=t.users.unionByName(conform(raw_users, "users")),
                 inventory=t.inventory.unionByName(conform(raw_inv, "inventory")))
    return _W.constraint_violations(t2)


register("constraint_violations_raw_feeds")(_violations_raw)

# --- S: sinks ---------------------------------------------------------------------------
from glazier.sources.tables import to_json_rows as _to_json  # noqa: E402

# Rows-only: JSON text formatting (number and time rendering) differs between engines; the parsed rows are compared below.
register("invoice_history_json")(lambda s, d: _to_json(_L.invoice_history(_t(s, d)), ["invoice_id"]))


@_w("patch_categories")
def _q_patch_cats(t, f):
    return _W.patch_categories(t.glass_categories, f["category_patches"]).table


@_w("patch_categories_rejects")
def _q_patch_cats_rej(t, f):
    return _W.patch_categories(t.glass_categories, f["category_patches"]).rejects

# --- store forms, ids, and what change-set jobs refuse ------------------------------------
ONE_STORE, NO_STORE = 3, 987654

register("low_stock_alerts_store")(lambda s, d: reports.low_stock_alerts(_t(s, d), ONE_STORE))
register("top_products_store")(lambda s, d: reports.top_products(_t(s, d), store_id=ONE_STORE))
register("monthly_revenue_store")(lambda s, d: reports.monthly_revenue(_t(s, d), FIXTURE_AS_OF, ONE_STORE))
register("store_summary_store")(lambda s, d: reports.store_summary(_t(s, d), FIXTURE_AS_OF, ONE_STORE))
register("store_summary_unknown_store")(lambda s, d: reports.store_summary(_t(s, d), FIXTURE_AS_OF, NO_STORE))
register("available_inventory_store")(lambda s, d: _L.available_inventory(_t(s, d), ONE_STORE))
register("store_products_store")(lambda s, d: _L.store_products(_t(s, d), ONE_STORE))
register("invoice_history_store")(lambda s, d: _L.invoice_history(_t(s, d), ONE_STORE))


def _detail_ids(s, d):
    t = _t(s, d)
    return _L.product_detail(t, t.inventory.filter(_F.col("available_stock") <= 0).select("product_id").distinct())


def _lookup_categories(s, d):
    t = _t(s, d)
    return _L.lookup(t.glass_categories, "category_name", _feeds(s, d)["category_requests"], "category_name", ignore_case=True)


def _lookup_products(s, d):
    t = _t(s, d)
    return _L.lookup(t.products, "id", _feeds(s, d)["product_delete_ids"])


register("product_detail_ids")(_detail_ids)
register("lookup_categories_by_name")(_lookup_categories)
register("lookup_products_by_id")(_lookup_products)


@_w("upsert_inventory_rejects")
def _q_upsert_rej(t, f):
    return _W.upsert_inventory(t.inventory, f["inventory_changes"], t.stores.filter("status"), t.products).rejects


@_w("set_discount_override_rejects")
def _q_override_rej(t, f):
    return _W.set_discount_override(t.inventory, f["override_changes"]).rejects


@_w("deactivate_stores_rejects")
def _q_deact_rej(t, f):
    return _W.deactivate_stores(t.stores, f["store_deactivate_ids"]).rejects


@_w("insert_categories_rejects")
def _q_ins_cat_rej(t, f):
    return _W.insert_categories(t.glass_categories, f["category_inserts"]).rejects


@_w("resolve_category_rejects")
def _q_resolve_rej(t, f):
    return _W.resolve_category(f["category_requests"], t.glass_categories).rejects


@_w("reassign_admins_rejects")
def _q_reassign_rej(t, f):
    return _W.reassign_admins(t.users, f["user_reassignments"]).rejects


@_w("insert_products_rejects")
def _q_ins_prod_rej(t, f):
    return _W.insert_products(t, f["product_inserts"]).rejects


def _after_inserts(t, f):
    """The tables after W11, in which some products are on no invoice."""
    made = _W.insert_products(t, f["product_inserts"])
    return t.with_(products=made.table, inventory=made.extra["inventory"])


@_w("delete_new_products")
def _q_del_new(t, f):
    return _W.delete_products(_after_inserts(t, f), f["product_delete_ids"]).table.select(
        "id", "product_name", "category_id", "color", "thickness", "unit")


@_w("delete_new_products_inventory")
def _q_del_new_stock(t, f):
    stock = _W.delete_products(_after_inserts(t, f), f["product_delete_ids"]).extra["inventory"]
    return stock.groupBy("store_id").agg(_F.count(_F.lit(1)).alias("stock_rows"), _F.sum("product_id").alias("id_sum"))


@_w("delete_new_categories")
def _q_del_new_cat(t, f):
    made = _W.insert_categories(t.glass_categories, f["category_inserts"]).table
    return _W.delete_categories(t.with_(glass_categories=made), f["category_delete_ids"]).table.select("id", "category_name")


# --- every output of the ordered jobs, keyed streams and round trips --------------------------------------
@_w("insert_users_rejects")
def _q_ins_users_rej(t, f):
    return _W.insert_users(t.users, f["user_inserts"]).rejects


@_w("create_stores_with_admins_users")
def _q_signup_users(t, f):
    return _W.create_stores_with_admins(t, f["store_signups"]).extra["new_users"]


@_w("create_stores_with_admins_rejects")
def _q_signup_rej(t, f):
    return _W.create_stores_with_admins(t, f["store_signups"]).rejects


@_w("update_store_products_inventory")
def _q_edit_stock(t, f):
    return _W.update_store_products(t, f["store_product_edits"]).extra["inventory"]


@_w("update_store_products_rejects")
def _q_edit_rej(t, f):
    return _W.update_store_products(t, f["store_product_edits"]).rejects


from glazier.streaming import keyed as _K  # noqa: E402


def _posted_by_key(s, d):
    out, ckpt = _shared(s, "t1-keyed-out"), _shared(s, "t1-keyed-ckpt")
    _replayed(s, _t(s, d), "t1-keyed-requests", lambda t, bills: _K.run_post_bills_keyed(t, bills, out, ckpt))
    return out, ckpt


register("stream_post_bills_keyed")(lambda s, d: s.read.parquet(f"{_posted_by_key(s, d)[0]}/decisions"))
register("stream_stock_keyed")(lambda s, d: _K.stock_in_state(s, _posted_by_key(s, d)[1]))


def _from_json(s, d):
    history = _L.invoice_history(_t(s, d))
    text = _to_json(history, ["invoice_id"])
    return text.select(_F.from_json("json", history.schema).alias("row")).select("row.*")


register("invoice_history_from_json")(_from_json)

from glazier.sources.tables import load_tables as _load, write_tables as _write  # noqa: E402

for _name in ("products", "inventory", "invoice_items"):
    register(f"round_trip_{_name}")((lambda n: lambda s, d: getattr(
        _load(s, _write(_t(s, d), _shared(s, "snapshot"), num_files=4)), n))(_name))


# --- W2: edits of products, stores and users ----------------------------------------------------------------
_EDITS = {
    "patch_products": lambda t, f: _W.patch_products(t.products, f["product_patches"], t.glass_categories),
    "patch_stores": lambda t, f: _W.patch_stores(t.stores, f["store_patches"]),
    "patch_credentials": lambda t, f: _W.patch_users(t.users, f["user_patches"]),
    "patch_store_admins": lambda t, f: _W.patch_users(t.users, f["user_patches"], store_admins_only=True),
}
for _name, _edit in _EDITS.items():
    _w(_name)((lambda edit: lambda t, f: edit(t, f).table)(_edit))
    _w(f"{_name}_rejects")((lambda edit: lambda t, f: edit(t, f).rejects)(_edit))


# --- dashboards kept fresh by the posted batches ---------------------------------------------------------------
from glazier.streaming import fresh as _Fresh  # noqa: E402


def _fresh(name):
    """Register a report from the partial sums that T1's batches left, after the last batch."""
    def deco(build):
        def query(s, d):
            out, ckpt = _shared(s, "t1-fresh"), _shared(s, "t1-ckpt")
            t = _replayed(s, _t(s, d), "t1-requests", lambda t, bills: _S.run_post_bills(t, bills, out, ckpt, reports=True))
            last = _S.last_batch(s, out)
            return build(t, out, last, _Fresh.partials(s, out, last))
        register(f"fresh_{name}")(query)
        return build
    return deco


@_fresh("master_summary")
def _q_fresh_master(t, out, last, parts):
    return _Fresh.master_summary(parts, t, FIXTURE_AS_OF)


@_fresh("branch_performance")
def _q_fresh_branches(t, out, last, parts):
    return _Fresh.branch_performance(parts, t)


@_fresh("monthly_revenue")
def _q_fresh_months(t, out, last, parts):
    posted = t.invoices.sparkSession.read.parquet(f"{out}/invoices").select(*t.invoices.columns)
    return _Fresh.monthly_revenue(parts, t.invoices.unionByName(posted), FIXTURE_AS_OF)


@_fresh("store_summary")
def _q_fresh_store(t, out, last, parts):
    return _Fresh.store_summary(parts, t, FIXTURE_AS_OF)


@_fresh("store_wise_revenue")
def _q_fresh_stores(t, out, last, parts):
    return _Fresh.store_wise_revenue(parts, t, FIXTURE_AS_OF)


@_fresh("top_products_by_store")
def _q_fresh_top(t, out, last, parts):
    return _Fresh.top_products_by_store(t.products.sparkSession, out, last, t.products)


# --- deep pages, more lookups, deletes by the reference graph -------------------------------------------------
from glazier.operators import paging as _P  # noqa: E402
from glazier.operators import referential as _Ref  # noqa: E402


def _indexed_page(s, d):
    t = _t(s, d)
    index = _P.index_invoice_history(t, _shared(s, "invoice-order"), rows_per_range=1_000)
    return _P.indexed_invoice_history(t, index, 100, 10)


def _page_after(s, d):
    inv = _t(s, d).invoices.select("invoice_id", "store_id", "grand_total", "created_at")
    order = [("created_at", False), ("invoice_id", False)]
    shown = _L.page(inv, [_F.col("created_at").desc(), _F.col("invoice_id").desc()], 3, 10).collect()  # one page
    return _L.page_after(inv, order, shown[-1].asDict() if shown else None, 10)


register("invoice_history_indexed_page")(_indexed_page)
register("invoice_page_after")(_page_after)
register("lookup_users_by_email")(lambda s, d: _L.lookup(_t(s, d).users, "email", _t(s, d).stores.select(
    _F.concat(_F.lit("admin-"), "store_email").alias("email")).filter(_F.col("email").contains("3"))))
register("lookup_store_admins_by_id")(lambda s, d: _L.lookup(
    _t(s, d).users.filter(_R.role_is("role", "store")), "id", _feeds(s, d)["store_deactivate_ids"]))
register("lookup_categories_by_id")(lambda s, d: _L.lookup(_t(s, d).glass_categories, "id", _feeds(s, d)["category_delete_ids"]))
register("lookup_stores_by_email")(lambda s, d: _L.lookup(_t(s, d).stores, "store_email", _feeds(s, d)["store_signups"], "store_email"))


@_w("delete_invoices_items")
def _q_del_invoices(t, f):
    gone = _Ref.delete_rows(t, "invoices", t.products.select((_F.col("id") * 23).alias("id")))
    return gone.tables.invoice_items.select("invoice_id", "line_no", "product_id", "quantity")


@_w("delete_invoices_rejects")
def _q_del_invoices_rej(t, f):
    return _Ref.delete_rows(t, "invoices", t.products.select((_F.col("id") * 23).alias("id"))).rejects


@_w("delete_stores_rejects")
def _q_del_stores_rej(t, f):
    return _Ref.delete_rows(t, "stores", f["store_deactivate_ids"]).rejects


@_w("delete_users_rejects")
def _q_del_users_rej(t, f):
    return _Ref.delete_rows(t, "users", f["user_reassignments"].select("user_id")).rejects


@_w("delete_new_stores_inventory")
def _q_del_new_stores(t, f):
    """New stores have no invoices yet: they go with the stock they were given."""
    made = _W.create_stores_with_admins(t, f["store_signups"])
    stores = made.extra["new_stores"]
    given = t.inventory.filter(_F.col("product_id") % 5 == 0).join(
        stores.select(_F.col("store_id").alias("new_id")), _F.col("new_id") % 97 == _F.col("store_id")).select(
        (_F.col("id") + _F.col("new_id").cast("long") * 10**9).alias("id"), _F.col("new_id").cast("int").alias("store_id"),
        *[c for c in t.inventory.columns if c not in ("id", "store_id")])
    after = t.with_(stores=made.table, inventory=t.inventory.unionByName(given.select(*t.inventory.columns)))
    gone = _Ref.delete_rows(after, "stores", stores.filter(_F.col("store_id") % 2 == 0).select("store_id"))
    return gone.tables.inventory.groupBy("store_id").agg(_F.count(_F.lit(1)).alias("stock_rows"))
