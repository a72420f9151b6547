"""Bill posting.

A bill is all-or-nothing: it is accepted only when every line passes, and an
accepted bill lowers the stock seen by the store's later bills.  Everything
that does not depend on earlier outcomes runs as native, set-based Spark
(validation, enrichment, discount limits, pricing, totals, stock update).

Only the accept/reject decision of bills that touch *contended* stock needs
order.  A (store, product) key is uncontended when the total quantity
requested on it by every bill that passes validation is within its starting
stock: then no line on it can ever fail, whatever is accepted before it.
Bills touching only uncontended keys are decided at once.  The others are
decided by rounds of running sums per key (``_accepted_contended``), in which a hot
key is spread over all tasks (``glazier.plans.prefix``), and only
chains of bills that would need many rounds by an ordered fold
(``_fold_rest``), which streams and keeps one stock number per key.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glazier.functions.rules import billing_dimension, effective_max_discount, line_area, line_base, line_price, line_sides
from glazier.plans.groups import connected_groups
from glazier.plans.prefix import cut_ranges, sums_before
from glazier.plans.session import forget, shuffles_dropped, stored
from glazier.sources.tables import Tables, conform

# Reasons a bill is refused.
R_NO_ITEMS = "no_items"
R_INVALID_ITEM = "invalid_product_or_quantity"
R_INVALID_WIDTH = "invalid_width"
R_INVALID_HEIGHT = "invalid_height"
R_INVALID_CHARGED_RATE = "invalid_charged_rate"
R_INVALID_AREA = "invalid_area"
R_NOT_FOUND = "not_found"
R_STOCK = "insufficient_stock"
R_DISCOUNT = "discount_limit_exceeded"
R_AMOUNT = "amount_out_of_range"
ACCEPTED, REJECTED = "accepted", "rejected"

BILL_ORDER = ("created_at", "bill_id")

def validate_bill_requests(reqs: DataFrame) -> DataFrame:
    """B1: per-line request checks, in the order the request is read.

    ``invalid_reason`` is the line's first failing check (NULL when valid).
    A bill needs an item: one without any is a single row without ``line_no``.
    A product id must be present (0 is a valid id here) and the quantity > 0;
    width, height and area must be > 0 and charged_rate >= 0 when given."""
    q = F.col("quantity")
    reason = (F.when(F.col("line_no").isNull(), F.lit(R_NO_ITEMS))
              .when(F.col("product_id").isNull() | q.isNull() | (q <= 0), F.lit(R_INVALID_ITEM))
              .when(F.col("width").isNotNull() & (F.col("width") <= 0), F.lit(R_INVALID_WIDTH))
              .when(F.col("height").isNotNull() & (F.col("height") <= 0), F.lit(R_INVALID_HEIGHT))
              .when(F.col("charged_rate").isNotNull() & (F.col("charged_rate") < 0), F.lit(R_INVALID_CHARGED_RATE))
              .when(F.col("area").isNotNull() & (F.col("area") <= 0), F.lit(R_INVALID_AREA)))
    return reqs.withColumn("invalid_reason", reason)


def _with_stock(lines: DataFrame, t: Tables) -> DataFrame:
    """B2, first half: each line with its stock row, if there is one (``has_stock``)."""
    inv = t.inventory.select(
        F.col("store_id").alias("inv_store_id"), F.col("product_id").alias("inv_product_id"),
        F.lit(True).alias("has_stock"), "available_stock", "selling_rate", "override_max_discount")
    return lines.join(inv, (lines.store_id == inv.inv_store_id) & (lines.product_id == inv.inv_product_id), "left").drop(
        "inv_store_id", "inv_product_id")


def _with_product(lines: DataFrame, t: Tables) -> DataFrame:
    """B2, second half: lines of ``_with_stock`` with product, store and limits."""
    prod = t.products.select(
        F.col("id").alias("p_id"), "product_name", "category_id", "thickness", "color",
        F.col("length").alias("p_length"), F.col("width").alias("p_width"), F.col("area").alias("p_area"),
        "unit", "dimension_unit")
    stores = t.stores.select(F.col("store_id").alias("s_id"), "default_max_discount")
    j = (lines.join(prod, F.col("product_id") == F.col("p_id"), "left")
         .join(stores, F.col("store_id") == F.col("s_id"), "left"))
    found = F.col("has_stock").isNotNull() & F.col("p_id").isNotNull() & F.col("s_id").isNotNull()
    return (j.withColumn("found", found)
            .withColumn("start_stock", F.coalesce("available_stock", F.lit(0)))
            .withColumn("max_discount", effective_max_discount("override_max_discount", "default_max_discount"))
            .withColumn("applied_discount", F.coalesce("discount_applied", F.lit(0)).cast("decimal(5,2)"))
            .drop("has_stock", "p_id", "s_id"))


def enrich_bill_lines(lines: DataFrame, t: Tables) -> DataFrame:
    """B2: attach stock, rate, discount limits and product sizes to each line.

    A line is found when its (store, product) has a stock row *and* the
    product and store exist (the reference's inner joins).  Lines join the
    stock table first, so only requested keys reach the product and store
    joins, never the whole inventory."""
    return _with_product(_with_stock(lines, t), t)


def check_bill_lines(lines: DataFrame) -> DataFrame:
    """B3, the stock-independent part: per line ``static_reason`` is
    not_found or discount_limit_exceeded (the discount is tested even when
    a charged_rate overrides the price; a negative discount passes).  The
    stock test (``start_stock`` < quantity on the *current* stock) is
    applied by ``post_bills`` in bill order."""
    disc_fail = F.col("applied_discount") > F.col("max_discount")
    return lines.withColumn(
        "static_reason",
        F.when(~F.col("found"), F.lit(R_NOT_FOUND)).when(disc_fail, F.lit(R_DISCOUNT)))


def price_bill_lines(lines: DataFrame) -> DataFrame:
    """Sizes (E7) then amounts (E6) per line, exact decimals; the stored
    line total is rounded to cents.  Each step reads the columns of the one
    before, so a line's sides, area and base are computed once."""
    length, width = line_sides("height", "length", "width", "p_length", "p_width")
    out = lines.withColumns({"line_length": length, "line_width": width})
    out = out.withColumns({"line_billing_length": billing_dimension("line_length"),
                           "line_billing_width": billing_dimension("line_width")})
    out = out.withColumns({side: F.col(f"line_billing_{side[1:]}").cast("double") for side in ("_length", "_width")})
    out = out.withColumn("line_area", line_area("area", "_length", "_width", "dimension_unit", "unit"))
    out = out.withColumn("_base", line_base("selling_rate", "line_area", "quantity")).drop("_length", "_width")
    out = out.withColumns(line_price("selling_rate", "line_area", "quantity", "applied_discount", "charged_rate", "_base")).drop("_base")
    # A line whose amounts pass the columns' range is refused with its bill;
    # the other bills go on.
    out = out.withColumn("total_price", F.col("final_total").try_cast("decimal(12,2)"))
    fits = (F.col("total_price").isNotNull() & F.col("base_total").try_cast("decimal(12,2)").isNotNull()
            & F.col("line_area").try_cast("decimal(10,4)").isNotNull())
    priced = F.col("selling_rate").isNotNull() | F.col("charged_rate").isNotNull()
    return out.withColumn("static_reason", F.when(F.col("static_reason").isNull() & priced & ~fits, F.lit(R_AMOUNT))
                          .otherwise(F.col("static_reason")))


def prepare_bill_lines(reqs: DataFrame, t: Tables) -> DataFrame:
    """B1 -> B2 -> B3 (static) -> B4 as one native plan."""
    return price_bill_lines(check_bill_lines(enrich_bill_lines(validate_bill_requests(reqs), t)))


def build_invoices(lines: DataFrame) -> DataFrame:
    """One header per bill with its cashier and customer: sub_total = sum
    of line bases, grand_total = sum of line finals, each rounded once to
    cents."""
    return conform(lines.groupBy("bill_id", "store_id", "created_at", "billed_by", "customer_name", "customer_phone").agg(
        F.sum("base_total").try_cast("decimal(12,2)").alias("sub_total"),
        F.sum("final_total").try_cast("decimal(12,2)").alias("grand_total"))
        .withColumnRenamed("bill_id", "invoice_id"), "invoices")


def build_invoice_items(lines: DataFrame) -> DataFrame:
    """The stored item columns (original, not bracketed, sides) in request order."""
    return conform(lines.select(
        F.col("bill_id").alias("invoice_id"), "product_id", "quantity",
        F.col("selling_rate").alias("unit_price"), F.col("applied_discount").alias("discount_percent"),
        "total_price", F.col("line_length").alias("length"), F.col("line_width").alias("width"),
        "charged_dimension", F.col("line_area").alias("area"), "charged_rate", "line_no"), "invoice_items")


def apply_stock(inventory: DataFrame, lines: DataFrame, sold_only: bool = False) -> DataFrame:
    """Lower stock by the quantities sold per (store, product).  Sales are
    summed per key (partial aggregate) before the join with the stock table.
    With ``sold_only`` the rows that nothing was sold of are left out, and ``stock_before`` is the stock they had."""
    sold = lines.groupBy(F.col("store_id").alias("sold_store_id"),
                         F.col("product_id").alias("sold_product_id")).agg(
        F.sum("quantity").alias("sold_qty"), F.max("created_at").alias("sold_at"))
    j = inventory.join(sold, (inventory.store_id == sold.sold_store_id)
                       & (inventory.product_id == sold.sold_product_id), "inner" if sold_only else "left")
    touched = F.col("sold_qty").isNotNull()
    before = [F.col("available_stock").alias("stock_before")] if sold_only else []
    j = j.select("*", *before).withColumns({
        "available_stock": F.when(touched, (F.col("available_stock") - F.col("sold_qty")).cast("int"))
        .otherwise(F.col("available_stock")),
        "updated_at": F.when(touched, F.greatest("updated_at", "sold_at")).otherwise(F.col("updated_at"))})
    return conform(j, "inventory", [c for c in j.columns if c == "stock_before"])


def bill_receipts(invoices: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """The receipt returned for a posted bill; the line field
    ``charged_rate`` there carries the line's *total*.  Lines are in request order."""
    p = products.select(F.col("id").alias("p_id"), "product_name", "category_id", "thickness", "color", "unit")
    line = F.struct(
        F.col("product_id").alias("productId"), F.col("product_name").alias("productName"),
        F.coalesce(F.col("category_id").cast("string"), F.lit("N/A")).alias("category"),
        "thickness", "length", "width", "charged_dimension", "color", "area", "unit", "quantity",
        F.col("total_price").alias("charged_rate"))
    keys = [F.col("line_no"), F.col("product_id"), F.col("quantity"), F.col("total_price"), F.col("length"), F.col("width"),
            F.col("area"), F.col("charged_dimension")]
    key_fields = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    per_invoice = (items.join(p, items.product_id == p.p_id)
                   .groupBy(F.col("invoice_id").alias("r_invoice_id"))
                   .agg(F.transform(F.sort_array(F.collect_list(F.struct(*key_fields, line.alias("v")))),
                                    lambda x: x["v"]).alias("items")))
    return (invoices.join(per_invoice, invoices.invoice_id == per_invoice.r_invoice_id)
            .select("invoice_id", "customer_name", F.col("grand_total").alias("total_price"),
                    "created_at", "items"))


# --- B8 -----------------------------------------------------------------------

SLOW_ROUND = 0.1  # rounds that decide a smaller share of the open rows leave the rest to the fold
STOCK_KEY = ["store_id", "product_id"]


def _accepted_contended(wants: DataFrame) -> DataFrame:
    """(bill_id) of the accepted bills among those that want contended stock.

    ``wants`` (from ``cut_ranges``): per bill and key the quantity taken and the largest line (``taken``, ``most``),
    the key's starting stock and the bill's place.  Rounds of running sums over the keys decide bills
    exactly: a bill all of whose lines fit even if every open earlier bill is accepted is accepted; a
    bill with a line that cannot fit after only the accepted earlier bills is refused.  The earliest
    open bill of a key chain is decided in every round.  Decided bills leave the rows; what the accepted
    ones took is carried in ``sold``.  Chains that would take many rounds are left to ``_fold_rest``."""
    rows = wants.withColumns({"sold": F.lit(0).cast("long"), "accepted": F.lit(False)})
    done, rounds, left, before = [], [], rows.count(), None
    while left:
        newly = F.when(F.col("accepted"), F.col("taken"))
        ahead = F.when(~F.col("accepted"), F.col("taken"))
        still = (sums_before(rows, STOCK_KEY, list(BILL_ORDER), gone=newly, ahead=ahead).filter(~F.col("accepted"))
                 .withColumn("sold", F.col("sold") + F.col("gone")).drop("gone", "accepted"))
        if before is not None and left > (1 - SLOW_ROUND) * before:
            done.append(_folded(still.drop("ahead")))
            break
        free = F.col("start_stock") - F.col("sold")
        bills = still.groupBy("bill_id").agg(F.min(free - F.col("ahead") >= F.col("most")).alias("accepted"),
                                             F.max(free < F.col("most")).alias("fails"))
        rows = stored(still.join(bills, "bill_id").filter(F.col("accepted") | ~F.col("fails")).drop("fails", "ahead"), "round")
        rounds.append(rows)
        done.append(rows.filter("accepted").select("bill_id").distinct())
        before, left = left, rows.filter(~F.col("accepted")).count()
    out = wants.select("bill_id").limit(0)
    for part in done:
        out = out.union(part)
    out = stored(out, "contended-accepted")
    forget(*rounds)
    return out


def _folded(rest: DataFrame) -> DataFrame:
    """(bill_id) of the accepted bills of what the rounds leave, by one ordered fold per connected group of keys."""
    node = F.col("store_id").cast("long") * F.lit(1 << 32) + F.col("product_id").cast("long")
    rest = stored(rest.withColumn("node", node), "chains")
    groups = connected_groups(rest.select(F.col("bill_id").alias("item"), "node"))
    return (rest.join(groups, "node").repartition("label").sortWithinPartitions("label", *BILL_ORDER)
            .select("label", "bill_id", "node", "taken", "most", (F.col("start_stock") - F.col("sold")).alias("free"))
            .mapInArrow(_fold_rest, "bill_id long"))


def _fold_rest(batches):
    """Open bills of a connected group of keys in order: what the group's bills took of each key so far is
    all that is kept; ``free`` is the stock left by the bills decided before.  Yields the accepted bills."""
    group, took, bill, held = None, {}, None, []

    def close():
        fits = all(r["free"] - took.get(r["node"], 0) >= r["most"] for r in held)
        if fits:
            for r in held:
                took[r["node"]] = took.get(r["node"], 0) + r["taken"]
        return fits

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if (r["label"], r["bill_id"]) != bill:
                if held and close():
                    out.append(held[0]["bill_id"])
                held, bill = [], (r["label"], r["bill_id"])
            if r["label"] != group:
                group, took = r["label"], {}
            held.append(r)
        yield pa.RecordBatch.from_pydict({"bill_id": pa.array(out, pa.int64())})
    if held and close():
        yield pa.RecordBatch.from_pydict({"bill_id": pa.array([held[0]["bill_id"]], pa.int64())})


def _decide_contended(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Decisions of the bills with a line on a contended key (``lines``: those
    lines up to the bill's first stock-independent failure), and the copies they are read from."""
    wants = lines.groupBy(*STOCK_KEY, *BILL_ORDER).agg(
        F.sum("quantity").alias("taken"), F.max("quantity").alias("most"), F.first("start_stock").alias("start_stock"),
        F.max("static_line").alias("static_line"))
    wants = cut_ranges(wants, STOCK_KEY, list(BILL_ORDER))
    accepted = _accepted_contended(wants.filter("static_line is null").drop("static_line"))
    # Stock each bill met: the start less what the accepted earlier bills took.
    met = sums_before(wants.join(accepted.withColumn("accepted", F.lit(True)), "bill_id", "left"), STOCK_KEY, list(BILL_ORDER),
                      sold=F.when(F.col("accepted"), F.col("taken")))
    met = met.select(*STOCK_KEY, "bill_id", F.coalesce("accepted", F.lit(False)).alias("accepted"),
                     (F.col("start_stock") - F.col("sold")).alias("met"))
    short = F.when(F.col("met") < F.col("quantity"), F.col("line_no"))
    judged = (lines.join(met, [*STOCK_KEY, "bill_id"]).groupBy("bill_id", "store_id", "created_at")
              .agg(F.max("accepted").alias("accepted"), F.min(short).alias("short_line"),
                   F.max("static_line").alias("static_line"), F.max("bill_static_reason").alias("static_reason")))
    refused = ~F.col("accepted")
    return judged.select(
        "bill_id", "store_id", "created_at", F.when(refused, F.lit(REJECTED)).otherwise(F.lit(ACCEPTED)).alias("status"),
        F.when(refused, F.when(F.col("short_line").isNotNull(), F.lit(R_STOCK)).otherwise(F.col("static_reason"))).alias("reason"),
        F.when(refused, F.coalesce("short_line", "static_line")).cast("int").alias("failed_line")), [wants, accepted]


# The line columns posting needs: decision inputs and the stored outputs.
POSTING_COLUMNS = ("bill_id", "store_id", "created_at", "line_no", "product_id", "quantity", "start_stock", "found",
                   "invalid_reason", "static_reason", "selling_rate", "applied_discount", "total_price",
                   "line_length", "line_width", "charged_dimension", "line_area", "charged_rate", "base_total",
                   "final_total", "billed_by", "customer_name", "customer_phone")


# The columns that decide a bill, of a line and of what its bill's lines say together.
LINE_FACTS = ("bill_id", "store_id", "created_at", "line_no", "product_id", "quantity", "start_stock", "found",
              "invalid_reason", "static_reason", "base_total")
# The columns that decide the bills with a line on a contended key.
FOLD_COLUMNS = (*STOCK_KEY, *BILL_ORDER, "line_no", "quantity", "start_stock", "static_line", "bill_static_reason")


@dataclass(frozen=True)
class Posting:
    decisions: DataFrame       # bill_id, store_id, created_at, status, reason, failed_line
    invoices: DataFrame        # headers of accepted bills
    invoice_items: DataFrame   # items of accepted bills
    inventory: DataFrame       # stock after the accepted bills
    lines: DataFrame           # priced lines of accepted bills (POSTING_COLUMNS)
    copies: tuple = ()         # what is stored for the outputs; to be forgotten by who has written them


def post_bills(t: Tables, reqs: DataFrame | None = None, part: bool = False) -> Posting:
    """Post many bills, each all-or-nothing, per store in (created_at,
    bill_id) order; accepted bills lower the stock later bills see.

    Lines and decisions are written to the shared checkpoint folder once, so
    the outputs reuse them and a lost executor recomputes from there.  The
    lines pass each shuffle in a step of their own, whose files go when it
    ends, and only the columns that decide go on to the facts of the bill:
    disk holds one step's shuffle, not all of them.  With ``part`` the
    requests are a small part of the whole (a micro-batch): the joins with
    stock and product are one step, which saves a copy of the lines."""
    reqs = t.bill_requests if reqs is None else reqs
    with shuffles_dropped(reqs.sparkSession):
        return _post_bills(t, reqs, part)


def _post_bills(t: Tables, reqs: DataFrame, part: bool) -> Posting:
    stocked = _with_stock(validate_bill_requests(reqs), t)
    copies = [] if part else [stored(stocked, "stocked-lines")]
    stocked = stocked if part else copies[0]
    # A bill without items is refused at line 0, before any line.
    priced = stored(price_bill_lines(check_bill_lines(_with_product(stocked, t))).select(*POSTING_COLUMNS).withColumn(
        "line_no", F.coalesce("line_no", F.lit(0))), "priced-lines")
    forget(*copies)
    lines = priced.select(*LINE_FACTS)

    # Per-bill facts on every line, from one window over the bill (one
    # shuffle by bill_id): first invalid line and its reason, first line
    # failing a stock-independent check and its reason, first and last line.
    w = Window.partitionBy("bill_id")
    at = (-F.col("line_no").cast("long")).alias("at")
    first = lambda reason: F.max(F.when(F.col(reason).isNotNull(), F.struct(at, F.col(reason).alias("reason")))).over(w)
    too_large = (F.count("base_total").over(w) > 0) & F.sum("base_total").over(w).try_cast("decimal(12,2)").isNull()
    lines = lines.withColumns({"invalid": first("invalid_reason"), "static": first("static_reason"), "too_large": too_large,
                               "first_line": F.min("line_no").over(w), "last_line": F.max("line_no").over(w)})
    # A bill whose sum passes the header's range fails once its lines have passed.
    fails_late = F.col("too_large") & F.col("static").isNull() & F.col("invalid").isNull()
    lines = lines.withColumns({
        "invalid_line": (-F.col("invalid.at")).cast("int"), "bill_invalid_reason": F.col("invalid.reason"),
        "static_line": F.when(fails_late, F.col("last_line")).otherwise((-F.col("static.at")).cast("int")),
        "bill_static_reason": F.when(fails_late, F.lit(R_AMOUNT)).otherwise(F.col("static.reason"))})
    lines = lines.drop("invalid", "static", "too_large", "last_line", "invalid_reason", "static_reason", "base_total")
    lines = stored(lines, "bill-lines")

    # Demand per key from every bill that passes validation, on its lines up
    # to (and including) its first static failure: the only lines whose
    # stock test can ever run.  Keys whose demand fits their stock can never
    # fail; only bills with a line on a contended key need the ordered fold.
    lb = lines.filter(F.col("invalid_line").isNull() & F.col("found")
                      & (F.col("static_line").isNull() | (F.col("line_no") <= F.col("static_line"))))
    demand = lb.groupBy("store_id", "product_id").agg(F.sum("quantity").alias("demand"),
                                                      F.max("start_stock").alias("stock"))
    contended = demand.filter(F.col("demand") > F.col("stock")).select("store_id", "product_id")
    fold_lines = stored(lb.join(contended, ["store_id", "product_id"], "left_semi").select(*FOLD_COLUMNS), "contended-lines")
    folded, passing = _decide_contended(fold_lines)

    bill_rows = lines.filter(F.col("line_no") == F.col("first_line"))
    native = (bill_rows.join(fold_lines.select("bill_id").distinct(), "bill_id", "left_anti")
              .select("bill_id", "store_id", "created_at",
                      F.when(F.col("invalid_line").isNull() & F.col("static_line").isNull(), F.lit(ACCEPTED))
                      .otherwise(F.lit(REJECTED)).alias("status"),
                      F.coalesce("bill_invalid_reason", "bill_static_reason").alias("reason"),
                      F.nullif(F.coalesce("invalid_line", "static_line"), F.lit(0)).cast("int").alias("failed_line")))
    decisions = stored(native.unionByName(folded), "bill-decisions")
    forget(lines, fold_lines, *passing)
    accepted = priced.join(decisions.filter(F.col("status") == ACCEPTED).select("bill_id"), "bill_id", "left_semi")
    return Posting(decisions=decisions, invoices=build_invoices(accepted),
                   invoice_items=build_invoice_items(accepted),
                   inventory=apply_stock(t.inventory, accepted), lines=accepted, copies=(priced, decisions))

