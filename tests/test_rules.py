"""Row rules and reports on hand-made edge tables (FIXTURES.md §3)."""

from decimal import Decimal

from pyspark.sql import functions as F

from retail_rows import D, TS, make, tables
from glazier.functions import rules as R
from glazier.operators import listings as L
from glazier.operators import reports as Rep


def test_billing_dimension_brackets(spark):
    df = spark.createDataFrame([(D(x),) for x in (0, -3, 12, 12.01, 18, 24, 36, 36.01)] + [(None,)],
                               "x decimal(10,2)")
    got = [r[0] for r in df.select(R.billing_dimension("x")).collect()]
    assert got == [D(12), D(12), D(12), D(18), D(18), D(24), D(36), D("36.01"), None]


def test_area_units(spark):
    rows = [(D(12), D(12), "Feet", "Sq.ft"), (D(12), D(12), "inches", "Sq.ft"), (D(12), D(12), "in", "SQM"),
            (D(304.8), D(304.8), "cm", "Sq.ft"), (D(304.8), D(304.8), None, "square meter"),
            (None, D(3), "ft", "Sq.ft")]
    df = spark.createDataFrame(rows, "l decimal(10,2), w decimal(10,2), du string, u string")
    got = [r[0] for r in df.select(R.area("l", "w", "du", "u")).collect()]
    assert got == [D("144.0000"), D("1.0000"), D("0.0929"), D("1.0000"), D("0.0929"), D("0.0000")]


def test_stock_status_and_discount(spark):
    df = spark.createDataFrame([(None, 5, None, D(10)), (0, 5, D(0), D(10)), (-2, -5, None, None),
                                (5, 5, D(3), None), (6, None, None, D(7))],
                               "a int, m int, o decimal(5,2), d decimal(5,2)")
    got = df.select(R.stock_status("a", "m"), R.effective_max_discount("o", "d")).collect()
    assert [tuple(r) for r in got] == [("in_stock", D(10)), ("out_of_stock", D(0)), ("out_of_stock", D(0)),
                                       ("low_stock", D(3)), ("in_stock", D(7))]


def test_line_price_charged_rate_and_discount(spark):
    df = spark.createDataFrame([(D(10), D(2.5), 3, D(10), None), (D(10), D(2.5), 3, D(10), D(99))],
                               "r decimal(12,2), a decimal(14,4), q int, d decimal(5,2), c decimal(12,2)")
    p = R.line_price("r", "a", "q", "d", "c")
    got = df.select(p["base_total"], p["discount_amount"], p["final_total"]).collect()
    assert [float(x) for x in got[0]] == [75.0, 7.5, 67.5]
    assert [float(x) for x in got[1]] == [99.0, 0.0, 99.0]


def _inv(store, product, a, m, o=None, rate=10):
    return {"id": store * 1000 + product, "store_id": store, "product_id": product, "available_stock": a,
            "minimum_stock": m, "override_max_discount": D(o), "selling_rate": D(rate), "purchase_rate": D(5)}


def test_inventory_summary_overlaps(spark):
    t = tables(spark, stores=[{"store_id": 1, "status": True}],
               inventory=[_inv(1, 1, -2, -5), _inv(1, 2, None, 3), _inv(1, 3, 3, None), _inv(1, 4, 2, 2),
                          _inv(9, 5, 100, 0)])
    r = L.inventory_summary(t).first().asDict()
    assert r["total_inventory_records"] == 4          # store 9 does not exist
    assert r["out_of_stock_count"] == 1
    assert r["in_stock_count"] == 1                   # -2 > -5: out of stock *and* in stock
    assert r["low_stock_count"] == 1
    assert r["total_stock_units"] == 3
    assert r["total_stock_value"] == Decimal("30.00")


def test_monthly_revenue_bounds_and_store_wise(spark):
    inv = [{"invoice_id": i, "store_id": s, "grand_total": D(g), "created_at": TS(ts)} for i, s, g, ts in [
        (1, 1, 10, "2001-01-26 12:00:00"), (2, 1, 20, "2001-01-26 11:59:59"), (3, 1, 30, "2001-07-26 08:00:00"),
        (4, 2, 40, "2001-09-01 00:00:00"), (5, 3, 50, "2001-07-01 00:00:00")]]
    stores = [{"store_id": 1, "store_name": "a", "status": True}, {"store_id": 2, "store_name": "b", "status": False},
              {"store_id": 4, "store_name": "d", "status": True}]
    t = tables(spark, invoices=inv, stores=stores)
    months = [tuple(r) for r in Rep.monthly_revenue(t, "2001-07-26 12:00:00").collect()]
    assert months == [("Jan 2001", D("10.00")), ("Jul 2001", D("80.00")), ("Sep 2001", D("40.00"))]
    sw = {r.store_id: r for r in Rep.store_wise_revenue(t, "2001-07-26 12:00:00").collect()}
    assert set(sw) == {1, 4}                           # inactive store 2 dropped, store 4 kept with zeros
    assert (sw[1].total_revenue, sw[1].current_month_revenue, sw[1].today_revenue) == (D(60), D(30), D(30))
    assert (sw[4].total_revenue, sw[4].today_revenue) == (D(0), D(0))
    bp = {r.store_id for r in Rep.branch_performance(t).collect()}
    assert bp == {1, 2}                                # store 3 has no store row; inactive 2 kept


def test_top_products_same_name_kept_apart(spark):
    t = tables(spark, products=[{"id": 1, "product_name": "X"}, {"id": 2, "product_name": "X"}],
               invoice_items=[{"invoice_id": 1, "product_id": 1, "quantity": 3},
                              {"invoice_id": 2, "product_id": 2, "quantity": 4}])
    got = [tuple(r) for r in Rep.top_products(t).collect()]
    assert got == [(2, "X", 4), (1, "X", 3)]


def test_invoice_history_drops_invoices_without_items(spark):
    t = tables(spark, invoices=[{"invoice_id": 1, "store_id": 1}, {"invoice_id": 2, "store_id": 1}],
               products=[{"id": 7, "product_name": "P", "length": D(5), "category_id": None}],
               invoice_items=[{"invoice_id": 1, "product_id": 7, "quantity": 1, "length": None}])
    rows = L.invoice_history(t).collect()
    assert [r.invoice_id for r in rows] == [1]
    item = rows[0]["items"][0]
    assert item["category"] == "N/A" and item["length"] == D(5)


def test_page_arguments(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    assert [r.k for r in L.page(df, ["k"], 3, 10).collect()] == [20, 21, 22, 23, 24]
    assert [r.k for r in L.page(df, ["k"], 0, "x").collect()] == list(range(10))
    info = L.page_info(df, 1, 10).first()
    assert (info.total_records, info.total_pages) == (25, 3)
