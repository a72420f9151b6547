"""Bill posting: edge bills, the serial model, invariants, and streaming = batch."""

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from brute import post_bills_loop
from retail_rows import D, TS, make, tables
from glazier.operators import billing as B

STORE = {"store_id": 1, "status": True, "default_max_discount": D(10)}
PRODUCTS = [{"id": p, "product_name": f"P{p}", "length": D(10), "width": D(20), "dimension_unit": "inch",
             "unit": "Sq.ft"} for p in (1, 2, 3)]


def _line(bill, line, product, qty, ts="2001-01-01 00:00:00", disc=0, **kw):
    return {"bill_id": bill, "store_id": 1, "created_at": TS(ts), "line_no": line, "product_id": product,
            "quantity": qty, "discount_applied": D(disc), **kw}


def _post(spark, inventory, lines):
    t = tables(spark, stores=[STORE], products=PRODUCTS, inventory=inventory, bill_requests=lines)
    return B.post_bills(t)


def _inv(product, stock, override=None):
    return {"id": product, "store_id": 1, "product_id": product, "available_stock": stock, "minimum_stock": 0,
            "selling_rate": D(2), "purchase_rate": D(1), "override_max_discount": D(override),
            "updated_at": TS("2000-01-01 00:00:00")}


def test_edge_bills(spark):
    lines = [
        _line(1, 1, 1, 3), _line(1, 2, 1, 3),                            # same product twice: 3 <= 4 each
        _line(2, 1, 2, 1, ts="2001-01-02 00:00:00", disc=10),            # discount = limit: ok
        _line(3, 1, 2, 1, ts="2001-01-03 00:00:00", disc=10.01),         # above limit
        _line(4, 1, 2, 1, ts="2001-01-04 00:00:00", disc=50, charged_rate=D(5)),  # charged rate, bad discount
        _line(5, 1, 9, 1, ts="2001-01-05 00:00:00"),                     # unknown product
        _line(6, 1, 3, 1, ts="2001-01-06 00:00:00"),                     # last unit
        _line(7, 1, 3, 1, ts="2001-01-07 00:00:00"),                     # nothing left
        _line(8, 1, 2, 5, ts="2001-01-08 00:00:00"),                     # too many: rejected ...
        _line(9, 1, 2, 1, ts="2001-01-09 00:00:00"),                     # ... the next one fits
        _line(10, 1, 2, 0, ts="2001-01-10 00:00:00"),                    # invalid quantity
    ]
    post = _post(spark, [_inv(1, 4), _inv(2, 3), _inv(3, 1)], lines)
    got = {r.bill_id: (r.status, r.reason) for r in post.decisions.collect()}
    assert got == {1: ("accepted", None), 2: ("accepted", None), 3: ("rejected", "discount_limit_exceeded"),
                   4: ("rejected", "discount_limit_exceeded"), 5: ("rejected", "not_found"),
                   6: ("accepted", None), 7: ("rejected", "insufficient_stock"),
                   8: ("rejected", "insufficient_stock"), 9: ("accepted", None),
                   10: ("rejected", "invalid_product_or_quantity")}
    stock = {r.product_id: r.available_stock for r in post.inventory.collect()}
    assert stock == {1: -2, 2: 1, 3: 0}                                # bill 1 drove product 1 below zero


def test_pricing_and_totals(spark):
    lines = [_line(1, 1, 1, 2, disc=10), _line(1, 2, 2, 1, charged_rate=D(7.5)), _line(1, 3, 3, 1, height=D(30))]
    post = _post(spark, [_inv(1, 9), _inv(2, 9), _inv(3, 9)], lines)
    inv = post.invoices.first()
    # inch sides 10 x 20 -> brackets 12 x 24 -> 2 sq ft; 2 x 2 x 2 = 8, minus 10% = 7.2
    # line 3: 30 x 20 -> 36 x 24 -> 6 sq ft x 2 = 12
    assert inv.sub_total == D("27.50") and inv.grand_total == D("26.70")
    items = {r.product_id: r for r in post.invoice_items.collect()}
    assert items[1].total_price == D("7.20") and items[1].area == D("2.0000")
    assert items[2].total_price == D("7.50") and items[2].charged_rate == D("7.50")
    assert items[3].length == D(30)                                    # original, not bracketed


def _equals_serial_model(post, t):
    got = {r.bill_id: (r.status, r.reason, r.failed_line) for r in post.decisions.collect()}
    lines = B.prepare_bill_lines(t.bill_requests, t).select(
        "bill_id", "store_id", "created_at", "line_no", "product_id", "quantity", "start_stock", "found",
        "invalid_reason", "applied_discount", "max_discount").toPandas()
    ref = post_bills_loop(lines)
    assert got == ref["decisions"]
    stock = {(r.store_id, r.product_id): r.available_stock for r in post.inventory.collect()}
    assert all(stock[k] == v for k, v in ref["stock"].items())
    assert Counter(s for s, _, _ in got.values())["rejected"] > 0


def test_matches_serial_model(spark, small_tables):
    _equals_serial_model(B.post_bills(small_tables), small_tables)


@pytest.mark.parametrize("slow_round", [0.1, 1.0])
def test_one_giant_store_with_long_chains(spark, monkeypatch, slow_round):
    """Multi-line bills on a few products; with 1.0 the fold decides all that the first rounds leave."""
    monkeypatch.setattr(B, "SLOW_ROUND", slow_round)
    rng = random.Random(11)
    lines = [_line(b, k + 1, rng.randint(1, 3), rng.randint(1, 4), ts=f"2001-01-{1 + b // 12:02d} 00:00:00",
                   disc=rng.choice([0, 0, 0, 11])) for b in range(1, 250) for k in range(rng.randint(1, 4))]
    t = tables(spark, stores=[STORE], products=PRODUCTS, inventory=[_inv(1, 150), _inv(2, 90), _inv(3, 200)],
               bill_requests=lines)
    _equals_serial_model(B.post_bills(t), t)


def test_a_bill_without_items_is_refused(spark):
    lines = [_line(1, None, None, None), _line(2, 1, 1, 2), _line(3, None, None, None), _line(3, 1, 1, 1)]
    post = _post(spark, [_inv(1, 9)], lines)
    assert {r.bill_id: (r.status, r.reason, r.failed_line) for r in post.decisions.collect()} == {
        1: ("rejected", "no_items", None), 2: ("accepted", None, None), 3: ("rejected", "no_items", None)}
    assert [r.available_stock for r in post.inventory.collect()] == [7]


def test_running_sums_spread_a_hot_key(spark):
    from glazier.plans.prefix import CUT, cut_ranges, sums_before
    rows = spark.range(20_000).select((F.col("id") % 10 == 0).cast("int").alias("k"), F.col("id"),
                                      (F.xxhash64("id") % 50).alias("v"))
    cut = cut_ranges(rows, ["k"], ["id"])
    spread = cut.filter("k = 0").groupBy(CUT).count().collect()
    assert len(spread) >= 7 and max(r["count"] for r in spread) < 6_000
    got = sums_before(cut.filter("id % 3 <> 0"), ["k"], ["id"], s=F.col("v"), n=F.lit(1)).orderBy("k", "id").collect()
    key, total, n = None, 0, 0
    for r in got:
        if r.k != key:
            key, total, n = r.k, 0, 0
        assert (r.s, r.n) == (total, n)
        total, n = total + r.v, n + 1


def test_one_hot_key_of_many_bills(spark):
    """200,000 one-line bills on one product; a loop over (quantity) decides them in order."""
    n, stock = 200_000, 250_000
    reqs = spark.range(n).select(
        F.col("id").alias("bill_id"), F.lit(1).alias("store_id"), F.lit(TS("2001-01-01 00:00:00")).alias("created_at"),
        F.lit(1).alias("line_no"), F.lit(1).alias("product_id"), (1 + F.abs(F.xxhash64("id")) % 3).cast("int").alias("quantity"))
    from glazier.sources.tables import conform
    t = tables(spark, stores=[STORE], products=PRODUCTS, inventory=[_inv(1, stock)])
    post = B.post_bills(t, conform(reqs, "bill_requests"))
    got = {r.bill_id for r in post.decisions.filter("status = 'accepted'").select("bill_id").collect()}
    want = set()
    for r in reqs.select("bill_id", "quantity").orderBy("bill_id").toLocalIterator():
        if r.quantity <= stock:
            stock -= r.quantity
            want.add(r.bill_id)
    assert got == want and 0 < len(want) < n


def test_headers_name_cashier_and_customer(spark):
    lines = [_line(1, k, p, 1, billed_by=7, customer_name="Ann", customer_phone="555") for k, p in ((1, 3), (2, 1), (3, 2))]
    post = _post(spark, [_inv(1, 9), _inv(2, 9), _inv(3, 9)], lines)
    head = post.invoices.first()
    assert (head.billed_by, head.customer_name, head.customer_phone) == (7, "Ann", "555")
    t = tables(spark, products=PRODUCTS)
    receipt = B.bill_receipts(post.invoices, post.invoice_items, t.products).first()
    assert [x.productId for x in receipt["items"]] == [3, 1, 2]  # request order


def test_an_oversized_line_refuses_its_bill_only(spark):
    lines = [_line(1, 1, 1, 1, height=D("99999999"), width=D("99999999")), _line(2, 1, 1, 1)]
    post = _post(spark, [_inv(1, 9)], lines)
    assert {r.bill_id: (r.status, r.reason) for r in post.decisions.collect()} == {
        1: ("rejected", "amount_out_of_range"), 2: ("accepted", None)}


def test_item_totals_add_up(spark, small_tables):
    post = B.post_bills(small_tables)
    per_bill = post.invoice_items.groupBy("invoice_id").agg(F.sum("total_price").alias("s"),
                                                            F.count("*").alias("n"))
    bad = (post.invoices.join(per_bill, "invoice_id")
           .filter(F.abs(F.col("s") - F.col("grand_total")) > F.col("n") * F.lit(0.01)).count())
    assert bad == 0


def test_stream_equals_batch(spark, small_tables, tmp_path):
    from glazier.registry import STREAM_BOUNDS
    from glazier.streaming import streams as S
    t = small_tables
    staged = S.stage_bill_requests(t.bill_requests, str(tmp_path / "req"), STREAM_BOUNDS)
    out = S.run_post_bills(t, S.bill_request_stream(spark, staged), str(tmp_path / "out"), str(tmp_path / "ck"))
    stream = {r.bill_id: (r.status, r.reason) for r in spark.read.parquet(f"{out}/decisions").collect()}
    batch = {r.bill_id: (r.status, r.reason) for r in B.post_bills(t).decisions.collect()}
    assert stream == batch
    s_stock = {(r.store_id, r.product_id): r.available_stock for r in S.latest_stock(spark, out).collect()}
    b_stock = {(r.store_id, r.product_id): r.available_stock for r in B.post_bills(t).inventory.collect()}
    assert s_stock == b_stock


def test_replayed_batch_is_not_posted_twice(spark, tmp_path):
    from glazier.streaming import streams as S
    t = tables(spark, stores=[STORE], products=PRODUCTS, inventory=[_inv(1, 5)])
    handle = S.post_bills_batch(t, str(tmp_path / "out"))
    batch = make(spark, "bill_requests", [_line(1, 1, 1, 2)])
    handle(batch, 0)
    handle(batch, 0)                                    # replay of the same micro-batch
    stock = S.latest_stock(spark, str(tmp_path / "out")).first().available_stock
    assert stock == 3
    handle(make(spark, "bill_requests", [_line(2, 1, 1, 2, ts="2001-01-02 00:00:00")]), 1)
    assert S.latest_stock(spark, str(tmp_path / "out")).first().available_stock == 1


def test_stream_needs_its_predecessor_and_its_own_folder(spark, tmp_path):
    from glazier.streaming import streams as S
    t = tables(spark, stores=[STORE], products=PRODUCTS, inventory=[_inv(1, 5)])
    handle = S.post_bills_batch(t, str(tmp_path / "out"))
    handle(make(spark, "bill_requests", [_line(1, 1, 1, 4)]), 0)
    with pytest.raises(RuntimeError):
        handle(make(spark, "bill_requests", [_line(2, 1, 1, 4, ts="2001-01-02 00:00:00")]), 2)
    out, first = str(tmp_path / "other"), str(tmp_path / "ck1")
    S._claim(spark, out, first)
    S._claim(spark, out, first)                         # the same query again
    with pytest.raises(ValueError):
        S._claim(spark, out, str(tmp_path / "ck2"))


def test_staged_ranges_are_posted_one_by_one(spark, tmp_path):
    """A range is written by all tasks, and all its files are one micro-batch."""
    from glazier.streaming import streams as S
    t = tables(spark, stores=[STORE], products=PRODUCTS, inventory=[_inv(1, 5)])
    bills = [_line(n, 1, 1, 1, ts=f"{1996 + n // 4}-01-01 00:00:0{n % 4}") for n in range(8)]
    out, ck, files = str(tmp_path / "out"), str(tmp_path / "ck"), []

    def post(staged):
        files.append(spark.read.parquet(staged).select(F.input_file_name()).distinct().count())
        S.run_post_bills(t, S.bill_request_stream(spark, staged, files_per_trigger=None), out, ck)

    S.stage_bill_requests(make(spark, "bill_requests", bills).repartition(3), str(tmp_path / "req"), ["1997-01-01", "1999-01-01"], post)
    got = {(r.bill_id, r.batch_id, r.status) for r in spark.read.parquet(f"{out}/decisions").collect()}
    assert files[0] > 1
    assert got == {(n, n // 4, "accepted" if n < 5 else "rejected") for n in range(8)}
    assert S.last_batch(spark, out) == 2             # the empty last range is a micro-batch too


def test_clean_quotes_price_the_requests_once(spark, monkeypatch):
    from glazier import registry
    reqs = [_line(1, 1, 1, 1), _line(1, 2, 1, 0), _line(2, 1, 1, 2), {**_line(3, 1, 1, 1), "bill_id": None}]
    t = tables(spark, stores=[STORE], products=PRODUCTS, inventory=[_inv(1, 5)], bill_requests=reqs)
    monkeypatch.setattr(registry, "_t", lambda s, d: t)
    lines = registry._clean_lines(spark, "")
    assert sorted((r.bill_id or 0, r.line_no) for r in lines.collect()) == [(0, 1), (2, 1)]
    assert "LeftAnti" not in lines._jdf.queryExecution().optimizedPlan().toString()
