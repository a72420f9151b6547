import pytest

from brute import post_bills_loop
from glazier.operators import billing as B
from glazier.sources.fixtures import sale_events_batch
from glazier.streaming import keyed as K
from glazier.streaming import streams as S

SF = "/root/testdata/sf0.001"


def test_daily_tiles_equal_batch(spark, tmp_path):
    n = spark.read.parquet(f"{SF}/supplier.parquet").count()
    out = S.run_daily_revenue(S.sales_stream(spark, SF, n), str(tmp_path / "tiles"), str(tmp_path / "ck"))
    stream = {(r.store_id, r.day): (r.revenue, r.sales) for r in S.current_tiles(spark, out).collect()}
    batch = {(r.store_id, r.day): (r.revenue, r.sales) for r in S.daily_revenue(sale_events_batch(spark, SF)).collect()}
    assert stream == batch and len(batch) > 0


def _serial(t):
    lines = B.prepare_bill_lines(t.bill_requests, t).select(
        "bill_id", "store_id", "created_at", "line_no", "product_id", "quantity", "start_stock", "found",
        "invalid_reason", "applied_discount", "max_discount").toPandas()
    return post_bills_loop(lines)


def test_keyed_state_survives_a_stop_and_a_failed_batch(spark, small_tables, tmp_path, monkeypatch):
    from glazier.registry import STREAM_BOUNDS
    t, out, ck, req = small_tables, str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "req")
    model = _serial(t)

    def go_on(bounds, rows):
        S.stage_bill_requests(rows, req, bounds)
        K.run_post_bills_keyed(t, S.bill_request_stream(spark, req), out, ck)

    early = t.bill_requests.filter("created_at < timestamp_ntz'1999-01-01'")
    late = t.bill_requests.filter("created_at >= timestamp_ntz'1999-01-01'")
    go_on(STREAM_BOUNDS[:1], early)                       # two batches, then the query ends

    write = K.write_batch

    def failing(folder):
        handle = write(folder)

        def fail(batch, batch_id):
            handle(batch, batch_id)
            raise RuntimeError("lost after its rows were written, before the batch was committed")
        return fail

    monkeypatch.setattr(K, "write_batch", failing)
    with pytest.raises(Exception):
        go_on(STREAM_BOUNDS[2:], late)
    monkeypatch.setattr(K, "write_batch", write)
    K.run_post_bills_keyed(t, S.bill_request_stream(spark, req), out, ck)

    got = spark.read.parquet(f"{out}/decisions").collect()
    assert {r.bill_id: (r.status, r.reason, r.failed_line) for r in got} == model["decisions"] and len(got) == len(model["decisions"])
    stock = {(r.store_id, r.product_id): r.available_stock for r in K.stock_in_state(spark, ck).collect()}
    assert all(stock[k] == v for k, v in model["stock"].items())
    batch = B.post_bills(t)
    for name, rows in (("invoices", batch.invoices), ("items", batch.invoice_items)):
        posted = spark.read.parquet(f"{out}/{name}").drop("batch_id").select(*rows.columns)
        assert sorted(map(str, posted.collect())) == sorted(map(str, rows.collect()))


def test_keyed_state_refuses_a_bill_past_the_header_s_range(spark, tmp_path):
    from retail_rows import D, TS, make, tables
    line = {"store_id": 1, "created_at": TS("2001-01-01 00:00:00"), "product_id": 1, "quantity": 1}
    big = {"charged_rate": D("9999999999.99")}
    reqs = [{**line, **big, "bill_id": 1, "line_no": 1}, {**line, **big, "bill_id": 1, "line_no": 2},
            {**line, **big, "bill_id": 2, "line_no": 1}, {**line, "bill_id": 3, "line_no": None, "product_id": None}]
    t = tables(spark, stores=[{"store_id": 1}], products=[{"id": 1}], bill_requests=reqs,
               inventory=[{"id": 1, "store_id": 1, "product_id": 1, "available_stock": 5, "selling_rate": D(1)}])
    t.bill_requests.coalesce(1).write.parquet(str(tmp_path / "req"))
    out = K.run_post_bills_keyed(t, S.bill_request_stream(spark, str(tmp_path / "req")), str(tmp_path / "out"), str(tmp_path / "ck"))
    for rows in (spark.read.parquet(f"{out}/decisions"), B.post_bills(t).decisions):
        assert {r.bill_id: (r.status, r.reason, r.failed_line) for r in rows.collect()} == {
            1: ("rejected", "amount_out_of_range", 2), 2: ("accepted", None, None), 3: ("rejected", "no_items", None)}


def test_reports_are_fresh_after_every_batch(spark, small_tables, tmp_path, monkeypatch):
    """Four batches, bills out of time order, whole sets every second batch; every report equals its batch form."""
    from pyspark.sql import functions as F

    from glazier.operators import reports as R
    from glazier.sources.fixtures import FIXTURE_AS_OF
    from glazier.streaming import fresh
    monkeypatch.setattr(fresh, "COMPACT_EVERY", 3)
    t, out = small_tables, str(tmp_path / "out")
    handle = S.post_bills_batch(t, out, reports=True)
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    for batch_id in range(4):
        rows = t.bill_requests.filter(F.pmod(F.col("bill_id").cast("long"), F.lit(4)) == batch_id)
        handle(rows, batch_id)
        if batch_id == 1:
            handle(rows, batch_id)                      # a replayed batch changes nothing
        now = t.with_(
            invoices=t.invoices.unionByName(spark.read.parquet(f"{out}/invoices").select(*t.invoices.columns)),
            invoice_items=t.invoice_items.unionByName(spark.read.parquet(f"{out}/items").select(*t.invoice_items.columns)),
            inventory=S.latest_stock(spark, out))
        assert S.last_batch(spark, out) == batch_id
        parts = fresh.partials(spark, out, batch_id)
        assert same(fresh.master_summary(parts, t, FIXTURE_AS_OF), R.master_summary(now, FIXTURE_AS_OF))
        assert same(fresh.branch_performance(parts, t), R.branch_performance(now))
        assert same(fresh.monthly_revenue(parts, now.invoices, FIXTURE_AS_OF), R.monthly_revenue(now, FIXTURE_AS_OF))
        assert same(fresh.store_summary(parts, t, FIXTURE_AS_OF), R.store_summary(now, FIXTURE_AS_OF))
        assert same(fresh.store_wise_revenue(parts, t, FIXTURE_AS_OF), R.store_wise_revenue(now, FIXTURE_AS_OF))
        assert same(fresh.top_products_by_store(spark, out, batch_id, t.products), R.top_products_by_store(now))


def test_leaders_stay_exact(spark, tmp_path, monkeypatch):
    """Random sales with many ties and one whole set at the start; the first two of every store after each batch."""
    import random

    from glazier.streaming import fresh
    monkeypatch.setattr(fresh, "COMPACT_EVERY", 100)
    monkeypatch.setattr(fresh, "SPARE", 2)
    draw, base, totals = random.Random(7), str(tmp_path / "out"), {}
    kinds = "store_id int, product_id int, sold long"
    for batch_id in range(9):
        sales = {(draw.randrange(12), draw.randrange(25)): draw.choice([1, 1, 2, 3, 9])
                 for _ in range(150 if batch_id == 0 else 30)}
        for key, units in sales.items():
            totals[key] = totals.get(key, 0) + units
        rows = spark.createDataFrame([(*k, v) for k, v in sales.items()], kinds).coalesce(1)
        rows.write.parquet(fresh._paths(base, "units", batch_id)[-1])
        fresh.write_leaders(spark, base, batch_id, n=2)
        got = {(r.store_id, r.place): (r.product_id, r.sold) for r in spark.read.parquet(fresh._leaders(base, batch_id)).collect()}
        for store in {s for s, _ in totals}:
            ranked = sorted((-v, p) for (s, p), v in totals.items() if s == store)[:2]
            for place, (minus, product) in enumerate(ranked, 1):
                assert got[store, place] == (product, -minus), (batch_id, store)


def test_a_store_s_stock_is_one_value_a_batch(spark, tmp_path, monkeypatch):
    """Calls to the state do not grow with a store's products or lines."""
    from types import SimpleNamespace

    import pandas as pd
    calls, held = [], {}
    value = SimpleNamespace(get=lambda: calls.append("get") or held.get("v"),
                            update=lambda v: calls.append("update") or held.update(v=v))
    store = K.StoreStock()
    store.init(SimpleNamespace(getValueState=lambda name, schema: value))
    n = 50
    store.handleInitialState((1,), pd.DataFrame({"product_id": range(n), "available_stock": [1] * n}), None)
    lines = pd.DataFrame({
        "store_id": 1, "bill_id": range(2 * n), "created_at": pd.Timestamp("2001-01-01"), "line_no": 1,
        "product_id": [i % n for i in range(2 * n)], "quantity": 1, "found": True, "invalid_reason": None,
        "static_reason": None, "base_total": "1", "payload": "{}"}).sample(frac=1, random_state=3)
    out = pd.concat(store.handleInputRows((1,), iter([lines]), None)).sort_values("bill_id")
    assert list(out["status"]) == ["accepted"] * n + ["rejected"] * n
    assert dict(map(tuple, held["v"][0])) == dict.fromkeys(range(n), 0)
    assert len(calls) <= 4
