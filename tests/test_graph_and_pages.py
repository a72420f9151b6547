"""Deletes by the reference graph, and pages through the order index."""

from retail_rows import tables
from glazier.operators import listings as L
from glazier.operators import paging as P
from glazier.operators import referential as R


def _shop(spark):
    return tables(
        spark, stores=[{"store_id": i} for i in (1, 2, 3)], users=[{"id": i} for i in (1, 2)],
        glass_categories=[{"id": i} for i in (1, 2)],
        products=[{"id": 1, "category_id": 1}, {"id": 2, "category_id": 1}, {"id": 3}],
        inventory=[{"id": 1, "store_id": 1, "product_id": 1}, {"id": 2, "store_id": 2, "product_id": 1},
                   {"id": 3, "store_id": 2, "product_id": 2}],
        invoices=[{"invoice_id": 1, "store_id": 1, "billed_by": 1}, {"invoice_id": 2, "store_id": 1, "billed_by": 1}],
        invoice_items=[{"invoice_id": 1, "product_id": 1, "quantity": 1}, {"invoice_id": 2, "product_id": 3, "quantity": 1}])


def _delete(spark, table, *ids, **more):
    res = R.delete_rows(_shop(spark), table, spark.createDataFrame([(i,) for i in ids], "id long"), **more)
    return res.tables, {(r.id, r.reason) for r in res.rejects.collect()}, {r.id for r in res.deleted.collect()}


def test_deletes_follow_the_five_rules(spark):
    t, refused, gone = _delete(spark, "products", 1, 2, 3, 9, 9)
    assert refused == {(1, "still_referenced"), (3, "still_referenced"), (9, "not_found")} and gone == {2}
    assert {r.id for r in t.inventory.collect()} == {1, 2} and {r.id for r in t.products.collect()} == {1, 3}
    t, refused, _ = _delete(spark, "stores", 1, 2)
    assert refused == {(1, "still_referenced")} and {r.id for r in t.inventory.collect()} == {1}
    t, refused, _ = _delete(spark, "invoices", 1, None)
    assert not refused and [(r.invoice_id, r.product_id) for r in t.invoice_items.collect()] == [(2, 3)]
    _, refused, gone = _delete(spark, "glass_categories", 1, 2)
    assert refused == {(1, "still_referenced")} and gone == {2}
    _, refused, gone = _delete(spark, "users", 1, 2)
    assert refused == {(1, "still_referenced")} and gone == {2}


def test_a_cascade_into_a_restricted_row_is_refused_whole(spark):
    """With categories that take their products along, category 1 reaches product 1, which is on an invoice."""
    rules = (R.Reference("products", "category_id", "glass_categories", R.CASCADE), *R.REFERENCES[1:])
    t, refused, gone = _delete(spark, "glass_categories", 1, 2, references=rules)
    assert refused == {(1, "still_referenced")} and gone == {2}
    assert t.products.count() == 3 and t.inventory.count() == 3


def test_pages_through_the_index_equal_offset_pages(spark, small_tables, tmp_path):
    t = small_tables
    index = P.index_invoice_history(t, str(tmp_path / "index"), rows_per_range=100)
    listing = L.invoice_history(t)
    order = [r.invoice_id for r in listing.select("invoice_id").collect()]
    assert index.total == len(order) and len(index.ranges) >= 10 and index.pages(7) == -(-len(order) // 7)
    again = P.open_order_index(spark, index.path)
    assert again == index
    for page_no, limit in ((1, 10), (60, 10), (3, 250), (index.pages(7), 7), (10_000, 10), (None, 0)):
        p, n = page_no or 1, limit or 10
        want = order[(p - 1) * n:p * n]
        assert [r.invoice_id for r in P.indexed_page(spark, index, page_no, limit).collect()] == want
    rows = P.indexed_invoice_history(t, index, 60, 10).collect()
    assert rows == L.invoice_history_page(t, 60, 10).collect() and len(rows) == 10


def test_a_deep_page_reads_one_range(spark, small_tables, tmp_path):
    index = P.index_invoice_history(small_tables, str(tmp_path / "index"), rows_per_range=100)
    k = len(index.ranges) // 2
    page_no = index.starts[k] // 10 + 2
    page = P.indexed_page(spark, index, page_no, 10)
    assert len(page.collect()) == 10
    plan = page._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    leaves = plan.collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    while any("QueryStage" in s.getClass().getSimpleName() for s in scans):
        scans = [x for s in scans for x in ([s.plan().collectLeaves().apply(i) for i in range(s.plan().collectLeaves().size())]
                                            if "QueryStage" in s.getClass().getSimpleName() else [s])]
    assert [s.metrics().apply("numFiles").value() for s in scans] == [1]
