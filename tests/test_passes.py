"""What jobs hold, shuffle and compute again: seen in their plans and written files."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from retail_rows import tables

from glazier.operators import billing, changes
from glazier.operators import listings as L
from glazier.operators import paging as P
from glazier.plans.session import at_once


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_ranges_share_a_folder(spark, small_tables, tmp_path):
    """One folder and task a range were 54,000 of them for 54 million invoices."""
    index = P.index_invoice_history(small_tables, str(tmp_path / "index"), rows_per_range=100)
    assert len(index.ranges) == -(-index.total // 100)
    assert len(list(Path(index.path, "rows").glob("folder=*"))) == 1
    assert max(b - a for a, b in zip(index.starts, index.starts[1:])) == 100


def test_ranges_go_on_over_folders(spark, small_tables, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_FOLDER", 300)
    index = P.index_invoice_history(small_tables, str(tmp_path / "index"), rows_per_range=100)
    assert len(list(Path(index.path, "rows").glob("folder=*"))) > 2
    order = [r.invoice_id for r in L.invoice_history(small_tables).select("invoice_id").collect()]
    for page_no, limit in ((1, 10), (2, 700), (index.pages(7), 7)):
        got = P.indexed_page(spark, index, page_no, limit).collect()
        assert [r.invoice_id for r in got] == order[(page_no - 1) * limit:page_no * limit]
        assert [r.position for r in got] == list(range((page_no - 1) * limit, (page_no - 1) * limit + len(got)))


def test_each_rule_has_its_own_aggregation(spark):
    t = tables(spark, stores=[{"store_id": 1}, {"store_id": 1}, {"store_id": None}],
               users=[{"id": 1, "role": "clerk", "username": "u"}, {"id": 1, "role": "clerk", "username": "u"}],
               inventory=[{"id": 1, "store_id": 2, "product_id": 7}, {"id": 2, "store_id": 2, "product_id": 7},
                          {"id": 3, "store_id": None, "product_id": 7}])
    found = changes.constraint_violations(t)
    rows = [(r.table_name, r.rule, r.key_value, r.n) for r in found.collect()]
    assert rows.count(("users", "check:role", "1", 1)) == 2 and rows.count(("stores", "not_null:store_email", None, 1)) == 1
    for row in (("stores", "unique:store_id", "1", 2), ("users", "unique:id", "1", 2), ("users", "unique:username", "u", 2),
                ("inventory", "unique:store_id,product_id", "2|7", 2), ("inventory", "foreign_key:store_id", "2", 2),
                ("inventory", "foreign_key:product_id", "7", 3)):
        assert rows.count(row) == 1
    assert "Aggregate [rule" not in _plan(found)


def test_invoice_lines_are_nested_behind_their_shuffle(small_tables):
    plan = L.invoice_history(small_tables)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    partial = next(i for i, line in enumerate(lines) if "partial_collect_list" in line)
    assert any("REPARTITION_BY_COL" in line for line in lines[partial:])


def test_facts_of_a_bill_come_from_one_window(spark, small_tables, monkeypatch):
    seen = []
    write = billing.stored
    monkeypatch.setattr(billing, "stored", lambda df, name: seen.append((name, _plan(df))) or write(df, name))
    billing.post_bills(small_tables, small_tables.bill_requests.limit(50))
    plan = dict(seen)["bill-lines"]
    assert sum("windowspecdefinition(bill_id" in line and "Window [" in line for line in plan.splitlines()) == 1


def test_a_line_s_sides_area_and_base_are_computed_once(small_tables):
    plan = _plan(billing.prepare_bill_lines(small_tables.bill_requests, small_tables).select(*billing.POSTING_COLUMNS))
    assert plan.count("coalesce(height") == 1 and plan.count("* cast(quantity") == 1


def test_a_batch_picks_its_accepted_lines_once(spark, small_tables, tmp_path, monkeypatch):
    """Headers, items and sold stock are made of one written copy; the contended lines carry what decides them only."""
    from glazier.streaming import streams as S
    seen = []
    for module in (billing, S):
        write = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, write=write: seen.append((name, df.columns)) or write(df, name))
    bills = small_tables.bill_requests.filter("created_at < timestamp_ntz'1997-01-01'")
    S.post_bills_batch(small_tables, str(tmp_path / "out"))(bills, 0)
    names = [name for name, _ in seen]
    assert names.count("accepted-lines") == 1 and len(dict(seen)["contended-lines"]) <= 9
    posting, read = billing.post_bills(small_tables, bills), spark.read.parquet
    for folder, wanted in (("invoices/batch=0", posting.invoices), ("items/batch=0", posting.invoice_items),
                           ("inventory/v=0", posting.inventory)):
        got = read(str(tmp_path / "out" / folder)).select(*wanted.columns)
        assert got.count() and got.exceptAll(wanted).count() == 0 == wanted.exceptAll(got).count()


def test_sold_rows_know_the_stock_they_had(spark):
    t = tables(spark, inventory=[{"id": 1, "store_id": 1, "product_id": 1, "available_stock": 9},
                                 {"id": 2, "store_id": 1, "product_id": 2, "available_stock": 4}])
    lines = spark.createDataFrame([(1, 1, 2), (1, 1, 3)], "store_id int, product_id int, quantity int").selectExpr(
        "*", "timestamp_ntz'2001-01-01' as created_at")
    row, = billing.apply_stock(t.inventory, lines, sold_only=True).collect()
    assert (row.id, row.available_stock, row.stock_before) == (1, 4, 9)
    assert billing.apply_stock(t.inventory, lines).columns == t.inventory.columns


def test_jobs_at_once_meet_and_raise():
    meet = threading.Barrier(2, timeout=20)
    assert len(at_once(meet.wait, meet.wait)) == 2

    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError):
        at_once(fails, lambda: 1)


def _copies(spark):
    from glazier.plans.session import checkpoint_dir
    return {p.name for p in Path(checkpoint_dir(spark).removeprefix("file:")).iterdir()}


def _made(spark, before):
    """Names of the copies in the shared folder that were not there before."""
    return sorted(name.rsplit("-", 1)[0] for name in _copies(spark) - before)


def test_posting_shuffles_narrow_lines_and_forgets_its_copies(spark, small_tables, monkeypatch):
    """Each wide shuffle of the lines is a step of its own; the window of a bill has only the columns that decide."""
    from glazier.plans.session import SHUFFLE_CLEANUP
    seen = []
    write = billing.stored
    monkeypatch.setattr(billing, "stored", lambda df, name: seen.append(
        (name, df.columns, spark.conf.get(SHUFFLE_CLEANUP, None))) or write(df, name))
    before, conf = _copies(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    posting = billing.post_bills(small_tables)
    assert _made(spark, before) == ["bill-decisions", "priced-lines"]
    assert {c for _, _, c in seen} == {"true"} and spark.conf.get(SHUFFLE_CLEANUP, None) == conf
    assert not {"customer_name", "total_price", "base_total"} & set({n: c for n, c, _ in seen}["bill-lines"])
    assert posting.decisions.count() and posting.invoices.count()


def test_a_batch_leaves_only_its_output(spark, small_tables, tmp_path):
    from glazier.streaming import streams as S
    before = _copies(spark)
    S.post_bills_batch(small_tables, str(tmp_path / "out"), reports=True)(small_tables.bill_requests, 0)
    assert _made(spark, before) == []


def test_only_copies_in_the_shared_folder_are_forgotten(spark, tmp_path):
    from glazier.plans.session import forget, stored
    spark.range(3).write.parquet(str(tmp_path / "mine"))
    mine, copy = spark.read.parquet(str(tmp_path / "mine")), stored(spark.range(4), "copy")
    folder = Path(copy.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists()
    forget(mine, copy)
    assert mine.count() == 3 and not folder.exists()


def test_a_keyed_batch_leaves_only_its_output(spark, small_tables, tmp_path):
    from glazier.operators.billing import POSTING_COLUMNS, prepare_bill_lines
    from glazier.streaming import keyed as K
    from pyspark.sql import functions as F
    lines = prepare_bill_lines(small_tables.bill_requests.limit(20), small_tables).select(*POSTING_COLUMNS).withColumns(
        {"status": F.lit("accepted"), "reason": F.lit(None).cast("string"), "failed_line": F.lit(None).cast("int")})
    before = _copies(spark)
    K.write_batch(str(tmp_path / "out"))(lines, 0)
    assert _made(spark, before) == [] and spark.read.parquet(str(tmp_path / "out" / "decisions")).count()


def test_the_keyed_stream_passes_fields_without_their_names(spark, small_tables, tmp_path):
    from glazier.streaming import keyed as K
    from glazier.streaming import streams as S
    small_tables.bill_requests.limit(5).write.parquet(str(tmp_path / "req"))
    decided = K.decided_lines(small_tables, S.bill_request_stream(spark, str(tmp_path / "req")))
    plan = decided._jdf.queryExecution().analyzed().toString()
    assert "struct(0, bill_id" in plan and "struct(bill_id, bill_id" not in plan
    assert decided.columns[:len(K.POSTING_COLUMNS)] == list(K.POSTING_COLUMNS)


def test_edits_meet_their_rows_in_one_join(spark):
    """The rows' keys are not joined once more to drop unknown ones: as ids of one column they were broadcast."""
    stock = tables(spark, inventory=[{"id": 1, "store_id": 1, "product_id": 1, "available_stock": 9},
                                     {"id": 2, "store_id": 1, "product_id": 2, "available_stock": 4},
                                     {"id": 3, "store_id": 1, "product_id": 2, "available_stock": 5},
                                     {"id": 4, "store_id": 1, "product_id": None, "available_stock": 6}]).inventory
    patch = spark.createDataFrame(
        [(1, 1, 1, 70, True), (1, 1, 2, 71, True), (1, 2, 3, 72, True), (1, 3, 4, 73, True), (1, None, 5, 74, True),
         (1, 1, 6, 75, False)],
        "store_id int, product_id int, seq long, available_stock int, set_available_stock boolean").selectExpr(
        "*", "timestamp_ntz'2001-01-01' as patched_at")
    change = changes.patch_rows(stock, patch, ["store_id", "product_id"], ["available_stock"])
    assert {r.id: r.available_stock for r in change.table.collect()} == {1: 71, 2: 72, 3: 72, 4: 6}
    assert sorted((r.seq, r.reason) for r in change.rejects.collect()) == [
        (4, "not_found"), (5, "not_found"), (6, "no_fields")]
    plan = _plan(change.table)
    assert "LeftSemi" not in plan and plan.count("Join ") == 1


def test_stock_is_met_by_the_key_of_the_bills(spark, tmp_path):
    """Stock after a batch: changed rows by their id, found by store and product, so lines meet it without a second shuffle."""
    from retail_rows import make
    from glazier.streaming import streams as S
    row = {"store_id": 1, "product_id": 1, "available_stock": 9}
    rows = [{**row, "id": 1}, {**row, "id": 2}, {**row, "id": 3, "product_id": None}, {**row, "id": 4, "product_id": 2}]
    make(spark, "inventory", rows).write.parquet(str(tmp_path / "inventory" / "v=0"))
    for v, (stock, some) in enumerate([(5, rows[:1]), (3, rows[:2])], 1):
        make(spark, "inventory", [{**r, "available_stock": stock} for r in some]).write.parquet(str(tmp_path / "stock_changes" / f"v={v}"))
    now = S.stock_after(spark, str(tmp_path), 2)
    assert {r.id: r.available_stock for r in now.collect()} == {1: 3, 2: 3, 3: 9, 4: 9}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = spark.range(5).selectExpr("int(id) as store_id", "int(id) as product_id")
        met = lines.join(now.select(now.store_id.alias("s"), now.product_id.alias("p"), "available_stock"),
                         (F.col("store_id") == F.col("s")) & (F.col("product_id") == F.col("p")), "left")
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the lines, the snapshot, and the changes twice: by row, then by store and product
    assert plan.count("Exchange hashpartitioning(") - plan.count("ReusedExchange") <= 4
    assert not [x for x in plan.splitlines() if "hashpartitioning(id#" in x]
