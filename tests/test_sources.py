"""Snapshot round trip, layout, JSON with null keys; keyset paging."""

import json

from pyspark.sql import functions as F

from glazier.operators import listings as L
from glazier.sources.tables import load_tables, to_json_rows, write_tables


def test_snapshot_round_trip(spark, small_tables, tmp_path):
    out = str(tmp_path / "snap")
    write_tables(small_tables, out, num_files=3)
    back = load_tables(spark, out)
    for name, df in small_tables.items():
        got = getattr(back, name)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in df.schema]
        assert got.count() == df.count()
        assert got.exceptAll(df).count() == 0
    assert len([f for f in (tmp_path / "snap" / "inventory").iterdir() if f.name.endswith(".parquet")]) == 3


def test_write_refuses_overwrite(spark, small_tables, tmp_path):
    out = str(tmp_path / "snap2")
    write_tables(small_tables, out)
    try:
        write_tables(small_tables, out)
        raise AssertionError("overwrote a snapshot")
    except Exception as e:  # noqa: BLE001
        assert "already exists" in str(e) or "PATH_ALREADY_EXISTS" in str(e)


def test_json_keeps_null_keys(spark, small_tables):
    row = to_json_rows(L.invoice_history(small_tables), ["invoice_id"]).first()
    doc = json.loads(row.json)
    assert doc["invoice_id"] == row.invoice_id
    assert "customer_phone" in doc and doc["customer_phone"] is None
    assert "charged_dimension" in doc["items"][0]


def test_keyset_page_equals_offset_page(spark, small_tables):
    hist = small_tables.invoices.select("invoice_id", "created_at")
    order = [("created_at", False), ("invoice_id", False)]
    first = L.page_after(hist, order, None, 10).collect()
    cursor = first[-1].asDict()
    second = L.page_after(hist, order, cursor, 10).collect()
    by_offset = L.page(hist, [F.col("created_at").desc(), F.col("invoice_id").desc()], 2, 10).collect()
    assert second == by_offset


def test_files_of_a_snapshot_grow_with_the_table(spark, small_tables, tmp_path, monkeypatch):
    from glazier.sources import tables as S
    monkeypatch.setattr(S, "ROWS_PER_FILE", 1000)
    out = str(tmp_path / "grown")
    S.write_tables(small_tables.with_(bill_requests=None), out, num_files=2)
    rows = small_tables.invoice_items.count()
    sizes = spark.read.parquet(f"{out}/invoice_items").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in sizes) == rows and rows > 4000
    assert max(r["count"] for r in sizes) < 2000      # two files would hold more


def test_a_snapshot_s_steps_leave_nothing_beside_it(spark, small_tables, tmp_path, monkeypatch):
    """Every table is computed once, and shuffles and copies of the tables before do not pile up."""
    from pathlib import Path

    from glazier.plans.session import SHUFFLE_CLEANUP, checkpoint_dir
    from glazier.sources import tables as S
    shared = Path(checkpoint_dir(spark).removeprefix("file:"))
    before, conf, seen = set(shared.iterdir()), spark.conf.get(SHUFFLE_CLEANUP, None), []
    write = S.write_table
    monkeypatch.setattr(S, "write_table", lambda df, *more: seen.append(
        (spark.conf.get(SHUFFLE_CLEANUP, None), df._jdf.queryExecution().optimizedPlan().toString())) or write(df, *more))
    write_tables(small_tables, str(tmp_path / "snap"), num_files=2)
    assert len(seen) == 8 and all(on == "true" and "Join" not in plan for on, plan in seen)
    assert set(shared.iterdir()) == before and spark.conf.get(SHUFFLE_CLEANUP, None) == conf
