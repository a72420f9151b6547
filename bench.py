"""Headline-query benchmark.

Runs the main reports and jobs on ``$BENCH_SF_DIR`` (default sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line.  The retail tables are first
derived from the driver's tables and stored as parquet in the shared folder
(``staging_sec``, not part of the value), then read back with the typed
loader, as a deployment reads its stored tables.  Each query is fully
executed with the ``noop`` sink (no rows to the driver); the value per query
is the median of ``$BENCH_RUNS`` (default 3) warm runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from glazier.operators import billing, changes, listings, reports  # noqa: E402
from glazier.plans.session import get_session, shared_path  # noqa: E402
from glazier.sources.fixtures import FIXTURE_AS_OF, change_feeds, retail_tables  # noqa: E402
from glazier.sources.tables import load_tables, write_table, write_tables  # noqa: E402


def _run(df):
    df.write.format("noop").mode("overwrite").save()


def stage(spark, sf_dir):
    """Derive the retail tables once and store them (S2), return them read back."""
    base = shared_path(spark, "bench-tables")
    files = max(int(spark.sparkContext.defaultParallelism), 1)
    write_tables(retail_tables(spark, sf_dir), base, num_files=files)
    changes_path = write_table(change_feeds(spark, sf_dir)["inventory_changes"], f"{base}/inventory_changes")
    return load_tables(spark, base), {"inventory_changes": spark.read.parquet(changes_path)}


def headline(spark, t, feeds):
    a = FIXTURE_AS_OF

    def post():
        p = billing.post_bills(t)
        for df in (p.decisions, p.invoices, p.invoice_items, p.inventory):
            _run(df)

    return {
        "master_summary": lambda: _run(reports.master_summary(t, a)),
        "store_wise_revenue": lambda: _run(reports.store_wise_revenue(t, a)),
        "low_stock_alerts": lambda: _run(reports.low_stock_alerts(t)),
        "top_products_by_store": lambda: _run(reports.top_products_by_store(t)),
        "monthly_revenue": lambda: _run(reports.monthly_revenue(t, a)),
        "store_summary": lambda: _run(reports.store_summary(t, a)),
        "inventory_listing": lambda: _run(listings.inventory_listing(t)),
        "inventory_summary": lambda: _run(listings.inventory_summary(t)),
        "product_catalog": lambda: _run(listings.product_catalog(t)),
        "invoice_history": lambda: _run(listings.invoice_history(t)),
        "invoice_history_page": lambda: _run(listings.invoice_history_page(t, 3, 10)),
        "post_bills": post,
        "upsert_inventory": lambda: _run(changes.upsert_inventory(t.inventory, feeds["inventory_changes"]).table),
        "constraint_violations": lambda: _run(changes.constraint_violations(t)),
    }


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(f"local[{cpus}]", int(cpus) * 2,
                        extra_conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    t0 = time.perf_counter()
    t, feeds = stage(spark, sf_dir)
    staging = round(time.perf_counter() - t0, 3)
    qs = headline(spark, t, feeds)
    qs["master_summary"]()  # warm-up: JVM, code caches, file listing
    times = {}
    for name, fn in qs.items():
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "runs": runs, "cpus": int(cpus),
                      "staging_sec": staging,
                      "spark": spark.version}))


if __name__ == "__main__":
    main()
