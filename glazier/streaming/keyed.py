"""T1 with keyed state: bills posted as they arrive, the stock of every store kept by Spark's state store.

The form in ``streams`` runs the batch job per micro-batch and writes the stock it left as files.  Here the stock is
the state of a keyed operator (``transformWithStateInPandas``): one map product -> stock per store, read and written
whole once a micro-batch (a call per product costs a round trip to the JVM each), started from the stock table, held in RocksDB and committed to the query's checkpoint with the offsets.  A restarted query goes on
from the last committed batch, and a batch that is run again starts from the same state, so no bill is
posted twice.  Validation, limits and prices are native joins before the state; headers, items and decisions are
native aggregates after it.

The key is the store, because a store's bills are decided in order; a store's lines of one micro-batch are held by
one task.  A single store that takes most bills is better served by ``streams``, which spreads it.  A bill's lines
arrive in one micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glazier.operators.billing import (
    ACCEPTED, POSTING_COLUMNS, R_AMOUNT, R_NOT_FOUND, R_STOCK, REJECTED, build_invoice_items, build_invoices,
    prepare_bill_lines)
from glazier.plans.session import forget, shuffles_dropped, stored
from glazier.sources.tables import Tables

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# What the state needs of a line; the rest of the line passes it as one value.
_TESTED = ("store_id", "bill_id", "created_at", "line_no", "product_id", "quantity", "found", "invalid_reason", "static_reason")
_MOST = Decimal("9999999999.99")  # the header's range
_DECISION = [T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()),
             T.StructField("failed_line", T.IntegerType())]


class StoreStock(StatefulProcessor):
    """Decides a store's bills in (created_at, bill_id) order against the store's stock."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = T.StructType([T.StructField("product_id", T.IntegerType()), T.StructField("available_stock", T.LongType())])
        self.stock = handle.getValueState("stock", T.StructType([T.StructField("held", T.ArrayType(one))]))

    def _held(self) -> dict[int, int]:
        value = self.stock.get()
        return dict(map(tuple, value[0])) if value is not None else {}

    def _hold(self, stock: dict[int, int]) -> None:
        self.stock.update((list(stock.items()),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        given = dict(zip(initialState["product_id"].astype("int64").tolist(), initialState["available_stock"].astype("int64").tolist()))
        self._hold(self._held() | given)

    def _judge(self, lines: list, stock: dict[int, int]) -> tuple:
        """(status, reason, failed line) of one bill; an accepted bill lowers ``stock``.  ``lines``: in line order, as
        (line_no, product_id, quantity, found, invalid_reason, static_reason, base_total)."""
        for line, _, _, _, invalid, _, _ in lines:
            if invalid is not None:
                return REJECTED, invalid, line or None
        left = {}
        for line, product, quantity, found, _, static, _ in lines:
            if not found:
                return REJECTED, R_NOT_FOUND, line
            if product not in left:
                left[product] = stock.get(product, 0)
            if left[product] < quantity:
                return REJECTED, R_STOCK, line
            if static is not None:
                return REJECTED, static, line
        total = sum((Decimal(base) for *_, base in lines if base is not None), Decimal(0))
        if abs(total.quantize(Decimal("0.01"), ROUND_HALF_UP)) > _MOST:
            return REJECTED, R_AMOUNT, lines[-1][0]
        for _, product, quantity, _, _, _, _ in lines:
            left[product] -= quantity
        stock.update(left)
        return ACCEPTED, None, None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        none = lambda v: None if pd.isna(v) else v
        whole = lambda v: None if pd.isna(v) else int(v)
        lines = [(int(n), whole(p), whole(q), bool(f), none(i), none(s), none(b)) for n, p, q, f, i, s, b in zip(*(
            batch[c].tolist() for c in ("line_no", "product_id", "quantity", "found", "invalid_reason", "static_reason", "base_total")))]
        ids, bills = batch["bill_id"].tolist(), {}
        for i in np.lexsort([batch[c].to_numpy() for c in ("line_no", "bill_id", "created_at")]).tolist():
            bills.setdefault(none(ids[i]), []).append(i)  # bills in the order of their first lines
        stock, decided = self._held(), [None] * len(lines)
        for at in bills.values():
            verdict = self._judge([lines[i] for i in at], stock)
            for i in at:
                decided[i] = verdict
        if any(status == ACCEPTED for status, _, _ in decided):
            self._hold(stock)
        status, reason, failed_line = zip(*decided)
        yield pd.DataFrame({"bill_id": batch["bill_id"], "payload": batch["payload"], "status": list(status),
                            "reason": pd.Series(reason, index=batch.index, dtype=object),
                            "failed_line": pd.Series(failed_line, index=batch.index, dtype="Int32")})

    def close(self) -> None:
        pass


_JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def decided_lines(t: Tables, requests: DataFrame) -> DataFrame:
    """The stream of ``requests`` lines with their bill's ``status``, ``reason`` and ``failed_line``."""
    lines = prepare_bill_lines(requests, t).select(*POSTING_COLUMNS).withColumn("line_no", F.coalesce("line_no", F.lit(0)))
    # Every line is shuffled with its payload: its fields go by their numbers, which are shorter than the names.
    fields = F.struct(*[F.col(c).alias(str(n)) for n, c in enumerate(POSTING_COLUMNS)])
    packed = T.StructType([T.StructField(str(n), lines.schema[c].dataType) for n, c in enumerate(POSTING_COLUMNS)])
    tested = lines.select(*_TESTED, F.col("base_total").cast("string").alias("base_total"), F.to_json(fields, _JSON).alias("payload"))
    start = t.inventory.select("store_id", "product_id", F.coalesce("available_stock", F.lit(0)).alias("available_stock"))
    out = T.StructType([T.StructField("bill_id", T.LongType()), T.StructField("payload", T.StringType()), *_DECISION])
    judged = tested.groupBy("store_id").transformWithStateInPandas(
        StoreStock(), out, "append", "none", start.groupBy("store_id"))
    return judged.select(F.from_json("payload", packed, _JSON).alias("line"), *[f.name for f in _DECISION]).select(
        *[F.col("line")[str(n)].alias(c) for n, c in enumerate(POSTING_COLUMNS)], *[f.name for f in _DECISION])


def write_batch(out_dir: str):
    """The ``foreachBatch`` body: decisions, headers and items of one micro-batch, each in the batch's own folder,
    so a batch that is run again replaces its rows.  The decided lines are written once first: every
    reading of them would run the state again.  That copy goes when the rows are written."""
    base = out_dir.rstrip("/")

    def handle(batch: DataFrame, batch_id: int) -> None:
        lines = stored(batch, "decided-lines")
        decisions = lines.groupBy("bill_id", "store_id", "created_at").agg(
            F.first("status").alias("status"), F.first("reason").alias("reason"), F.first("failed_line").alias("failed_line"))
        accepted = lines.filter(F.col("status") == ACCEPTED)
        for name, rows in (("decisions", decisions), ("invoices", build_invoices(accepted)), ("items", build_invoice_items(accepted))):
            rows.write.mode("overwrite").parquet(f"{base}/{name}/batch_id={batch_id}")
        forget(lines)

    return handle


def run_post_bills_keyed(t: Tables, requests: DataFrame, out_dir: str, checkpoint: str) -> str:
    """Post a stream of bill requests until the source is drained; state and progress are in ``checkpoint``."""
    conf = requests.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, ROCKSDB)  # keyed state needs it; the running query keeps the value it started with
    try:
        with shuffles_dropped(requests.sparkSession):
            query = (decided_lines(t, requests).writeStream.option("checkpointLocation", checkpoint)
                     .foreachBatch(write_batch(out_dir)).trigger(availableNow=True).start())
            query.awaitTermination()
    finally:
        conf.set(_PROVIDER, before)
    return out_dir


def stock_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(store_id, product_id, available_stock) as the last committed batch left it, read from the state store."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "stock").load()
    held = state.select(F.col("key.store_id").alias("store_id"), F.explode("value.held").alias("row"))
    return held.select("store_id", "row.product_id", F.col("row.available_stock").cast("int").alias("available_stock"))
