"""Structured Streaming forms.

T2 keeps a per-store daily revenue tile fresh: event time is cast to
``timestamp`` (a watermark on ``timestamp_ntz`` is an analysis error), a
watermark bounds the state, and a 1-day tumbling window aggregates in
update mode.  Each micro-batch's updated rows are appended with their batch
id; the current value of a tile is the row of its highest batch id.

T1 posts bills as they arrive: ``foreachBatch`` runs the batch job B8 on
each micro-batch against the stock the previous batch left, and writes the
stock rows it changed keyed by the batch id (every COMPACT_EVERY batches the
whole stock).  A replayed batch finds its stock already committed and is
skipped, so no bill is posted twice; a batch whose predecessor is missing
raises; an output folder belongs to one checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glazier.operators.billing import apply_stock, build_invoice_items, build_invoices, post_bills
from glazier.plans.session import at_once, forget, shuffles_dropped, stored
from glazier.sources.tables import SCHEMAS, Tables
from glazier.streaming.fresh import write_partials

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


# --- T2 ------------------------------------------------------------------------------

def daily_revenue(sales: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Revenue per store per day over a (streaming or batch) sales feed
    (ts, store_id, amount)."""
    # Read the wall clock as UTC whatever the session zone, so the 1-day
    # windows (aligned to UTC) are calendar days of the recorded times.
    zone = sales.sparkSession.conf.get("spark.sql.session.timeZone")
    s = sales.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone))
    if sales.isStreaming:
        s = s.withWatermark("ts", watermark)
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
    return (s.groupBy(F.window("ts", "1 day").alias("w"), "store_id")
            .agg(F.sum("amount").cast("decimal(38,2)").alias("revenue"), F.count(F.lit(1)).alias("sales"))
            .select("store_id", day.alias("day"), "revenue", "sales"))


def sales_stream(spark: SparkSession, directory: str, n_stores: int, glob: str = "events.parquet",
                 files_per_trigger: int | None = None) -> DataFrame:
    """Purchase events of a parquet folder as a stream of sales."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    events = reader.parquet(directory)
    return (events.filter(F.col("event_type") == "purchase")
            .select("ts", (F.col("user_id") % n_stores).cast("int").alias("store_id"),
                    F.col("value").cast("decimal(12,2)").alias("amount")))


def run_daily_revenue(sales: DataFrame, out_dir: str, checkpoint: str, watermark: str = "1 day") -> str:
    """Run T2 until the source is drained (availableNow); every micro-batch
    appends its updated tiles, tagged with the batch id."""
    def write(batch: DataFrame, batch_id: int):
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(out_dir)

    q = (daily_revenue(sales, watermark).writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint).foreachBatch(write)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_dir


def current_tiles(spark: SparkSession, out_dir: str) -> DataFrame:
    """The latest value of every (store, day) tile written by T2."""
    rows = spark.read.parquet(out_dir)
    latest = rows.groupBy("store_id", "day").agg(
        F.max_by(F.struct("revenue", "sales"), "batch_id").alias("v"))
    return latest.select("store_id", "day", F.col("v.revenue").alias("revenue"),
                         F.col("v.sales").cast("long").alias("sales"))


# --- T1 ------------------------------------------------------------------------------

# A full stock snapshot is written every so many batches; the batches between
# write only the stock rows they changed.
COMPACT_EVERY = 20


def _exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a *committed* write: its ``_SUCCESS`` marker,
    which the file committer writes last."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return bool(marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker))


def _stock_paths(base: str, batch_id: int) -> tuple[str, list[str]]:
    """Snapshot and change folders that make up the stock after a batch."""
    start = batch_id - batch_id % COMPACT_EVERY
    return (f"{base}/inventory/v={start}", [f"{base}/stock_changes/v={v}" for v in range(start + 1, batch_id + 1)])


def _committed(spark: SparkSession, base: str, batch_id: int) -> bool:
    snapshot, changed = _stock_paths(base, batch_id)
    return _exists(spark, changed[-1] if changed else snapshot)


def stock_after(spark: SparkSession, out_dir: str, batch_id: int) -> DataFrame:
    """Stock after a committed batch: the last full snapshot with the rows
    changed since, the latest change of a row winning."""
    snapshot, changed = _stock_paths(out_dir.rstrip("/"), batch_id)
    stock = spark.read.schema(SCHEMAS["inventory"]).parquet(snapshot)
    if not changed:
        return stock
    rows = spark.read.schema(SCHEMAS["inventory"]).parquet(changed[0]).withColumn("_v", F.lit(0))
    for v, path in enumerate(changed[1:], 1):
        rows = rows.unionByName(spark.read.schema(SCHEMAS["inventory"]).parquet(path).withColumn("_v", F.lit(v)))
    # Met by store and product, which bills and sales are met by next: the stock is shuffled once, not by id first.
    key = ["store_id", "product_id"]
    last = rows.filter("id is not null").groupBy(*key, "id").agg(F.max_by(F.struct("available_stock", "updated_at"), "_v").alias("now"))
    held = last.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("id", "now"))).alias("_held"))
    return stock.join(held, key, "left").withColumn("_now", F.try_element_at("_held", F.col("id"))).withColumns({
        "available_stock": F.coalesce("_now.available_stock", "available_stock"),
        "updated_at": F.when(F.col("_now").isNotNull(), F.col("_now.updated_at")).otherwise(F.col("updated_at")),
    }).select(*[f.name for f in SCHEMAS["inventory"].fields])


def post_bills_batch(t: Tables, out_dir: str, reports: bool = False):
    """The ``foreachBatch`` body of T1 (B8 per micro-batch); with ``reports`` the partial sums of the
    fresh dashboards (``glazier.streaming.fresh``) are written with every batch.

    A batch needs the stock its predecessor left: if that is missing, the
    batch raises instead of starting from the original stock again."""
    base = out_dir.rstrip("/")

    def handle(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        if _committed(spark, base, batch_id):          # replayed batch
            return
        if batch_id == 0:
            inventory = t.inventory
        elif _committed(spark, base, batch_id - 1):
            inventory = stock_after(spark, base, batch_id - 1)
        else:
            raise RuntimeError(f"stock after batch {batch_id - 1} is missing in {base}; batch {batch_id} cannot be posted")
        with shuffles_dropped(spark):
            post(batch, batch_id, inventory)

    def post(batch: DataFrame, batch_id: int, inventory: DataFrame):
        spark = batch.sparkSession
        posting = post_bills(t.with_(inventory=inventory), batch, part=True)
        tag = F.lit(batch_id).cast("long").alias("batch_id")

        def write(name: str, rows: DataFrame) -> DataFrame:
            path = f"{base}/{name}/batch={batch_id}"
            rows.select("*", tag).write.mode("overwrite").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        # The accepted lines are picked once.  What is made of them does not need each other; the sold rows are
        # computed once, and the partial sums, like the stock, are taken from what was written.
        # A copy goes when all that is made of it is written.
        _, lines = at_once(lambda: write("decisions", posting.decisions), lambda: stored(posting.lines, "accepted-lines"))
        forget(*posting.copies)
        invoices, items, sold = at_once(
            lambda: write("invoices", build_invoices(lines)), lambda: write("items", build_invoice_items(lines)),
            lambda: stored(apply_stock(inventory, lines, sold_only=True), "sold-stock"))
        rows = sold.drop("stock_before")
        if reports:
            before = sold.withColumn("available_stock", F.col("stock_before"))
            write_partials(t, base, batch_id, invoices, items, before, rows)
        # The stock is written last: its presence marks the batch as done.
        snapshot, changed = _stock_paths(base, batch_id)
        if changed:
            rows.write.mode("overwrite").parquet(changed[-1])
        else:
            apply_stock(inventory, lines).write.mode("overwrite").parquet(snapshot)
        forget(lines, sold)

    return handle


def _token(spark: SparkSession, path: str) -> str | None:
    return spark.read.schema("token string").json(path).first()[0] if _exists(spark, path) else None


def _claim(spark: SparkSession, out_dir: str, checkpoint: str) -> None:
    """Tie an output folder to one query's checkpoint.  A new query numbers its
    batches from 0 again, so on another query's folder its bills would pass
    for replayed ones: that is refused."""
    ours, theirs = f"{checkpoint.rstrip('/')}-owner", f"{out_dir.rstrip('/')}/_owner"
    mine, owner = _token(spark, ours), _token(spark, theirs)
    if owner != mine or (owner is None and _exists(spark, f"{out_dir.rstrip('/')}/inventory/v=0")):
        if owner is not None or mine is None:
            raise ValueError(f"{out_dir} holds the output of another query; use its checkpoint or a new folder")
    if owner is None:
        row = spark.createDataFrame([(mine or uuid.uuid4().hex,)], "token string")
        for path in (ours, theirs):
            row.write.mode("overwrite").json(path)


def run_post_bills(t: Tables, requests: DataFrame, out_dir: str, checkpoint: str, reports: bool = False) -> str:
    """Post a stream of bill requests until the source is drained."""
    _claim(requests.sparkSession, out_dir, checkpoint)
    with shuffles_dropped(requests.sparkSession):  # also for the tables' session, which the batches' is cloned from
        q = (requests.writeStream.option("checkpointLocation", checkpoint)
             .foreachBatch(post_bills_batch(t, out_dir, reports)).trigger(availableNow=True).start())
        q.awaitTermination()
    return out_dir


def last_batch(spark: SparkSession, out_dir: str) -> int:
    """The last committed batch of T1, from one listing of the stock folders; batches are committed in order."""
    base = out_dir.rstrip("/")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [0]
    for pattern in (f"{base}/inventory/v=*/_SUCCESS", f"{base}/stock_changes/v=*/_SUCCESS"):
        marker = fs_path(pattern)
        listed = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marker)
        found += [int(status.getPath().getParent().getName().removeprefix("v=")) for status in listed or ()]
    return max(found)


def latest_stock(spark: SparkSession, out_dir: str) -> DataFrame:
    """Stock after the last committed batch of T1."""
    return stock_after(spark, out_dir, last_batch(spark, out_dir))


def bill_request_stream(spark: SparkSession, directory: str, files_per_trigger: int | None = 1) -> DataFrame:
    """Bill requests of a folder as a stream; without ``files_per_trigger`` all new files are one micro-batch."""
    reader = spark.readStream.schema(SCHEMAS["bill_requests"])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(directory)


def stage_bill_requests(requests: DataFrame, directory: str, bounds: list[str],
                        drain: Callable[[str], object] | None = None) -> str:
    """Write bill requests by time range, oldest first, so a file stream
    replays them in time order.  A staging helper for tests and demos: a real
    feed (a message bus) delivers micro-batches itself.

    With ``drain`` a range is written by all tasks and ``drain`` posts it as one micro-batch before the next is
    written (``files_per_trigger=None``).  Without, each range becomes one file, because the file source
    orders by file: one task writes it, which suits small data only.  The requests are computed once; that copy goes
    when its last range is written."""
    with shuffles_dropped(requests.sparkSession):
        requests = stored(requests, "requests")
    edges = [None] + list(bounds) + [None]
    for k in range(len(edges) - 1):
        part = requests
        if edges[k] is not None:
            part = part.filter(F.col("created_at") >= F.lit(edges[k]).cast("timestamp_ntz"))
        if edges[k + 1] is not None:
            part = part.filter(F.col("created_at") < F.lit(edges[k + 1]).cast("timestamp_ntz"))
        (part if drain else part.coalesce(1)).write.mode("append").parquet(directory)
        if k == len(edges) - 2:
            forget(requests)
        if drain:
            drain(directory)
    return directory

