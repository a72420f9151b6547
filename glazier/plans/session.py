"""Session settings and the shared folder for lineage cuts and written snapshots.

Nothing here is global state: every operator takes the session or DataFrames
it works on.  ``get_session`` is a convenience for tests, the bench and the
command line; on a cluster the caller's session is used as it is.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Settings every job in the library relies on.  AQE turns sort-merge joins
# into broadcast joins only when the runtime size of one side is below
# ``spark.sql.autoBroadcastJoinThreshold`` (the size check), splits skewed
# shuffle partitions, and coalesces small ones.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "glazier", extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, snapshots and stream state.

    The cluster names it in ``spark.checkpoint.dir``; that value is always
    used when present.  Only when it is unset and the master is local (tests)
    a fresh local folder is taken and recorded in the session, so later calls
    agree.  On a cluster an unset folder is an error: executors would not
    share a local one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="glazier-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: materialises ``df`` in the shared folder, so a
    lost executor recomputes from there instead of from the whole plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts the lineage like ``cut_lineage``, and
    later readers scan only the columns they need."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*copies: DataFrame) -> None:
    """Remove copies made by ``stored`` that no later step reads.  Only folders under the shared folder go."""
    for df in copies:
        base = df.sparkSession._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(df.sparkSession))
        files = base.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
        for folder in {os.path.dirname(file) for file in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            if files.makeQualified(path).toString().startswith(f"{files.makeQualified(base).toString()}/"):
                files.delete(path, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of a query when it ends, not when the driver happens to collect its
    garbage.  For operators whose steps are stored: disk then holds one step's shuffles, not those of all steps."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def at_once(*jobs: Callable[[], object]) -> list:
    """Results of jobs that do not need each other, submitted side by side, so that one's last tasks leave no cores
    idle.  All have ended when this returns or raises the first one's error."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(job)) for job in jobs]
    return [job.result() for job in running]


def default_sf_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
