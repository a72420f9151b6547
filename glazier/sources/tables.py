"""Typed retail tables (S1), snapshot writer (S2) and JSON rows (S3).

One explicit ``StructType`` per table; nothing is inferred at read time.
Money is DECIMAL, timestamps are ``timestamp_ntz`` (the session zone is UTC).
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glazier.plans.session import forget, shuffles_dropped, stored

MONEY = T.DecimalType(12, 2)
PCT = T.DecimalType(5, 2)
DIM = T.DecimalType(10, 2)
AREA = T.DecimalType(10, 4)
TS = T.TimestampNTZType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in cols])


SCHEMAS: dict[str, T.StructType] = {
    "stores": _schema(
        ("store_id", T.IntegerType()), ("store_email", T.StringType()), ("store_name", T.StringType()),
        ("store_location", T.StringType()), ("status", T.BooleanType()), ("created_at", TS),
        ("default_max_discount", PCT)),
    "users": _schema(
        ("id", T.IntegerType()), ("store_id", T.IntegerType()), ("full_name", T.StringType()),
        ("username", T.StringType()), ("email", T.StringType()), ("role", T.StringType()),
        ("status", T.BooleanType()), ("created_at", TS), ("updated_at", TS)),
    "glass_categories": _schema(
        ("id", T.IntegerType()), ("category_name", T.StringType()), ("description", T.StringType()),
        ("status", T.BooleanType()), ("created_at", TS), ("updated_at", TS)),
    "products": _schema(
        ("id", T.IntegerType()), ("product_name", T.StringType()), ("category_id", T.IntegerType()),
        ("color", T.StringType()), ("thickness", T.StringType()), ("length", DIM), ("width", DIM),
        ("dimension_unit", T.StringType()), ("area", AREA), ("unit", T.StringType()), ("gst", PCT),
        ("product_image", T.StringType()), ("created_at", TS), ("updated_at", TS)),
    "inventory": _schema(
        ("id", T.LongType()), ("store_id", T.IntegerType()), ("product_id", T.IntegerType()),
        ("purchase_rate", MONEY), ("selling_rate", MONEY), ("available_stock", T.IntegerType()),
        ("minimum_stock", T.IntegerType()), ("override_max_discount", PCT), ("created_at", TS),
        ("updated_at", TS)),
    "invoices": _schema(
        ("invoice_id", T.LongType()), ("store_id", T.IntegerType()), ("billed_by", T.IntegerType()),
        ("customer_name", T.StringType()), ("customer_phone", T.StringType()), ("sub_total", MONEY),
        ("total_gst", MONEY), ("grand_total", MONEY), ("created_at", TS)),
    "invoice_items": _schema(
        ("invoice_id", T.LongType()), ("product_id", T.IntegerType()), ("quantity", T.IntegerType()),
        ("unit_price", MONEY), ("discount_percent", PCT), ("total_price", MONEY), ("length", DIM),
        ("width", DIM), ("charged_dimension", T.StringType()), ("area", AREA), ("charged_rate", MONEY),
        ("line_no", T.IntegerType())),
    # One row per requested bill line (the request body of "create bill").
    "bill_requests": _schema(
        ("bill_id", T.LongType()), ("store_id", T.IntegerType()), ("created_at", TS),
        ("line_no", T.IntegerType()), ("product_id", T.IntegerType()), ("quantity", T.IntegerType()),
        ("discount_applied", PCT), ("height", DIM), ("length", DIM), ("width", DIM), ("area", AREA),
        ("charged_rate", MONEY), ("charged_dimension", T.StringType()), ("billed_by", T.IntegerType()),
        ("customer_name", T.StringType()), ("customer_phone", T.StringType())),
}

TABLE_NAMES = ("stores", "users", "glass_categories", "products", "inventory", "invoices",
               "invoice_items", "bill_requests")


@dataclass(frozen=True)
class Tables:
    """The retail tables an operator reads.  Change-set jobs return a new
    ``Tables`` (via ``with_``) rather than mutating anything."""

    stores: DataFrame
    users: DataFrame
    glass_categories: DataFrame
    products: DataFrame
    inventory: DataFrame
    invoices: DataFrame
    invoice_items: DataFrame
    bill_requests: DataFrame | None = None

    def with_(self, **changes) -> "Tables":
        return replace(self, **changes)

    def items(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None:
                yield f.name, value


def conform(df: DataFrame, name: str, more: list[str] = ()) -> DataFrame:
    """Project ``df`` onto the table's schema: column order, types, and
    NULL for any column it lacks; columns of ``more`` follow as they are."""
    present = set(df.columns)
    cols: list[Column] = []
    for field in SCHEMAS[name].fields:
        src = F.col(field.name) if field.name in present else F.lit(None)
        cols.append(src.cast(field.dataType).alias(field.name))
    return df.select(*cols, *more)


def load_tables(spark: SparkSession, directory: str) -> Tables:
    """Typed scan of the retail tables stored as ``<dir>/<table>`` parquet."""
    frames = {}
    for name in TABLE_NAMES:
        reader = spark.read.schema(SCHEMAS[name])
        try:
            frames[name] = reader.parquet(f"{directory.rstrip('/')}/{name}")
        except Exception:
            if name == "bill_requests":
                frames[name] = None
            else:
                raise
    return Tables(**frames)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "errorifexists") -> str:
    """Persist a snapshot.  Snapshots go to a *new* path: the default
    mode refuses to overwrite, so a job never clobbers the files it reads."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


# Rows a task sorts and writes as one file, at most (on average).
ROWS_PER_FILE = 1_000_000

# Layout keys: rows of one key land in one file, sorted, so scans of a key
# range skip row groups by their min/max statistics.
CLUSTER_KEYS = {
    "stores": ["store_id"], "users": ["id"], "glass_categories": ["id"], "products": ["id"],
    "inventory": ["store_id", "product_id"], "invoices": ["invoice_id"], "invoice_items": ["invoice_id"],
    "bill_requests": ["store_id", "bill_id"],
}


def write_tables(tables: Tables, directory: str, partition_by: dict[str, list[str]] | None = None,
                 num_files: int | None = None) -> str:
    """S2 for a whole snapshot.  With ``num_files`` each table is
    hash-clustered on its layout key into that many files, more when they would
    hold over ``ROWS_PER_FILE`` rows each, and sorted inside each file.

    A table that is to be clustered is computed once, stored as it comes, counted and clustered from there, so disk
    never holds the shuffles of its making beside that of its clustering, nor those of the tables before it."""
    for name, df in tables.items():
        path = f"{directory.rstrip('/')}/{name}"
        with shuffles_dropped(df.sparkSession):
            if num_files:
                rows = stored(df, f"{name}-rows")
                keys = CLUSTER_KEYS.get(name, [])
                files = max(num_files, -(-rows.count() // ROWS_PER_FILE))
                df = rows.repartition(files, *keys).sortWithinPartitions(*keys) if keys else rows.repartition(files)
            write_table(df, path, (partition_by or {}).get(name))
            if num_files:
                forget(rows)
    return directory


def to_json_rows(df: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """S3: every row as one JSON text, null-valued keys kept (as
    JSON_BUILD_OBJECT does).  ``key_cols`` are kept beside the text."""
    key_cols = key_cols or []
    payload = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(*key_cols, payload.alias("json"))
