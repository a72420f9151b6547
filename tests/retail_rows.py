"""Hand-made tables for the tests."""
import datetime as dt
from decimal import Decimal

from glazier.sources.tables import SCHEMAS, Tables


def D(x):
    return None if x is None else Decimal(str(x))


def TS(s):
    return dt.datetime.fromisoformat(s)


def make(spark, name, rows):
    schema = SCHEMAS[name]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def tables(spark, **given):
    frames = {n: make(spark, n, given.get(n, [])) for n in
              ("stores", "users", "glass_categories", "products", "inventory", "invoices", "invoice_items",
               "bill_requests")}
    return Tables(**frames)
