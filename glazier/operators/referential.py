"""Deletes by the schema's graph of references (W5-W7 for any table).

A reference either cascades (its rows go with the row they refer to) or restricts (the row they refer to stays).  A
request to delete a row is worked through the graph to a fixpoint: the rows it would take along are marked with the
request, and a request that marks a row which any row refers to by a restricting reference is refused
whole, as one that cascades into a restricted row must be.  Everything is set-based: one join per reference and
round, whatever the number of requests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glazier.operators.changes import NOT_FOUND
from glazier.plans.session import cut_lineage
from glazier.sources.tables import Tables

CASCADE, RESTRICT = "cascade", "restrict"
REFERENCED = "still_referenced"


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str
    action: str


# The schema's references and their delete rules, and the key that others refer to.
REFERENCES = (
    Reference("products", "category_id", "glass_categories", RESTRICT),
    Reference("inventory", "product_id", "products", CASCADE),
    Reference("inventory", "store_id", "stores", CASCADE),
    Reference("invoices", "store_id", "stores", RESTRICT),
    Reference("invoices", "billed_by", "users", RESTRICT),
    Reference("invoice_items", "invoice_id", "invoices", CASCADE),
    Reference("invoice_items", "product_id", "products", RESTRICT),
)
KEYS = {"stores": "store_id", "users": "id", "glass_categories": "id", "products": "id", "inventory": "id",
        "invoices": "invoice_id"}


@dataclass(frozen=True)
class Deletion:
    tables: Tables
    rejects: DataFrame  # id, reason
    deleted: DataFrame  # id of the requests carried out


def _marks(t: Tables, table: str, known: DataFrame, references) -> dict[str, DataFrame]:
    """Per table the (root, key) of rows that the requests mark, to a fixpoint over the cascading references.

    Tables without a key of their own are leaves: they follow their parents and need no marks."""
    marked, frontier = {table: known}, {table: known}
    while frontier:
        found: dict[str, DataFrame] = {}
        for ref in references:
            if ref.action != CASCADE or ref.parent not in frontier or ref.child not in KEYS:
                continue
            rows = getattr(t, ref.child).select(F.col(KEYS[ref.child]).alias("row"), F.col(ref.column).alias("key"))
            hit = rows.join(frontier[ref.parent], "key").select("root", F.col("row").alias("key"))
            found[ref.child] = found[ref.child].unionByName(hit) if ref.child in found else hit
        frontier = {}
        for child, rows in found.items():
            rows = rows.distinct()
            if child in marked:
                rows = rows.join(marked[child], ["root", "key"], "left_anti")
            rows = cut_lineage(rows)
            if rows.isEmpty():
                continue
            frontier[child] = rows
            marked[child] = marked[child].unionByName(rows) if child in marked else rows
    return marked


def delete_rows(t: Tables, table: str, ids: DataFrame, references=REFERENCES) -> Deletion:
    """Delete the rows of ``table`` with the keys in the first column of ``ids``, with all that goes along.

    Refused: an unknown key, and a request that would delete a row which a restricting reference holds, also
    one that would itself go in the same request (a restriction is tested before anything is deleted)."""
    key = KEYS[table]
    asked = ids.select(F.col(ids.columns[0]).cast("long").alias("root")).filter("root is not null").distinct()
    here = getattr(t, table).select(F.col(key).cast("long").alias("root")).distinct()
    known = cut_lineage(asked.join(here, "root", "left_semi").select("root", F.col("root").alias("key")))
    marked = _marks(t, table, known, references)
    held = known.select("root").limit(0)
    for ref in references:
        if ref.action == RESTRICT and ref.parent in marked:
            used = getattr(t, ref.child).select(F.col(ref.column).alias("key")).filter("key is not null").distinct()
            held = held.unionByName(marked[ref.parent].join(used, "key", "left_semi").select("root"))
    held = cut_lineage(held.distinct())
    done = known.select("root").join(held, "root", "left_anti")
    gone = {name: rows.join(held, "root", "left_anti").select("key").distinct() for name, rows in marked.items()}
    after = {name: getattr(t, name).join(keys.withColumnRenamed("key", KEYS[name]), KEYS[name], "left_anti")
             .select(*getattr(t, name).columns) for name, keys in gone.items()}
    for ref in references:
        if ref.action == CASCADE and ref.parent in gone and ref.child not in KEYS:
            rows = after.get(ref.child, getattr(t, ref.child))
            after[ref.child] = rows.join(gone[ref.parent].withColumnRenamed("key", ref.column), ref.column, "left_anti").select(*rows.columns)
    rejects = asked.join(here, "root", "left_anti").select(F.col("root").alias("id"), F.lit(NOT_FOUND).alias("reason")).unionByName(
        held.select(F.col("root").alias("id"), F.lit(REFERENCED).alias("reason")))
    return Deletion(t.with_(**after), rejects, done.withColumnRenamed("root", "id"))
