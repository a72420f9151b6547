"""Write endpoints re-aimed as batch change-set jobs.

Each job takes the current table(s) and a DataFrame of changes (one request
per row) and returns the *new snapshot* plus ``rejects`` (the request's key
and a reason) for requests the endpoint would refuse.  Nothing is mutated.

Several changes to one key in one batch are folded per key first: sums add
up, "last value" fields take the value of the highest ``seq`` (``max_by``,
which Spark aggregates partially before the shuffle), so the table meets at
most one change row per key in a single join.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glazier.functions.rules import category_key, role_is
from glazier.plans.groups import connected_groups
from glazier.plans.ids import assign_dense_ids
from glazier.plans.session import at_once, cut_lineage, forget, shuffles_dropped, stored
from glazier.sources.tables import Tables, conform

# Reasons a change is refused.
NOT_FOUND = "not_found"
NO_FIELDS = "no_fields"
OUT_OF_RANGE = "out_of_range"
NOT_A_NUMBER = "not_a_number"
INVOICED = "product_invoiced"
IN_USE = "category_in_use"
BLANK_NAME = "blank_name"
DUPLICATE_NAME = "duplicate_name"
CATEGORY_NOT_FOUND = "category_not_found"
MISSING_FIELDS = "missing_fields"
NOT_IN_STORE = "not_in_store"
DUP_STORE_EMAIL = "duplicate_store_email"
DUP_EMAIL = "duplicate_email"
DUP_USERNAME = "duplicate_username"
INVALID_ROLE = "invalid_role"
NOT_STORE_ADMIN = "not_store_admin"
ROLES = ("MASTER_ADMIN", "STORE_ADMIN")


@dataclass(frozen=True)
class Change:
    table: DataFrame
    rejects: DataFrame
    extra: dict = field(default_factory=dict)


def _reject(df: DataFrame, keys: list[str], reason) -> DataFrame:
    r = reason if isinstance(reason, Column) else F.lit(reason)
    return df.select(*keys, r.alias("reason"))


def _last(col: str, order: Column) -> Column:
    return F.max_by(F.col(col), order)


def _max_id(df: DataFrame, id_col: str = "id") -> Column:
    return df.select(F.max(id_col)).scalar()


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _absent(c: Column) -> Column:
    """A required request field that is missing or empty (whitespace counts as given)."""
    return c.isNull() | (c == "")


# --- W1 -------------------------------------------------------------------------

def upsert_inventory(inv: DataFrame, changes: DataFrame, stores: DataFrame | None = None,
                     products: DataFrame | None = None) -> Change:
    """Assign a product to a store, or restock it.

    New key -> a new stock row; existing key -> rates and minimum are
    *replaced*, stock is *added*.  Missing numbers count as 0; the discount
    override is left alone.  A missing store_id or product_id is refused,
    and so is a store or product that ``stores`` / ``products`` (when given)
    do not hold.  ``changes``: seq, store_id, product_id, purchase_rate,
    selling_rate, available_stock, minimum_stock, changed_at."""
    whole = F.col("store_id").isNotNull() & F.col("product_id").isNotNull()
    rejects = _reject(changes.filter(~whole), ["seq"], MISSING_FIELDS)
    changes = changes.filter(whole)
    for parent, key, column in ((stores, "store_id", "store_id"), (products, "id", "product_id")):
        if parent is not None:
            known = parent.select(F.col(key).alias(column)).distinct()
            rejects = rejects.unionByName(_reject(changes.join(known, column, "left_anti"), ["seq"], NOT_FOUND))
            changes = changes.join(known, column, "left_semi")
    vals = ["purchase_rate", "selling_rate", "minimum_stock"]
    order = F.struct("seq", *vals, "available_stock", "changed_at")
    folded = changes.groupBy("store_id", "product_id").agg(
        F.sum(F.coalesce("available_stock", F.lit(0))).alias("add_stock"),
        F.max_by(F.struct(*vals, "changed_at"), order).alias("last"))
    c = folded.select(F.col("store_id").alias("c_store_id"), F.col("product_id").alias("c_product_id"),
                      "add_stock", F.col("last.changed_at").alias("changed_at"),
                      F.coalesce("last.purchase_rate", F.lit(0)).cast("decimal(12,2)").alias("c_purchase_rate"),
                      F.coalesce("last.selling_rate", F.lit(0)).cast("decimal(12,2)").alias("c_selling_rate"),
                      F.coalesce("last.minimum_stock", F.lit(0)).cast("int").alias("c_minimum_stock"))
    # Existing rows: one left join.  New keys: the folded changes without a
    # stock row (anti join on the keys only), so only they reach the id step.
    j = inv.join(c, (inv.store_id == c.c_store_id) & (inv.product_id == c.c_product_id), "left")
    hit = F.col("c_store_id").isNotNull()
    existing = j.select(
        "id", "store_id", "product_id",
        F.when(hit, F.col("c_purchase_rate")).otherwise(F.col("purchase_rate")).alias("purchase_rate"),
        F.when(hit, F.col("c_selling_rate")).otherwise(F.col("selling_rate")).alias("selling_rate"),
        F.when(hit, (F.col("available_stock") + F.col("add_stock")).cast("int"))
        .otherwise(F.col("available_stock")).alias("available_stock"),
        F.when(hit, F.col("c_minimum_stock")).otherwise(F.col("minimum_stock")).alias("minimum_stock"),
        "override_max_discount", "created_at",
        F.when(hit, F.col("changed_at")).otherwise(F.col("updated_at")).alias("updated_at"))
    keys = inv.select(F.col("store_id").alias("c_store_id"), F.col("product_id").alias("c_product_id"))
    new = c.join(keys, ["c_store_id", "c_product_id"], "left_anti").select(
        F.col("c_store_id").alias("store_id"), F.col("c_product_id").alias("product_id"),
        F.col("c_purchase_rate").alias("purchase_rate"), F.col("c_selling_rate").alias("selling_rate"),
        F.col("add_stock").cast("int").alias("available_stock"),
        F.col("c_minimum_stock").alias("minimum_stock"),
        F.col("changed_at").alias("created_at"), F.col("changed_at").alias("updated_at"))
    new = assign_dense_ids(new, ["store_id", "product_id"], _max_id(inv))
    table = conform(existing, "inventory").unionByName(conform(new, "inventory"))
    return Change(table, rejects.distinct())


# --- W2 -------------------------------------------------------------------------

def _judge_unique(requests: DataFrame, table: DataFrame, key: list[str], unique: dict[str, bool]) -> DataFrame:
    """(seq, reason) of the requests that set a unique field, each judged alone in ``seq`` order against the
    values the table holds by then: reason NULL when accepted.

    Requests that share a row or a value, old or new, belong to one group.  A request alone in its group is
    judged against the table; any other group in order by one streamed fold that keeps the group's moved
    values only, and groups are independent."""
    def value(name: str) -> Column:
        return F.lower(F.col(name)) if unique[name] else F.col(name)

    fields = list(unique)
    held = table.select(F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("row"),
                        *[value(f).alias(f"old_{f}") for f in fields])
    asked = requests.select("seq", F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("row"),
                            *[F.when(F.coalesce(F.col(f"set_{f}"), F.lit(False)), value(f)).alias(f"new_{f}") for f in fields],
                            *[F.coalesce(F.col(f"set_{f}"), F.lit(False)).alias(f"sets_{f}") for f in fields])
    asked = asked.filter(" or ".join(f"sets_{f}" for f in fields)).join(held, "row")
    for f in fields:
        owners = held.filter(F.col(f"old_{f}").isNotNull()).groupBy(F.col(f"old_{f}").alias(f"new_{f}")).agg(
            F.collect_set("row").alias(f"owners_{f}"))
        asked = asked.join(owners, f"new_{f}", "left")
    asked = cut_lineage(asked)
    nodes = F.filter(F.array(F.xxhash64(F.lit("row"), "row"), *[
        F.when(F.col(f"{age}_{f}").isNotNull(), F.xxhash64(F.lit(f), f"{age}_{f}")) for f in fields for age in ("old", "new")]),
        lambda n: n.isNotNull())
    touched = cut_lineage(asked.select("seq", F.explode(F.array_distinct(nodes)).alias("node")))
    met = touched.groupBy("node").agg(F.count(F.lit(1)).alias("met"))
    crowded = cut_lineage(touched.join(met.filter("met > 1"), "node", "left_semi").select("seq").distinct())
    reason = None
    for f in reversed(fields):
        taken = F.col(f"new_{f}").isNotNull() & F.coalesce(F.exists(f"owners_{f}", lambda o: o != F.col("row")), F.lit(False))
        reason = F.when(taken, F.lit(f"duplicate_{f}")).otherwise(F.lit(None) if reason is None else reason)
    alone = asked.join(crowded, "seq", "left_anti").select("seq", reason.cast("string").alias("reason"))
    groups = connected_groups(touched.join(crowded, "seq", "left_semi").withColumnRenamed("seq", "item"))
    rows = (asked.join(crowded, "seq", "left_semi").withColumn("node", F.xxhash64(F.lit("row"), "row")).join(groups, "node")
            .repartition("label").sortWithinPartitions("label", "seq"))

    def judge(batches):
        group, now, at = None, {}, {}   # of the group: (field, row) -> value, (field, value) -> rows moved there
        for batch in batches:
            seqs, reasons = [], []
            for r in batch.to_pylist():
                if r["label"] != group:
                    group, now, at = r["label"], {}, {}
                row, reason = r["row"], None
                for f in fields:
                    want = r[f"new_{f}"]
                    if reason is None and want is not None and (
                            any(o != row and now.get((f, o), want) == want for o in r[f"owners_{f}"] or ())
                            or at.get((f, want), set()) - {row}):
                        reason = f"duplicate_{f}"
                if reason is None:
                    for f in fields:
                        if r[f"sets_{f}"]:
                            at.get((f, now.get((f, row))), set()).discard(row)
                            now[f, row] = r[f"new_{f}"]
                            at.setdefault((f, r[f"new_{f}"]), set()).add(row)
                seqs.append(r["seq"])
                reasons.append(reason)
            yield pa.RecordBatch.from_pydict({"seq": pa.array(seqs, pa.int64()), "reason": pa.array(reasons, pa.string())})

    return alone.unionByName(rows.mapInArrow(judge, "seq long, reason string"))


def patch_rows(table: DataFrame, patch: DataFrame, key: list[str], fields: list[str],
               updated_col: str | None = "updated_at",
               unique: dict[str, bool] | None = None, clean: dict | None = None) -> Change:
    """Sparse update.  Only supplied fields change (``set_<f>`` tells "set to NULL" from "not
    supplied").  Every request is judged alone, in ``seq`` order: one without fields, one for an unknown
    key, and one whose value in a ``unique`` field (name -> ignore case) another row holds by then is
    refused as a whole, and refused requests change nothing.  Of the accepted ones the latest value per
    field wins.  ``clean`` (name -> Column function) normalises a supplied value first (e.g. trim a
    category name).  Rejects carry key, seq and reason.
    ``patch``: key..., seq, patched_at, f..., set_f..."""
    for f, fn in (clean or {}).items():
        patch = patch.withColumn(f, fn(F.col(f)))
    flags = {f: F.coalesce(F.col(f"set_{f}"), F.lit(False)) for f in fields}
    anything = F.greatest(*flags.values()) if len(fields) > 1 else flags[fields[0]]
    unnamed = patch.filter(~anything)
    named = patch.filter(anything)
    unknown = named.join(table.select(*key), key, "left_anti")
    rejects = _reject(unnamed, [*key, "seq"], NO_FIELDS).unionByName(_reject(unknown, [*key, "seq"], NOT_FOUND))
    accepted = named  # requests for an unknown key are folded under it and meet no row
    if unique:
        accepted = named.join(table.select(*key), key, "left_semi")
        refused = cut_lineage(_judge_unique(accepted, table, key, unique).filter("reason is not null"))
        rejects = rejects.unionByName(accepted.select(*key, "seq").join(refused, "seq").select(*key, "seq", "reason"))
        accepted = accepted.join(refused, "seq", "left_anti")

    aggs = [F.max_by("patched_at", F.struct("seq", "patched_at")).alias("_patched_at")]
    for f in fields:
        aggs.append(F.max_by(F.col(f), F.when(flags[f], F.struct("seq", F.col(f)))).alias(f"_new_{f}"))
        aggs.append(F.max(flags[f]).alias(f"_any_{f}"))
    folded = accepted.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(*aggs)
    cond = None
    for k in key:
        e = table[k] == F.col(f"_k_{k}")
        cond = e if cond is None else (cond & e)
    j = table.join(folded, cond, "left")
    hit = F.col(f"_k_{key[0]}").isNotNull()
    cols = []
    for c in table.columns:
        if c in fields:
            cols.append(F.when(hit & F.col(f"_any_{c}"), F.col(f"_new_{c}")).otherwise(F.col(c))
                        .cast(table.schema[c].dataType).alias(c))
        elif updated_col and c == updated_col:
            cols.append(F.when(hit, F.col("_patched_at")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return Change(j.select(*cols), rejects)


STORE_FIELDS = ["store_name", "store_location", "status"]


def patch_inventory(inv: DataFrame, patch: DataFrame) -> Change:
    """W2, stock form: rates, stock and minimum of (store, product) rows."""
    return patch_rows(inv, patch, ["store_id", "product_id"], INVENTORY_FIELDS)


def patch_products(products: DataFrame, patch: DataFrame, cats: DataFrame) -> Change:
    """W2, catalogue form: product columns only (stock rates sent with a
    product edit are not applied, as in the reference).  An edit that names a category, by id or (in a
    column ``category_name``) by name, is refused as a whole unless ``cats`` holds it."""
    checked = resolve_patched_category(patch, cats)
    res = patch_rows(products, checked.table, ["id"], PRODUCT_FIELDS)
    lost = patch.select("id", "seq").join(checked.rejects, "seq").select("id", "seq", "reason")
    return Change(res.table, res.rejects.unionByName(lost))


def patch_stores(stores: DataFrame, patch: DataFrame) -> Change:
    """W2, store form: name, location, status; stores keep no updated_at."""
    return patch_rows(stores, patch, ["store_id"], STORE_FIELDS, updated_col=None)


CATEGORY_FIELDS = ["category_name", "description", "status"]


def patch_categories(cats: DataFrame, patch: DataFrame) -> Change:
    """W2, category form: names are trimmed and must not equal another
    category's name ignoring case."""
    return patch_rows(cats, patch, ["id"], CATEGORY_FIELDS, unique={"category_name": True},
                      clean={"category_name": F.trim})


CREDENTIAL_FIELDS = ["email", "username"]
STORE_ADMIN_FIELDS = ["full_name", "username", "email", "status"]


def patch_users(users: DataFrame, patch: DataFrame, fields: list[str] | None = None,
                store_admins_only: bool = False) -> Change:
    """W2, user forms: credential edits (email, username) or store-admin
    edits (name, username, email, status; only rows whose role is
    STORE_ADMIN, others refused).  A new email or username must not belong
    to another user (exact case).  Passwords are not handled here."""
    fields = fields or (STORE_ADMIN_FIELDS if store_admins_only else CREDENTIAL_FIELDS)
    rejects = None
    if store_admins_only:
        others = users.filter(~F.coalesce(role_is("role", "store"), F.lit(False))).select("id")
        rejects = _reject(patch.join(others, "id", "left_semi"), ["id", "seq"], NOT_STORE_ADMIN)
        patch = patch.join(others, "id", "left_anti")
    res = patch_rows(users, patch, ["id"], fields,
                     unique={f: False for f in ("email", "username") if f in fields})
    return Change(res.table, res.rejects if rejects is None else rejects.unionByName(res.rejects))


# --- W3 / W4 ------------------------------------------------------------------------

def set_store_discount(stores: DataFrame, changes: DataFrame) -> Change:
    """A store's default discount limit.  Values below 0 or above 100 are
    refused; NULL passes and is stored; unknown stores are a silent no-op.
    ``changes``: seq, store_id, max_discount."""
    v = F.col("max_discount")
    bad = changes.filter(v.isNotNull() & ((v < 0) | (v > 100)))
    ok = changes.filter(v.isNull() | ((v >= 0) & (v <= 100)))
    last = ok.groupBy(F.col("store_id").alias("c_store_id")).agg(
        F.max_by(v, F.struct("seq", v)).alias("new_discount"))
    j = stores.join(last, stores.store_id == last.c_store_id, "left")
    table = j.select(*[F.when(F.col("c_store_id").isNotNull(), F.col("new_discount").cast("decimal(5,2)"))
                       .otherwise(F.col(c)).alias(c) if c == "default_max_discount" else F.col(c)
                       for c in stores.columns])
    return Change(table, _reject(bad, ["store_id"], OUT_OF_RANGE))


def set_discount_override(inv: DataFrame, changes: DataFrame) -> Change:
    """A stock row's own discount limit.  '' or NULL clears it; there is
    no range check; unknown keys are a silent no-op; text that is not a
    number is refused.  ``changes``: seq, store_id, product_id,
    override_value (text), changed_at."""
    raw = F.nullif(F.col("override_value"), F.lit(""))
    parsed = changes.withColumn("_v", F.expr("try_cast(nullif(override_value, '') AS DECIMAL(5,2))"))
    bad = parsed.filter(raw.isNotNull() & F.col("_v").isNull())
    ok = parsed.filter(raw.isNull() | F.col("_v").isNotNull())
    last = ok.groupBy(F.col("store_id").alias("c_store_id"), F.col("product_id").alias("c_product_id")).agg(
        F.max_by(F.col("_v"), F.struct("seq", "_v")).alias("_new"),
        F.max_by("changed_at", F.struct("seq", "changed_at")).alias("_at"))
    j = inv.join(last, (inv.store_id == last.c_store_id) & (inv.product_id == last.c_product_id), "left")
    hit = F.col("c_store_id").isNotNull()
    cols = []
    for c in inv.columns:
        if c == "override_max_discount":
            cols.append(F.when(hit, F.col("_new")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(hit, F.col("_at")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return Change(j.select(*cols), _reject(bad, ["store_id", "product_id"], NOT_A_NUMBER))


# --- W5 - W8: deletes -------------------------------------------------------------------

def delete_inventory(inv: DataFrame, keys: DataFrame) -> Change:
    """Remove stock rows by (store_id, product_id); unknown keys refused."""
    k = keys.select("store_id", "product_id").distinct()
    return Change(inv.join(k, ["store_id", "product_id"], "left_anti"),
                  _reject(k.join(inv.select("store_id", "product_id"), ["store_id", "product_id"], "left_anti"),
                          ["store_id", "product_id"], NOT_FOUND))


def delete_products(t: Tables, ids: DataFrame) -> Change:
    """Delete products and, by cascade, their stock rows.  A product on
    any invoice item is refused (RESTRICT); unknown ids are refused."""
    k = ids.select(F.col(ids.columns[0]).cast("int").alias("id")).distinct()
    unknown = k.join(t.products.select("id"), "id", "left_anti")
    known = k.join(t.products.select("id"), "id", "left_semi")
    sold = (t.invoice_items.select(F.col("product_id").alias("id")).join(known, "id", "left_semi").distinct())
    invoiced = known.join(sold, "id", "left_semi")
    gone = known.join(invoiced, "id", "left_anti")
    products = t.products.join(gone, "id", "left_anti")
    inventory = t.inventory.join(gone.select(F.col("id").alias("product_id")), "product_id", "left_anti")
    rejects = _reject(unknown, ["id"], NOT_FOUND).unionByName(_reject(invoiced, ["id"], INVOICED))
    return Change(products, rejects, {"inventory": inventory})


def delete_categories(t: Tables, ids: DataFrame) -> Change:
    """Hard delete; refused while any product uses the category."""
    k = ids.select(F.col(ids.columns[0]).cast("int").alias("id")).distinct()
    cats = t.glass_categories
    unknown = k.join(cats.select("id"), "id", "left_anti")
    known = k.join(cats.select("id"), "id", "left_semi")
    in_use = t.products.select(F.col("category_id").alias("id")).join(known, "id", "left_semi").distinct()
    used = known.join(in_use, "id", "left_semi")
    gone = known.join(used, "id", "left_anti")
    return Change(cats.join(gone, "id", "left_anti"),
                  _reject(unknown, ["id"], NOT_FOUND).unionByName(_reject(used, ["id"], IN_USE)))


def deactivate_stores(stores: DataFrame, ids: DataFrame) -> Change:
    """Soft delete: status = false, the row stays."""
    k = ids.select(F.col(ids.columns[0]).cast("int").alias("_sid"), F.lit(True).alias("_off")).distinct()
    j = stores.join(k, stores.store_id == k._sid, "left")
    table = j.select(*[F.when(F.col("_off").isNotNull(), F.lit(False)).otherwise(F.col(c)).alias(c)
                       if c == "status" else F.col(c) for c in stores.columns])
    unknown = k.join(stores.select(F.col("store_id").alias("_sid")), "_sid", "left_anti")
    return Change(table, _reject(unknown, [F.col("_sid").alias("store_id")], NOT_FOUND))


# --- W9 / W10: categories -------------------------------------------------------------------

def _first_per(df: DataFrame, key: Column, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Split rows into the first per key (lowest seq) and the later ones."""
    firsts = df.groupBy(key.alias("_dk")).agg(F.min(seq).alias("_first_seq"))
    j = df.join(firsts, key == F.col("_dk"))
    first = j.filter(F.col(seq) == F.col("_first_seq")).drop("_dk", "_first_seq")
    later = j.filter(F.col(seq) != F.col("_first_seq")).drop("_dk", "_first_seq")
    return first, later


def insert_categories(cats: DataFrame, new: DataFrame) -> Change:
    """Names are trimmed; blank names are refused, and so is a name equal
    (ignoring case) to an existing category or to an earlier row of the
    batch.  An empty description is stored as NULL.
    ``new``: seq, category_name, description, created_at."""
    n = new.withColumn("_name", F.trim("category_name"))
    blank = n.filter(_blank(F.col("category_name")))
    named = n.filter(~_blank(F.col("category_name")))
    clash = named.join(cats.select(category_key("category_name").alias("_ck")),
                       category_key("_name") == F.col("_ck"), "left_semi")
    fresh = named.join(clash.select("seq"), "seq", "left_anti")
    first, later = _first_per(fresh, category_key("_name"))
    rows = first.select(F.col("_name").alias("category_name"),
                        F.when(F.col("description").isNull() | (F.col("description") == ""), F.lit(None))
                        .otherwise(F.trim("description")).alias("description"),
                        F.lit(True).alias("status"), "created_at", F.col("created_at").alias("updated_at"),
                        "seq")
    rows = assign_dense_ids(rows, ["seq"], _max_id(cats))
    table = cats.unionByName(conform(rows, "glass_categories"))
    rejects = (_reject(blank, ["seq"], BLANK_NAME).unionByName(_reject(clash, ["seq"], DUPLICATE_NAME))
               .unionByName(_reject(later, ["seq"], DUPLICATE_NAME)))
    return Change(table, rejects)


def resolve_category(feed: DataFrame, cats: DataFrame, verify_id: bool = False) -> Change:
    """The category of a product request.  A given ``category_id`` is
    used (on create it is trusted; with ``verify_id`` it must exist);
    otherwise ``category_name`` is matched ignoring case against every
    category, active or not (input trimmed, stored names as they are; the
    lowest id wins if several match).  No match is refused."""
    by_name = cats.groupBy(F.lower("category_name").alias("_ck")).agg(F.min("id").alias("_cid"))
    f = feed.withColumn("_want", F.when(F.col("category_id").isNull(), F.lower(F.trim("category_name"))))
    j = f.join(by_name, F.col("_want") == F.col("_ck"), "left")
    resolved = F.coalesce(F.col("category_id"), F.col("_cid"))
    out = j.withColumn("resolved_category_id", resolved).drop("_want", "_ck", "_cid")
    if verify_id:
        ids = cats.select(F.col("id").alias("_vid"))
        out = (out.join(ids, out.resolved_category_id == ids._vid, "left")
               .withColumn("resolved_category_id", F.col("_vid")).drop("_vid"))
    missing = out.filter(F.col("resolved_category_id").isNull())
    return Change(out.filter(F.col("resolved_category_id").isNotNull()),
                  _reject(missing, ["seq"], CATEGORY_NOT_FOUND))


# --- W11 / W12: products ------------------------------------------------------------------

def insert_products(t: Tables, feed: DataFrame) -> Change:
    """New catalogue products.  Name, color and thickness are required
    and a category must resolve (W10); sizes start at 0 in mm and Sq.ft.
    Rows with a ``store_id`` (the store-admin form) are also stocked in that
    store through W1.  ``feed``: seq, product_name, color, thickness,
    category_id, category_name, product_image, store_id, purchase_rate,
    selling_rate, available_stock, minimum_stock, created_at."""
    missing = feed.filter(_absent(F.col("product_name")) | _absent(F.col("color")) | _absent(F.col("thickness")))
    complete = feed.join(missing.select("seq"), "seq", "left_anti")
    res = resolve_category(complete, t.glass_categories)
    rows = res.table.select(
        "seq", "product_name", F.col("resolved_category_id").alias("category_id"), "color", "thickness",
        F.lit(0).alias("length"), F.lit(0).alias("width"), F.lit("mm").alias("dimension_unit"),
        F.lit(0).alias("area"), F.lit("Sq.ft").alias("unit"), "product_image", "created_at",
        F.col("created_at").alias("updated_at"), "store_id", "purchase_rate", "selling_rate",
        "available_stock", "minimum_stock")
    rows = assign_dense_ids(rows, ["seq"], _max_id(t.products))
    products = t.products.unionByName(conform(rows, "products"))
    stocked = rows.filter(F.col("store_id").isNotNull()).select(
        "seq", "store_id", F.col("id").cast("int").alias("product_id"), "purchase_rate", "selling_rate",
        "available_stock", "minimum_stock", F.col("created_at").alias("changed_at"))
    stocking = upsert_inventory(t.inventory, stocked, stores=t.stores)
    inventory = stocking.table
    rejects = _reject(missing, ["seq"], MISSING_FIELDS).unionByName(res.rejects).unionByName(stocking.rejects)
    return Change(products, rejects, {"inventory": inventory, "new_products": conform(rows, "products")})


PRODUCT_FIELDS = ["product_name", "category_id", "color", "thickness", "length", "width", "dimension_unit",
                  "area", "unit", "product_image"]
INVENTORY_FIELDS = ["purchase_rate", "selling_rate", "available_stock", "minimum_stock"]


def resolve_patched_category(patch: DataFrame, cats: DataFrame) -> Change:
    """The category check of product edits: an edit that sets a category names it by id (which must exist)
    or by ``category_name`` when the patch has that column (W10 with ``verify_id``); no match refuses the edit."""
    if "category_name" not in patch.columns:
        patch = patch.withColumn("category_name", F.lit(None).cast("string"))
    asks = F.coalesce(F.col("set_category_id"), F.lit(False)) | F.col("category_name").isNotNull()
    patch = patch.withColumn("category_id", F.when(F.coalesce(F.col("set_category_id"), F.lit(False)), F.col("category_id"))
                             .cast("int"))
    res = resolve_category(patch.filter(asks), cats, verify_id=True)
    done = (res.table.withColumn("category_id", F.col("resolved_category_id").cast("int"))
            .withColumn("set_category_id", F.lit(True)).select(*patch.columns))
    return Change(patch.filter(~asks).unionByName(done), res.rejects)


def update_store_products(t: Tables, feed: DataFrame) -> Change:
    """A store admin edits a product it stocks: refused unless the
    (store, product) stock row exists and a category it names is known (W10);
    then product fields and that store's stock fields are patched (W2).
    ``feed``: seq, store_id, product_id, patched_at, f / set_f for product
    and stock fields, optionally category_name."""
    k = feed.select("seq", "store_id", "product_id")
    not_in = k.join(t.inventory.select("store_id", "product_id"), ["store_id", "product_id"], "left_anti")
    checked = resolve_patched_category(feed.join(not_in.select("seq"), "seq", "left_anti"), t.glass_categories)
    ok = checked.table
    prod_patch = ok.select(F.col("product_id").alias("id"), "seq", "patched_at",
                           *[c for f in PRODUCT_FIELDS for c in (f, f"set_{f}")])
    has_prod = F.greatest(*[F.coalesce(F.col(f"set_{f}"), F.lit(False)) for f in PRODUCT_FIELDS])
    has_inv = F.greatest(*[F.coalesce(F.col(f"set_{f}"), F.lit(False)) for f in INVENTORY_FIELDS])
    p = patch_rows(t.products, prod_patch.filter(has_prod), ["id"], PRODUCT_FIELDS)
    inv_patch = ok.filter(has_inv).select("store_id", "product_id", "seq", "patched_at",
                                          *[c for f in INVENTORY_FIELDS for c in (f, f"set_{f}")])
    i = patch_rows(t.inventory, inv_patch, ["store_id", "product_id"], INVENTORY_FIELDS)
    rejects = _reject(not_in, ["seq"], NOT_IN_STORE).unionByName(checked.rejects)
    nothing = ok.filter(~has_prod & ~has_inv)
    return Change(p.table, rejects.unionByName(_reject(nothing, ["seq"], NO_FIELDS)),
                  {"inventory": i.table})


# --- W13 - W15: stores and users ---------------------------------------------------------------

SLOW_ROUND = 0.1  # rounds that decide a smaller share of the open claims leave the rest to the fold


def _winners(claims: DataFrame) -> DataFrame:
    """(seq) of the accepted requests: a request is accepted unless an earlier accepted one claims one of its
    values.  ``claims``: (seq, field, value), one row for every value a request needs.

    In a round, requests that come first on all their values among the open ones are accepted, and those that
    share a value with them refused; both leave.  Conflicts of short chains take few rounds; when a round
    decides little, the rest is folded in order, one connected group of shared values at a time."""
    claims = cut_lineage(claims)
    done, before, left = [], None, claims.count()
    while left:
        if before is not None and left > (1 - SLOW_ROUND) * before:
            done.append(_folded_claims(claims))
            break
        first = claims.groupBy("field", "value").agg(F.min("seq").alias("first"))
        met = cut_lineage(claims.join(first, ["field", "value"]))
        wins = cut_lineage(met.groupBy("seq").agg(F.min(F.col("seq") == F.col("first")).alias("wins"))
                           .filter("wins").select("seq"))
        over = met.join(wins.select(F.col("seq").alias("first")), "first", "left_semi").select("seq").distinct()
        claims = cut_lineage(claims.join(over, "seq", "left_anti"))
        done.append(wins)
        before, left = left, claims.count()
    out = claims.select("seq").limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def _folded_claims(claims: DataFrame) -> DataFrame:
    """The winners by one streamed fold per connected group, which keeps the values its accepted requests took."""
    node = F.xxhash64("field", "value")
    groups = connected_groups(claims.select(F.col("seq").alias("item"), node.alias("node")))
    asked = claims.groupBy("seq").agg(F.collect_list(F.struct("field", "value")).alias("needs"), F.min(node).alias("node"))
    ordered = asked.join(groups, "node").repartition("label").sortWithinPartitions("label", "seq").select("label", "seq", "needs")

    def judge(batches):
        group, taken = None, set()
        for batch in batches:
            seqs = []
            for r in batch.to_pylist():
                if r["label"] != group:
                    group, taken = r["label"], set()
                needs = [(n["field"], n["value"]) for n in r["needs"]]
                if taken.isdisjoint(needs):
                    taken.update(needs)
                    seqs.append(r["seq"])
            yield pa.RecordBatch.from_pydict({"seq": pa.array(seqs, pa.int64())})

    return ordered.mapInArrow(judge, "seq long")


def _sequential_unique(rows: DataFrame, checks: list[tuple[str, DataFrame, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Refuse rows whose values are taken, exactly as one-at-a-time
    processing in ``seq`` order would: a value is taken by an existing row
    or by an *accepted* earlier row of the batch.  ``checks`` = [(column,
    existing rows, existing column, reason)] in the endpoint's order; a
    refused row's reason is its first check whose value is taken.

    Who is accepted is decided first (``_winners``); the reasons follow from the accepted rows' values."""
    cols = [c for c, _, _, _ in checks]
    whys = F.array(*[F.lit(why) for _, _, _, why in checks])
    asked = rows.select(F.col("seq").cast("long"), *cols)
    for col, existing, column, _ in checks:
        held = existing.select(F.col(column).alias(col)).filter(F.col(col).isNotNull()).distinct()
        asked = asked.join(held.withColumn(f"held_{col}", F.lit(True)), col, "left")
    asked = cut_lineage(asked)

    def claims(requests: DataFrame) -> DataFrame:
        needs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("value")) for n, c in enumerate(cols)])
        return requests.select("seq", F.explode(needs).alias("need")).select("seq", "need.*").filter("value is not null")

    blocked = F.coalesce(*[f"held_{c}" for c in cols], F.lit(False))
    free = asked.filter(~blocked)
    unclaimed = free.filter(F.coalesce(*cols).isNull()).select("seq")
    accepted = cut_lineage(_winners(claims(free)).unionByName(unclaimed))
    refused = asked.join(accepted, "seq", "left_anti")
    taken = claims(asked.join(accepted, "seq", "left_semi")).withColumnRenamed("seq", "owner")
    lost = claims(refused).join(taken, ["field", "value"]).filter("owner < seq").select("seq", "field")
    for n, c in enumerate(cols):
        lost = lost.unionByName(refused.filter(f"held_{c}").select("seq", F.lit(n).alias("field")))
    reasons = cut_lineage(lost.groupBy("seq").agg(F.get(whys, F.min("field")).alias("reason")))
    return rows.join(accepted, "seq", "left_semi"), reasons


def create_stores_with_admins(t: Tables, feed: DataFrame) -> Change:
    """Each request creates a store and its admin together or neither.
    Refused, in this order: store email taken, admin email taken, admin
    username taken (exact case), by an existing row or by an earlier
    accepted request of the batch (``_sequential_unique``).  The admin's
    role is STORE_ADMIN.  Requests missing a store or admin field are
    refused first.  ``feed``: seq, store_email, store_name, store_location,
    full_name, username, email, created_at."""
    required = ["store_email", "store_name", "store_location", "full_name", "username", "email"]
    missing = feed.filter(F.greatest(*[_absent(F.col(c)) for c in required]))
    feed = feed.join(missing.select("seq"), "seq", "left_anti")
    alive, rejects = _sequential_unique(feed, [
        ("store_email", t.stores, "store_email", DUP_STORE_EMAIL),
        ("email", t.users, "email", DUP_EMAIL),
        ("username", t.users, "username", DUP_USERNAME)])
    stores_new = assign_dense_ids(alive.select("seq", "store_email", "store_name", "store_location", "created_at",
                                               "full_name", "username", "email"),
                                  ["seq"], _max_id(t.stores, "store_id"), "store_id")
    store_rows = conform(stores_new.withColumn("status", F.lit(True)), "stores")
    users_new = assign_dense_ids(stores_new.select("seq", F.col("store_id").cast("int").alias("store_id"),
                                                   "full_name", "username", "email", "created_at"),
                                 ["seq"], _max_id(t.users))
    user_rows = conform(users_new.withColumn("role", F.lit("STORE_ADMIN")).withColumn("status", F.lit(True))
                        .withColumn("updated_at", F.col("created_at")), "users")
    rejects = _reject(missing, ["seq"], MISSING_FIELDS).unionByName(rejects)
    return Change(t.stores.unionByName(store_rows), rejects,
                  {"users": t.users.unionByName(user_rows), "new_stores": store_rows, "new_users": user_rows})


def insert_users(users: DataFrame, feed: DataFrame) -> Change:
    """Register users.  full_name, username, email and role are
    required (missing or empty); the role, upper-cased, must be MASTER_ADMIN or STORE_ADMIN;
    email then username must be unused by existing rows and by earlier
    accepted requests of the batch (``_sequential_unique``).  A ``store_id`` is kept (store-admin form).
    ``feed``: seq, full_name, username, email, role, store_id, created_at."""
    missing = feed.filter(_absent(F.col("full_name")) | _absent(F.col("username")) | _absent(F.col("email"))
                          | _absent(F.col("role")))
    rest = feed.join(missing.select("seq"), "seq", "left_anti")
    bad_role = rest.filter(~F.upper("role").isin(*ROLES))
    rest = rest.join(bad_role.select("seq"), "seq", "left_anti")
    alive, dup = _sequential_unique(rest, [("email", users, "email", DUP_EMAIL),
                                       ("username", users, "username", DUP_USERNAME)])
    rows = assign_dense_ids(alive.withColumn("role", F.upper("role")), ["seq"], _max_id(users))
    rows = conform(rows.withColumn("status", F.lit(True)).withColumn("updated_at", F.col("created_at")), "users")
    rejects = (_reject(missing, ["seq"], MISSING_FIELDS).unionByName(_reject(bad_role, ["seq"], INVALID_ROLE))
               .unionByName(dup))
    return Change(users.unionByName(rows), rejects, {"new_users": rows})


def reassign_admins(users: DataFrame, changes: DataFrame) -> Change:
    """Move store admins to another store (no check that the store
    exists); the latest change per user wins.  A change without a user or a
    store is refused; users that are not store admins are refused, unknown
    users too.  ``changes``: seq, user_id, store_id, changed_at."""
    partial = changes.filter(F.col("user_id").isNull() | F.col("store_id").isNull())
    changes = changes.filter(F.col("user_id").isNotNull() & F.col("store_id").isNotNull())
    last = changes.groupBy(F.col("user_id").alias("_uid")).agg(
        F.max_by(F.col("store_id"), F.struct("seq", "store_id")).alias("_sid"),
        F.max_by("changed_at", F.struct("seq", "changed_at")).alias("_at"))
    admins = users.filter(role_is("role", "store")).select(F.col("id").alias("_uid"))
    unknown = last.join(users.select(F.col("id").alias("_uid")), "_uid", "left_anti")
    not_admin = last.join(users.select(F.col("id").alias("_uid")), "_uid", "left_semi").join(
        admins, "_uid", "left_anti")
    apply = last.join(admins, "_uid", "left_semi")
    j = users.join(apply, users.id == apply._uid, "left")
    hit = F.col("_uid").isNotNull()
    cols = []
    for c in users.columns:
        if c == "store_id":
            cols.append(F.when(hit, F.col("_sid").cast("int")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(hit, F.col("_at")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    rejects = (_reject(unknown, [F.col("_uid").alias("user_id")], NOT_FOUND)
               .unionByName(_reject(not_admin, [F.col("_uid").alias("user_id")], NOT_STORE_ADMIN))
               .unionByName(_reject(partial, ["user_id"], MISSING_FIELDS)))
    return Change(j.select(*cols), rejects)


# --- W16 --------------------------------------------------------------------------------------

# The schema's NOT NULL columns (passwords are not kept here).
NOT_NULL = {
    "stores": ["store_email", "store_name", "store_location"],
    "users": ["full_name", "username", "role"],
    "glass_categories": ["category_name"],
    "products": ["product_name", "category_id", "color", "thickness", "length", "width", "area"],
    "inventory": ["product_id", "purchase_rate", "selling_rate"],
    "invoices": ["store_id", "billed_by", "sub_total", "grand_total"],
    "invoice_items": ["invoice_id", "product_id", "quantity", "unit_price", "total_price"],
}


# The schema's unique columns, and its references (column -> table and key it must be found in).
UNIQUE = {
    "stores": [["store_id"], ["store_email"]],
    "users": [["id"], ["username"], ["email"]],
    "glass_categories": [["id"], ["category_name"]],
    "products": [["id"]],
    "inventory": [["id"], ["store_id", "product_id"]],
    "invoices": [["invoice_id"]],
    "invoice_items": [],
}
REFERENCES = {
    "products": {"category_id": ("glass_categories", "id")},
    "inventory": {"product_id": ("products", "id"), "store_id": ("stores", "store_id")},
    "invoices": {"store_id": ("stores", "store_id"), "billed_by": ("users", "id")},
    "invoice_items": {"invoice_id": ("invoices", "invoice_id"), "product_id": ("products", "id")},
}
ROW_KEY = {"stores": "store_id", "users": "id", "glass_categories": "id", "products": "id", "inventory": "id",
           "invoices": "invoice_id", "invoice_items": "invoice_id"}
# A finding's kind: once a row, more than one row a key, or rows without a parent.
_ROW, _KEY, _CHILD = "row", "unique", "reference"
RULES = ([(t, "not_null:" + c, _ROW) for t, cs in NOT_NULL.items() for c in cs] + [("users", "check:role", _ROW)]
         + [(t, "unique:" + ",".join(cs), _KEY) for t, keys in UNIQUE.items() for cs in keys]
         + [(t, "foreign_key:" + c, _CHILD) for t, refs in REFERENCES.items() for c in refs])
_NUMBER = {(t, rule): n for n, (t, rule, _) in enumerate(RULES)}


def _facts(df: DataFrame, table: str) -> DataFrame:
    """All that the rules need of one table, in one scan: (rule, key, rows, parents).

    A broken row rule counts the row, a unique key and a reference count the row under their value, and a key
    that others refer to counts as a parent under each of those rules."""
    def fact(rule: tuple[str, str], key: Column, parent: int, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(_NUMBER[rule]).alias("rule"), key.cast("string").alias("key"),
                                     F.lit(1 - parent).alias("row"), F.lit(parent).alias("parent")))

    row_key = F.col(ROW_KEY[table])
    facts = [fact((table, "not_null:" + c), row_key, 0, F.col(c).isNull()) for c in NOT_NULL[table]]
    if table == "users":
        facts.append(fact((table, "check:role"), row_key, 0, ~F.col("role").isin(*ROLES)))
    for cols in UNIQUE[table]:
        whole = F.col(cols[0]).isNotNull()
        for c in cols[1:]:
            whole &= F.col(c).isNotNull()
        facts.append(fact((table, "unique:" + ",".join(cols)), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 0, whole))
    facts += [fact((table, "foreign_key:" + c), F.col(c), 0, F.col(c).isNotNull()) for c in REFERENCES.get(table, {})]
    facts += [fact((child, "foreign_key:" + c), F.col(key), 1, F.col(key).isNotNull())
              for child, refs in REFERENCES.items() for c, (parent, key) in refs.items() if parent == table]
    return df.select(F.explode(F.filter(F.array(*facts), lambda x: x.isNotNull())).alias("fact")).select("fact.*")


def _all_facts(t: Tables) -> DataFrame:
    out = None
    for table in ROW_KEY:
        facts = _facts(getattr(t, table), table)
        out = facts if out is None else out.unionByName(facts)
    return out


def _findings(facts: DataFrame) -> DataFrame:
    """(table_name, rule, key_value, n) of the broken rules, from one aggregation over the facts."""
    rules = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(r).alias("rule"), F.lit(k).alias("kind")) for t, r, k in RULES])
    seen = facts.groupBy("rule", "key").agg(F.sum("row").alias("n"), F.sum("parent").alias("parents"))
    seen = seen.select(F.get(rules, F.col("rule")).alias("of"), F.col("key").alias("key_value"), "n", "parents")
    kind, n = F.col("of.kind"), F.col("n")
    broken = ((kind == _ROW) | ((kind == _KEY) & (n > 1)) | ((kind == _CHILD) & (n > 0) & (F.col("parents") == 0)))
    # Rows that break a row rule are reported one by one, also under one key.
    times = F.when(kind == _ROW, F.array_repeat(F.lit(1).cast("long"), n.cast("int"))).otherwise(F.array(n))
    return seen.filter(broken).select("of.table_name", "of.rule", "key_value", F.explode(times).alias("n"))


def _rule_columns(df: DataFrame, table: str) -> DataFrame:
    """The keys and references of a table, and the row rules that each row breaks (``broken``), from one scan."""
    broken = [F.when(F.col(c).isNull(), F.lit(_NUMBER[table, "not_null:" + c])) for c in NOT_NULL[table]]
    if table == "users":
        broken.append(F.when(~F.col("role").isin(*ROLES), F.lit(_NUMBER[table, "check:role"])))
    keys = {ROW_KEY[table], *(c for cols in UNIQUE[table] for c in cols), *REFERENCES.get(table, {}),
            *(key for refs in REFERENCES.values() for parent, key in refs.values() if parent == table)}
    return df.select(*[c for c in df.columns if c in keys], F.array_compact(F.array(*broken)).alias("broken"))


def constraint_violations(t: Tables) -> DataFrame:
    """Rows that break the schema's UNIQUE / NOT NULL / CHECK / FOREIGN
    KEY rules, as (table_name, rule, key_value, n).

    Every table is read once: the columns that rules need are stored.  Each rule is decided by its own aggregation over its
    typed keys, so a task holds the keys of a part of one rule, not of all rules.  A table's findings are stored, so a
    reader of the result scans them once per table; the columns' copies go then."""
    with shuffles_dropped(t.stores.sparkSession):
        rows = {table: stored(_rule_columns(getattr(t, table), table), f"rules-{table}") for table in ROW_KEY}
        found = at_once(*[lambda table=table: stored(_table_findings(rows, table), f"findings-{table}") for table in rows])
        forget(*rows.values())
    return reduce(DataFrame.unionByName, found)


def _table_findings(rows: dict[str, DataFrame], table: str) -> DataFrame:
    """The findings of one table's rules, given the ``_rule_columns`` of all tables."""

    def finding(df: DataFrame, table, rule, key: Column, n: Column) -> DataFrame:
        return df.select(table.alias("table_name"), rule.alias("rule"), key.cast("string").alias("key_value"), n.cast("long").alias("n"))

    names = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule")) for table, rule, _ in RULES])
    df = rows[table]
    # Rows that break a row rule are reported one by one, also under one key.
    broken = df.select(F.col(ROW_KEY[table]).alias("key"), F.explode("broken").alias("number")).withColumn(
        "of", F.get(names, F.col("number")))
    found = [finding(broken, F.col("of.table_name"), F.col("of.rule"), F.col("key"), F.lit(1))]
    for cols in UNIQUE[table]:
        twice = df.dropna(subset=cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found.append(finding(twice, F.lit(table), F.lit("unique:" + ",".join(cols)),
                             F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), F.col("n")))
    for c, (parent, key) in REFERENCES.get(table, {}).items():
        used = df.dropna(subset=[c]).groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        orphans = used.join(rows[parent].select(F.col(key).alias("key")), "key", "left_anti")
        found.append(finding(orphans, F.lit(table), F.lit("foreign_key:" + c), F.col("key"), F.col("n")))
    return reduce(DataFrame.unionByName, found)


def violations_of_changes(t: Tables, changed: dict[str, DataFrame], removed: dict[str, DataFrame] | None = None) -> DataFrame:
    """W16 for the rules that a change can have broken: ``t`` are the tables after it, ``changed`` their new or
    edited rows by table, ``removed`` the rows that went or were edited, as they were.

    Only (rule, key) pairs that a changed row touches, as a row, a child or a parent, can have turned: the facts of all
    tables are met by those pairs first, so the rest neither is shuffled nor aggregated."""
    touched = None
    for rows in (changed, removed or {}):
        for table, df in rows.items():
            facts = _facts(df, table).select("rule", "key")
            touched = facts if touched is None else touched.unionByName(facts)
    return _findings(_all_facts(t).join(touched.distinct(), ["rule", "key"], "left_semi"))
