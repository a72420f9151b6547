"""DuckDB oracle text for the correctness gate.

Each oracle query is self-contained: the retail views of FIXTURES.md §2 are
inlined as CTEs over the driver's base tables (region nation customer
supplier part orders lineitem ...), followed by the report's own SQL with
"now" pinned to the fixture ``as_of``.  Every output column is cast to the
type the Spark side returns.
"""

from __future__ import annotations

AS_OF_TS = "TIMESTAMP '2001-07-26 12:00:00'"
AS_OF_DATE = "DATE '2001-07-26'"

_CAT_ID = ("CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'PROMO' THEN 3 "
           "WHEN 'SMALL' THEN 4 WHEN 'MEDIUM' THEN 5 WHEN 'LARGE' THEN 6 END AS INT)")

VIEWS: dict[str, str] = {
    "stores": """
        SELECT CAST(s.s_suppkey AS INT) AS store_id, concat(s.s_name, '@example.test') AS store_email,
               s.s_name AS store_name, n.n_name AS store_location, s.s_suppkey % 10 <> 0 AS status,
               f.created_at,
               CAST(CASE WHEN s.s_suppkey % 7 = 0 THEN NULL ELSE (s.s_suppkey % 4) * 5 END AS DECIMAL(5,2))
                   AS default_max_discount
        FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
        LEFT JOIN (SELECT l_suppkey, min(l_shipdate) AS created_at FROM lineitem GROUP BY l_suppkey) f
               ON s.s_suppkey = f.l_suppkey""",
    "users": """
        SELECT CAST(s_suppkey AS INT) AS id, CAST(s_suppkey AS INT) AS store_id, s_name AS full_name,
               s_name AS username, concat('admin-', s_name, '@example.test') AS email,
               CASE WHEN s_suppkey % 9 = 8 THEN 'MASTER_ADMIN' ELSE 'STORE_ADMIN' END AS role,
               s_suppkey % 8 <> 0 AS status, CAST(NULL AS TIMESTAMP) AS created_at,
               CAST(NULL AS TIMESTAMP) AS updated_at
        FROM supplier""",
    "glass_categories": f"""
        SELECT {_CAT_ID} AS id, p_type AS category_name, CAST(NULL AS VARCHAR) AS description,
               p_type <> 'SMALL' AS status, CAST(NULL AS TIMESTAMP) AS created_at,
               CAST(NULL AS TIMESTAMP) AS updated_at
        FROM (SELECT DISTINCT p_type FROM part) d""",
    "products": f"""
        SELECT CAST(p_partkey AS INT) AS id, p_name AS product_name,
               CASE WHEN p_partkey % 25 = 0 THEN NULL ELSE {_CAT_ID} END AS category_id,
               split_part(p_name, ' ', 1) AS color,
               concat(CAST(p_size % 12 AS VARCHAR), 'mm') AS thickness,
               CAST(p_size AS DECIMAL(10,2)) AS length,
               CAST((p_partkey % 40) + 0.5 AS DECIMAL(10,2)) AS width,
               CASE p_partkey % 3 WHEN 0 THEN 'inch' WHEN 1 THEN 'mm' ELSE 'feet' END AS dimension_unit,
               CAST(p_size * 0.25 AS DECIMAL(10,4)) AS area,
               CASE p_partkey % 2 WHEN 0 THEN 'Sq.ft' ELSE 'Sq.m' END AS unit,
               CAST(NULL AS DECIMAL(5,2)) AS gst, CAST(NULL AS VARCHAR) AS product_image,
               f.created_at, f.created_at AS updated_at
        FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS created_at FROM lineitem GROUP BY l_partkey) f
               ON p_partkey = f.l_partkey""",
    "inventory": """
        SELECT g.l_suppkey * 1000000 + g.l_partkey AS id, CAST(g.l_suppkey AS INT) AS store_id,
               CAST(g.l_partkey AS INT) AS product_id,
               CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 0.70 AS DECIMAL(12,2)) AS purchase_rate,
               CAST(p_retailprice AS DECIMAL(12,2)) AS selling_rate,
               CAST(CAST(g.q AS INT) % 40 - 3 AS INT) AS available_stock,
               CAST(g.l_partkey % 15 AS INT) AS minimum_stock,
               CAST(CASE WHEN (g.l_suppkey + g.l_partkey) % 3 = 0 THEN NULL
                         ELSE (g.l_suppkey + g.l_partkey) % 3 * 10 END AS DECIMAL(5,2)) AS override_max_discount,
               g.first_ship AS created_at, g.last_ship AS updated_at
        FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q, min(l_shipdate) AS first_ship,
                     max(l_shipdate) AS last_ship
              FROM lineitem GROUP BY l_suppkey, l_partkey) g
        JOIN part ON g.l_partkey = part.p_partkey""",
    "invoices": """
        SELECT o_orderkey AS invoice_id,
               CAST(o_custkey % (SELECT count(*) FROM supplier) AS INT) AS store_id,
               CAST(o_custkey % (SELECT count(*) FROM supplier) AS INT) AS billed_by,
               c_name AS customer_name, CAST(NULL AS VARCHAR) AS customer_phone,
               CAST(CAST(o_totalprice AS DECIMAL(12,2)) + CAST(o_orderkey % 50 AS DECIMAL(12,2)) AS DECIMAL(12,2))
                   AS sub_total,
               CAST(NULL AS DECIMAL(12,2)) AS total_gst,
               CAST(o_totalprice AS DECIMAL(12,2)) AS grand_total, o_orderdate AS created_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "invoice_items": """
        SELECT l_orderkey AS invoice_id, CAST(l_partkey AS INT) AS product_id,
               CAST(l_quantity AS INT) AS quantity,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.02 AS DECIMAL(12,2)) AS unit_price,
               CAST(CAST(l_discount AS DECIMAL(5,2)) * 100 AS DECIMAL(5,2)) AS discount_percent,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))
                    AS DECIMAL(12,2)) AS total_price,
               CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 7 END AS DECIMAL(10,2)) AS length,
               CAST(NULL AS DECIMAL(10,2)) AS width, CAST(NULL AS VARCHAR) AS charged_dimension,
               CAST(NULL AS DECIMAL(10,4)) AS area,
               CAST(CASE WHEN l_linenumber = 7 THEN l_extendedprice END AS DECIMAL(12,2)) AS charged_rate,
               CAST(l_linenumber AS INT) AS line_no
        FROM lineitem""",
    "bill_requests": """
        SELECT l_orderkey * 10000 + l_suppkey AS bill_id, CAST(l_suppkey AS INT) AS store_id,
               o_orderdate AS created_at,
               CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey
                    ORDER BY l_partkey, l_quantity, l_extendedprice, l_discount, l_linenumber) AS INT) AS line_no,
               CAST(CASE WHEN l_orderkey % 29 = 0 AND l_linenumber = 2 THEN l_partkey + 1000000
                         WHEN l_orderkey % 31 = 0 AND l_linenumber = 1 THEN NULL ELSE l_partkey END AS INT) AS product_id,
               CAST(CASE WHEN l_orderkey % 37 = 0 AND l_linenumber = 1 THEN 0
                         ELSE CAST(l_quantity AS INT) % 10 + 1 END AS INT) AS quantity,
               CAST(CAST(l_discount AS DECIMAL(5,2)) * 100 AS DECIMAL(5,2)) AS discount_applied,
               CAST(CASE WHEN l_orderkey % 43 = 0 AND l_linenumber = 1 THEN -1
                         WHEN l_linenumber % 2 = 0 THEN l_linenumber * 7 END AS DECIMAL(10,2)) AS height,
               CAST(CASE WHEN l_linenumber = 5 THEN 33 END AS DECIMAL(10,2)) AS length,
               CAST(CASE WHEN l_orderkey % 41 = 0 AND l_linenumber = 1 THEN 0
                         WHEN l_linenumber % 3 = 0 THEN l_linenumber * 5 END AS DECIMAL(10,2)) AS width,
               CAST(CASE WHEN l_orderkey % 53 = 0 AND l_linenumber = 1 THEN 0
                         WHEN l_linenumber = 4 THEN 2.5 END AS DECIMAL(10,4)) AS area,
               CAST(CASE WHEN l_orderkey % 47 = 0 AND l_linenumber = 1 THEN -5
                         WHEN l_linenumber = 6 THEN l_orderkey % 500 END AS DECIMAL(12,2)) AS charged_rate,
               CAST(CASE WHEN l_linenumber = 5 THEN '3 x 4' END AS VARCHAR) AS charged_dimension,
               CAST(l_suppkey AS INT) AS billed_by, concat('Customer ', CAST(o_custkey AS VARCHAR)) AS customer_name,
               CAST(CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey + 5550000 AS VARCHAR) END AS VARCHAR) AS customer_phone
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL BY NAME
        SELECT o_orderkey * 10000 + 9999 AS bill_id, CAST(o_custkey % (SELECT count(*) FROM supplier) AS INT) AS store_id,
               o_orderdate AS created_at, CAST(o_custkey % (SELECT count(*) FROM supplier) AS INT) AS billed_by,
               concat('Customer ', CAST(o_custkey AS VARCHAR)) AS customer_name
        FROM orders WHERE o_orderkey % 59 = 0""",
}


def with_views(body: str, *names: str) -> str:
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in names)
    return f"WITH {ctes}\n{body}"


def _bracket(x: str) -> str:
    return (f"CAST(CASE WHEN {x} <= 12 THEN 12 WHEN {x} <= 18 THEN 18 WHEN {x} <= 24 THEN 24 "
            f"WHEN {x} <= 36 THEN 36 ELSE {x} END AS DECIMAL(10,2))")


def _area(l: str, w: str, du: str, u: str) -> str:
    """E2 in SQL: sides to feet, multiply, optional square metres, 4 decimals."""
    d = f"lower(coalesce({du}, ''))"
    o = f"lower(coalesce({u}, ''))"
    f = (f"(CASE WHEN {d} LIKE '%feet%' OR {d} = 'ft' THEN 1.0 "
         f"WHEN {d} LIKE '%inch%' OR {d} = 'in' THEN 12.0 ELSE 304.8 END)")
    sq = f"((CAST({l} AS DOUBLE) / {f}) * (CAST({w} AS DOUBLE) / {f}))"
    val = (f"(CASE WHEN {o} = 'sq.m' OR {o} = 'sqm' OR {o} LIKE '%meter%' "
           f"THEN {sq} * 0.092903 ELSE {sq} END)")
    return (f"CAST(CASE WHEN {l} IS NULL OR {w} IS NULL THEN 0.0 ELSE round({val}, 4) END "
            f"AS DECIMAL(14,4))")


def _status(a: str, m: str) -> str:
    return (f"CASE WHEN {a} <= 0 THEN 'out_of_stock' WHEN {a} <= {m} THEN 'low_stock' "
            f"ELSE 'in_stock' END")


def _eff(o: str, d: str) -> str:
    return f"CAST(coalesce({o}, {d}, 0) AS DECIMAL(5,2))"


SQL: dict[str, str] = {}

# Month and day of the fixture's as_of, as half-open ranges.
_IN_MONTH = "created_at >= TIMESTAMP '2001-07-01' AND created_at < TIMESTAMP '2001-08-01'"
_IN_DAY = "created_at >= TIMESTAMP '2001-07-26' AND created_at < TIMESTAMP '2001-07-27'"
_TAKINGS = f"""sales AS (
  SELECT store_id, sum(grand_total) AS ever, sum(grand_total) FILTER ({_IN_MONTH}) AS in_month,
         sum(grand_total) FILTER ({_IN_DAY}) AS in_day, count(*) AS bills
  FROM invoices GROUP BY store_id)"""


def _cents(x: str) -> str:
    return f"CAST(coalesce({x}, 0) AS DECIMAL(38,2))"


SQL["store_wise_revenue"] = with_views(f""", {_TAKINGS},
open_stores AS (SELECT store_id, store_name FROM stores WHERE status)
SELECT store_id, store_name, {_cents('ever')} AS total_revenue, {_cents('in_month')} AS current_month_revenue,
       {_cents('in_day')} AS today_revenue
FROM open_stores LEFT JOIN sales USING (store_id)""", "stores", "invoices")

SQL["master_summary"] = with_views(f""", {_TAKINGS},
takings AS (SELECT {_cents('sum(in_day)')} AS today_revenue, {_cents('sum(in_month)')} AS month_revenue,
                   CAST(coalesce(sum(bills), 0) AS BIGINT) AS total_bills FROM sales),
listed AS (SELECT CAST(count(*) AS BIGINT) AS total_products FROM products
           WHERE category_id IN (SELECT id FROM glass_categories WHERE status)),
branches AS (SELECT CAST(coalesce(sum(CAST(status AS INT)), 0) AS BIGINT) AS total_stores FROM stores)
SELECT today_revenue, month_revenue, total_bills, total_products, total_stores FROM takings, listed, branches""",
    "invoices", "products", "glass_categories", "stores")

# A stock row is short when nothing is left above its minimum; NULLs give no gap.
SQL["low_stock_alerts"] = with_views(""",
gaps AS (SELECT store_id, product_id, available_stock, minimum_stock, minimum_stock - available_stock AS gap FROM inventory),
named AS (SELECT id AS product_id, product_name, color, thickness FROM products)
SELECT store_id, product_name, color, thickness, available_stock, minimum_stock
FROM named JOIN (SELECT * FROM gaps WHERE gap >= 0) USING (product_id)""", "inventory", "products")

SQL["branch_performance"] = with_views(f""", {_TAKINGS},
names AS (SELECT store_id, store_name FROM stores)
SELECT store_id, store_name, {_cents('ever')} AS total_revenue FROM names JOIN sales USING (store_id)""", "stores", "invoices")

SQL["top_products"] = with_views(""",
units AS (SELECT product_id, sum(quantity) AS units FROM invoice_items SEMI JOIN products ON products.id = product_id GROUP BY product_id),
placed AS (SELECT *, row_number() OVER (ORDER BY units DESC, product_id) AS place FROM units)
SELECT product_id, (SELECT product_name FROM products WHERE id = product_id) AS product_name, CAST(units AS BIGINT) AS total_sold
FROM placed WHERE place <= 5""", "invoice_items", "products")

SQL["top_products_by_store"] = with_views("""
SELECT store_id, CAST(rank AS INT) AS rank, product_id, product_name, total_sold FROM (
  SELECT inv.store_id, p.id AS product_id, p.product_name, CAST(SUM(ii.quantity) AS BIGINT) AS total_sold,
         row_number() OVER (PARTITION BY inv.store_id ORDER BY SUM(ii.quantity) DESC, p.id) AS rank
  FROM invoice_items ii JOIN invoices inv ON ii.invoice_id = inv.invoice_id
  JOIN products p ON ii.product_id = p.id
  GROUP BY inv.store_id, p.id, p.product_name) r
WHERE rank <= 5""", "invoice_items", "invoices", "products")



def _months(of: str) -> str:
    """Takings by calendar month of the invoices ``of``, from six months before the fixture's day on."""
    return with_views(f""",
recent AS (SELECT year(created_at) AS y, month(created_at) AS m, grand_total FROM invoices
           WHERE {of} AND NOT created_at < {AS_OF_TS} - INTERVAL 6 MONTH)
SELECT strftime(make_date(y, m, 1), '%b %Y') AS month, {_cents('sum(grand_total)')} AS revenue FROM recent GROUP BY y, m""", "invoices")


SQL["monthly_revenue"] = _months("true")

SQL["store_summary"] = with_views(f""", {_TAKINGS},
shelf AS (
  SELECT store_id, count(product_id) AS kinds, sum(available_stock) AS units,
         sum(CAST(available_stock <= 0 AS INT)) AS empty
  FROM inventory GROUP BY store_id)
SELECT store_id, {_cents('in_day')} AS today_revenue, {_cents('in_month')} AS month_revenue,
       CAST(coalesce(bills, 0) AS BIGINT) AS total_bills, CAST(coalesce(kinds, 0) AS BIGINT) AS total_products,
       CAST(coalesce(units, 0) AS BIGINT) AS total_stock_units, CAST(coalesce(empty, 0) AS BIGINT) AS out_of_stock_count
FROM stores LEFT JOIN sales USING (store_id) LEFT JOIN shelf USING (store_id)""", "stores", "invoices", "inventory")

# A store's limit, a stock row and a product as listings show them: unknown numbers as 0, the limit worked out.
VIEWS["branch"] = """
        SELECT store_id, store_name, store_location, default_max_discount AS own_limit,
               CAST(ifnull(default_max_discount, 0) AS DECIMAL(5,2)) AS default_max_discount FROM stores"""
VIEWS["shelf"] = f"""
        SELECT id, store_id, product_id, available_stock, minimum_stock, updated_at, override_max_discount,
               CAST(ifnull(purchase_rate, 0) AS DECIMAL(12,2)) AS purchase_rate, CAST(ifnull(selling_rate, 0) AS DECIMAL(12,2)) AS selling_rate,
               {_status('available_stock', 'minimum_stock')} AS stock_status,
               CAST(ifnull(available_stock * selling_rate, 0) AS DECIMAL(23,2)) AS stock_value
        FROM inventory"""
VIEWS["sheet"] = """
        SELECT id AS product_id, product_name, product_image, category_id, color, thickness, dimension_unit, unit,
               CAST(ifnull(length, 0) AS DECIMAL(10,2)) AS length, CAST(ifnull(width, 0) AS DECIMAL(10,2)) AS width,
               CAST(ifnull(area, 0) AS DECIMAL(10,4)) AS area
        FROM products"""
_LIMITS = ("default_max_discount, override_max_discount, " + _eff("override_max_discount", "own_limit") + " AS effective_max_discount")
_SHELVES = ("inventory", "products", "stores", "glass_categories", "branch", "shelf", "sheet")

_LISTING = f"""
SELECT id, store_id, store_name, store_location, product_id, product_name, product_image, category_id, category_name, color, thickness,
       length, width, dimension_unit, area, unit, purchase_rate, selling_rate, available_stock, minimum_stock, stock_status,
       stock_value, updated_at, {_LIMITS}
FROM (SELECT id AS category_id, category_name FROM glass_categories) JOIN sheet USING (category_id)
     JOIN shelf USING (product_id) JOIN branch USING (store_id)"""

SQL["inventory_listing"] = with_views(_LISTING, *_SHELVES)

SQL["inventory_summary"] = with_views(f""",
held AS (
  SELECT store_id, product_id, available_stock AS units, available_stock * selling_rate AS worth,
         available_stock * purchase_rate AS cost, {_status('available_stock', 'minimum_stock')} AS standing,
         available_stock > minimum_stock AS plenty
  FROM inventory SEMI JOIN stores USING (store_id))
SELECT CAST(count(*) AS BIGINT) AS total_inventory_records,
       (SELECT count(*) FROM (SELECT DISTINCT product_id FROM held WHERE product_id IS NOT NULL)) AS total_unique_products,
       (SELECT count(*) FROM (SELECT DISTINCT store_id FROM held)) AS total_stores_with_stock,
       CAST(coalesce(sum(units), 0) AS BIGINT) AS total_stock_units,
       {_cents('sum(worth)')} AS total_stock_value, {_cents('sum(cost)')} AS total_purchase_value,
       CAST(coalesce(sum(CAST(plenty AS INT)), 0) AS BIGINT) AS in_stock_count,
       CAST(coalesce(sum(CAST(standing = 'low_stock' AS INT)), 0) AS BIGINT) AS low_stock_count,
       CAST(coalesce(sum(CAST(standing = 'out_of_stock' AS INT)), 0) AS BIGINT) AS out_of_stock_count
FROM held""", "inventory", "stores")

SQL["available_inventory"] = with_views(f"""
SELECT store_id, id, product_id, product_name, category_name, color, thickness, length, width, dimension_unit, area, unit,
       selling_rate, available_stock, {_LIMITS}
FROM (SELECT * FROM shelf WHERE available_stock > 0) JOIN sheet USING (product_id) JOIN branch USING (store_id)
     JOIN (SELECT id AS category_id, category_name FROM glass_categories) USING (category_id)""", *_SHELVES)

SQL["master_inventory"] = with_views(f"""
SELECT id, store_id, store_name, product_id, product_name, color, thickness, bare.length, bare.width, dimension_unit, bare.area, unit,
       available_stock, minimum_stock, purchase_rate, selling_rate, updated_at, {_LIMITS}
FROM shelf JOIN branch USING (store_id) JOIN (SELECT * EXCLUDE (length, width, area) FROM sheet) USING (product_id)
     JOIN (SELECT id AS product_id, length, width, area FROM products) bare USING (product_id)""", *_SHELVES)

_P_COLS = ("p.id, p.product_name, p.category_id, p.color, p.thickness, p.length, p.width, p.dimension_unit, "
           "p.area, p.unit, p.gst, p.product_image, p.created_at, p.updated_at, "
           + _bracket("p.length") + " AS billing_length, " + _bracket("p.width") + " AS billing_width")



def _nested(held: str, more: str) -> str:
    """Every product with its stock rows in a list, nested per product before the catalogue is met."""
    return with_views(f""",
stocked AS (SELECT product_id, list({{{held}}} ORDER BY store_id) AS rows FROM inventory GROUP BY product_id),
kinds AS (SELECT id AS category_id, category_name, description AS category_description FROM glass_categories)
SELECT {_P_COLS}, category_name{more}, coalesce(rows, []) AS store_inventory
FROM products p LEFT JOIN stocked ON product_id = p.id LEFT JOIN kinds USING (category_id)""",
        "products", "glass_categories", "inventory")


_HELD = ("store_id", "available_stock", "selling_rate")
_HELD_DETAIL = ("store_id", "purchase_rate", "selling_rate", "available_stock", "minimum_stock", "updated_at")
SQL["product_catalog"] = _nested(", ".join(f"'{c}': {c}" for c in _HELD), "")
SQL["product_detail"] = _nested(", ".join(f"'{c}': {c}" for c in _HELD_DETAIL), ", category_description")

SQL["store_products"] = with_views(f"""
SELECT i.store_id, {_P_COLS}, gc.category_name, gc.description AS category_description,
       i.purchase_rate, i.selling_rate, i.available_stock, i.minimum_stock, i.updated_at AS assigned_at
FROM inventory i JOIN products p ON i.product_id = p.id
LEFT JOIN glass_categories gc ON p.category_id = gc.id""", "inventory", "products", "glass_categories")

SQL["active_categories"] = with_views("""
SELECT * FROM glass_categories WHERE status = true""", "glass_categories")

SQL["store_list"] = with_views("""
SELECT store_id, store_email, store_name, store_location, status, created_at FROM stores""", "stores")

SQL["store_admin_list"] = with_views("""
SELECT id, store_id, full_name, username, email, role, status, created_at
FROM users WHERE UPPER(role) = 'STORE_ADMIN'""", "users")

SQL["store_admin_profiles"] = with_views(""",
shops AS (SELECT store_id, store_name, store_email, store_location, status AS store_status FROM stores),
admins AS (SELECT id AS user_id, full_name, username, email, role, status AS user_status, created_at AS user_created_at, store_id AS works_at
           FROM users WHERE status AND upper(role) = 'STORE_ADMIN')
SELECT admins.* EXCLUDE (works_at), shops.* FROM admins LEFT JOIN shops ON works_at = shops.store_id""", "users", "stores")

SQL["master_admin_profiles"] = with_views("""
SELECT id AS user_id, full_name, username, email, role, status AS user_status, created_at AS user_created_at
FROM users WHERE UPPER(role) IN ('MASTER_ADMIN', 'MASTERADMIN') AND status = true""", "users")

# One row per sold item of a known product, then one list per bill.
_SOLD = """sold AS (
  SELECT it.invoice_id, it.quantity, it.unit_price, it.discount_percent, it.total_price, it.charged_rate,
         it.length AS own_length, it.width AS own_width, it.area AS own_area,
         {'product_id': it.product_id, 'product_name': p.product_name,
          'category': ifnull(CAST(p.category_id AS VARCHAR), 'N/A'), 'thickness': p.thickness,
          'length': ifnull(it.length, p.length), 'width': ifnull(it.width, p.width),
          'charged_dimension': it.charged_dimension, 'color': p.color, 'area': ifnull(it.area, p.area), 'unit': p.unit,
          'quantity': it.quantity, 'unit_price': it.unit_price, 'discount_percent': it.discount_percent,
          'charged_rate': it.charged_rate, 'total_price': it.total_price} AS item
  FROM products p JOIN invoice_items it ON p.id = it.product_id),
bundles AS (
  SELECT invoice_id,
         array_agg(item ORDER BY item.product_id NULLS FIRST, quantity NULLS FIRST, unit_price NULLS FIRST,
                   discount_percent NULLS FIRST, total_price NULLS FIRST, charged_rate NULLS FIRST,
                   own_length NULLS FIRST, own_width NULLS FIRST, own_area NULLS FIRST,
                   item.charged_dimension NULLS FIRST) AS items
  FROM sold GROUP BY invoice_id)"""
_HISTORY = f""", {_SOLD}
SELECT invoice_id, store_id, customer_name, customer_phone, sub_total, grand_total, created_at, items
FROM bundles JOIN invoices USING (invoice_id)"""

SQL["invoice_history"] = with_views(_HISTORY, "invoices", "invoice_items", "products")

SQL["invoice_history_page"] = with_views(
    f"{_HISTORY} ORDER BY created_at DESC, invoice_id DESC LIMIT 10 OFFSET 10",
    "invoices", "invoice_items", "products")

SQL["inventory_listing_page"] = with_views(
    f"SELECT * FROM ({_LISTING}) l ORDER BY store_name, category_name, product_name, id LIMIT 10 OFFSET 20", *_SHELVES)

SQL["invoice_page_info"] = with_views("""
SELECT CAST(COUNT(*) AS BIGINT) AS total_records, 1 AS current_page,
       CAST(ceil(COUNT(*) / 10.0) AS BIGINT) AS total_pages
FROM invoices""", "invoices")

SQL["lookup_users_by_username"] = with_views("""
SELECT * FROM users WHERE username IN (SELECT store_name FROM stores WHERE status = true)""", "users", "stores")

# --- rules (E1-E10) ------------------------------------------------------------

SQL["product_billing_sizes"] = with_views(f"""
SELECT id, {_bracket('length')} AS billing_length, {_bracket('width')} AS billing_width,
       {_area(_bracket('length'), _bracket('width'), 'dimension_unit', 'unit')} AS billing_area,
       {_area('length', 'width', 'dimension_unit', 'unit')} AS sheet_area
FROM products""", "products")

SQL["inventory_stock_rules"] = with_views(f"""
SELECT i.id, {_status('i.available_stock', 'i.minimum_stock')} AS stock_status,
       CAST(i.available_stock * i.selling_rate AS DECIMAL(23,2)) AS stock_value,
       {_eff('i.override_max_discount', 's.default_max_discount')} AS effective_max_discount
FROM inventory i LEFT JOIN stores s ON i.store_id = s.store_id""", "inventory", "stores")

SQL["user_roles"] = with_views("""
SELECT id, UPPER(role) IN ('MASTER_ADMIN', 'MASTERADMIN') AS is_master, UPPER(role) = 'STORE_ADMIN' AS is_store_admin
FROM users""", "users")

SQL["category_keys"] = with_views("""
SELECT id, lower(trim(category_name)) AS category_key FROM glass_categories""", "glass_categories")

# --- bills (B1-B7, B9) -----------------------------------------------------------

VIEWS["bill_lines"] = """
        SELECT r.bill_id, r.store_id, r.created_at, r.billed_by, r.customer_name, r.customer_phone, r.line_no, r.product_id, r.quantity, r.height, r.length,
               r.width, r.area, r.charged_rate, r.charged_dimension,
               CASE WHEN r.line_no IS NULL THEN 'no_items'
                    WHEN r.product_id IS NULL OR r.quantity IS NULL OR r.quantity <= 0 THEN 'invalid_product_or_quantity'
                    WHEN r.width IS NOT NULL AND r.width <= 0 THEN 'invalid_width'
                    WHEN r.height IS NOT NULL AND r.height <= 0 THEN 'invalid_height'
                    WHEN r.charged_rate IS NOT NULL AND r.charged_rate < 0 THEN 'invalid_charged_rate'
                    WHEN r.area IS NOT NULL AND r.area <= 0 THEN 'invalid_area' END AS invalid_reason,
               (i.store_id IS NOT NULL AND p.id IS NOT NULL AND s.store_id IS NOT NULL) AS found,
               COALESCE(i.available_stock, 0) AS start_stock,
               CAST(COALESCE(i.override_max_discount, s.default_max_discount, 0) AS DECIMAL(5,2)) AS max_discount,
               CAST(COALESCE(r.discount_applied, 0) AS DECIMAL(5,2)) AS applied_discount,
               i.selling_rate, p.length AS p_length, p.width AS p_width, p.dimension_unit, p.unit
        FROM bill_requests r
        LEFT JOIN inventory i ON r.store_id = i.store_id AND r.product_id = i.product_id
        LEFT JOIN products p ON r.product_id = p.id
        LEFT JOIN stores s ON r.store_id = s.store_id"""
VIEWS["bill_checked"] = """
        SELECT *, CASE WHEN NOT found THEN 'not_found'
                       WHEN applied_discount > max_discount THEN 'discount_limit_exceeded' END AS static_reason,
               CAST(COALESCE(height, length, p_length) AS DECIMAL(10,2)) AS line_length,
               CAST(COALESCE(width, p_width) AS DECIMAL(10,2)) AS line_width
        FROM bill_lines"""
VIEWS["bill_sized"] = f"""
        SELECT *, CAST(COALESCE(CAST(area AS DECIMAL(14,4)),
                   {_area(_bracket('line_length'), _bracket('line_width'), 'dimension_unit', 'unit')})
                   AS DECIMAL(14,4)) AS line_area,
               {_bracket('line_length')} AS line_billing_length, {_bracket('line_width')} AS line_billing_width
        FROM bill_checked"""
VIEWS["bill_priced"] = """
        SELECT *,
               CASE WHEN charged_rate IS NOT NULL THEN charged_rate ELSE raw_base END AS base_total,
               CASE WHEN charged_rate IS NOT NULL THEN 0 ELSE raw_base * applied_discount * 0.01 END
                   AS discount_amount,
               CASE WHEN charged_rate IS NOT NULL THEN charged_rate
                    ELSE raw_base - raw_base * applied_discount * 0.01 END AS final_total
        FROM (SELECT *, CAST(CAST(selling_rate * line_area AS DECIMAL(20,6)) * CAST(quantity AS DECIMAL(10,0))
                             AS DECIMAL(24,6)) AS raw_base
              FROM bill_sized) b"""
VIEWS["clean_bills"] = """
        SELECT bill_id FROM bill_priced GROUP BY bill_id
        HAVING count(*) FILTER (WHERE invalid_reason IS NOT NULL OR static_reason IS NOT NULL) = 0"""

_BILL_VIEWS = ("bill_requests", "inventory", "products", "stores", "bill_lines", "bill_checked", "bill_sized",
               "bill_priced", "clean_bills")

SQL["bill_line_checks"] = with_views("""
SELECT bill_id, line_no, store_id, product_id, quantity, invalid_reason, found, start_stock, max_discount,
       applied_discount, static_reason
FROM bill_checked""", *_BILL_VIEWS[:6])

SQL["bill_line_prices"] = with_views("""
SELECT bill_id, line_no, line_length, line_width, line_billing_length, line_billing_width, line_area,
       CAST(base_total AS DECIMAL(38,6)) AS base_total, CAST(discount_amount AS DECIMAL(38,10)) AS discount_amount,
       CAST(final_total AS DECIMAL(38,10)) AS final_total, CAST(final_total AS DECIMAL(12,2)) AS total_price
FROM bill_priced""", *_BILL_VIEWS[:8])

_HEADERS = """
SELECT bill_id AS invoice_id, store_id, billed_by, customer_name, customer_phone, CAST(SUM(base_total) AS DECIMAL(12,2)) AS sub_total,
       CAST(NULL AS DECIMAL(12,2)) AS total_gst, CAST(SUM(final_total) AS DECIMAL(12,2)) AS grand_total, created_at
FROM bill_priced WHERE bill_id IN (SELECT bill_id FROM clean_bills)
GROUP BY bill_id, store_id, created_at, billed_by, customer_name, customer_phone"""
SQL["bill_quote_headers"] = with_views(_HEADERS, *_BILL_VIEWS)

SQL["bill_quote_items"] = with_views("""
SELECT bill_id AS invoice_id, product_id, quantity, selling_rate AS unit_price, applied_discount AS discount_percent,
       CAST(final_total AS DECIMAL(12,2)) AS total_price, line_length AS length, line_width AS width,
       charged_dimension, CAST(line_area AS DECIMAL(10,4)) AS area, charged_rate, line_no
FROM bill_priced WHERE bill_id IN (SELECT bill_id FROM clean_bills)""", *_BILL_VIEWS)

_STOCK_AFTER = """
SELECT i.id, i.store_id, i.product_id, i.purchase_rate, i.selling_rate,
       CASE WHEN q.sold IS NOT NULL THEN CAST(i.available_stock - q.sold AS INT) ELSE i.available_stock END
           AS available_stock,
       i.minimum_stock, i.override_max_discount, i.created_at,
       CASE WHEN q.sold IS NOT NULL THEN greatest(i.updated_at, q.sold_at) ELSE i.updated_at END AS updated_at
FROM inventory i LEFT JOIN (
    SELECT store_id, product_id, SUM(quantity) AS sold, MAX(created_at) AS sold_at FROM bill_priced
    WHERE bill_id IN (SELECT bill_id FROM clean_bills) GROUP BY store_id, product_id) q
  ON i.store_id = q.store_id AND i.product_id = q.product_id"""
SQL["stock_after_quotes"] = with_views(_STOCK_AFTER, *_BILL_VIEWS)

SQL["bill_receipts"] = with_views("""
SELECT i.invoice_id, i.customer_name, i.grand_total AS total_price, i.created_at,
       list(struct_pack(productId := ii.product_id, productName := p.product_name,
                        category := COALESCE(CAST(p.category_id AS VARCHAR), 'N/A'), thickness := p.thickness,
                        length := ii.length, width := ii.width, charged_dimension := ii.charged_dimension,
                        color := p.color, area := ii.area, unit := p.unit, quantity := ii.quantity,
                        charged_rate := ii.total_price)
            ORDER BY ii.line_no NULLS FIRST, ii.product_id NULLS FIRST, ii.quantity NULLS FIRST,
                     ii.total_price NULLS FIRST, ii.length NULLS FIRST, ii.width NULLS FIRST, ii.area NULLS FIRST,
                     ii.charged_dimension NULLS FIRST) AS items
FROM invoices i JOIN invoice_items ii ON i.invoice_id = ii.invoice_id JOIN products p ON ii.product_id = p.id
GROUP BY i.invoice_id, i.customer_name, i.grand_total, i.created_at""", "invoices", "invoice_items", "products")

# --- change feeds and change-set jobs (W) -----------------------------------------------------

_SEQ = "CAST(l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS BIGINT)"
_FEED_TIME = "TIMESTAMP '2001-08-01 09:00:00'"

VIEWS["inventory_changes"] = f"""
        SELECT {_SEQ} AS seq, CAST(l_suppkey AS INT) AS store_id,
               CAST((l_partkey + l_linenumber - 1) % (SELECT count(*) FROM part) AS INT) AS product_id,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.01 AS DECIMAL(12,2)) AS purchase_rate,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.02 AS DECIMAL(12,2)) AS selling_rate,
               CAST(l_quantity AS INT) - 20 AS available_stock, CAST(l_linenumber AS INT) AS minimum_stock,
               l_shipdate AS changed_at
        FROM lineitem"""
VIEWS["inventory_patches"] = f"""
        SELECT CAST(l_suppkey AS INT) AS store_id,
               CAST(l_partkey + CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END AS INT) AS product_id,
               {_SEQ} AS seq, l_shipdate AS patched_at,
               CAST(l_quantity AS INT) AS available_stock, l_linenumber % 2 = 0 AS set_available_stock,
               CAST(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS INT) AS minimum_stock,
               l_linenumber % 3 = 0 AS set_minimum_stock,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.01 AS DECIMAL(12,2)) AS purchase_rate,
               l_linenumber = 5 AS set_purchase_rate,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.02 AS DECIMAL(12,2)) AS selling_rate,
               l_linenumber = 5 OR l_linenumber = 2 AS set_selling_rate
        FROM lineitem"""
VIEWS["store_discount_changes"] = """
        SELECT CAST(store_id AS BIGINT) AS seq,
               CAST(CASE WHEN store_id % 17 = 16 THEN store_id + 100000 ELSE store_id END AS INT) AS store_id,
               CAST(CASE WHEN store_id % 11 = 0 THEN NULL ELSE (store_id % 13) * 10 - 10 END AS DECIMAL(5,2))
                   AS max_discount
        FROM stores"""
VIEWS["override_changes"] = """
        SELECT id AS seq, store_id,
               CAST(CASE WHEN id % 5 = 0 THEN product_id + 1000000 ELSE product_id END AS INT) AS product_id,
               CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN NULL WHEN id % 4 = 2 THEN 'abc'
                    ELSE CAST(id % 60 AS VARCHAR) END AS override_value,
               updated_at AS changed_at
        FROM inventory"""
VIEWS["inventory_delete_keys"] = """
        SELECT CAST(l_suppkey AS INT) AS store_id, CAST(l_partkey + l_linenumber % 2 AS INT) AS product_id
        FROM lineitem"""
VIEWS["product_delete_ids"] = "SELECT CAST(p_partkey * 2 AS INT) AS id FROM part"
VIEWS["category_delete_ids"] = """
        SELECT id FROM glass_categories UNION ALL SELECT CAST(id + 7 AS INT) FROM glass_categories"""
VIEWS["store_deactivate_ids"] = "SELECT CAST(store_id * 2 AS INT) AS store_id FROM stores"
VIEWS["category_inserts"] = f"""
        SELECT p_partkey AS seq,
               CASE WHEN p_partkey % 4 = 0 THEN concat(' ', p_brand, ' ') WHEN p_partkey % 4 = 1 THEN lower(p_type)
                    WHEN p_partkey % 4 = 2 THEN '  ' ELSE p_brand END AS category_name,
               CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS description,
               {_FEED_TIME} AS created_at
        FROM part"""
VIEWS["category_requests"] = f"""
        SELECT p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN {_CAT_ID} END AS category_id,
               CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) WHEN p_partkey % 4 = 1 THEN concat(' ', p_type, ' ')
                    WHEN p_partkey % 4 = 2 THEN concat(p_type, 'X') ELSE p_type END AS category_name
        FROM part"""
VIEWS["user_reassignments"] = f"""
        SELECT CAST(id AS BIGINT) AS seq, CASE WHEN id % 13 = 0 THEN id + 1000 ELSE id END AS user_id,
               CAST(id + 1 AS INT) AS store_id, {_FEED_TIME} AS changed_at
        FROM users"""
VIEWS["user_inserts"] = f"""
        SELECT c_custkey AS seq, c_name AS full_name,
               CASE WHEN c_custkey % 5 = 0 THEN replace(c_name, 'Customer', 'Supplier') ELSE c_name END AS username,
               concat('c', CAST(c_custkey % 500 AS VARCHAR), '@mail.test') AS email,
               CASE WHEN c_custkey % 3 = 0 THEN 'store_admin' WHEN c_custkey % 3 = 1 THEN 'MASTER_ADMIN'
                    ELSE 'clerk' END AS role,
               CAST(c_nationkey AS INT) AS store_id, {_FEED_TIME} AS created_at
        FROM customer"""

_INV_COLS = "id, store_id, product_id, purchase_rate, selling_rate, available_stock, minimum_stock, " \
            "override_max_discount, created_at, updated_at"

SQL["upsert_inventory"] = with_views(f"""
, c AS (
  SELECT f.store_id, f.product_id, f.add_stock, l.changed_at,
         CAST(COALESCE(l.purchase_rate, 0) AS DECIMAL(12,2)) AS c_purchase_rate,
         CAST(COALESCE(l.selling_rate, 0) AS DECIMAL(12,2)) AS c_selling_rate,
         CAST(COALESCE(l.minimum_stock, 0) AS INT) AS c_minimum_stock
  FROM (SELECT store_id, product_id, SUM(COALESCE(available_stock, 0)) AS add_stock
        FROM inventory_changes GROUP BY store_id, product_id) f
  JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY seq DESC, purchase_rate DESC NULLS LAST, selling_rate DESC NULLS LAST, minimum_stock DESC NULLS LAST, available_stock DESC NULLS LAST, changed_at DESC NULLS LAST) AS rn
                       FROM inventory_changes) WHERE rn = 1) l
    ON f.store_id = l.store_id AND f.product_id = l.product_id)
SELECT i.id, i.store_id, i.product_id,
       CASE WHEN c.store_id IS NOT NULL THEN c.c_purchase_rate ELSE i.purchase_rate END AS purchase_rate,
       CASE WHEN c.store_id IS NOT NULL THEN c.c_selling_rate ELSE i.selling_rate END AS selling_rate,
       CASE WHEN c.store_id IS NOT NULL THEN CAST(i.available_stock + c.add_stock AS INT) ELSE i.available_stock END
           AS available_stock,
       CASE WHEN c.store_id IS NOT NULL THEN c.c_minimum_stock ELSE i.minimum_stock END AS minimum_stock,
       i.override_max_discount, i.created_at,
       CASE WHEN c.store_id IS NOT NULL THEN c.changed_at ELSE i.updated_at END AS updated_at
FROM inventory i LEFT JOIN c ON i.store_id = c.store_id AND i.product_id = c.product_id
UNION ALL
SELECT (SELECT max(id) FROM inventory) + row_number() OVER (ORDER BY c.store_id, c.product_id) AS id,
       c.store_id, c.product_id, c.c_purchase_rate, c.c_selling_rate, CAST(c.add_stock AS INT), c.c_minimum_stock,
       CAST(NULL AS DECIMAL(5,2)), c.changed_at, c.changed_at
FROM c WHERE NOT EXISTS (SELECT 1 FROM inventory i WHERE i.store_id = c.store_id AND i.product_id = c.product_id)
""",
    "inventory", "inventory_changes")

_PATCH_FOLD = """
  -- last supplied value per field: highest seq, ties to the larger value (NULL lowest)
  SELECT store_id, product_id,
         max(CASE WHEN any_set AND seq = ms_any THEN patched_at END) AS patched_at,
         max(CASE WHEN set_available_stock AND seq = ms_avail THEN available_stock END) AS n_avail, bool_or(set_available_stock) AS a_avail,
         max(CASE WHEN set_minimum_stock AND seq = ms_min THEN minimum_stock END) AS n_min, bool_or(set_minimum_stock) AS a_min,
         max(CASE WHEN set_purchase_rate AND seq = ms_pr THEN purchase_rate END) AS n_pr, bool_or(set_purchase_rate) AS a_pr,
         max(CASE WHEN set_selling_rate AND seq = ms_sr THEN selling_rate END) AS n_sr, bool_or(set_selling_rate) AS a_sr
  FROM (SELECT *, max(CASE WHEN any_set THEN seq END) OVER (PARTITION BY store_id, product_id) AS ms_any, max(CASE WHEN set_available_stock THEN seq END) OVER (PARTITION BY store_id, product_id) AS ms_avail, max(CASE WHEN set_minimum_stock THEN seq END) OVER (PARTITION BY store_id, product_id) AS ms_min, max(CASE WHEN set_purchase_rate THEN seq END) OVER (PARTITION BY store_id, product_id) AS ms_pr, max(CASE WHEN set_selling_rate THEN seq END) OVER (PARTITION BY store_id, product_id) AS ms_sr
        FROM (SELECT *, set_available_stock OR set_minimum_stock OR set_purchase_rate OR set_selling_rate AS any_set FROM inventory_patches) p) w
  GROUP BY store_id, product_id"""

SQL["patch_inventory"] = with_views(f"""
SELECT i.id, i.store_id, i.product_id,
       CASE WHEN k.store_id IS NOT NULL AND k.a_pr THEN k.n_pr ELSE i.purchase_rate END AS purchase_rate,
       CASE WHEN k.store_id IS NOT NULL AND k.a_sr THEN k.n_sr ELSE i.selling_rate END AS selling_rate,
       CASE WHEN k.store_id IS NOT NULL AND k.a_avail THEN k.n_avail ELSE i.available_stock END AS available_stock,
       CASE WHEN k.store_id IS NOT NULL AND k.a_min THEN k.n_min ELSE i.minimum_stock END AS minimum_stock,
       i.override_max_discount, i.created_at,
       CASE WHEN k.store_id IS NOT NULL THEN k.patched_at ELSE i.updated_at END AS updated_at
FROM inventory i LEFT JOIN ({_PATCH_FOLD}) k
  ON i.store_id = k.store_id AND i.product_id = k.product_id AND (k.a_avail OR k.a_min OR k.a_pr OR k.a_sr)""",
    "inventory", "inventory_patches")

SQL["patch_inventory_rejects"] = with_views("""
SELECT store_id, product_id, seq,
       CASE WHEN set_available_stock OR set_minimum_stock OR set_purchase_rate OR set_selling_rate THEN 'not_found'
            ELSE 'no_fields' END AS reason
FROM inventory_patches p
WHERE NOT (set_available_stock OR set_minimum_stock OR set_purchase_rate OR set_selling_rate)
   OR NOT EXISTS (SELECT 1 FROM inventory i WHERE i.store_id = p.store_id AND i.product_id = p.product_id)""",
    "inventory", "inventory_patches")

SQL["set_store_discount"] = with_views("""
SELECT s.store_id, s.store_email, s.store_name, s.store_location, s.status, s.created_at,
       CASE WHEN l.store_id IS NOT NULL THEN CAST(l.new_discount AS DECIMAL(5,2)) ELSE s.default_max_discount END
           AS default_max_discount
FROM stores s LEFT JOIN (
    SELECT store_id, arg_max_null(max_discount, seq) AS new_discount FROM store_discount_changes
    WHERE max_discount IS NULL OR (max_discount >= 0 AND max_discount <= 100) GROUP BY store_id) l
  ON s.store_id = l.store_id""", "stores", "store_discount_changes")

SQL["set_store_discount_rejects"] = with_views("""
SELECT store_id, 'out_of_range' AS reason FROM store_discount_changes
WHERE max_discount IS NOT NULL AND (max_discount < 0 OR max_discount > 100)""", "stores", "store_discount_changes")

SQL["set_discount_override"] = with_views("""
SELECT i.id, i.store_id, i.product_id, i.purchase_rate, i.selling_rate, i.available_stock, i.minimum_stock,
       CASE WHEN l.store_id IS NOT NULL THEN l.new_v ELSE i.override_max_discount END AS override_max_discount,
       i.created_at, CASE WHEN l.store_id IS NOT NULL THEN l.at ELSE i.updated_at END AS updated_at
FROM inventory i LEFT JOIN (
    SELECT store_id, product_id, arg_max_null(v, seq) AS new_v, arg_max(changed_at, seq) AS at
    FROM (SELECT *, TRY_CAST(NULLIF(override_value, '') AS DECIMAL(5,2)) AS v FROM override_changes) p
    WHERE NULLIF(override_value, '') IS NULL OR v IS NOT NULL GROUP BY store_id, product_id) l
  ON i.store_id = l.store_id AND i.product_id = l.product_id""", "inventory", "override_changes")

SQL["delete_inventory"] = with_views("""
SELECT * FROM inventory i
WHERE NOT EXISTS (SELECT 1 FROM inventory_delete_keys k WHERE k.store_id = i.store_id AND k.product_id = i.product_id)""",
    "inventory", "inventory_delete_keys")

SQL["delete_inventory_rejects"] = with_views("""
SELECT DISTINCT store_id, product_id, 'not_found' AS reason FROM inventory_delete_keys k
WHERE NOT EXISTS (SELECT 1 FROM inventory i WHERE k.store_id = i.store_id AND k.product_id = i.product_id)""",
    "inventory", "inventory_delete_keys")

SQL["delete_products"] = with_views("""
SELECT * FROM products p
WHERE NOT EXISTS (SELECT 1 FROM product_delete_ids d WHERE d.id = p.id
                  AND NOT EXISTS (SELECT 1 FROM invoice_items ii WHERE ii.product_id = d.id))""",
    "products", "invoice_items", "product_delete_ids")

SQL["delete_products_rejects"] = with_views("""
SELECT DISTINCT id, 'not_found' AS reason FROM product_delete_ids d WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.id = d.id)
UNION ALL
SELECT DISTINCT id, 'product_invoiced' FROM product_delete_ids d
WHERE EXISTS (SELECT 1 FROM products p WHERE p.id = d.id)
  AND EXISTS (SELECT 1 FROM invoice_items ii WHERE ii.product_id = d.id)""",
    "products", "invoice_items", "product_delete_ids")

SQL["delete_categories"] = with_views("""
SELECT * FROM glass_categories c
WHERE NOT EXISTS (SELECT 1 FROM category_delete_ids d WHERE d.id = c.id
                  AND NOT EXISTS (SELECT 1 FROM products p WHERE p.category_id = d.id))""",
    "glass_categories", "products", "category_delete_ids")

SQL["delete_categories_rejects"] = with_views("""
SELECT DISTINCT id, 'not_found' AS reason FROM category_delete_ids d
WHERE NOT EXISTS (SELECT 1 FROM glass_categories c WHERE c.id = d.id)
UNION ALL
SELECT DISTINCT id, 'category_in_use' FROM category_delete_ids d
WHERE EXISTS (SELECT 1 FROM glass_categories c WHERE c.id = d.id)
  AND EXISTS (SELECT 1 FROM products p WHERE p.category_id = d.id)""",
    "glass_categories", "products", "category_delete_ids")

SQL["deactivate_stores"] = with_views("""
SELECT store_id, store_email, store_name, store_location,
       CASE WHEN store_id IN (SELECT store_id FROM store_deactivate_ids) THEN false ELSE status END AS status,
       created_at, default_max_discount
FROM stores""", "stores", "store_deactivate_ids")

SQL["insert_categories"] = with_views("""
SELECT * FROM glass_categories
UNION ALL
SELECT CAST((SELECT max(id) FROM glass_categories) + row_number() OVER (ORDER BY seq) AS INT) AS id,
       _name AS category_name,
       CASE WHEN description IS NULL OR description = '' THEN NULL ELSE trim(description) END AS description,
       true AS status, created_at, created_at AS updated_at
FROM (SELECT *, min(seq) OVER (PARTITION BY lower(trim(_name))) AS first_seq
      FROM (SELECT *, trim(category_name) AS _name FROM category_inserts
            WHERE category_name IS NOT NULL AND trim(category_name) <> '') n
      WHERE lower(trim(_name)) NOT IN (SELECT lower(trim(category_name)) FROM glass_categories)) f
WHERE seq = first_seq""", "glass_categories", "category_inserts")

SQL["resolve_category"] = with_views("""
SELECT f.seq, COALESCE(f.category_id, b.cid) AS resolved_category_id
FROM category_requests f
LEFT JOIN (SELECT lower(category_name) AS ck, min(id) AS cid FROM glass_categories GROUP BY lower(category_name)) b
  ON f.category_id IS NULL AND lower(trim(f.category_name)) = b.ck
WHERE COALESCE(f.category_id, b.cid) IS NOT NULL""", "glass_categories", "category_requests")

# insert_users (W14) has no SQL oracle: a request's acceptance depends on
# which earlier requests were accepted (an ordered fixpoint); it is checked
# against a one-at-a-time Python model in tests/test_changes.py.

SQL["reassign_admins"] = with_views("""
SELECT u.id, CASE WHEN a.user_id IS NOT NULL THEN CAST(a.sid AS INT) ELSE u.store_id END AS store_id,
       u.full_name, u.username, u.email, u.role, u.status, u.created_at,
       CASE WHEN a.user_id IS NOT NULL THEN a.at ELSE u.updated_at END AS updated_at
FROM users u LEFT JOIN (
    SELECT l.* FROM (SELECT user_id, arg_max_null(store_id, seq) AS sid, arg_max(changed_at, seq) AS at
                     FROM user_reassignments GROUP BY user_id) l
    WHERE l.user_id IN (SELECT id FROM users WHERE upper(role) = 'STORE_ADMIN')) a
  ON u.id = a.user_id""", "users", "user_reassignments")


_SRC: dict[str, str] = {}   # table name -> relation to read it from (default: the view itself)


def _src(table: str) -> str:
    return _SRC.get(table, table)


def _dupes_sql(table: str, cols: list[str]) -> str:
    key = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"
    nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return (f"SELECT '{table}' AS table_name, 'unique:{','.join(cols)}' AS rule, {key} AS key_value, "
            f"CAST(count(*) AS BIGINT) AS n FROM {_src(table)} WHERE {nn} GROUP BY {key} HAVING count(*) > 1")


def _nulls_sql(table: str, key: str, col: str) -> str:
    return (f"SELECT '{table}', 'not_null:{col}', CAST({key} AS VARCHAR), CAST(1 AS BIGINT) FROM {_src(table)} "
            f"WHERE {col} IS NULL")


def _orphans_sql(table: str, fk: str, parent: str, pk: str) -> str:
    return (f"SELECT '{table}', 'foreign_key:{fk}', CAST({fk} AS VARCHAR), CAST(count(*) AS BIGINT) "
            f"FROM {_src(table)} c WHERE {fk} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM {_src(parent)} p WHERE p.{pk} = c.{fk}) GROUP BY {fk}")


def _violations_body() -> str:
    return "\nUNION ALL\n".join([
    _dupes_sql("stores", ["store_id"]), _dupes_sql("stores", ["store_email"]),
    *[_nulls_sql("stores", "store_id", c) for c in ("store_email", "store_name", "store_location")],
    _dupes_sql("users", ["id"]), _dupes_sql("users", ["username"]), _dupes_sql("users", ["email"]),
    *[_nulls_sql("users", "id", c) for c in ("full_name", "username", "role")],
    f"SELECT 'users', 'check:role', CAST(id AS VARCHAR), CAST(1 AS BIGINT) FROM {_src('users')} "
    "WHERE role NOT IN ('MASTER_ADMIN', 'STORE_ADMIN')",
    _dupes_sql("glass_categories", ["id"]), _dupes_sql("glass_categories", ["category_name"]),
    _nulls_sql("glass_categories", "id", "category_name"),
    _dupes_sql("products", ["id"]),
    *[_nulls_sql("products", "id", c) for c in ("product_name", "category_id", "color", "thickness", "length", "width",
                                                "area")],
    _orphans_sql("products", "category_id", "glass_categories", "id"),
    _dupes_sql("inventory", ["id"]), _dupes_sql("inventory", ["store_id", "product_id"]),
    *[_nulls_sql("inventory", "id", c) for c in ("product_id", "purchase_rate", "selling_rate")],
    _orphans_sql("inventory", "product_id", "products", "id"), _orphans_sql("inventory", "store_id", "stores", "store_id"),
    _dupes_sql("invoices", ["invoice_id"]),
    *[_nulls_sql("invoices", "invoice_id", c) for c in ("store_id", "billed_by", "sub_total", "grand_total")],
    _orphans_sql("invoices", "store_id", "stores", "store_id"), _orphans_sql("invoices", "billed_by", "users", "id"),
    *[_nulls_sql("invoice_items", "invoice_id", c) for c in ("invoice_id", "product_id", "quantity", "unit_price",
                                                             "total_price")],
    _orphans_sql("invoice_items", "invoice_id", "invoices", "invoice_id"),
    _orphans_sql("invoice_items", "product_id", "products", "id"),
    ])


SQL["constraint_violations"] = with_views(_violations_body(), "stores", "users", "glass_categories", "products",
                                          "inventory", "invoices", "invoice_items")

# The same report over tables with the raw change feeds appended unchecked,
# so duplicates, bad roles and dangling keys really occur.
VIEWS["users_raw"] = """
        SELECT * FROM users
        UNION ALL
        SELECT CAST(seq AS INT) AS id, store_id, full_name, username, email, role, true AS status,
               created_at, created_at AS updated_at
        FROM user_inserts"""
VIEWS["inventory_raw"] = """
        SELECT * FROM inventory
        UNION ALL
        SELECT seq AS id, store_id, product_id, purchase_rate, selling_rate, available_stock, minimum_stock,
               CAST(NULL AS DECIMAL(5,2)) AS override_max_discount, changed_at AS created_at, changed_at AS updated_at
        FROM inventory_changes"""
_SRC.update({"users": "users_raw", "inventory": "inventory_raw"})
SQL["constraint_violations_raw_feeds"] = with_views(
    _violations_body(), "stores", "users", "glass_categories", "products", "inventory", "invoices", "invoice_items",
    "user_inserts", "inventory_changes", "users_raw", "inventory_raw")
_SRC.clear()

# --- streaming (T2; T1 is rows-only) ------------------------------------------------------------

SQL["stream_daily_revenue"] = """
SELECT CAST(user_id % (SELECT count(*) FROM supplier) AS INT) AS store_id, CAST(ts AS DATE) AS day,
       CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS revenue, CAST(count(*) AS BIGINT) AS sales
FROM events WHERE event_type = 'purchase'
GROUP BY 1, 2"""

VIEWS["category_patches"] = f"""
        SELECT {_CAT_ID} AS id, p_partkey AS seq, {_FEED_TIME} AS patched_at,
               CASE WHEN p_partkey % 5 = 0 THEN concat(' ', upper(p_type[1]) || lower(p_type[2:]), ' ')
                    WHEN p_partkey % 5 = 1 THEN 'promo' ELSE concat(p_type, ' glass') END AS category_name,
               p_partkey % 5 <= 2 AS set_category_name,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS description,
               p_partkey % 3 = 0 AS set_description,
               p_size > 25 AS status, p_partkey % 7 = 0 AS set_status
        FROM part"""

# Requests are judged one by one in seq order: ``names`` maps every category to the name it holds by then.
_CAT_JUDGED = """
numbered AS (
  SELECT *, lower(trim(category_name)) AS want, row_number() OVER (ORDER BY seq) AS nth
  FROM category_patches WHERE set_category_name AND id IN (SELECT id FROM glass_categories)),
judged AS (
  SELECT CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS seq, true AS ok,
         map(list(id ORDER BY id), list(lower(category_name) ORDER BY id)) AS names
  FROM glass_categories
  UNION ALL
  SELECT n.nth, n.seq,
         len(list_filter(map_entries(j.names), lambda e: e.key <> n.id AND e.value = n.want)) = 0,
         CASE WHEN len(list_filter(map_entries(j.names), lambda e: e.key <> n.id AND e.value = n.want)) = 0
              THEN map_concat(j.names, MAP {n.id: n.want}) ELSE j.names END
  FROM judged j JOIN numbered n ON n.nth = j.nth + 1),
refused AS (SELECT seq FROM judged WHERE NOT ok),
accepted AS (
  SELECT * FROM category_patches
  WHERE (set_category_name OR set_description OR set_status) AND id IN (SELECT id FROM glass_categories)
    AND seq NOT IN (SELECT seq FROM refused))"""


def _last_set(value: str, flag: str) -> str:
    return f"arg_max_null({value}, seq) FILTER ({flag})"


SQL["patch_categories"] = with_views(f""", {_CAT_JUDGED}
SELECT g.id, CASE WHEN k.a_name THEN k.n_name ELSE g.category_name END AS category_name,
       CASE WHEN k.a_desc THEN k.n_desc ELSE g.description END AS description,
       CASE WHEN k.a_status THEN k.n_status ELSE g.status END AS status, g.created_at,
       CASE WHEN k.id IS NOT NULL THEN k.at ELSE g.updated_at END AS updated_at
FROM glass_categories g LEFT JOIN (
    SELECT id, arg_max(patched_at, seq) AS at, bool_or(set_category_name) AS a_name, bool_or(set_description) AS a_desc,
           bool_or(set_status) AS a_status, {_last_set('trim(category_name)', 'set_category_name')} AS n_name,
           {_last_set('description', 'set_description')} AS n_desc, {_last_set('status', 'set_status')} AS n_status
    FROM accepted GROUP BY id) k ON g.id = k.id""",
    "glass_categories", "category_patches").replace("WITH ", "WITH RECURSIVE ", 1)

SQL["patch_categories_rejects"] = with_views(f""", {_CAT_JUDGED}
SELECT id, seq, CASE WHEN NOT (set_category_name OR set_description OR set_status) THEN 'no_fields'
                     WHEN id NOT IN (SELECT id FROM glass_categories) THEN 'not_found'
                     ELSE 'duplicate_category_name' END AS reason
FROM category_patches WHERE seq NOT IN (SELECT seq FROM accepted)""",
    "glass_categories", "category_patches").replace("WITH ", "WITH RECURSIVE ", 1)

# --- store forms, ids, and what change-set jobs refuse ---------------------------------------------

_ONE, _NONE = 3, 987654


def _of_store(name: str, columns: str = "* EXCLUDE (store_id)") -> str:
    return f"SELECT {columns} FROM ({SQL[name]}) every_store WHERE store_id = {_ONE}"


SQL["low_stock_alerts_store"] = _of_store("low_stock_alerts")
SQL["top_products_store"] = _of_store("top_products_by_store", "product_id, product_name, total_sold")
SQL["monthly_revenue_store"] = _months(f"store_id = {_ONE}")
SQL["store_summary_store"] = _of_store("store_summary", "*")
SQL["store_summary_unknown_store"] = f"""
SELECT CAST({_NONE} AS INT) AS store_id, {_cents('0')} AS today_revenue, {_cents('0')} AS month_revenue,
       CAST(0 AS BIGINT) AS total_bills, CAST(0 AS BIGINT) AS total_products, CAST(0 AS BIGINT) AS total_stock_units,
       CAST(0 AS BIGINT) AS out_of_stock_count"""
SQL["available_inventory_store"] = _of_store("available_inventory")
SQL["store_products_store"] = _of_store("store_products")
SQL["invoice_history_store"] = _of_store("invoice_history")
SQL["product_detail_ids"] = with_views(f"""
SELECT * FROM ({SQL["product_detail"]}) d
WHERE id IN (SELECT product_id FROM inventory WHERE available_stock <= 0)""", "inventory")
SQL["lookup_categories_by_name"] = with_views("""
SELECT * FROM glass_categories
WHERE lower(category_name) IN (SELECT lower(trim(category_name)) FROM category_requests)""",
    "glass_categories", "category_requests")
SQL["lookup_products_by_id"] = with_views(
    "SELECT * FROM products WHERE id IN (SELECT id FROM product_delete_ids)", "products", "product_delete_ids")

SQL["upsert_inventory_rejects"] = with_views("""
SELECT DISTINCT seq, 'not_found' AS reason FROM inventory_changes
WHERE store_id NOT IN (SELECT store_id FROM stores WHERE status) OR product_id NOT IN (SELECT id FROM products)""",
    "stores", "products", "inventory_changes")
SQL["set_discount_override_rejects"] = with_views("""
SELECT store_id, product_id, 'not_a_number' AS reason FROM override_changes
WHERE override_value <> '' AND TRY_CAST(override_value AS DECIMAL(5,2)) IS NULL""", "inventory", "override_changes")
SQL["deactivate_stores_rejects"] = with_views("""
SELECT DISTINCT store_id, 'not_found' AS reason FROM store_deactivate_ids
WHERE store_id NOT IN (SELECT store_id FROM stores)""", "stores", "store_deactivate_ids")
SQL["insert_categories_rejects"] = with_views("""
SELECT seq, CASE WHEN name = '' THEN 'blank_name' ELSE 'duplicate_name' END AS reason
FROM (SELECT seq, trim(coalesce(category_name, '')) AS name,
             row_number() OVER (PARTITION BY lower(trim(category_name)) ORDER BY seq) AS nth FROM category_inserts) n
WHERE name = '' OR nth > 1 OR lower(name) IN (SELECT lower(trim(category_name)) FROM glass_categories)""",
    "glass_categories", "category_inserts")
SQL["resolve_category_rejects"] = with_views("""
SELECT seq, 'category_not_found' AS reason FROM category_requests
WHERE category_id IS NULL AND lower(trim(category_name)) NOT IN (SELECT lower(category_name) FROM glass_categories)""",
    "glass_categories", "category_requests")
SQL["reassign_admins_rejects"] = with_views("""
SELECT DISTINCT user_id, CASE WHEN user_id IN (SELECT id FROM users) THEN 'not_store_admin' ELSE 'not_found' END AS reason
FROM user_reassignments WHERE user_id NOT IN (SELECT id FROM users WHERE upper(role) = 'STORE_ADMIN')""",
    "users", "user_reassignments")

VIEWS["product_inserts"] = f"""
        SELECT p_partkey AS seq, concat(p_name, ' II') AS product_name,
               CASE WHEN p_size % 10 <> 0 THEN split_part(p_name, ' ', 2) END AS color,
               concat(CAST(p_size % 8 AS VARCHAR), 'mm') AS thickness,
               CASE WHEN p_partkey % 7 = 0 THEN 'Unknown' ELSE p_type END AS category_name,
               CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % (SELECT count(*) FROM supplier) AS INT) END AS store_id
        FROM part"""
VIEWS["product_judged"] = """
        SELECT f.*, c.cid,
               CASE WHEN coalesce(product_name, '') = '' OR coalesce(color, '') = '' OR coalesce(thickness, '') = ''
                         THEN 'missing_fields'
                    WHEN c.cid IS NULL THEN 'category_not_found' END AS refused
        FROM product_inserts f
        LEFT JOIN (SELECT lower(category_name) AS ck, min(id) AS cid FROM glass_categories GROUP BY 1) c
          ON lower(trim(f.category_name)) = c.ck"""
VIEWS["product_made"] = """
        SELECT CAST((SELECT max(id) FROM products) + row_number() OVER (ORDER BY seq) AS INT) AS id, *
        FROM product_judged WHERE refused IS NULL"""
_MAKING = ("glass_categories", "products", "product_inserts", "product_judged", "product_made")

SQL["insert_products"] = with_views(f"""
SELECT id, product_name, cid AS category_id, color, thickness, CAST(0 AS DECIMAL(10,2)) AS length,
       CAST(0 AS DECIMAL(10,2)) AS width, 'mm' AS dimension_unit, CAST(0 AS DECIMAL(10,4)) AS area, 'Sq.ft' AS unit,
       CAST(NULL AS DECIMAL(5,2)) AS gst, CAST(NULL AS VARCHAR) AS product_image, {_FEED_TIME} AS created_at,
       {_FEED_TIME} AS updated_at
FROM product_made""", *_MAKING)
SQL["insert_products_rejects"] = with_views(
    "SELECT seq, refused AS reason FROM product_judged WHERE refused IS NOT NULL", *_MAKING[:-1])
VIEWS["all_products"] = """
        SELECT id, product_name, category_id, color, thickness, unit FROM products
        UNION ALL SELECT id, product_name, cid, color, thickness, 'Sq.ft' FROM product_made"""
VIEWS["gone_products"] = """
        SELECT DISTINCT id FROM product_delete_ids
        WHERE id IN (SELECT id FROM all_products) AND id NOT IN (SELECT product_id FROM invoice_items)"""
_REMOVING = (*_MAKING, "invoice_items", "product_delete_ids", "all_products", "gone_products")
SQL["delete_new_products"] = with_views(
    "SELECT * FROM all_products WHERE id NOT IN (SELECT id FROM gone_products)", *_REMOVING)
SQL["delete_new_products_inventory"] = with_views("""
SELECT store_id, count(*) AS stock_rows, CAST(sum(product_id) AS BIGINT) AS id_sum
FROM (SELECT store_id, product_id FROM inventory
      UNION ALL SELECT store_id, id FROM product_made WHERE store_id IN (SELECT store_id FROM stores)) held
WHERE product_id NOT IN (SELECT id FROM gone_products) GROUP BY store_id""", "stores", "inventory", *_REMOVING)
SQL["delete_new_categories"] = with_views(f"""
, made AS ({SQL["insert_categories"]})
SELECT id, category_name FROM made
WHERE id NOT IN (SELECT id FROM category_delete_ids)
   OR id IN (SELECT category_id FROM products WHERE category_id IS NOT NULL)""", "glass_categories", "category_delete_ids",
    "products")


# --- bills in order: one recursive step decides the next bill of every store -------------------------
# Only keys that all requests together can exhaust are remembered (``sold``): no other key ever runs short.
VIEWS["scarce"] = """
        SELECT store_id, product_id FROM bill_priced WHERE found
        GROUP BY store_id, product_id HAVING sum(CASE WHEN quantity > 0 THEN quantity END) > max(start_stock)"""
VIEWS["whole_bills"] = """
        SELECT b.store_id, b.created_at, b.bill_id, row_number() OVER (PARTITION BY b.store_id ORDER BY b.created_at, b.bill_id) AS nth,
               arg_min(invalid_reason, coalesce(line_no, 0)) FILTER (invalid_reason IS NOT NULL) AS invalid_reason,
               min(coalesce(line_no, 0)) FILTER (invalid_reason IS NOT NULL) AS invalid_line,
               list(struct_pack(line := line_no, product := b.product_id, quantity := quantity, found := found,
                                stock := start_stock, scarce := s.product_id IS NOT NULL,
                                limited := static_reason = 'discount_limit_exceeded') ORDER BY line_no) AS lines
        FROM bill_priced b LEFT JOIN scarce s ON s.store_id = b.store_id AND s.product_id = b.product_id
        GROUP BY b.store_id, b.created_at, b.bill_id"""
_STOCK_LEFT = "l.stock - coalesce(p.sold[l.product], 0)"
VIEWS["posted"] = f"""
        SELECT store_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS bill_id, MAP {{}}::MAP(INTEGER, BIGINT) AS sold,
               CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS INTEGER) AS failed_line
        FROM (SELECT DISTINCT store_id FROM whole_bills)
        UNION ALL
        SELECT store_id, nth, bill_id,
               CASE WHEN reason IS NOT NULL OR len(taken) = 0 THEN sold ELSE map_concat(sold, map_from_entries(
                   list_transform(list_distinct(list_transform(taken, lambda l: l.product)), lambda k: struct_pack(k := k,
                       v := coalesce(sold[k], 0) + CAST(list_sum(list_transform(list_filter(taken, lambda l: l.product = k), lambda l: l.quantity)) AS BIGINT))))) END,
               reason, failed_line
        FROM (
            SELECT store_id, nth, bill_id, sold, list_filter(lines, lambda l: l.scarce) AS taken,
                   CASE WHEN invalid_reason IS NOT NULL THEN invalid_reason WHEN bad IS NULL THEN NULL
                        WHEN NOT bad.found THEN 'not_found' WHEN bad.short THEN 'insufficient_stock'
                        ELSE 'discount_limit_exceeded' END AS reason,
                   CASE WHEN invalid_reason IS NOT NULL THEN nullif(invalid_line, 0) ELSE bad.line END AS failed_line
            FROM (
                SELECT b.*, p.sold, list_filter(list_transform(b.lines, lambda l: struct_pack(line := l.line, found := l.found,
                           short := {_STOCK_LEFT} < l.quantity, limited := coalesce(l.limited, false))),
                           lambda x: NOT x.found OR x.short OR x.limited)[1] AS bad
                FROM posted p JOIN whole_bills b ON b.store_id = p.store_id AND b.nth = p.nth + 1) tested) decided"""
VIEWS["post_decisions"] = """
        SELECT b.bill_id, b.store_id, b.created_at, CASE WHEN p.reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
               p.reason, CAST(p.failed_line AS INTEGER) AS failed_line
        FROM posted p JOIN whole_bills b ON b.bill_id = p.bill_id"""
_POSTING = ("bill_requests", "inventory", "products", "stores", "bill_lines", "bill_checked", "bill_sized", "bill_priced",
            "scarce", "whole_bills", "posted", "post_decisions")


def _recursive(body: str, *names: str) -> str:
    return with_views(body, *names).replace("WITH ", "WITH RECURSIVE ", 1)


SQL["post_bills_decisions"] = _recursive("SELECT * FROM post_decisions", *_POSTING)
_CLEAN, _ACCEPTED = "(SELECT bill_id FROM clean_bills)", "(SELECT bill_id FROM post_decisions WHERE status = 'accepted')"
SQL["post_bills_invoices"] = _recursive(_HEADERS.replace(_CLEAN, _ACCEPTED), *_POSTING)
SQL["post_bills_stock"] = _recursive(_STOCK_AFTER.replace(_CLEAN, _ACCEPTED), *_POSTING)
# The stream replays the requests in four ranges of time, one batch each.
_BATCH = " + ".join(f"CAST(created_at >= TIMESTAMP '{day}' AS INTEGER)" for day in ("1997-01-01", "1999-01-01", "2001-01-01"))
SQL["stream_post_bills"] = _recursive(
    f"SELECT *, CAST({_BATCH} AS BIGINT) AS batch_id, {_BATCH} AS batch FROM post_decisions", *_POSTING)
SQL["stream_post_bills_keyed"] = _recursive(f"SELECT *, {_BATCH} AS batch_id FROM post_decisions", *_POSTING)
SQL["stream_stock_keyed"] = f"SELECT store_id, product_id, available_stock FROM ({SQL['post_bills_stock']}) stock"

# --- registrations in order -----------------------------------------------------------------------------
VIEWS["user_inserts"] = f"""
        SELECT c_custkey AS seq, c_name AS full_name,
               CASE WHEN c_custkey % 5 = 0 THEN replace(c_name, 'Customer', 'Supplier') ELSE c_name END AS username,
               concat('c', CAST(c_custkey % 500 AS VARCHAR), '@mail.test') AS email,
               CASE c_custkey % 3 WHEN 0 THEN 'store_admin' WHEN 1 THEN 'MASTER_ADMIN' ELSE 'clerk' END AS role,
               CAST(c_nationkey AS INT) AS store_id, {_FEED_TIME} AS created_at
        FROM customer"""
VIEWS["user_numbered"] = """
        SELECT *, row_number() OVER (ORDER BY seq) AS nth, email IN (SELECT email FROM users) AS held_email,
               username IN (SELECT username FROM users) AS held_username
        FROM user_inserts WHERE upper(role) IN ('MASTER_ADMIN', 'STORE_ADMIN')"""
VIEWS["user_judged"] = """
        SELECT CAST(0 AS BIGINT) AS nth, CAST(NULL AS VARCHAR) AS reason, CAST([] AS VARCHAR[]) AS emails, CAST([] AS VARCHAR[]) AS names
        UNION ALL
        SELECT nth, reason, CASE WHEN reason IS NULL THEN list_append(emails, email) ELSE emails END,
               CASE WHEN reason IS NULL THEN list_append(names, username) ELSE names END
        FROM (SELECT n.nth, n.email, n.username, j.emails, j.names,
                     CASE WHEN n.held_email OR list_contains(j.emails, n.email) THEN 'duplicate_email'
                          WHEN n.held_username OR list_contains(j.names, n.username) THEN 'duplicate_username' END AS reason
              FROM user_judged j JOIN user_numbered n ON n.nth = j.nth + 1) step"""
_REGISTERING = ("users", "user_inserts", "user_numbered", "user_judged")
SQL["insert_users"] = _recursive("""
SELECT CAST((SELECT max(id) FROM users) + row_number() OVER (ORDER BY seq) AS INT) AS id, store_id, full_name, username, email,
       upper(role) AS role, true AS status, created_at, created_at AS updated_at
FROM user_numbered n JOIN user_judged j ON j.nth = n.nth AND j.reason IS NULL""", *_REGISTERING)
SQL["insert_users_rejects"] = _recursive("""
SELECT seq, 'invalid_role' AS reason FROM user_inserts WHERE upper(role) NOT IN ('MASTER_ADMIN', 'STORE_ADMIN')
UNION ALL SELECT n.seq, j.reason FROM user_numbered n JOIN user_judged j ON j.nth = n.nth WHERE j.reason IS NOT NULL""", *_REGISTERING)

VIEWS["store_signups"] = f"""
        SELECT c_custkey AS seq, concat(CASE WHEN c_custkey % 4 = 0 THEN replace(c_name, 'Customer', 'Supplier') ELSE c_name END,
                                        '@example.test') AS store_email,
               concat('Shop ', c_name) AS store_name, c_mktsegment AS store_location, c_name AS full_name,
               concat('owner-', CAST(c_custkey % 700 AS VARCHAR)) AS username,
               concat('owner', CAST(c_custkey AS VARCHAR), '@mail.test') AS email, {_FEED_TIME} AS created_at,
               row_number() OVER (ORDER BY c_custkey) AS nth
        FROM customer"""
VIEWS["signup_judged"] = """
        SELECT CAST(0 AS BIGINT) AS nth, CAST(NULL AS VARCHAR) AS reason, CAST([] AS VARCHAR[]) AS taken
        UNION ALL
        SELECT nth, reason, CASE WHEN reason IS NULL THEN list_concat(taken, keys) ELSE taken END
        FROM (SELECT n.nth, j.taken, ['s ' || store_email, 'e ' || email, 'u ' || username] AS keys,
                     CASE WHEN store_email IN (SELECT store_email FROM stores) OR list_contains(taken, 's ' || store_email)
                               THEN 'duplicate_store_email'
                          WHEN email IN (SELECT email FROM users) OR list_contains(taken, 'e ' || email) THEN 'duplicate_email'
                          WHEN username IN (SELECT username FROM users) OR list_contains(taken, 'u ' || username)
                               THEN 'duplicate_username' END AS reason
              FROM signup_judged j JOIN store_signups n ON n.nth = j.nth + 1) step"""
VIEWS["signup_made"] = """
        SELECT n.*, row_number() OVER (ORDER BY seq) AS place FROM store_signups n JOIN signup_judged j ON j.nth = n.nth AND j.reason IS NULL"""
_SIGNING = ("stores", "users", "store_signups", "signup_judged", "signup_made")
SQL["create_stores_with_admins"] = _recursive("""
SELECT CAST((SELECT max(store_id) FROM stores) + place AS INT) AS store_id, store_email, store_name, store_location, true AS status,
       created_at, CAST(NULL AS DECIMAL(5,2)) AS default_max_discount
FROM signup_made""", *_SIGNING)
SQL["create_stores_with_admins_users"] = _recursive("""
SELECT CAST((SELECT max(id) FROM users) + place AS INT) AS id, CAST((SELECT max(store_id) FROM stores) + place AS INT) AS store_id,
       full_name, username, email, 'STORE_ADMIN' AS role, true AS status, created_at, created_at AS updated_at
FROM signup_made""", *_SIGNING)
SQL["create_stores_with_admins_rejects"] = _recursive("""
SELECT n.seq, j.reason FROM store_signups n JOIN signup_judged j ON j.nth = n.nth WHERE j.reason IS NOT NULL""", *_SIGNING)

# --- store admins' product edits ---------------------------------------------------------------------------
VIEWS["product_edits"] = """
        SELECT bill_id * 100 + line_no AS seq, store_id, CAST(product_id + CASE WHEN line_no = 2 THEN 1 ELSE 0 END AS INT) AS product_id,
               created_at AS patched_at, line_no, concat('Edited ', CAST(product_id AS VARCHAR)) AS product_name,
               CAST(quantity * 10 AS DECIMAL(12,2)) AS selling_rate, quantity AS available_stock
        FROM bill_requests WHERE line_no IS NOT NULL"""
VIEWS["edits_held"] = """
        SELECT e.* FROM product_edits e JOIN inventory i ON i.store_id = e.store_id AND i.product_id = e.product_id"""
_EDITING = ("bill_requests", "products", "inventory", "product_edits", "edits_held")
SQL["update_store_products"] = with_views("""
SELECT p.* REPLACE (coalesce(e.product_name, p.product_name) AS product_name,
                    CASE WHEN e.product_id IS NOT NULL THEN e.at ELSE p.updated_at END AS updated_at)
FROM products p LEFT JOIN (
    SELECT product_id, arg_max(product_name, seq) AS product_name, arg_max(patched_at, seq) AS at
    FROM edits_held WHERE line_no = 1 GROUP BY product_id) e ON e.product_id = p.id""", *_EDITING)
SQL["update_store_products_inventory"] = with_views("""
SELECT i.* REPLACE (coalesce(e.selling_rate, i.selling_rate) AS selling_rate, coalesce(e.stock, i.available_stock) AS available_stock,
                    CASE WHEN e.product_id IS NOT NULL THEN e.at ELSE i.updated_at END AS updated_at)
FROM inventory i LEFT JOIN (
    SELECT store_id, product_id, arg_max(selling_rate, seq) AS selling_rate, arg_max(patched_at, seq) AS at,
           arg_max(available_stock, seq) FILTER (line_no = 3) AS stock
    FROM edits_held WHERE line_no <= 3 GROUP BY store_id, product_id) e ON e.store_id = i.store_id AND e.product_id = i.product_id""", *_EDITING)
SQL["update_store_products_rejects"] = with_views("""
SELECT seq, 'not_in_store' AS reason FROM product_edits WHERE seq NOT IN (SELECT seq FROM edits_held)
UNION ALL SELECT seq, 'no_fields' FROM edits_held WHERE line_no > 3""", *_EDITING)

# --- rows that went through files or JSON come back as they were ---------------------------------------------
SQL["invoice_history_from_json"] = SQL["invoice_history"]
for _name in ("products", "inventory", "invoice_items"):
    SQL[f"round_trip_{_name}"] = with_views(f"SELECT * FROM {_name}", _name)


# --- edits of products, stores and users -----------------------------------------------------------------
VIEWS["product_patches"] = f"""
        SELECT CAST(CASE WHEN p_partkey % 19 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS INT) AS id,
               p_partkey * 2 + again AS seq, {_FEED_TIME} AS patched_at,
               concat('Renamed ', CAST(p_partkey * 2 + again AS VARCHAR)) AS product_name, (p_partkey * 2 + again) % 3 = 0 AS set_name,
               CAST(p_partkey % 9 AS INT) AS category_id, (p_partkey * 2 + again) % 5 = 0 AS set_category,
               CASE WHEN (p_partkey * 2 + again) % 4 = 0 THEN 'clear' END AS color, (p_partkey * 2 + again) % 7 = 0 AS set_color,
               CAST((p_partkey * 2 + again) % 90 AS DECIMAL(10,2)) AS length, (p_partkey * 2 + again) % 11 = 0 AS set_length
        FROM part CROSS JOIN (VALUES (0), (1)) twice(again)"""
VIEWS["product_patches_judged"] = """
        SELECT *, CASE WHEN set_category AND category_id NOT IN (SELECT id FROM glass_categories) THEN 'category_not_found'
                       WHEN NOT (set_name OR set_category OR set_color OR set_length) THEN 'no_fields'
                       WHEN id NOT IN (SELECT id FROM products) THEN 'not_found' END AS reason
        FROM product_patches"""
_PATCHING = ("glass_categories", "products", "product_patches", "product_patches_judged")
SQL["patch_products"] = with_views(f"""
SELECT p.* REPLACE (CASE WHEN k.a_name THEN k.n_name ELSE p.product_name END AS product_name,
                    CASE WHEN k.a_cat THEN k.n_cat ELSE p.category_id END AS category_id,
                    CASE WHEN k.a_color THEN k.n_color ELSE p.color END AS color,
                    CASE WHEN k.a_length THEN k.n_length ELSE p.length END AS length,
                    CASE WHEN k.id IS NOT NULL THEN k.at ELSE p.updated_at END AS updated_at)
FROM products p LEFT JOIN (
    SELECT id, max(patched_at) AS at, bool_or(set_name) AS a_name, bool_or(set_category) AS a_cat, bool_or(set_color) AS a_color,
           bool_or(set_length) AS a_length, {_last_set('product_name', 'set_name')} AS n_name,
           {_last_set('category_id', 'set_category')} AS n_cat, {_last_set('color', 'set_color')} AS n_color,
           {_last_set('length', 'set_length')} AS n_length
    FROM product_patches_judged WHERE reason IS NULL GROUP BY id) k ON k.id = p.id""", *_PATCHING)
SQL["patch_products_rejects"] = with_views(
    "SELECT id, seq, reason FROM product_patches_judged WHERE reason IS NOT NULL", *_PATCHING)

VIEWS["store_patches"] = """
        SELECT CAST(CASE WHEN store_id % 6 = 5 THEN store_id + 5000 ELSE store_id END AS INT) AS store_id, CAST(store_id AS BIGINT) AS seq,
               concat('Branch ', CAST(store_id AS VARCHAR)) AS store_name, store_id % 2 = 0 AS set_name, store_id % 5 = 0 AS set_location,
               store_id % 4 = 0 AS status, store_id % 3 = 0 AS set_status
        FROM stores"""
SQL["patch_stores"] = with_views("""
SELECT s.* REPLACE (CASE WHEN k.set_name THEN k.store_name ELSE s.store_name END AS store_name,
                    CASE WHEN k.set_location THEN NULL ELSE s.store_location END AS store_location,
                    CASE WHEN k.set_status THEN k.status ELSE s.status END AS status)
FROM stores s LEFT JOIN store_patches k ON k.store_id = s.store_id""", "stores", "store_patches")
SQL["patch_stores_rejects"] = with_views("""
SELECT store_id, seq, CASE WHEN NOT (set_name OR set_location OR set_status) THEN 'no_fields' ELSE 'not_found' END AS reason
FROM store_patches WHERE NOT (set_name OR set_location OR set_status) OR store_id NOT IN (SELECT store_id FROM stores)""",
    "stores", "store_patches")

VIEWS["user_patches"] = f"""
        SELECT CAST(c_custkey % ((SELECT count(*) FROM supplier) + 3) AS INT) AS id, c_custkey AS seq, {_FEED_TIME} AS patched_at,
               concat('mail', CAST(c_custkey % 47 AS VARCHAR), '@x.test') AS email, c_custkey % 2 = 0 AS set_email,
               concat('name', CAST(c_custkey % 31 AS VARCHAR)) AS username, c_custkey % 3 = 0 AS set_username,
               c_name AS full_name, c_custkey % 5 = 0 AS set_full_name, c_custkey % 4 = 0 AS status, c_custkey % 11 = 0 AS set_status
        FROM customer"""


def _user_patches(anything: str, outsiders: str) -> tuple[str, str]:
    """Edited users, and refusals, with edits judged one by one; the maps hold every user's email and name by then."""
    views = f""",
outsiders AS (SELECT id FROM users WHERE {outsiders}),
asking AS (SELECT * FROM user_patches WHERE {anything} AND id IN (SELECT id FROM users) AND id NOT IN (SELECT id FROM outsiders)),
numbered AS (SELECT *, row_number() OVER (ORDER BY seq) AS nth FROM asking WHERE set_email OR set_username),
judged AS (
  SELECT CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS reason,
         map(list(id ORDER BY id), list(email ORDER BY id)) AS emails, map(list(id ORDER BY id), list(username ORDER BY id)) AS names
  FROM users
  UNION ALL
  SELECT nth, seq, reason, CASE WHEN reason IS NULL AND set_email THEN map_concat(emails, MAP {{id: email}}) ELSE emails END,
         CASE WHEN reason IS NULL AND set_username THEN map_concat(names, MAP {{id: username}}) ELSE names END
  FROM (SELECT n.*, j.emails, j.names,
               CASE WHEN n.set_email AND len(list_filter(map_entries(j.emails), lambda e: e.key <> n.id AND e.value = n.email)) > 0
                         THEN 'duplicate_email'
                    WHEN n.set_username AND len(list_filter(map_entries(j.names), lambda e: e.key <> n.id AND e.value = n.username)) > 0
                         THEN 'duplicate_username' END AS reason
        FROM judged j JOIN numbered n ON n.nth = j.nth + 1) step),
refused AS (SELECT seq, reason FROM judged WHERE reason IS NOT NULL),
taken AS (SELECT * FROM asking WHERE seq NOT IN (SELECT seq FROM refused))
"""
    more = ("CASE WHEN k.a_full THEN k.n_full ELSE u.full_name END AS full_name, "
            "CASE WHEN k.a_status THEN k.n_status ELSE u.status END AS status, ") if "set_status" in anything else ""
    table = views + f"""
SELECT u.* REPLACE ({more}CASE WHEN k.a_email THEN k.n_email ELSE u.email END AS email,
                    CASE WHEN k.a_name THEN k.n_name ELSE u.username END AS username,
                    CASE WHEN k.id IS NOT NULL THEN k.at ELSE u.updated_at END AS updated_at)
FROM users u LEFT JOIN (
    SELECT id, max(patched_at) AS at, bool_or(set_email) AS a_email, bool_or(set_username) AS a_name, bool_or(set_full_name) AS a_full,
           bool_or(set_status) AS a_status, {_last_set('email', 'set_email')} AS n_email, {_last_set('username', 'set_username')} AS n_name,
           {_last_set('full_name', 'set_full_name')} AS n_full, {_last_set('status', 'set_status')} AS n_status
    FROM taken GROUP BY id) k ON k.id = u.id"""
    rejects = views + f"""
SELECT id, seq, CASE WHEN id IN (SELECT id FROM outsiders) THEN 'not_store_admin' WHEN NOT ({anything}) THEN 'no_fields'
                     ELSE 'not_found' END AS reason
FROM user_patches WHERE id IN (SELECT id FROM outsiders) OR NOT ({anything}) OR id NOT IN (SELECT id FROM users)
UNION ALL SELECT p.id, r.seq, r.reason FROM refused r JOIN user_patches p ON p.seq = r.seq"""
    return _recursive(table, "users", "user_patches"), _recursive(rejects, "users", "user_patches")


SQL["patch_credentials"], SQL["patch_credentials_rejects"] = _user_patches("(set_email OR set_username)", "false")
SQL["patch_store_admins"], SQL["patch_store_admins_rejects"] = _user_patches(
    "(set_email OR set_username OR set_full_name OR set_status)", "upper(role) <> 'STORE_ADMIN'")


# --- reports after all requests are posted ------------------------------------------------------------------
_ITEMS_POSTED = """
SELECT bill_id AS invoice_id, product_id, quantity FROM bill_priced WHERE bill_id IN (
    SELECT bill_id FROM post_decisions WHERE status = 'accepted')"""


def _after_posting(name: str) -> str:
    """A report's SQL with the posted bills added to its invoices and items, and the stock they left."""
    outer = with_views("", *_POSTING).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    posted = {"invoices": f"SELECT * FROM ({VIEWS['invoices']}) b UNION ALL BY NAME SELECT * FROM posted_invoices",
              "invoice_items": f"SELECT * FROM ({VIEWS['invoice_items']}) b UNION ALL BY NAME SELECT * FROM posted_items",
              "inventory": "SELECT * FROM posted_stock"}
    report = SQL[name]
    for table, rows in posted.items():
        report = report.replace(f"{table} AS ({VIEWS[table]})", f"{table} AS ({rows})")
    views = [("posted_invoices", _HEADERS), ("posted_items", _ITEMS_POSTED), ("posted_stock", _STOCK_AFTER)]
    added = ",\n".join(f"{view} AS ({body.replace(_CLEAN, _ACCEPTED)})" for view, body in views)
    return f"{outer},\n{added}\nSELECT * FROM ({report}) report"


for _name in ("master_summary", "branch_performance", "monthly_revenue", "store_summary", "store_wise_revenue", "top_products_by_store"):
    SQL[f"fresh_{_name}"] = _after_posting(_name)


# --- deep pages, more lookups, deletes by the reference graph ----------------------------------------------------
SQL["invoice_history_indexed_page"] = with_views(
    f"{_HISTORY} ORDER BY created_at DESC, invoice_id DESC LIMIT 10 OFFSET 990", "invoices", "invoice_items", "products")
SQL["invoice_page_after"] = with_views("""
SELECT invoice_id, store_id, grand_total, created_at FROM invoices ORDER BY created_at DESC, invoice_id DESC LIMIT 10 OFFSET 30""",
    "invoices")
SQL["lookup_users_by_email"] = with_views("""
SELECT * FROM users WHERE email IN (SELECT 'admin-' || store_email FROM stores) AND email LIKE '%3%'""", "users", "stores")
SQL["lookup_store_admins_by_id"] = with_views("""
SELECT * FROM users WHERE upper(role) = 'STORE_ADMIN' AND id IN (SELECT store_id * 2 FROM stores)""", "users", "stores")
SQL["lookup_categories_by_id"] = with_views("""
SELECT * FROM glass_categories WHERE id IN (SELECT unnest([id, id + 7]) FROM glass_categories)""", "glass_categories")
SQL["lookup_stores_by_email"] = with_views("""
SELECT * FROM stores WHERE store_email IN (SELECT store_email FROM store_signups)""", "stores", "store_signups")
_ASKED = "asked AS (SELECT DISTINCT CAST(id * 23 AS BIGINT) AS id FROM products)"
SQL["delete_invoices_items"] = with_views(f""", {_ASKED}
SELECT invoice_id, line_no, product_id, quantity FROM invoice_items
WHERE invoice_id NOT IN (SELECT id FROM asked WHERE id IN (SELECT invoice_id FROM invoices))""", "products", "invoices", "invoice_items")
SQL["delete_invoices_rejects"] = with_views(f""", {_ASKED}
SELECT id, 'not_found' AS reason FROM asked WHERE id NOT IN (SELECT invoice_id FROM invoices)""", "products", "invoices")


def _held_rejects(asked: str, table: str, key: str, column: str) -> str:
    return with_views(f""",
asked AS (SELECT DISTINCT CAST({asked} AS BIGINT) AS id FROM {table})
SELECT id, CASE WHEN id IN (SELECT {key} FROM {table}) THEN 'still_referenced' ELSE 'not_found' END AS reason
FROM asked WHERE id NOT IN (SELECT {key} FROM {table}) OR id IN (SELECT {column} FROM invoices)""", table, "invoices")


SQL["delete_stores_rejects"] = _held_rejects("store_id * 2", "stores", "store_id", "store_id")
SQL["delete_users_rejects"] = _held_rejects("CASE WHEN id % 13 = 0 THEN id + 1000 ELSE id END", "users", "id", "billed_by")
SQL["delete_new_stores_inventory"] = _recursive("""
SELECT store_id, count(*) AS stock_rows FROM (
    SELECT store_id FROM inventory
    UNION ALL
    SELECT n.store_id FROM (SELECT CAST((SELECT max(store_id) FROM stores) + place AS INT) AS store_id FROM signup_made) n
    JOIN inventory i ON i.product_id % 5 = 0 AND n.store_id % 97 = i.store_id WHERE n.store_id % 2 = 1) held
GROUP BY store_id""", *_SIGNING, "inventory")
