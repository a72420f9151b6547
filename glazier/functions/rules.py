"""Pricing and stock rules as Column -> Column expressions.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the pricing rules.
BILLING_BRACKETS = (12, 18, 24, 36)          # E1: sizes are rounded up to these
MM_PER_FOOT = 304.8                          # E2: millimetre sides -> feet
INCHES_PER_FOOT = 12.0                       # E2: inch sides -> feet
SQFT_TO_SQM = 0.092903                       # E2: square feet -> square metres
MASTER_ROLES = ("MASTER_ADMIN", "MASTERADMIN")
STORE_ROLE = "STORE_ADMIN"
STOCK_OUT, STOCK_LOW, STOCK_IN = "out_of_stock", "low_stock", "in_stock"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def billing_dimension(x, out_type: str = "decimal(10,2)") -> Column:
    """Round a side up to the next bracket; larger sides stay as they are.
    Zero and negative sides become the first bracket; NULL stays NULL."""
    x = _c(x)
    expr = None
    for bracket in BILLING_BRACKETS:
        cond = x <= F.lit(bracket)
        expr = F.when(cond, F.lit(bracket)) if expr is None else expr.when(cond, F.lit(bracket))
    return expr.otherwise(x).cast(out_type)


def area(length, width, dimension_unit, unit) -> Column:
    """Area of a length x width sheet in the product's unit, 4 decimals.

    Sides in "feet"/"ft" are used as they are, "inch"/"in" are divided by 12,
    anything else (NULL too) counts as millimetres.  The area is in square
    metres when the unit is "sq.m", "sqm" or mentions "meter", else in square
    feet.  A missing side gives 0, like a failed number parse; an area beyond
    the column's range is NULL.
    """
    l = _c(length).cast("double")
    w = _c(width).cast("double")
    d_unit = F.lower(F.coalesce(_c(dimension_unit).cast("string"), F.lit("")))
    o_unit = F.lower(F.coalesce(_c(unit).cast("string"), F.lit("")))
    per_foot = (F.when(d_unit.contains("feet") | (d_unit == "ft"), F.lit(1.0))
                .when(d_unit.contains("inch") | (d_unit == "in"), F.lit(INCHES_PER_FOOT))
                .otherwise(F.lit(MM_PER_FOOT)))
    sq_ft = (l / per_foot) * (w / per_foot)
    is_sqm = (o_unit == "sq.m") | (o_unit == "sqm") | o_unit.contains("meter")
    value = F.when(is_sqm, sq_ft * F.lit(SQFT_TO_SQM)).otherwise(sq_ft)
    return F.when(l.isNull() | w.isNull() | F.isnan(l) | F.isnan(w), F.lit(0.0)) \
        .otherwise(F.round(value, 4)).try_cast("decimal(14,4)")


def stock_status(available, minimum) -> Column:
    """First match wins; a NULL stock or minimum falls through to in_stock."""
    a, m = _c(available), _c(minimum)
    return F.when(a <= 0, F.lit(STOCK_OUT)).when(a <= m, F.lit(STOCK_LOW)).otherwise(F.lit(STOCK_IN))


def stock_value(available, rate) -> Column:
    """Units x rate, exact decimal; negative stock gives a negative value."""
    return (_c(available).cast("decimal(10,0)") * _c(rate)).cast("decimal(23,2)")


def effective_max_discount(override, default) -> Column:
    """E5: the override when set (0 counts), else the store default, else 0."""
    return F.coalesce(_c(override), _c(default), F.lit(0).cast("decimal(5,2)")).cast("decimal(5,2)")


def line_base(rate, line_area, quantity) -> Column:
    """Rate x area x qty, unrounded; NULL beyond its width."""
    return ((_c(rate) * _c(line_area)).try_cast("decimal(20,6)")
            * _c(quantity).cast("decimal(10,0)")).try_cast("decimal(24,6)")


def line_price(rate, line_area, quantity, discount, charged_rate=None, base=None) -> dict[str, Column]:
    """Exact (unrounded) line amounts; ``base`` is a column that holds ``line_base`` already.

    base = rate x area x qty, discount = base x pct / 100, final = base - discount.
    A given charged_rate replaces the whole line: base = final = charged_rate
    (a line total, not per unit) and discount = 0.  An amount beyond the
    widths below is NULL: its line is refused (B3), the batch goes on.
    """
    # Widths are pinned at each step so no product passes 38 digits (where
    # Spark would silently drop scale): base (24,6), discount (34,10).
    base = line_base(rate, line_area, quantity) if base is None else _c(base)
    disc_amt = (base * _c(discount).cast("decimal(5,2)")) * F.lit(0.01).cast("decimal(3,2)")
    final = base - disc_amt
    if charged_rate is None:
        return {"base_total": base, "discount_amount": disc_amt, "final_total": final}
    cr = _c(charged_rate)
    has = cr.isNotNull()
    return {"base_total": F.when(has, cr).otherwise(base),
            "discount_amount": F.when(has, F.lit(0)).otherwise(disc_amt),
            "final_total": F.when(has, cr).otherwise(final)}


def line_sides(item_height, item_length, item_width, product_length, product_width) -> tuple[Column, Column]:
    """Length and width from the item, else the product."""
    return (F.coalesce(_c(item_height), _c(item_length), _c(product_length)).cast("decimal(10,2)"),
            F.coalesce(_c(item_width), _c(product_width)).cast("decimal(10,2)"))


def line_area(item_area, billing_length, billing_width, dimension_unit, unit) -> Column:
    """Area from the item, else E2 over the bracketed sides."""
    return F.coalesce(_c(item_area).try_cast("decimal(14,4)"),
                      area(billing_length, billing_width, dimension_unit, unit)).try_cast("decimal(14,4)")


def line_dimensions(item_height, item_length, item_width, item_area,
                    product_length, product_width, dimension_unit, unit) -> dict[str, Column]:
    """Sides from the item, else the product; area from the item, else E2
    over the bracketed (E1) sides."""
    length, width = line_sides(item_height, item_length, item_width, product_length, product_width)
    b_len, b_wid = billing_dimension(length), billing_dimension(width)
    return {"length": length, "width": width, "billing_length": b_len,
            "billing_width": b_wid, "area": line_area(item_area, b_len, b_wid, dimension_unit, unit)}


def role_is(role, kind: str) -> Column:
    """Case-insensitive role test; 'master' accepts both spellings."""
    r = F.upper(_c(role))
    if kind == "master":
        return r.isin(*MASTER_ROLES)
    if kind == "store":
        return r == F.lit(STORE_ROLE)
    raise ValueError(f"unknown role kind {kind!r}")


def category_key(name) -> Column:
    """Matching key of a category name (stored names are trimmed only)."""
    return F.lower(F.trim(_c(name)))


def zero_if_null(col, out_type: str | None = None) -> Column:
    """Listings show a missing rate, side or area as 0."""
    c = F.coalesce(_c(col), F.lit(0))
    return c.cast(out_type) if out_type else c


def money(col) -> Column:
    """Summary money with 2 decimals."""
    return _c(col).cast("decimal(38,2)")
