"""Plain-Python models used as independent checks of the Spark jobs."""

from __future__ import annotations

import pandas as pd


def post_bills_loop(lines: pd.DataFrame) -> dict:
    """Serial model of bill posting: one store at a time, bills in
    (created_at, bill_id) order, lines in line order, each line tested
    against the stock current at the start of its bill."""
    decisions = {}
    stock = {}
    for r in lines.itertuples(index=False):
        if r.found:
            stock[(r.store_id, r.product_id)] = int(r.start_stock)
    bills = lines.sort_values(["store_id", "created_at", "bill_id", "line_no"]).groupby("bill_id", sort=False)
    for bill_id, g in bills:
        g = g.sort_values("line_no")
        invalid = g[g.invalid_reason.notna()]
        if len(invalid):
            first = invalid.iloc[0]
            line = None if pd.isna(first.line_no) else int(first.line_no)   # a bill without items has no line
            decisions[bill_id] = ("rejected", first.invalid_reason, line)
            continue
        failed = None
        for r in g.itertuples(index=False):
            if not r.found:
                failed = ("not_found", r.line_no)
                break
            if stock[(r.store_id, r.product_id)] < r.quantity:
                failed = ("insufficient_stock", r.line_no)
                break
            if r.applied_discount > r.max_discount:
                failed = ("discount_limit_exceeded", r.line_no)
                break
        if failed:
            decisions[bill_id] = ("rejected", failed[0], int(failed[1]))
        else:
            for r in g.itertuples(index=False):
                stock[(r.store_id, r.product_id)] -= int(r.quantity)
            decisions[bill_id] = ("accepted", None, None)
    return {"decisions": decisions, "stock": stock}


def register_users_loop(existing: list[dict], requests: list[dict]) -> dict:
    """One-at-a-time model of user registration: seq -> reason or 'accepted'."""
    emails = {u["email"] for u in existing}
    names = {u["username"] for u in existing}
    out = {}
    for r in sorted(requests, key=lambda r: r["seq"]):
        if any(not r[f] for f in ("full_name", "username", "email", "role")):
            out[r["seq"]] = "missing_fields"
        elif r["role"].upper() not in ("MASTER_ADMIN", "STORE_ADMIN"):
            out[r["seq"]] = "invalid_role"
        elif r["email"] in emails:
            out[r["seq"]] = "duplicate_email"
        elif r["username"] in names:
            out[r["seq"]] = "duplicate_username"
        else:
            out[r["seq"]] = "accepted"
            emails.add(r["email"])
            names.add(r["username"])
    return out
