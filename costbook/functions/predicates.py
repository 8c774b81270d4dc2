"""Filters of the price list, shared by the list, its totals and the exports."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SEARCHED = ("res_Name", "res_Standard", "res_Name_EN", "res_Code", "cons_Name")


def in_scope(scope: str) -> Column:
    """Usage rows of a report module."""
    if scope in ("vol", "all"):
        return F.lit(True)
    if scope == "mix":
        return F.col("kind_Code").startswith("06")
    if scope == "machine":
        return F.col("cons_Style") == 5
    if scope == "me_main":
        return F.col("cons_Style").isin(6, 7)
    raise ValueError(f"unknown scope: {scope}")


def matches_keyword(q: str, columns: list[Column]) -> Column:
    """Substring over several columns; folds ASCII case only, % and _ act as wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = f"%{q.strip().translate(str.maketrans(upper, lower))}%"
    fold = lambda c: F.translate(F.coalesce(c, F.lit("")), upper, lower)
    return reduce(or_, [fold(c).like(pattern) for c in columns])


def in_tiers(text: str | None) -> Column | None:
    """Comma text to an IN list; None where it holds no tier at all."""
    tiers = [t.strip() for t in (text or "").split(",") if t.strip()]
    return F.col("tier").isin(tiers) if tiers else None


def is_priced(priced: str | None) -> Column | None:
    """Tests that a price row exists, whatever its value."""
    if priced == "yes":
        return F.col("price_res_ID").isNotNull()
    if priced == "no":
        return F.col("price_res_ID").isNull()
    return None


def list_predicate(
    available: list[str], scope: str = "all", vol: str | None = None, cls: int | str | None = None,
    priced: str | None = None, tier: str | None = None, q: str | None = None,
) -> Column:
    """All filters of the list, AND-ed; absent ones drop out."""
    parts = [in_scope(scope)]
    if vol:
        parts.append(F.col("vol") == vol)
    if cls:
        parts.append(F.col("cons_Style") == int(cls))
    parts += [p for p in (is_priced(priced), in_tiers(tier)) if p is not None]
    if q:
        parts.append(matches_keyword(q, [F.col(c) for c in SEARCHED if c in available]))
    return reduce(and_, parts)
