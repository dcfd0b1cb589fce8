"""Comparisons whose result is never null: a missing value differs from everything and is ordered before nothing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def equal(field: Column, value) -> Column:
    return field.eqNullSafe(F.lit(value))


def is_in(field: Column, values: Sequence) -> Column:
    """Membership; None among the values matches a missing field."""
    known = [v for v in values if v is not None]
    hit = _sure(field.isin(known)) if known else F.lit(False)
    return hit | field.isNull() if len(known) < len(values) else hit


def compare(field: Column, operator: str, value) -> Column:
    """One condition. Text operators need text on both sides, ordering needs both sides; else they are false."""
    if operator == "eq":
        return equal(field, value)
    if operator == "neq":
        return ~equal(field, value)
    if operator == "in":
        return is_in(field, list(value or []))
    if operator == "not_in":
        return ~is_in(field, list(value or []))
    if operator in ("starts_with", "ends_with", "contains"):
        if not isinstance(value, str):
            return F.lit(False)
        return _sure({"starts_with": field.startswith, "ends_with": field.endswith, "contains": field.contains}[operator](value))
    if operator in ("exists", "not_exists"):
        there = _sure(field.cast("string").isNotNull() & ~field.cast("string").isin("", "false"))
        return there if operator == "exists" else ~there
    if operator == "between":
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            return F.lit(False)
        return _sure(field.between(value[0], value[1]))
    ordered = {"gt": field.__gt__, "gte": field.__ge__, "lt": field.__lt__, "lte": field.__le__}
    if operator in ordered and value is not None:
        return _sure(ordered[operator](value))
    return F.lit(False)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def overlaps(first: Column, last: Column, start: float | None, end: float | None) -> Column:
    """Inclusive overlap of [first, last] with [start, end]; a missing bound on either side passes."""
    out = F.lit(True)
    if start is not None:
        out = out & F.coalesce(last >= F.lit(float(start)), F.lit(True))
    if end is not None:
        out = out & F.coalesce(first <= F.lit(float(end)), F.lit(True))
    return out
