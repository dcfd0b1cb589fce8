"""Queries over vehicle records as DataFrames: one logical plan for each, left to the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import UNKNOWN, scoped_id
from ..functions.predicates import all_of, any_of, compare, overlaps
from .plan import Filter, Query, problems


def field(name: str) -> Column:
    """The value that a condition on a field looks at."""
    readable = F.coalesce(F.col("plate_text") != "", F.lit(False))
    detected = F.coalesce(F.col("plate_detected"), F.lit(False))
    return {
        "class": F.col("vehicle_class"),
        "colour": F.col("colour"),
        "camera": F.col("camera_id"),
        "run": F.nullif(F.col("run_id"), F.lit("")),
        "plate_text": F.col("plate_text"),
        "plate_detected": detected,
        "plate_readable": readable,
        "plate_presence": F.when(readable, "readable").when(detected, "detected").otherwise("missing"),
        "start_time": F.col("first_seen_seconds"),
        "end_time": F.col("last_seen_seconds"),
        "vehicle_id": F.col("vehicle_id"),
    }[name]


def condition(f: Filter | None) -> Column:
    """A filter tree as one column that is never null."""
    if f is None:
        return F.lit(True)
    if f.kind == "condition":
        return compare(field(f.field), f.operator, f.value)
    parts = [condition(p) for p in f.parts]
    return {"and": all_of(parts), "or": any_of(parts), "not": ~any_of(parts)}[f.kind]


def in_scope(query: Query) -> Column:
    """Runs, cameras, earlier answers and time. Records without a run are in every scope."""
    checks = [overlaps(F.col("first_seen_seconds"), F.col("last_seen_seconds"), query.start, query.end)]
    if query.runs:
        checks.append(F.coalesce(F.nullif(F.col("run_id"), F.lit("")).isin(*query.runs), F.lit(True)))
    if query.cameras:
        checks.append(compare(F.col("camera_id"), "in", query.cameras))
    if query.without_cameras:
        checks.append(compare(F.col("camera_id"), "not_in", query.without_cameras))
    if query.previous_ids:
        checks.append(compare(F.col("vehicle_id"), "in", query.previous_ids) | compare(scoped_id(F.col("run_id"), F.col("vehicle_id")), "in", query.previous_ids))
    return all_of(checks)


def select(records: DataFrame, query: Query) -> DataFrame:
    """The records that a query is about."""
    if wrong := problems(query):
        raise ValueError("; ".join(wrong))
    return records.where(in_scope(query) & condition(query.filters))


def group_key(query: Query) -> Column:
    """The label that a record is grouped under; missing parts are UNKNOWN."""
    run = F.coalesce(F.nullif(F.col("run_id"), F.lit("")), F.lit(UNKNOWN))
    camera = F.coalesce(F.nullif(F.col("camera_id"), F.lit("")), F.lit(UNKNOWN))
    bucket = F.floor(F.col("first_seen_seconds") / query.bucket_seconds) * F.lit(query.bucket_seconds)
    return {
        "class": F.col("vehicle_class"),
        "colour": F.col("colour"),
        "camera": camera,
        "run": run,
        "run_camera": F.concat(run, F.lit(" / "), camera),
        "plate_presence": field("plate_presence"),
        "time_bucket": F.coalesce(bucket.cast("string"), F.lit(UNKNOWN)),
    }[query.group_by]
