"""Queries for reports, imports and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imports
from ..operators.aggregates import distribution
from ..sources.testdata import OBSERVATIONS, VEHICLES, observations, read, vehicle_records
from .registry import query

ALL = f"with v as ({VEHICLES}) "
O = f"with o as ({OBSERVATIONS}) "  # noqa: E741


@query(O + "select camera_id, raw_class_name, count(confidence) as n, avg(confidence) as mean, quantile_cont(confidence, 0.5) as p50, quantile_cont(confidence, 0.95) as p95, max(confidence) as largest from o group by 1, 2")
def latency_percentiles(spark, sf_dir):
    return distribution(observations(spark, sf_dir), "confidence", "camera_id", "raw_class_name")


_CLASSES = ("car", "motorcycle", "truck")


@query(O + "select camera_id, " + ", ".join(f"count(*) filter (raw_class_name = '{c}') as {c}" for c in _CLASSES) + " from o group by 1")
def pivot_configurations(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("camera_id").pivot("raw_class_name", list(_CLASSES)).count().na.fill(0)


@query(O + ", p as (select camera_id, " + ", ".join(f"count(*) filter (raw_class_name = '{c}') as {c}" for c in _CLASSES) + " from o group by 1) " + " union all ".join(f"select camera_id, '{c}' as metric, {c} as value from p" for c in _CLASSES))
def unpivot_metrics(spark, sf_dir):
    return pivot_configurations(spark, sf_dir).unpivot(["camera_id"], list(_CLASSES), "metric", "value")


@query(
    ALL
    + """, a as (select vehicle_id, vehicle_class as base, case when track_no % 11 = 0 then 'UNKNOWN' when track_no % 7 = 0 then 'CAR' else vehicle_class end as other from v)
    select case when base = 'UNKNOWN' and other = 'UNKNOWN' then 'both_unknown' when base = 'UNKNOWN' then 'base_unknown' when other = 'UNKNOWN' then 'other_unknown' when base = other then 'agree' else 'differ' end as outcome, count(*) as n from a group by 1"""
)
def agreement_classes(spark, sf_dir):
    base = F.col("vehicle_class")
    other = F.when(F.col("track_no") % 11 == 0, "UNKNOWN").when(F.col("track_no") % 7 == 0, "CAR").otherwise(base)
    outcome = F.when((base == "UNKNOWN") & (other == "UNKNOWN"), "both_unknown").when(base == "UNKNOWN", "base_unknown").when(other == "UNKNOWN", "other_unknown").when(base == other, "agree").otherwise("differ")
    return vehicle_records(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("select 'orphan_track' as code, o_orderkey, count(*) as rows from orders where o_orderkey not in (select l_orderkey from lineitem) group by o_orderkey")
def import_orphans(spark, sf_dir):
    return imports.orphans(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "orphan_track")


@query(
    ALL
    + """, r as (select *, concat(run_id, '/', camera_id, ':TRACK_', cast(track_no % 500 as varchar)) as track_id from v),
    n as (select *, row_number() over g as place, count(*) over k as n, count(*) filter (status = 'COMPLETED') over k as done from r window g as (partition by track_id order by track_no), k as (partition by track_id)),
    f as (select *, n = 1 or (status = 'COMPLETED' and done = 1) as keeps from n)
    select track_no, case when keeps then track_id else concat(track_id, '__DUPLICATE_', cast(place as varchar), '_', status) end as unique_key,
    case when keeps then null when status = 'COMPLETED' then 'duplicate_completed_logical_track_identity' else 'duplicate_noncanonical_track_identity_remapped' end as issue from f"""
)
def import_duplicates(spark, sf_dir):
    rows = vehicle_records(spark, sf_dir).withColumn("track_id", F.concat("run_id", F.lit("/"), "camera_id", F.lit(":TRACK_"), (F.col("track_no") % 500).cast("string")))
    return imports.numbered_duplicates(rows, "track_id", "track_no").select("track_no", "unique_key", "issue")


_SPANS = ALL + ", t as (select camera_id, owner, track_no, first_seen_seconds as a, first_seen_seconds + 40 as b, status from v where run_id = 'RUN_1'), r as (select track_no as ref_id, camera_id, owner, first_seen_seconds + 20 as f from v where run_id = 'RUN_1') "


@query(
    _SPANS
    + """, p as (select ref_id, count(*) filter (f between a and b) as around, min(track_no) filter (f between a and b) as x, count(*) filter (status = 'COMPLETED') as done, min(track_no) filter (status = 'COMPLETED') as c, min(track_no) as m
    from r join t using (camera_id, owner) group by 1)
    select ref_id, case when around = 1 then x when done = 1 then c else m end as track_no, case when around = 1 then 'containment' when done = 1 then 'completed' else 'first' end as how from p"""
)
def import_ref_range_join(spark, sf_dir):
    rows = vehicle_records(spark, sf_dir).where("run_id = 'RUN_1'")
    tracks = rows.select("camera_id", "owner", "track_no", F.col("first_seen_seconds").alias("first_frame"), (F.col("first_seen_seconds") + 40).alias("last_frame"), "status")
    refs = rows.select(F.col("track_no").alias("ref_id"), "camera_id", "owner", (F.col("first_seen_seconds") + 20).alias("frame_number"))
    return imports.resolved(refs, tracks, ["camera_id", "owner"])


@query(
    ALL
    + """, t as (select run_id, camera_id, owner, track_no, first_seen_seconds as a, first_seen_seconds + 40 as b, status from v), r as (select track_no as ref_id, run_id, camera_id, owner, first_seen_seconds + 20 as f from v),
    p as (select ref_id, count(*) filter (f between a and b) as around, min(track_no) filter (f between a and b) as x, count(*) filter (status = 'COMPLETED') as done, min(track_no) filter (status = 'COMPLETED') as c, min(track_no) as m
    from r join t using (run_id, camera_id, owner) group by 1)
    select ref_id, case when around = 1 then x when done = 1 then c else m end as track_no, case when around = 1 then 'containment' when done = 1 then 'completed' else 'first' end as how from p"""
)
def import_ref_range_join_all(spark, sf_dir):
    rows = vehicle_records(spark, sf_dir)
    keys = ["run_id", "camera_id", "owner"]
    tracks = rows.select(*keys, "track_no", F.col("first_seen_seconds").alias("first_frame"), (F.col("first_seen_seconds") + 40).alias("last_frame"), "status")
    refs = rows.select(F.col("track_no").alias("ref_id"), *keys, (F.col("first_seen_seconds") + 20).alias("frame_number"))
    return imports.resolved(refs, tracks, keys)


def _versions(spark, sf_dir):
    rows = vehicle_records(spark, sf_dir)
    old = rows.where("track_no % 3 <> 0").select("track_no", "run_id", "vehicle_class", F.lit(1).cast("long").alias("created"))
    new = rows.where("track_no % 2 = 0").select("track_no", "run_id", F.lit("BUS").alias("vehicle_class"), F.lit(2).cast("long").alias("created"))
    return old, new


_VERSIONS = ALL + ", a as (select track_no, run_id, vehicle_class, 1 as created from v where track_no % 3 <> 0), b as (select track_no, run_id, 'BUS' as vehicle_class, 2 as created from v where track_no % 2 = 0) "


@query(_VERSIONS + "select coalesce(b.track_no, a.track_no) as track_no, coalesce(b.run_id, a.run_id) as run_id, coalesce(b.vehicle_class, a.vehicle_class) as vehicle_class, cast(coalesce(a.created, b.created) as bigint) as created from a full join b on a.track_no = b.track_no")
def upsert_merge(spark, sf_dir):
    return imports.upserted(*_versions(spark, sf_dir), ["track_no"], ["created"])


@query(_VERSIONS + "select track_no, run_id, vehicle_class, cast(created as bigint) as created from a union all select track_no, run_id, vehicle_class, cast(created as bigint) from b where track_no not in (select track_no from a)")
def insert_ignore(spark, sf_dir):
    return imports.inserted(*_versions(spark, sf_dir), ["track_no"])


@query(_VERSIONS + "select track_no, run_id, vehicle_class, cast(created as bigint) as created from a where run_id <> 'RUN_2' union all select track_no, run_id, vehicle_class, cast(created as bigint) from b where run_id = 'RUN_2'")
def replace_run(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return imports.replaced(old, new.where("run_id = 'RUN_2'"), "run_id")


_RULES = {"confidence_range": "confidence between 0 and 1", "box_order": "x2 >= x1 and y2 >= y1", "first_frame": "frame_number >= 5"}


@query(O + " union all ".join(f"select '{n}' as rule, count(*) filter (not ({c})) as rows from o" for n, c in _RULES.items()))
def import_rules(spark, sf_dir):
    return imports.broken_rules(observations(spark, sf_dir), _RULES)
