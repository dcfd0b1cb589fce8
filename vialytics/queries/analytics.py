"""Filters, counts, rankings, comparisons, intervals and lists over vehicle records."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.labels import CLASSES, COLOURS
from ..operators import aggregates, intervals, listing, records
from ..plans.compiler import select
from ..plans.plan import Query, both, either, none_of, where
from ..sources.testdata import OBSERVATIONS, VEHICLES, observations, vehicle_records
from .registry import query

ALL = f"with v as ({VEHICLES}) "
DONE = f"with v as (select * from ({VEHICLES}) q where status = 'COMPLETED') "
IDS = ("run_id", "vehicle_id")


def done(spark, sf_dir):
    return records.completed(vehicle_records(spark, sf_dir))


def ids(spark, sf_dir, filters=None, **scope):
    return select(done(spark, sf_dir), Query(filters=filters, **scope)).select(*IDS)


@query(DONE + "select run_id, vehicle_id, camera_id, vehicle_class, colour, first_seen_seconds, last_seen_seconds, status, plate_text, plate_detected from v")
def rec_completed(spark, sf_dir):
    return done(spark, sf_dir).select(*records.FIELDS)


@query(DONE + "select run_id, vehicle_id from v where vehicle_class in ('CAR', 'BUS') and camera_id <> 'CAM_003'")
def flt_class_in(spark, sf_dir):
    return ids(spark, sf_dir, where("class", "in", ("CAR", "BUS")), without_cameras=("CAM_003",))


@query(DONE + "select run_id, vehicle_id from v where nullif(colour, 'UNKNOWN') is null or colour not in ('BLACK', 'RED')")
def flt_not_in_nullsafe(spark, sf_dir):
    missing = done(spark, sf_dir).withColumn("colour", F.nullif(F.col("colour"), F.lit("UNKNOWN")))
    return select(missing, Query(filters=where("colour", "not_in", ("BLACK", "RED")))).select(*IDS)


@query(DONE + "select run_id, vehicle_id from v where not (vehicle_class = 'CAR' or colour = 'WHITE') and (camera_id = 'CAM_001' or coalesce(plate_text, '') like 'HR%')")
def flt_nor_tree(spark, sf_dir):
    tree = both(none_of(where("class", "eq", "CAR"), where("colour", "eq", "WHITE")), either(where("camera", "eq", "CAM_001"), where("plate_text", "starts_with", "HR")))
    return ids(spark, sf_dir, tree)


@query(DONE + "select run_id, vehicle_id from v where plate_text like 'DL1%'")
def flt_plate_prefix(spark, sf_dir):
    return ids(spark, sf_dir, where("plate_text", "starts_with", "DL1"))


@query(DONE + "select run_id, vehicle_id from v where plate_text like '%77'")
def flt_plate_suffix(spark, sf_dir):
    return ids(spark, sf_dir, where("plate_text", "ends_with", "77"))


@query(DONE + "select run_id, vehicle_id from v where plate_text like '%45%'")
def flt_plate_contains(spark, sf_dir):
    return ids(spark, sf_dir, where("plate_text", "contains", "45"))


@query(DONE + "select run_id, vehicle_id from v where coalesce(plate_text, '') = ''")
def flt_plate_presence(spark, sf_dir):
    return ids(spark, sf_dir, where("plate_presence", "neq", "readable"))


@query(DONE + "select run_id, vehicle_id from v where coalesce(last_seen_seconds >= 100, true) and coalesce(first_seen_seconds <= 200, true) and run_id in ('RUN_1', 'RUN_2')")
def flt_time_overlap(spark, sf_dir):
    return ids(spark, sf_dir, start=100.0, end=200.0, runs=("RUN_1", "RUN_2"))


@query(DONE + "select run_id, vehicle_id from v where first_seen_seconds between 50 and 60 and last_seen_seconds > 70")
def flt_between(spark, sf_dir):
    return ids(spark, sf_dir, both(where("start_time", "between", (50.0, 60.0)), where("end_time", "gt", 70.0)))


#: An earlier answer names vehicles plainly or within a run.
EARLIER = tuple(f"CAM_00{c}:TRACK_5" for c in range(1, 6)) + tuple(f"RUN_{r}::CAM_00{c}:TRACK_9" for r in range(5) for c in range(1, 6))


@query(DONE + f"select run_id, vehicle_id from v where concat(run_id, '::', vehicle_id) in {EARLIER} or vehicle_id in {EARLIER}")
def flt_previous_ids(spark, sf_dir):
    return ids(spark, sf_dir, previous_ids=EARLIER)


def _dense(column, labels):
    rows = ", ".join(f"('{x}', {i})" for i, x in enumerate(labels))
    return DONE + f"select label, place, cast(count(v.vehicle_id) as bigint) as n from (values {rows}) t(label, place) left join v on v.{column} = label group by label, place"


@query(_dense("vehicle_class", CLASSES))
def agg_dense_class(spark, sf_dir):
    return aggregates.dense_counts(done(spark, sf_dir), "vehicle_class", CLASSES)


@query(_dense("colour", COLOURS))
def agg_dense_colour(spark, sf_dir):
    return aggregates.dense_counts(done(spark, sf_dir), "colour", COLOURS)


@query(_dense("colour", COLOURS) + " having count(v.vehicle_id) > 0")
def agg_present_labels(spark, sf_dir):
    return aggregates.present_labels(done(spark, sf_dir), "colour", COLOURS)


@query(DONE + "select count(*) as total, min(first_seen_seconds) as first_seen, max(last_seen_seconds) as last_seen from v where vehicle_class = 'TRUCK'")
def agg_summary(spark, sf_dir):
    return aggregates.summary(select(done(spark, sf_dir), Query(filters=where("class", "eq", "TRUCK"))))


@query(
    DONE
    + f""", k as (select camera_id as key, count(*) as total, min(first_seen_seconds) as first_seen, max(last_seen_seconds) as last_seen from v group by 1)
    select key, total, first_seen, last_seen, label, (select count(*) from v where camera_id = key and vehicle_class = label) as n
    from k, (values {", ".join(f"('{x}')" for x in CLASSES)}) t(label)"""
)
def agg_grouped_summary(spark, sf_dir):
    return aggregates.grouped_summary(done(spark, sf_dir), Query(group_by="camera"), CLASSES)


def _grouped(key):
    return DONE + f"select {key} as key, count(*) as n from v group by 1"


@query(_grouped("camera_id"))
def agg_group_camera(spark, sf_dir):
    return aggregates.grouped_counts(done(spark, sf_dir), Query(group_by="camera"))


@query(_grouped("concat(run_id, ' / ', camera_id)"))
def agg_group_run_camera(spark, sf_dir):
    return aggregates.grouped_counts(done(spark, sf_dir), Query(group_by="run_camera"))


@query(_grouped("case when coalesce(plate_text, '') <> '' then 'readable' when plate_detected then 'detected' else 'missing' end"))
def agg_group_plate_presence(spark, sf_dir):
    return aggregates.grouped_counts(done(spark, sf_dir), Query(group_by="plate_presence"))


@query(DONE + "select floor(first_seen_seconds / 60.0) * 60.0 as bucket, count(*) as n from v group by 1")
def agg_group_time_bucket(spark, sf_dir):
    counts = aggregates.grouped_counts(done(spark, sf_dir), Query(group_by="time_bucket", bucket_seconds=60.0))
    return counts.select(F.col("key").cast("double").alias("bucket"), "n")


def _ranked(key, direction, limit):
    return (
        DONE
        + f""", c as (select {key} as key, count(*) as n from v group by 1),
        r as (select *, row_number() over (order by n {direction}, key) as place, rank() over (order by n {direction}) = 1 as winner from c)
        select place, key, n, winner from r where place <= greatest({limit}, 3, (select count(*) from r where winner))"""
    )


@query(_ranked("concat(run_id, ' / ', camera_id)", "desc", 5))
def agg_rank_desc(spark, sf_dir):
    return aggregates.ranking(done(spark, sf_dir), Query(group_by="run_camera", descending=True, limit=5))


@query(_ranked("vehicle_class", "asc", 3))
def agg_rank_asc_ties(spark, sf_dir):
    return aggregates.ranking(done(spark, sf_dir), Query(group_by="class", descending=False))


@query(DONE + "select vehicle_class as key, count(*) as n from v group by 1 order by n desc, key limit 1")
def agg_top_group(spark, sf_dir):
    return aggregates.top_group(done(spark, sf_dir), Query(group_by="class"))


_CARS, _TRUCKS = where("class", "eq", "CAR"), where("class", "eq", "TRUCK")


@query(
    DONE
    + """, c as (select count(*) filter (vehicle_class = 'CAR') as a, count(*) filter (vehicle_class = 'TRUCK') as b from v where camera_id = 'CAM_002')
    select a as left_total, b as right_total, abs(a - b) as difference, round(cast(a as double) / b, 6) as ratio, round(cast(a as double) / b * 100.0, 3) as percentage,
      case when a > b then 'CAR' when b > a then 'TRUCK' end as winner, a = b as is_tie, case when a > b then 'YES' else 'NO' end as answer from c"""
)
def cmp_classes(spark, sf_dir):
    return aggregates.comparison(done(spark, sf_dir), Query(cameras=("CAM_002",)), _CARS, _TRUCKS, "CAR", "TRUCK")


@query(DONE + "select cast(count(*) filter (vehicle_class = 'CAR') as double) - count(*) filter (vehicle_class = 'TRUCK') as value from v")
def metric_difference(spark, sf_dir):
    return aggregates.metric(done(spark, sf_dir), Query(), "difference", _CARS, _TRUCKS)


@query(DONE + "select cast(count(*) filter (colour = 'BLACK') as double) / count(*) * 100.0 as value from v")
def metric_percentage(spark, sf_dir):
    return aggregates.metric(done(spark, sf_dir), Query(), "percentage", where("colour", "eq", "BLACK"), None)


_GRID = (
    DONE
    + """, t as (select cast(floor(max(greatest(first_seen_seconds, last_seen_seconds)) / 5) as bigint) as top from v),
    g as (select unnest(generate_series(0, top)) as k from t),
    w as (select k, count(*) filter (vehicle_class = 'CAR') as left_n, count(*) filter (vehicle_class = 'MOTORCYCLE') as right_n
      from g left join v on coalesce(last_seen_seconds >= k * 5, true) and coalesce(first_seen_seconds <= k * 5 + 5, true) group by k)"""
)


@query(_GRID + " select k, left_n, right_n from w where left_n > right_n")
def intervals_gt(spark, sf_dir):
    return intervals.matching(intervals.windows(done(spark, sf_dir), "CAR", "MOTORCYCLE"), ">")


@query(_GRID + " select k, left_n, right_n from w where left_n = right_n")
def intervals_eq(spark, sf_dir):
    return intervals.matching(intervals.windows(done(spark, sf_dir), "CAR", "MOTORCYCLE"), "=")


@query(
    _GRID
    + """, f as (select *, case when lag(k) over o = k - 1 and lag(left_n) over o = left_n and lag(right_n) over o = right_n then 0 else 1 end as s from w where left_n < right_n window o as (order by k)),
    r as (select *, sum(s) over (order by k) as run from f)
    select min(k) * 5.0e0 as start_time, (max(k) + 1) * 5.0e0 as end_time, min(left_n) as left_n, min(right_n) as right_n from r group by run"""
)
def intervals_merged(spark, sf_dir):
    return intervals.merged(intervals.matching(intervals.windows(done(spark, sf_dir), "CAR", "MOTORCYCLE"), "<"))


@query(
    DONE
    + """, u as (select run_id, concat(camera_id, ':TRACK_', cast(track_no % 500 as varchar(20))) as vehicle_id, vehicle_class, track_no from v),
    r as (select *, row_number() over (partition by vehicle_id order by run_id, track_no) as p from u) select run_id, vehicle_id, vehicle_class from r where p = 1"""
)
def union_dedupe_first(spark, sf_dir):
    short = F.concat("camera_id", F.lit(":TRACK_"), (F.col("track_no") % 500).cast("string"))
    rows = done(spark, sf_dir).withColumn("vehicle_id", short)
    parts = [select(rows, Query(runs=(f"RUN_{i}",))) for i in range(5)]
    both_ = parts[0]
    for p in parts[1:]:
        both_ = both_.unionByName(p)
    return records.first_of(both_, ["vehicle_id"], "run_id", "track_no").select("run_id", "vehicle_id", "vehicle_class")


@query(
    DONE
    + """select count(*) as total, count(*) filter (coalesce(plate_text, '') <> '') as readable, count(*) filter (plate_detected and coalesce(plate_text, '') = '') as unreadable,
    count(*) filter (not plate_detected and coalesce(plate_text, '') = '') as missing from v where camera_id = 'CAM_004'"""
)
def plate_lookup_counts(spark, sf_dir):
    return aggregates.plate_counts(done(spark, sf_dir), Query(cameras=("CAM_004",)))


@query(ALL + "select run_id, count(distinct camera_id) as cameras from v group by run_id having count(distinct camera_id) > 1")
def run_subject_multi_camera(spark, sf_dir):
    return vehicle_records(spark, sf_dir).groupBy("run_id").agg(F.countDistinct("camera_id").alias("cameras")).where("cameras > 1")


@query(
    ALL
    + """select run_id, count(distinct camera_id) as cameras, count(*) as tracks, count(*) filter (status = 'COMPLETED') as completed,
    (select count(*) from (select distinct run_id, camera_id, owner from v) m where m.run_id = v.run_id) as vehicles from v group by run_id"""
)
def list_runs_counts(spark, sf_dir):
    tracks = vehicle_records(spark, sf_dir)
    return listing.runs(tracks, tracks.select("run_id", "camera_id", "owner").distinct())


@query(
    ALL
    + f""", o as (select *, row_number() over (partition by track_no order by confidence desc, frame_number) as p, count(*) over (partition by track_no) as c from ({OBSERVATIONS}) q)
    select v.run_id, v.camera_id, vehicle_id, o.frame_number as best_frame, o.confidence as best_confidence, coalesce(c, 0) as observations
    from v left join o on o.track_no = v.track_no and p = 1"""
)
def list_tracks_top1(spark, sf_dir):
    return listing.tracks_with_best(vehicle_records(spark, sf_dir), observations(spark, sf_dir))


@query(
    ALL
    + """select run_id, concat(camera_id, '/', cast(owner as varchar(20))) as vehicle_key, count(*) as member_count, string_agg(vehicle_id, ',' order by vehicle_id) as members,
    string_agg(distinct camera_id, ',') as cameras, min(first_seen_seconds) as first_seen, max(last_seen_seconds) as last_seen from v group by 1, 2"""
)
def list_vehicles_arrays(spark, sf_dir):
    key = F.concat("camera_id", F.lit("/"), F.col("owner").cast("string"))
    return listing.vehicles_with_members(vehicle_records(spark, sf_dir).withColumn("vehicle_key", key))


@query(
    f"""with o as ({OBSERVATIONS}) select run_id, camera_id, count(*) as n, max(timestamp_seconds) as timestamp_seconds,
    (select max(frame_number) from o b where b.run_id = o.run_id and b.camera_id = o.camera_id and b.timestamp_seconds = max(o.timestamp_seconds)) as frame_number from o group by 1, 2"""
)
def list_cameras_latest(spark, sf_dir):
    return listing.camera_state(observations(spark, sf_dir))


@query(ALL + "select distinct 'camera' as kind, camera_id as value from v union all select distinct 'run', run_id from v union all select distinct 'class', vehicle_class from v union all select distinct 'colour', colour from v")
def filter_options(spark, sf_dir):
    return listing.filter_options(vehicle_records(spark, sf_dir))


@query(
    f"""with o as (select *, row_number() over (partition by camera_id, run_id order by confidence desc, track_no, frame_number) as place from ({OBSERVATIONS}) q)
    select run_id, camera_id, place, local_track_id, frame_number from o where place between 7 and 12"""
)
def page_evidence(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return listing.page(rows, [F.desc("confidence"), "track_no", "frame_number"], 1, 6, "camera_id", "run_id").select("run_id", "camera_id", "place", "local_track_id", "frame_number")


@query(ALL + "select run_id, vehicle_id, concat(run_id, '::', vehicle_id) as scoped_id, split_part(vehicle_id, ':', 2) as short_id, greatest(0, last_seen_seconds - first_seen_seconds) as duration_seconds from v where last_seen_seconds is not null")
def list_track_rows(spark, sf_dir):
    rows = records.listing(vehicle_records(spark, sf_dir)).where("last_seen_seconds is not null")
    return rows.select("run_id", "vehicle_id", "scoped_id", "short_id", "duration_seconds")


@query("select conv_id as session, count(*) as messages, count(*) filter (role = 'user') as user_messages, max(turn) as last_index, max(length(text)) as longest from conversations group by conv_id")
def chat_sessions_messages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.groupBy(F.col("conv_id").alias("session")).agg(
        F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.max("turn").alias("last_index"), F.max(F.length("text")).cast("long").alias("longest")
    )
