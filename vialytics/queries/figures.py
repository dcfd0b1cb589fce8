"""Queries for report figures and offline choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reporting
from ..sources.testdata import OBSERVATIONS, VEHICLES, observations, read, vehicle_records
from .registry import query

ALL = f"with v as ({VEHICLES}) "
O = f"with o as ({OBSERVATIONS}) "  # noqa: E741


@query(
    O
    + """, p as (select camera_id, frame_number, confidence + 0.01e0 as s, track_no from o), w as (select *, row_number() over (partition by track_no order by frame_number, s) as k from p)
    select track_no, count(*) as frames, round(avg(s), 6) as mean, max(s) as slowest, round(count(*) / sum(s), 6) as per_second from w where k > 2 group by 1"""
)
def latency_profile(spark, sf_dir):
    """Latencies of each track without its first two frames."""
    return reporting.latency_profile(observations(spark, sf_dir).withColumn("s", F.col("confidence") + 0.01), "track_no", "frame_number", "s", 2)


@query(O + "select raw_class_name, count(y2) as n, " + ", ".join(f"round(quantile_cont(y2, {p}), 6) as p{round(100 * p)}" for p in reporting.TENS) + ", count(*) filter (y2 <= 40) as at_low, count(*) filter (y2 >= 100) as at_high from o group by 1")
def percentiles_by_class(spark, sf_dir):
    """p10 to p90 of the lower edges of boxes, and how many lie at the frame's edges."""
    return reporting.percentile_table(observations(spark, sf_dir), "raw_class_name", "y2", 40, 100)


@query(
    O
    + """, t as (select run_id, track_no, max(y2) as high from o group by 1, 2), g as (select run_id, quantile_cont(high, 0.5) as goal from t group by 1),
    k as (select t.*, row_number() over (partition by run_id order by round(abs(high - goal), 9), track_no) as k from t join g using (run_id)) select run_id, track_no, high from k where k = 1"""
)
def nearest_to_median(spark, sf_dir):
    """The track of each run whose lowest box is nearest to the run's median."""
    rows = observations(spark, sf_dir).groupBy("run_id", "track_no").agg(F.max("y2").alias("high"))
    return reporting.nearest_to_percentile(rows, "run_id", "high", 0.5, "track_no")


_PROFILES = O + ", p as (select camera_id as name, round(avg(case when confidence >= 0.5 then 1 else 0 end), 6) as match, round(avg(case when x2 - x1 < 25 then 1 else 0 end), 6) as small, cast(count(*) as double) as fps, count(distinct track_no) as tracks from o group by 1) "


def _profiles(spark, sf_dir):
    share = lambda c: F.round(F.avg(F.when(c, 1).otherwise(0)), 6)
    return observations(spark, sf_dir).groupBy(F.col("camera_id").alias("name")).agg(
        share(F.col("confidence") >= 0.5).alias("match"), share(F.col("x2") - F.col("x1") < 25).alias("small"), F.count("*").cast("double").alias("fps"), F.count_distinct("track_no").alias("tracks")
    )


@query(_PROFILES + "select name, fps from p where match >= 0.5 and small >= 0.2 order by fps desc, name limit 1")
def recommended_profile(spark, sf_dir):
    """The camera with the most frames among those good enough by two rates."""
    return reporting.recommended(_profiles(spark, sf_dir), 0.5, 0.2).select("name", "fps")


@query(_PROFILES + "select name, match, small, tracks from p order by round(abs(match - 0.5), 2), -tracks, name limit 1")
def profile_choice(spark, sf_dir):
    """The camera that is smallest by a list of objectives, one after another."""
    best = reporting.best_profile(_profiles(spark, sf_dir), F.round(F.abs(F.col("match") - 0.5), 2), F.desc("tracks"), F.col("name"))
    return best.select("name", "match", "small", "tracks")


@query(
    O
    + """, w as (select *, case when x2 - x1 < 10 then 'under_10' when x2 - x1 < 20 then 'under_20' when x2 - x1 < 35 then 'under_35' else 'wide' end as bucket from o)
    select bucket, count(*) as n, count(*) filter (confidence >= 0.75) as valid, round(count(*) filter (confidence >= 0.75) / count(*), 6) as rate from w group by 1"""
)
def width_buckets(spark, sf_dir):
    """Boxes by width, and the share of each bucket that is sure enough."""
    bucket = reporting.buckets(F.col("x2") - F.col("x1"), [10, 20, 35], ["under_10", "under_20", "under_35", "wide"])
    valid = F.count_if(F.col("confidence") >= 0.75)
    return observations(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), valid.alias("valid"), F.round(valid / F.count("*"), 6).alias("rate"))


@query(
    O
    + """, e as (select run_id, camera_id, min(frame_number) as f0, max(frame_number) as f1, arg_min(timestamp_seconds, frame_number * 1000000 + timestamp_seconds) as t0, arg_max(timestamp_seconds, frame_number * 1000000 + timestamp_seconds) as t1 from o group by 1, 2)
    select run_id, camera_id, case when t1 > t0 then round((f1 - f0) / (t1 - t0), 6) end as fps from e"""
)
def frame_rates(spark, sf_dir):
    """Frames a second of each run and camera between its first and last frame."""
    return reporting.frame_rate(observations(spark, sf_dir), "run_id", "camera_id")


@query(
    O
    + """, c as (select track_no, frame_number, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy from o),
    s as (select track_no, sqrt(pow(cx - lag(cx) over w, 2) + pow(cy - lag(cy) over w, 2)) as way, frame_number - lag(frame_number) over w as gap from c window w as (partition by track_no order by frame_number))
    select track_no, count(way) as steps, round(quantile_cont(way, 0.5), 6) as median_step, count(*) filter (gap > 1) as reactivations from s group by 1"""
)
def track_steps(spark, sf_dir):
    """Median way between the frames of a track, and how often frames are missing."""
    return reporting.steps(observations(spark, sf_dir), "track_no")


@query(
    O
    + """, d as (select * from o where frame_number % 3 <> 0), s as (select track_no, frame_number - lag(frame_number) over (partition by track_no order by frame_number) as gap from d)
    select track_no, count(*) filter (gap > 1) as reactivations from s group by 1"""
)
def reactivations(spark, sf_dir):
    """How often a track comes back after missing frames; every third frame counts as missed."""
    return reporting.steps(observations(spark, sf_dir).where("frame_number % 3 <> 0"), "track_no").select("track_no", "reactivations")


@query(
    O
    + """, c as (select *, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy from o), m as (select track_no, quantile_cont(cx, 0.5) as mx, quantile_cont(cy, 0.5) as my, (max(x2) - min(x1)) * (max(y2) - min(y1)) as footprint from c group by 1)
    select track_no, round(mx, 6) as mx, round(my, 6) as my, round(quantile_cont(sqrt(pow(cx - mx, 2) + pow(cy - my, 2)), 0.75), 6) as p75, round(footprint, 6) as footprint from c join m using (track_no) group by track_no, mx, my, footprint"""
)
def track_spread(spark, sf_dir):
    """Median centre, spread and footprint of each track."""
    return reporting.spread(observations(spark, sf_dir), "track_no")


@query(
    """with x as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as place from embeddings)
    select label, cast(place as int) as place, round(avg(cast(x as double)), 6) as mean from x group by 1, 2"""
)
def vector_means(spark, sf_dir):
    """The mean vector of each label, place by place."""
    return reporting.vector_means(read(spark, sf_dir, "embeddings"), "label", "embedding")


_TWO = ALL + ", t as (select run_id, vehicle_class as a, case when track_no % 11 = 0 then 'UNKNOWN' when track_no % 7 = 0 then 'CAR' else vehicle_class end as b from v) "


@query(_TWO + "select run_id, count(*) filter (a = b) as equal, count(*) filter (a <> 'UNKNOWN' and b <> 'UNKNOWN' and a <> b) as different, count(*) filter (a <> 'UNKNOWN' and b = 'UNKNOWN') as only_first, count(*) filter (a = 'UNKNOWN' and b <> 'UNKNOWN') as only_second from t group by 1")
def backend_disagreement(spark, sf_dir):
    """How two backends' classes compare in each run."""
    other = F.when(F.col("track_no") % 11 == 0, "UNKNOWN").when(F.col("track_no") % 7 == 0, "CAR").otherwise(F.col("vehicle_class"))
    return reporting.disagreements(vehicle_records(spark, sf_dir).select("run_id", F.col("vehicle_class").alias("a"), other.alias("b")), "a", "b", "run_id")


@query(
    O
    + """, c as (select track_no, upper(raw_class_name) as label, sum(confidence) as s, count(*) as n from o group by 1, 2),
    k as (select *, row_number() over (partition by track_no order by n desc, label) as k from c) select track_no, label, round(greatest(0, least(1, s / n)), 6) as confidence from k where k = 1"""
)
def class_confidence(spark, sf_dir):
    """The mean confidence of a track's most frequent class, between 0 and 1."""
    votes = observations(spark, sf_dir).groupBy("track_no", F.upper("raw_class_name").alias("label")).agg(F.sum("confidence").alias("s"), F.count("*").alias("n"))
    best = votes.groupBy("track_no").agg(F.min(F.struct((-F.col("n")).alias("n"), "label", "s")).alias("w"))
    mean = F.try_divide(F.col("w.s"), -F.col("w.n"))
    return best.select("track_no", "w.label", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)), 6).alias("confidence"))


@query(O + "select camera_id, count(distinct frame_number) as frames from o where frame_number between 10 and 400 and (frame_number - 10) % 15 = 0 group by 1")
def frame_range_sampling(spark, sf_dir):
    """Frames from 10 to 400 in steps of 15 that a camera has."""
    frame = F.col("frame_number")
    return observations(spark, sf_dir).where(frame.between(10, 400) & ((frame - 10) % 15 == 0)).groupBy("camera_id").agg(F.count_distinct("frame_number").alias("frames"))


@query(
    O
    + """, b as (select track_no, frame_number, x1, y1, x2, y2, confidence, row_number() over (partition by track_no order by confidence desc, frame_number) as k from o)
    select track_no, frame_number, greatest(0, least(x1, 20000)) as x1, greatest(0, least(x2, 20000)) as x2, case when confidence < 0.6 then 'low_confidence' when x2 - x1 < 12 or y2 - y1 < 24 then 'too_small' else 'accepted' end as quality from b where k = 1"""
)
def plate_detection_choice(spark, sf_dir):
    """The surest box of each track, held inside the frame, with its quality."""
    best = observations(spark, sf_dir).groupBy("track_no").agg(F.max(F.struct("confidence", (-F.col("frame_number")).alias("f"), "x1", "y1", "x2", "y2")).alias("b"))
    wide, high = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.col(c), F.lit(20000.0)))
    quality = F.when(F.col("b.confidence") < 0.6, "low_confidence").when((wide < 12) | (high < 24), "too_small").otherwise("accepted")
    return best.select("track_no", (-F.col("b.f")).alias("frame_number"), held("b.x1").alias("x1"), held("b.x2").alias("x2"), quality.alias("quality"))


@query(
    O
    + """, c as (select camera_id, count(*) filter (confidence < 0.6) as wrong, count(distinct track_no) as fragments from o group by 1)
    select camera_id, wrong, fragments from c order by wrong, fragments, camera_id limit 1"""
)
def threshold_decision(spark, sf_dir):
    """The setting with the fewest wrong continuations, then the fewest fragments."""
    rows = observations(spark, sf_dir).groupBy("camera_id").agg(F.count_if(F.col("confidence") < 0.6).alias("wrong"), F.count_distinct("track_no").alias("fragments"))
    return reporting.best_profile(rows, F.col("wrong"), F.col("fragments"), F.col("camera_id"))


@query(
    O
    + """, m as (select run_id, map([concat(camera_id, '_', raw_class_name)], [count(*)]) as counts from o group by run_id, camera_id, raw_class_name)
    select run_id, cast(sum(list_sum(map_values(counts))) as bigint) as total from m group by 1"""
)
def map_metric_sum(spark, sf_dir):
    """The sum over all values of a run's map of counts."""
    counts = observations(spark, sf_dir).groupBy("run_id", F.concat_ws("_", "camera_id", "raw_class_name").alias("k")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counts"))  # as many entries as cameras and classes
    return maps.select("run_id", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
