"""Queries around transitions: consecutive tracks of one owner, at most 40 frames apart. Detections are the observations of all tracks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import transitions
from ..sources.shared import written
from ..sources.testdata import OBSERVATIONS, observations
from .registry import query

ACTIVATION = 0.6
_OBS = f"o as (select run_id, camera_id, track_no, owner, frame_number, timestamp_seconds, x1, y1, x2, y2, confidence, raw_class_name as class_name, (track_no + frame_number) % 4 <> 0 as passed from ({OBSERVATIONS}) ob join (select o_orderkey, o_custkey as owner from orders) oo on o_orderkey = track_no)"
_BOUNDS = f"""{_OBS},
  e as (select run_id, camera_id, owner, track_no, min(frame_number) as ff, max(frame_number) as lf, arg_min(timestamp_seconds, frame_number) as fs, arg_max(timestamp_seconds, frame_number) as ls from o group by 1, 2, 3, 4),
  n as (select *, lead(track_no) over w as new_no, lead(ff) over w as nff, lead(lf) over w as nlf, lead(fs) over w as nfs from e window w as (partition by run_id, camera_id, owner order by ff, track_no)),
  b0 as (select run_id, camera_id, track_no as old_no, new_no, ff as old_first_frame, lf as old_last_frame, ls as old_last_seconds, nff as new_first_frame, nlf as new_last_frame, nfs as new_first_seconds, nff - lf as gap_frames, nfs - ls as gap_seconds from n where nff - lf between 1 and 40),
  b as (select b0.*, t_x1, t_y1, t_x2, t_y2 from b0 join (select old_no, new_no, quantile_cont(x1, 0.5) as t_x1, quantile_cont(y1, 0.5) as t_y1, quantile_cont(x2, 0.5) as t_x2, quantile_cont(y2, 0.5) as t_y2 from b0 join o on track_no in (old_no, new_no) group by 1, 2) t using (old_no, new_no))"""
_IOU = "greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)) / nullif(({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)), 0)"
_STATE = "case when {w}_seen then 'ACTIVE' when frame_number < {w}_first_frame then 'NOT_CREATED' when frame_number <= {w}_last_frame + 40 then 'LOST' else 'COMPLETED' end as {w}_state"
_WINDOWS = f"""{_BOUNDS},
  f as (select *, unnest(generate_series(greatest(0, old_last_frame - 10), new_first_frame + 10)) as frame_number from b),
  d as (select f.old_no, f.new_no, o.*, coalesce({_IOU.format(a="o.", b="t_")}, 0) as target_iou, (x1 + x2) / 2 between t_x1 - 80 and t_x2 + 80 and (y1 + y2) / 2 between t_y1 - 80 and t_y2 + 80 as near from f join o using (run_id, camera_id, frame_number)),
  c as (select old_no, new_no, frame_number, count(*) as raw_count, count(*) filter (passed) as passed_count, max({{'passed': passed, 'target_iou': target_iou, 'confidence': confidence, 'class_name': class_name, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) as best
    from d where class_name in ('truck', 'bus', 'car') and (target_iou >= 0.08 or near) group by 1, 2, 3),
  g as (select f.*, raw_count, passed_count, best, last_value(best ignore nulls) over (partition by old_no, new_no order by frame_number rows between unbounded preceding and 1 preceding) as prev,
    exists (select 1 from o where track_no = old_no and o.frame_number = f.frame_number) as old_seen, exists (select 1 from o where track_no = new_no and o.frame_number = f.frame_number) as new_seen from f left join c using (old_no, new_no, frame_number)),
  h as (select *, coalesce(best.x1, t_x1) as p_x1, coalesce(best.y1, t_y1) as p_y1, coalesce(best.x2, t_x2) as p_x2, coalesce(best.y2, t_y2) as p_y2, best is not null and prev is not null as two from g),
  x as (select old_no, new_no, frame_number, count(*) as others from h join o using (run_id, camera_id, frame_number) where class_name not in ('truck', 'bus') and {_IOU.format(a="o.", b="p_")} > 0.05 group by 1, 2, 3),
  w as (select run_id, camera_id, old_no, new_no, frame_number, frame_number > old_last_frame and frame_number < new_first_frame as in_gap, coalesce(raw_count, 0) as raw_count, coalesce(passed_count, 0) as passed_count, best.class_name as primary_class, best.confidence as primary_confidence,
    case when best is null then 'missing' when best.confidence > {ACTIVATION} then 'high_confidence_path' when best.confidence > 0.1 then 'low_confidence_path' else 'below_bytetrack_low_confidence' end as band,
    case when two then coalesce({_IOU.format(a="best.", b="prev.")}, 0) end as iou, case when two then sqrt(((best.x1 + best.x2) / 2 - (prev.x1 + prev.x2) / 2) ** 2 + ((best.y1 + best.y2) / 2 - (prev.y1 + prev.y2) / 2) ** 2) end as shift,
    case when two then (best.x2 - best.x1) / (prev.x2 - prev.x1) end as width_ratio, case when two then (best.y2 - best.y1) / (prev.y2 - prev.y1) end as height_ratio, case when two then (best.x2 - best.x1) * (best.y2 - best.y1) / ((prev.x2 - prev.x1) * (prev.y2 - prev.y1)) end as area_ratio,
    {_STATE.format(w="old")}, {_STATE.format(w="new")}, coalesce(others, 0) as others from h left join x using (old_no, new_no, frame_number))"""
_ROUNDED = ("primary_confidence", "iou", "shift", "width_ratio", "height_ratio", "area_ratio")


def _seen(spark, sf_dir):
    return written(observations(spark, sf_dir).withColumnRenamed("raw_class_name", "class_name").withColumn("passed", (F.col("track_no") + F.col("frame_number")) % 4 != 0), "seen")


def bounds(spark, sf_dir, seen):
    """Boundaries of the transitions of seen observations."""
    owners = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("track_no"), F.col("o_custkey").alias("owner"))
    ends = seen.groupBy("run_id", "camera_id", "track_no").agg(F.min("frame_number").alias("first"), F.max("frame_number").alias("last")).join(owners, "track_no")
    own = Window.partitionBy("run_id", "camera_id", "owner").orderBy("first", "track_no")
    pairs = ends.withColumns({"new_no": F.lead("track_no").over(own), "gap": F.lead("first").over(own) - F.col("last")}).where("gap between 1 and 40")
    return transitions.boundaries(pairs.select("run_id", "camera_id", F.col("track_no").alias("old_no"), "new_no"), seen)


def _windows(spark, sf_dir, seen=None, found=None):
    seen = seen or _seen(spark, sf_dir)
    detected = seen.select(*transitions.FRAME, "class_name", "confidence", "passed", *(F.col(c).cast("double").alias(c) for c in transitions.BOX))
    return transitions.frame_windows(found or bounds(spark, sf_dir, seen), detected, seen, ACTIVATION)


@query(f"with {_BOUNDS} select run_id, camera_id, old_no, new_no, old_last_frame, old_last_seconds, new_first_frame, new_first_seconds, gap_frames, gap_seconds, round(t_x1, 6) as t_x1, round(t_y1, 6) as t_y1, round(t_x2, 6) as t_x2, round(t_y2, 6) as t_y2 from b")
def transition_boundaries(spark, sf_dir):
    """Where one track of an owner ends and the next begins."""
    rows = bounds(spark, sf_dir, _seen(spark, sf_dir))
    return rows.select("run_id", "camera_id", "old_no", "new_no", "old_last_frame", "old_last_seconds", "new_first_frame", "new_first_seconds", "gap_frames", "gap_seconds", *(F.round(f"t_{c}", 6).alias(f"t_{c}") for c in transitions.BOX))


@query(f"with {_WINDOWS} select * replace ({', '.join(f'round({c}, 6) as {c}' for c in _ROUNDED)}) from w")
def transition_windows(spark, sf_dir):
    """Every frame around the transitions: the detection that matters, its change, and the states of both tracks."""
    return _windows(spark, sf_dir).withColumns({c: F.round(c, 6) for c in _ROUNDED})


_SUMMARIES = f"""{_WINDOWS}, s0 as (select run_id, camera_id, old_no, new_no, coalesce(list(frame_number order by frame_number) filter (in_gap and primary_confidence is null), []) as missing, coalesce(list(frame_number order by frame_number) filter (in_gap and primary_confidence <= {ACTIVATION}), []) as low,
    min(iou) as least_iou, max(others) as most_others from w group by 1, 2, 3, 4),
  s as (select *, case when len(missing) > 0 then '{transitions.DROPOUT}' when len(low) > 0 then '{transitions.WEAK}' when least_iou < 0.45 then '{transitions.UNSTABLE}' when old_no % 3 = 0 then '{transitions.ASSOCIATION}' else '{transitions.SEVERAL}' end as root_cause from s0)"""


def _summaries(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    found = written(bounds(spark, sf_dir, seen), "bounds")
    return transitions.transition_summaries(_windows(spark, sf_dir, seen, found), ACTIVATION, found.where("old_no % 3 = 0"))


@query(f"with {_SUMMARIES} select run_id, camera_id, old_no, new_no, array_to_string(missing, ',') as missing_frames, array_to_string(low, ',') as low_frames, round(least_iou, 6) as least_iou, most_others, len(missing) > 0 as dropout, least_iou < 0.45 as box_jump, most_others > 0 as occlusion, root_cause from s")
def transition_summaries(spark, sf_dir):
    """Missing and weak frames of each transition and its root cause."""
    lists = {c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("missing_frames", "low_frames")}
    return _summaries(spark, sf_dir).withColumns(lists | {"least_iou": F.round("least_iou", 6)})


@query(
    f"""with {_SUMMARIES} select run_id, camera_id, count(*) as transitions, case when min(root_cause) = max(root_cause) then min(root_cause) when bool_or(root_cause like '%DROPOUT%') and bool_or(root_cause like '%LOW-CONFIDENCE%') then '{transitions.DROPOUT_AND_WEAK.replace("'", "''")}'
    when bool_or(root_cause like '%LOW-CONFIDENCE%') then '{transitions.WEAK}' else '{transitions.SEVERAL}' end as conclusion from s group by 1, 2"""
)
def transition_conclusions(spark, sf_dir):
    """What the transitions of a camera amount to."""
    return transitions.conclusions(_summaries(spark, sf_dir), ["run_id", "camera_id"])
