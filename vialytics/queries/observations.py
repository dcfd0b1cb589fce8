"""Queries over observations: life cycles, classes, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, tracks, votes
from ..sources.testdata import DETECTIONS, OBSERVATIONS, detections, observations
from .registry import query

O = f"with o as ({OBSERVATIONS}) "  # noqa: E741
D = f"with d as ({DETECTIONS}), f as (select distinct camera_id, frame_number from d) "


@query(D + ", p as (select *, lag(frame_number) over (partition by camera_id order by event_id % 10, event_id) as previous_frame from d) select camera_id, event_id, frame_number, previous_frame from p where frame_number < previous_frame")
def order_violations(spark, sf_dir):
    return tracks.order_violations(detections(spark, sf_dir).withColumn("arrival", F.struct(F.col("event_id") % 10, "event_id")), ["camera_id"], "arrival").select("camera_id", "event_id", "frame_number", "previous_frame")


def _frames(rows):
    return rows.select("camera_id", "frame_number").distinct()


_LIFE = (
    D
    + """, i as (select *, row_number() over (partition by camera_id order by frame_number) as idx, count(*) over (partition by camera_id) as last_idx from f),
    k as (select d.*, idx, last_idx from d join i using (camera_id, frame_number)),
    s as (select *, case when idx - lag(idx) over (partition by camera_id, native_id order by idx) > 31 or lag(idx) over (partition by camera_id, native_id order by idx) is null then 1 else 0 end as st from k),
    p as (select *, sum(st) over (partition by camera_id, native_id order by idx) as part from s),
    t as (select camera_id, native_id, part, min(idx) as first_idx, max(idx) as end_idx, min(frame_number) as first_frame, max(frame_number) as last_frame, count(*) as observations, max(last_idx) as li from p group by 1, 2, 3),
    life as (select camera_id, native_id, cast(part as bigint) as part, row_number() over (partition by camera_id order by first_idx, native_id) as track_number, first_frame, last_frame, observations,
      case when observations >= 3 then 'COMPLETED' else 'DISCARDED' end as status,
      case when li - end_idx <= 30 then 'END_OF_STREAM' when observations >= 3 then 'LOST_TIMEOUT' else 'INSUFFICIENT_OBSERVATIONS' end as reason from t) """
)


def _life(spark, sf_dir):
    rows = detections(spark, sf_dir)
    return tracks.lifecycles(rows, _frames(rows))


@query(_LIFE + "select * from life")
def lifecycle_islands(spark, sf_dir):
    return _life(spark, sf_dir)


@query(
    _LIFE
    + """select camera_id, count(*) filter (status = 'COMPLETED') as completed, count(*) filter (status = 'DISCARDED') as discarded,
    count(*) filter (reason = 'LOST_TIMEOUT') as lost_timeouts, avg(observations) as mean_observations from life group by 1"""
)
def lifecycle_metrics(spark, sf_dir):
    return tracks.lifecycle_metrics(_life(spark, sf_dir))


@query(
    O
    + """, c as (select track_no, raw_class_name, sum(cast(round(confidence, 2) as decimal(10, 2))) as w, count(*) as n from o group by 1, 2),
    r as (select *, row_number() over (partition by track_no order by w desc, raw_class_name desc) as p from c),
    t as (select track_no, sum(n) as obs, max(case when p = 1 then raw_class_name end) as winner, max(case when p = 1 then n end) as wn, max(case when p = 1 then w end) as w1, max(case when p = 2 then w end) as w2 from r group by 1)
    select track_no, cast(obs as bigint) as observations, case when obs < 3 or wn / obs < 0.60e0 or coalesce(w1 <= w2, false) then 'UNKNOWN' else winner end as final_class,
    case when obs < 3 then 'INSUFFICIENT_OBSERVATIONS' when wn / obs < 0.60e0 then 'WINNER_RATIO_TOO_LOW' when w1 <= w2 then 'NO_CLEAR_WINNER' else 'WEIGHTED_MAJORITY' end as reason from t"""
)
def lifecycle_final_class(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("confidence", F.round("confidence", 2).cast("decimal(10,2)"))
    return tracks.final_class(rows, "track_no")


@query(
    O
    + """, c as (select track_no, raw_class_name, count(*) as n from o group by 1, 2)
    select track_no, min(frame_number) as first_frame, max(frame_number) as last_frame, count(*) as observations, avg(confidence) as mean_confidence,
    (select string_agg(concat(raw_class_name, '=', cast(n as varchar)), ',' order by raw_class_name) from c where c.track_no = o.track_no) as class_counts from o group by track_no"""
)
def track_rebuild(spark, sf_dir):
    return tracks.rebuilt(observations(spark, sf_dir), "track_no")


_IOU = """greatest(0, least(x2, px2) - greatest(x1, px1)) * greatest(0, least(y2, py2) - greatest(y1, py1))"""


@query(
    O
    + f""", n as (select camera_id, raw_class_name, frame_number, avg(x1) as x1, avg(y1) as y1, avg(x2) as x2, avg(y2) as y2 from o group by 1, 2, 3),
    p as (select *, lag(frame_number) over w as pf, lag(x1) over w as px1, lag(y1) over w as py1, lag(x2) over w as px2, lag(y2) over w as py2 from n window w as (partition by camera_id, raw_class_name order by frame_number)),
    q as (select *, {_IOU} as i from p where frame_number - pf > 1)
    select camera_id, raw_class_name, frame_number, frame_number - pf as gap, i / ((x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - i) as overlap from q
    where i / ((x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - i) < 0.12"""
)
def suspected_switches(spark, sf_dir):
    keys = ["camera_id", "raw_class_name", "frame_number"]
    mean = observations(spark, sf_dir).groupBy(*keys).agg(*(F.avg(c).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return tracks.suspected_switches(mean, "camera_id", "raw_class_name")


@query(
    D
    + """, i as (select *, row_number() over (partition by camera_id order by frame_number) as idx, count(*) over (partition by camera_id) as last_idx from f),
    k as (select distinct camera_id, native_id, idx, last_idx from d join i using (camera_id, frame_number)),
    a as (select camera_id, idx, not exists (select 1 from k b where b.camera_id = k.camera_id and b.native_id = k.native_id and b.idx < k.idx) as n,
      not exists (select 1 from k b where b.camera_id = k.camera_id and b.native_id = k.native_id and b.idx = k.idx - 1) and exists (select 1 from k b where b.camera_id = k.camera_id and b.native_id = k.native_id and b.idx < k.idx) as r, false as l from k
      union all select camera_id, idx + 1, false, false, true from k where idx < last_idx and not exists (select 1 from k b where b.camera_id = k.camera_id and b.native_id = k.native_id and b.idx = k.idx + 1))
    select camera_id, frame_number, count(*) filter (n) as new_ids, count(*) filter (r) as back_ids, count(*) filter (l) as lost_ids from a join i using (camera_id, idx) group by 1, 2"""
)
def frame_arrivals(spark, sf_dir):
    rows = detections(spark, sf_dir)
    return tracks.arrivals(rows, _frames(rows))


#: An observation's sharpness is made from its weight; frames are 20000 by 2000 pixels.
FRAME = (20000.0, 2000.0)
_SCORED = (
    O
    + """, a as (select *, weight * 10 + 1 as sharpness, greatest(0, x2 - x1) * greatest(0, y2 - y1) as bbox_area from o),
    s as (select *, 0.35e0 * least(1, greatest(0, confidence)) + 0.25e0 * least(1, sharpness / max(sharpness) over t) + 0.20e0 * least(1, bbox_area / max(bbox_area) over t)
      + 0.10e0 * greatest(0, least(1, 1 - sqrt(pow((x1 + x2) / 2 - 10000, 2) + pow((y1 + y2) / 2 - 1000, 2)) / sqrt(1e8 + 1e6)))
      + 0.10e0 * greatest(0, least(1, x1 / greatest(1, x2 - x1), (20000 - x2) / greatest(1, x2 - x1), y1 / greatest(1, y2 - y1), (2000 - y2) / greatest(1, y2 - y1))) as overall from a window t as (partition by track_no)) """
)


def _scored(spark, sf_dir):
    return evidence.scored(observations(spark, sf_dir).withColumn("sharpness", F.col("weight") * 10 + 1), "track_no", *FRAME)


@query(_SCORED + "select track_no, frame_number, round(overall, 9) as overall from s")
def evidence_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("track_no", "frame_number", F.round("overall", 9).alias("overall"))


_ROLES = _SCORED + (
    ", r as (select *, round(overall, 9) as ov, (min(frame_number) over (partition by track_no) + max(frame_number) over (partition by track_no)) / 2.0 as mid from s) "
    + " union all ".join(
        f"select track_no, '{role}' as role, frame_number from (select *, row_number() over (partition by track_no order by {order}) as p from r) x where p = 1"
        for role, order in {
            "FIRST": "frame_number",
            "MIDDLE": "abs(frame_number - mid), frame_number",
            "LAST": "frame_number desc",
            "HIGHEST_CONFIDENCE": "confidence desc, frame_number",
            "LARGEST": "bbox_area desc, frame_number",
            "SHARPEST": "sharpness desc, frame_number",
            "BEST_OVERALL": "ov desc, confidence desc, frame_number",
        }.items()
    )
)


@query(_ROLES)
def evidence_roles(spark, sf_dir):
    return evidence.roles(_scored(spark, sf_dir).withColumn("overall", F.round("overall", 9)), "track_no")


_ZONE = (
    O
    + """, a as (select *, case when y2 < 60 then 'above' when y2 > 90 then 'below' else 'inside' end as pos from o),
    b as (select *, lag(pos) over (partition by track_no order by frame_number) as bef from a),
    z as (select track_no, count(*) filter (pos = 'inside' and bef is distinct from 'inside') as entries, count(*) filter (pos = 'below' and bef is not distinct from 'inside') as exits,
      min(case when pos = 'inside' and bef is distinct from 'inside' then frame_number end) as first_entry, max(case when pos = 'below' and bef is not distinct from 'inside' then frame_number end) as last_exit,
      max(y2) as max_trigger_y, arg_max(frame_number, y2 * 100000 + frame_number) as frame_of_max, count(*) filter (pos = 'inside') as candidates from b group by 1) """
)


@query(_ZONE + "select * from z")
def zone_enter_exit(spark, sf_dir):
    return evidence.zone_events(observations(spark, sf_dir), "track_no", 60.0, 90.0)


@query(
    _ZONE
    + """, e as (select track_no, count(*) filter (y2 between 60 and 90 and x2 - x1 >= 25) as eligible, max(case when status = 'DISCARDED' then 'LOST_TIMEOUT' end) as reason from o group by 1)
    select track_no, case when max_trigger_y < 60 and reason = 'LOST_TIMEOUT' then 'TRACK_ENDED_BEFORE_ZONE' when max_trigger_y < 60 then 'NEVER_REACHED_ZONE' when candidates = 0 then 'REACHED_ZONE_NO_CAPTURE'
      when eligible > 0 then 'CAPTURED_ELIGIBLE' else 'CAPTURED_TOO_SMALL' end as geometry_status from z join e using (track_no)"""
)
def geometry_status(spark, sf_dir):
    rows = observations(spark, sf_dir)
    usable = F.col("y2").between(60, 90) & (F.col("x2") - F.col("x1") >= 25)
    more = rows.groupBy("track_no").agg(F.count_if(usable).alias("eligible"), F.max(F.when(F.col("status") == "DISCARDED", "LOST_TIMEOUT")).alias("reason"))
    return evidence.geometry_status(evidence.zone_events(rows, "track_no", 60.0, 90.0).join(more, "track_no"), 60.0).select("track_no", "geometry_status")


@query(_ZONE + "select cast(least(4, greatest(0, floor(max_trigger_y / 150 * 5))) as bigint) as bin, count(*) as tracks from z group by 1")
def trigger_histogram(spark, sf_dir):
    return evidence.trigger_histogram(evidence.zone_events(observations(spark, sf_dir), "track_no", 60.0, 90.0), 150.0)


@query(_ROLES.replace("select track_no, 'FIRST'", ", x as (select track_no, 'FIRST'", 1) + ") select track_no, count(*) as items, string_agg(distinct role, ',' order by role) as roles, count(distinct frame_number) as frames from x group by 1")
def evidence_summary(spark, sf_dir):
    return evidence.summary(evidence.roles(_scored(spark, sf_dir).withColumn("overall", F.round("overall", 9)), "track_no"), "track_no")


@query()
def evidence_pool(spark, sf_dir):
    """What an online pool of three keeps of each track; held against a plain pool by tests."""
    rows = evidence.instantaneous(observations(spark, sf_dir).withColumn("sharpness", F.col("weight") * 10 + 1), *FRAME)
    return evidence.bounded_pool(rows, "track_no", 3).select("track_no", "frame_number", F.round("instant", 6).alias("instant"))


@query(
    O
    + """, c as (select *, greatest(0, least(20000, floor(x1 - greatest((x2 - x1) * 0.08, 8)))) as a, greatest(0, least(2000, floor(y1 - greatest((y2 - y1) * 0.08, 8)))) as b,
      greatest(0, least(20000, ceil(x2 + greatest((x2 - x1) * 0.08, 8)))) as c, greatest(0, least(2000, ceil(y2 + greatest((y2 - y1) * 0.08, 8)))) as d from o)
    select track_no, frame_number, round(1000 * confidence + 0.5 * (weight * 10 + 1) + 0.01 * (c - a) * (d - b) + 100 * greatest(0, least(1, 1 - sqrt(pow((x1 + x2) / 2 - 10000, 2) + pow((y1 + y2) / 2 - 1000, 2)) / sqrt(1e8 + 1e6)))
      + 100 * greatest(0, least(1, x1 / greatest(1, x2 - x1), (20000 - x2) / greatest(1, x2 - x1), y1 / greatest(1, y2 - y1), (2000 - y2) / greatest(1, y2 - y1))), 6) as instant from c"""
)
def evidence_instant_scores(spark, sf_dir):
    """The score of every observation as it comes."""
    rows = evidence.instantaneous(observations(spark, sf_dir).withColumn("sharpness", F.col("weight") * 10 + 1), *FRAME)
    return rows.select("track_no", "frame_number", F.round("instant", 6).alias("instant"))


@query()
def evidence_spaced(spark, sf_dir):
    return evidence.spaced(_scored(spark, sf_dir), "track_no", 2, 1).select("track_no", "frame_number", "overall")


_PRED = O + ", p as (select track_no, frame_number, case when raw_class_name = 'truck' and line_status = 'O' then 'UNKNOWN' else upper(raw_class_name) end as label, round(weight, 3) as weight, confidence from o) "


def _predictions(spark, sf_dir):
    label = F.when((F.col("raw_class_name") == "truck") & (F.col("line_status") == "O"), "UNKNOWN").otherwise(F.upper("raw_class_name"))
    return observations(spark, sf_dir).select("track_no", "frame_number", label.alias("label"), F.round("weight", 3).alias("weight"), "confidence")


@query(
    _PRED
    + """, v as (select track_no, label, round(sum(weight), 6) as w from p where label <> 'UNKNOWN' group by 1, 2),
    r as (select *, row_number() over (partition by track_no order by w desc, label desc) as k from v),
    t as (select track_no, max(case when k = 1 then label end) as top, max(case when k = 1 then w end) as a, max(case when k = 2 then w end) as b, sum(w) as total from r group by 1),
    d as (select *, case when b is null and a < 0.40 then 'single_weak_prediction' when b is null then 'weighted_agreement' when round(a - b, 6) <= greatest(0.05, round(0.15 * a, 6)) then 'conflicting_high_quality_predictions'
      when a / nullif(total, 0) >= 0.60 then 'weighted_majority' else 'insufficient_agreement' end as reason from t)
    select track_no, case when reason in ('weighted_agreement', 'weighted_majority') then top else 'UNKNOWN' end as label, reason from d"""
)
def colour_vote(spark, sf_dir):
    rows = _predictions(spark, sf_dir).withColumn("weight", F.col("weight").cast("decimal(20,6)"))
    return votes.weighted_vote(rows, "track_no").select("track_no", "label", "reason")


@query(_PRED + "select track_no, label from (select *, row_number() over (partition by track_no order by case when frame_number % 9 = 0 then -1 else confidence end desc, case when frame_number % 7 = 0 then -1 else weight end desc, label desc) as k from p) r where k = 1")
def best_prediction(spark, sf_dir):
    """The label of each track's surest prediction, then of the heaviest; missing numbers come last."""
    gaps = {c: F.when(F.col("frame_number") % n != 0, F.col(c)) for c, n in (("confidence", 9), ("weight", 7))}
    return votes.best_label(_predictions(spark, sf_dir).withColumns(gaps), "track_no")


@query(_PRED + "select track_no, arg_min(label, frame_number) as label, min(frame_number) as used from p where label <> 'UNKNOWN' group by 1")
def adaptive_first_valid(spark, sf_dir):
    return votes.first_valid(_predictions(spark, sf_dir), "track_no", "frame_number")


@query(
    _PRED
    + """, c as (select track_no, label, count(*) as n from p group by 1, 2)
    select track_no, case when count(*) filter (label <> 'UNKNOWN') = 0 then 'all_unknown' when count(*) filter (label = 'UNKNOWN') > 0 then 'mixture' when count(*) = 1 then 'unanimous' else 'mixed' end as agreement,
    max(n) / sum(n) * 100.0e0 as percent from c group by 1"""
)
def track_unanimity(spark, sf_dir):
    return votes.unanimity(_predictions(spark, sf_dir), "track_no")
