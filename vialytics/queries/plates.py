"""Queries over number plates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plates as text
from ..operators import plates
from ..sources.shared import written
from ..sources.testdata import OBSERVATIONS, VEHICLES, observations, vehicle_records
from .registry import query

ALL = f"with v as ({VEHICLES}) "
_STATES = ", ".join(f"'{s}'" for s in text.STATES)


@query(ALL + "select run_id, vehicle_id, nullif(regexp_replace(upper(' ' || lower(plate_text) || '-x'), '[^A-Z0-9]+', '', 'g'), '') as normalized, upper(plate_text) as shown from v")
def plate_normalise(spark, sf_dir):
    noisy = F.concat(F.lit(" "), F.lower("plate_text"), F.lit("-x"))
    return vehicle_records(spark, sf_dir).select("run_id", "vehicle_id", text.normalized(noisy).alias("normalized"), text.display(F.col("plate_text")).alias("shown"))


_VALID = f"regexp_matches(plate_text, '{text.STANDARD}') and substr(plate_text, 1, 2) in ({_STATES})"


@query(ALL + f"select run_id, vehicle_id, case when {_VALID} then 'standard_private' when regexp_matches(plate_text, '{text.BHARAT}') then 'bharat_series' end as format from v where plate_text is not null")
def plate_direct_valid(spark, sf_dir):
    return vehicle_records(spark, sf_dir).where("plate_text is not null").select("run_id", "vehicle_id", text.format_of(text.normalized(F.col("plate_text"))).alias("format"))


@query()
def plate_corrections(spark, sf_dir):
    """Plates with look-alikes put in: 0 as O in the number, S as 5 in the letters."""
    noisy = F.when(F.col("track_no") % 3 == 0, F.regexp_replace("plate_text", "0$", "O")).when(F.col("track_no") % 3 == 1, F.regexp_replace("plate_text", "(?<=[0-9])S(?=[0-9])", "5")).otherwise(F.col("plate_text"))
    check = text.validated(noisy)
    return vehicle_records(spark, sf_dir).select("run_id", "vehicle_id", noisy.alias("read"), check.alias("c")).select("run_id", "vehicle_id", "read", "c.canonical", "c.valid", "c.corrected", "c.reason")


@query(
    ALL
    + f"""select run_id, count(*) as total, count(*) filter (plate_text is not null and {_VALID}) as valid, count(*) filter (plate_text is null or not ({_VALID})) as invalid,
    count(*) filter ({_VALID}) as standard, cast(0 as bigint) as bharat, cast(0 as bigint) as corrected from v group by 1"""
)
def plate_audit(spark, sf_dir):
    return plates.audit(vehicle_records(spark, sf_dir), "plate_text", "run_id")


#: A plate's box lies in the lower half of its vehicle's; owners are sought among the vehicles of the run, camera and frame.
_PLATE_BOXES = {"p_x1": "x1 + (x2 - x1) * 0.3", "p_y1": "y1 + (y2 - y1) * 0.6", "p_x2": "x1 + (x2 - x1) * 0.7", "p_y2": "y1 + (y2 - y1) * 0.8"}
_OWNED = f"with o as (select concat(run_id, '/', camera_id) as camera_id, frame_number, track_no, confidence, x1, y1, x2, y2, {', '.join(f'{e} as {n}' for n, e in _PLATE_BOXES.items())} from ({OBSERVATIONS}) q) "
_INTER = "(greatest(0, least(p.p_x2, v.x2) - greatest(p.p_x1, v.x1)) * greatest(0, least(p.p_y2, v.y2) - greatest(p.p_y1, v.y1)))"
_PAREA = "((p.p_x2 - p.p_x1) * (p.p_y2 - p.p_y1))"
_VAREA = "greatest(1, (v.x2 - v.x1) * (v.y2 - v.y1))"


@query(
    _OWNED
    + f""", s as (select p.camera_id, p.frame_number, p.track_no, v.track_no as owner, case when {_INTER} > 0 then {_INTER} / greatest({_PAREA}, 1) * 1.5
      + greatest(0, least(1, 1 - sqrt(pow(abs((p.p_x1 + p.p_x2) / 2 - (v.x1 + v.x2) / 2) / greatest(1, v.x2 - v.x1), 2) + pow(abs((p.p_y1 + p.p_y2) / 2 - (v.y1 + v.y2) / 2) / greatest(1, v.y2 - v.y1), 2)))) * 0.75
      + least(1, {_PAREA} / ({_VAREA} * 0.02)) * 0.35 + p.confidence * 0.25 end as score from o p join o v on p.camera_id = v.camera_id and p.frame_number = v.frame_number),
    r as (select *, row_number() over (partition by camera_id, frame_number, track_no order by round(score, 9) desc nulls last, owner) as k, max(case when owner = track_no then score end) over (partition by camera_id, frame_number, track_no) as own from s)
    select camera_id, frame_number, track_no, case when score is not null then owner end as owner, round(score, 6) as best_score,
    case when score is null then 'no_geometric_owner' when own is null then 'target_not_in_owner_pool' when owner <> track_no and round(score - own, 9) >= 0.05 then 'geometric_owner' else 'kept' end as verdict from r where k = 1"""
)
def plate_owner_argmax(spark, sf_dir):
    seen = observations(spark, sf_dir).select(F.concat("run_id", F.lit("/"), "camera_id").alias("camera_id"), "frame_number", "track_no", "confidence", "x1", "y1", "x2", "y2")
    rows = written(seen, "boxes")
    found = plates.owners(rows.selectExpr("camera_id", "frame_number", "track_no", "confidence", *(f"{e} as {n}" for n, e in _PLATE_BOXES.items())), rows)
    return found.withColumn("best_score", F.round("best_score", 6))


_READ = ALL + ", r as (select camera_id, substr(plate_text, 1, 3) as plate_text, track_no, first_seen_seconds * 10 as read_at, cast(track_no * 37 % 1000 as double) / 1000 as score from v where plate_text is not null)"


@query(
    _READ
    + """, s as (select *, case when read_at - lag(read_at) over w <= 2 then 0 else 1 end as st from r window w as (partition by camera_id, plate_text order by read_at, score desc, track_no)),
    c as (select *, sum(st) over (partition by camera_id, plate_text order by read_at, score desc, track_no rows unbounded preceding) as cluster from s),
    k as (select *, row_number() over (partition by camera_id, plate_text, cluster order by score desc, read_at, track_no) as place, min(track_no) over g <> max(track_no) over g as several from c window g as (partition by camera_id, plate_text, cluster)),
    m as (select *, max(case when place = 1 then score end) over g as s1, max(case when place = 2 then score end) over g as s2 from k window g as (partition by camera_id, plate_text, cluster))
    select camera_id, plate_text, track_no, read_at, score, cast(cluster as bigint) as cluster,
    case when not several then 'kept' when s1 - s2 < 0.03 then 'ambiguous_owner' when place = 1 then 'kept' else 'duplicate_owner' end as verdict from m"""
)
def plate_conflict_islands(spark, sf_dir):
    readings = vehicle_records(spark, sf_dir).where("plate_text is not null").selectExpr(
        "camera_id", "substr(plate_text, 1, 3) as plate_text", "track_no", "first_seen_seconds * 10 as read_at", "cast(track_no * 37 % 1000 as double) / 1000 as score"
    )
    return plates.conflicts(readings)


@query(
    ALL
    + """, c as (select vehicle_id, plate_text, plate_detected, cast(track_no % 100 as double) / 100 as det, case when track_no % 5 = 0 then null else cast(track_no * 7 % 100 as double) / 100 end as ocr, track_no % 2 = 0 as acc, case track_no % 7 when 0 then 'ocr_timeout' when 1 then 'Validated_x ' when 2 then null else 'completed' end as reason from v),
    t as (select *, not (lower(trim(coalesce(reason, ''))) in ('', 'ocr_completed', 'completed') or starts_with(lower(trim(coalesce(reason, ''))), 'validated_')) as other from c),
    s as (select *, case when plate_detected and length(plate_text) >= 6 and other then 0.15e0 when plate_detected and length(plate_text) >= 6 then 0.42e0 * det + 0.42e0 * coalesce(ocr, det) + 0.16e0 * case when acc then 1.0e0 else 0.35e0 end else 0 end as score from t)
    select vehicle_id, round(score, 6) as score, case when coalesce(plate_detected and length(plate_text) >= 6, false) = false then 'UNUSABLE' when other then 'LOW' when round(score, 9) >= 0.72 and det >= 0.70 and coalesce(ocr, det) >= 0.70 then 'HIGH' when round(score, 9) >= 0.55 then 'MEDIUM' else 'LOW' end as label from s"""
)
def plate_reliability(spark, sf_dir):
    det, ocr = (F.col("track_no") % 100).cast("double") / 100, F.when(F.col("track_no") % 5 != 0, (F.col("track_no") * 7 % 100).cast("double") / 100)
    seventh = F.col("track_no") % 7
    reason = F.when(seventh == 0, "ocr_timeout").when(seventh == 1, "Validated_x ").when(seventh != 2, "completed")
    score, label = plates.reliability(F.col("plate_text"), F.col("plate_detected"), det, ocr, F.col("track_no") % 2 == 0, reason)
    return vehicle_records(spark, sf_dir).select("vehicle_id", F.round(score, 6).alias("score"), label.alias("label"))
