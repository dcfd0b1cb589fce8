"""Queries for physical vehicles: a vehicle is the tracks of one owner in a run."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import identity
from ..sources.testdata import OBSERVATIONS, VEHICLES, observations, vehicle_records
from .registry import query

_QUALITY = "case when plate_text is null then 'UNUSABLE' when track_no % 3 = 0 then 'HIGH' when track_no % 3 = 1 then 'MEDIUM' else 'LOW' end"
_MEMBERS = f"""with v as ({VEHICLES}), c as (select track_no, count(*) as observation_count, min(frame_number) as first_frame, max(frame_number) as last_frame from ({OBSERVATIONS}) o group by 1),
  m as (select run_id, owner, vehicle_id as track_id, v.track_no, camera_id, vehicle_class, colour, first_seen_seconds as first_seen, coalesce(last_seen_seconds, first_seen_seconds) as last_seen, plate_text, plate_detected,
    {_QUALITY} as plate_quality, cast(track_no % 100 as double) / 100 as plate_confidence, coalesce(observation_count, 0) as observation_count, coalesce(first_frame, 0) as first_frame, coalesce(last_frame, 0) as last_frame
    from v left join c using (track_no) where status = 'COMPLETED') """
_KEY = ["run_id", "owner"]


def _members(spark, sf_dir):
    ends = observations(spark, sf_dir).groupBy("track_no").agg(F.count("*").alias("observation_count"), F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"))
    done = vehicle_records(spark, sf_dir).where("status = 'COMPLETED'").join(ends, "track_no", "left")
    return done.selectExpr(
        "run_id", "owner", "vehicle_id as track_id", "track_no", "camera_id", "vehicle_class", "colour", "first_seen_seconds as first_seen", "coalesce(last_seen_seconds, first_seen_seconds) as last_seen", "plate_text", "plate_detected",
        f"{_QUALITY} as plate_quality", "cast(track_no % 100 as double) / 100 as plate_confidence", "coalesce(observation_count, 0) as observation_count", "coalesce(first_frame, 0) as first_frame", "coalesce(last_frame, 0) as last_frame",
    )


def _vote(label):
    return f"select run_id, owner, {label} from (select *, row_number() over (partition by run_id, owner order by votes desc, {label}) as k from (select run_id, owner, {label}, sum(greatest(observation_count, 1)) as votes from m group by 1, 2, 3) a) b where k = 1"


@query(_MEMBERS + _vote("vehicle_class"))
def vehicle_weighted_vote(spark, sf_dir):
    """The class of each physical vehicle by the observations of its tracks."""
    return identity.weighted_label(_members(spark, sf_dir), _KEY, "vehicle_class")


_ROLLUP = (
    _MEMBERS
    + f""", a as (select run_id, owner, count(*) as member_track_count, min(first_seen) as first_seen, max(last_seen) as last_seen, min(first_frame) as first_frame, max(last_frame) as last_frame,
    string_agg(distinct camera_id, ',' order by camera_id) as camera_ids, string_agg(track_id, ',' order by first_frame, track_id) as member_track_ids, arg_min(camera_id, (first_frame, track_id)) as primary_camera_id,
    min(plate_text) filter (plate_quality = 'HIGH') as plate_text, coalesce(max(plate_confidence) filter (plate_quality = 'HIGH'), 0) as plate_confidence,
    max(case plate_quality when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end) as q from m group by 1, 2),
    r as (select * exclude (q), case q when 3 then 'HIGH' when 2 then 'MEDIUM' when 1 then 'LOW' else 'UNUSABLE' end as plate_quality, case when member_track_count > 1 then 'MERGED' else 'SINGLE_TRACK' end as identity_status from a join ({_vote("vehicle_class")}) x using (run_id, owner) join ({_vote("colour")}) y using (run_id, owner)) """
)


@query(_ROLLUP + "select * from r")
def physical_vehicle_rollup(spark, sf_dir):
    """Physical vehicles from member tracks; lists as text joined by commas."""
    rows = identity.rolled_up(_members(spark, sf_dir), _KEY)
    return rows.withColumns({c: F.concat_ws(",", c) for c in ("camera_ids", "member_track_ids")})


@query(
    _ROLLUP
    + """select count(*) as completed_tracks, count(*) filter (plate_detected) as with_plate, count(plate_text) as with_text, count(*) filter (plate_quality = 'HIGH') as with_high_quality,
    (select count(*) from r) as vehicles, (select count(*) from r where member_track_count > 1) as merged_vehicles, count(*) - (select count(*) from r) as duplicates_removed from m"""
)
def identity_metrics(spark, sf_dir):
    """What merging tracks saved, and how many have plates."""
    members = _members(spark, sf_dir)
    return identity.identity_metrics(identity.rolled_up(members, _KEY), members)


#: Pairs of consecutive tracks of an owner; the truth has those of one class, the finding those of one colour.
_PAIRS = f"with v as ({VEHICLES}), n as (select *, lead(track_no) over (partition by run_id, owner order by track_no) as b, lead(vehicle_class) over (partition by run_id, owner order by track_no) as bc, lead(colour) over (partition by run_id, owner order by track_no) as bk, lead(camera_id) over (partition by run_id, owner order by track_no) as bcam, lead(plate_text) over (partition by run_id, owner order by track_no) as bp from v) "


def _pairs(spark, sf_dir):
    own = Window.partitionBy("run_id", "owner").orderBy("track_no")
    after = {n: F.lead(c).over(own) for n, c in {"b": "track_no", "bc": "vehicle_class", "bk": "colour", "bp": "plate_text"}.items()}
    return vehicle_records(spark, sf_dir).withColumns(after).where("b is not null")


@query(
    _PAIRS
    + """, f as (select track_no, b from n where b is not null and track_no % 5 <> 0), t as (select track_no, b from n where b is not null and vehicle_class = bc),
    c as (select count(*) filter (f.b is not null and t.b is not null) as tp, count(*) filter (t.b is null) as fp, count(*) filter (f.b is null) as fn from f full join t on f.track_no = t.track_no and f.b = t.b),
    p as (select *, coalesce(tp / nullif(tp + fp, 0), 1.0e0) as pr, coalesce(tp / nullif(tp + fn, 0), 1.0e0) as re from c)
    select tp, fp, fn, round(pr, 6) as precision, round(re, 6) as recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) as f1 from p"""
)
def identity_eval_prf(spark, sf_dir):
    """Precision, recall and F1 of pairs found against pairs that are true."""
    pairs = _pairs(spark, sf_dir)
    return identity.pair_quality(pairs.where("track_no % 5 <> 0"), pairs.where("vehicle_class = bc"), ["track_no", "b"])


@query(_PAIRS + "select track_no, b from n where b is not null and track_no % 5 <> 0 and vehicle_class is distinct from bc")
def pair_sets(spark, sf_dir):
    """Pairs found that are not true."""
    pairs = _pairs(spark, sf_dir)
    return pairs.where("track_no % 5 <> 0").select("track_no", "b").exceptAll(pairs.where("vehicle_class = bc").select("track_no", "b"))


@query()
def plate_pair_adjusted(spark, sf_dir):
    """Scores of consecutive tracks of an owner after plate evidence; text similarity has no SQL, tests hold it against plain rules."""
    quality = lambda no: F.when(no % 3 == 0, "HIGH").when(no % 3 == 1, "MEDIUM").otherwise("LOW")
    pairs = _pairs(spark, sf_dir).select(
        "track_no", "b", F.col("plate_text").alias("plate_a"), F.col("bp").alias("plate_b"), quality(F.col("track_no")).alias("quality_a"), quality(F.col("b")).alias("quality_b"),
        ((F.col("track_no") % 100) / 100.0).alias("score"), F.when(F.col("b") % 4 == 0, "different_camera").when(F.col("b") % 5 == 0, "time_gap_too_large").alias("rejection"),
    )
    return identity.plate_adjusted(identity.plate_relations(pairs)).select("track_no", "b", "evidence", "plate_reason", "score", "rejection", "edits")


@query(_PAIRS + "select track_no, b, cast(levenshtein(plate_text, bp) as int) as edits from n where plate_text is not null and bp is not null")
def plate_edit_distance(spark, sf_dir):
    """Edits between the plates of consecutive tracks of an owner."""
    return _pairs(spark, sf_dir).where("plate_text is not null and bp is not null").select("track_no", "b", F.levenshtein("plate_text", "bp").alias("edits"))


@query(_PAIRS.split(", n as")[0] + " select run_id, count(*) as tracks, round(count(*) filter (plate_detected) / count(*), 6) as detected_rate, round(count(plate_text) / count(*), 6) as read_rate, round(coalesce(count(plate_text) filter (plate_detected) / nullif(count(*) filter (plate_detected), 0), 0), 6) as read_of_detected from v group by 1")
def plate_coverage(spark, sf_dir):
    """Shares of a run's tracks with plates detected and read."""
    n, seen, read = F.count("*"), F.count_if("plate_detected"), F.count("plate_text")
    both = F.count_if(F.col("plate_detected") & F.col("plate_text").isNotNull())
    return vehicle_records(spark, sf_dir).groupBy("run_id").agg(
        n.alias("tracks"), F.round(seen / n, 6).alias("detected_rate"), F.round(read / n, 6).alias("read_rate"), F.round(F.coalesce(F.try_divide(both, seen), F.lit(0.0)), 6).alias("read_of_detected")
    )
