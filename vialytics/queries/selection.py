"""Queries for samples by quota. Crops are the observations of the tracks, their roles go by the frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection
from ..sources.testdata import OBSERVATIONS, VEHICLES, observations, vehicle_records
from .registry import query

_CROPS = {
    "track_no": "track_no", "frame_number": "frame_number", "role": "case frame_number % 6 when 0 then 'BEST_OVERALL' when 1 then 'LARGEST' when 2 then 'FIRST' when 3 then 'LAST' else 'OTHER' end",
    "path": "concat('crops/', cast(track_no as varchar(20)), '_', cast(frame_number - frame_number % 2 as varchar(20)))", "area": "(x2 - x1) * (y2 - y1)", "confidence": "confidence",
}
_CROP_ROWS = f"c as (select {', '.join(f'{e} as {n}' for n, e in _CROPS.items())} from ({OBSERVATIONS}) o)"
_PRIORITY = "case role " + " ".join(f"when '{r}' then {i}" for i, r in enumerate(selection.ROLE_PRIORITY)) + " end"


@query(
    f"""with {_CROP_ROWS}, r as (select *, {_PRIORITY} as p, row_number() over (partition by track_no, role order by confidence desc, area desc, frame_number, path) as a, row_number() over (partition by track_no order by confidence desc, area desc, frame_number, path) as b from c),
    t as (select *, case when p is not null and a = 1 then p else 1000 + b end as turn from r), o as (select *, row_number() over (partition by track_no, path order by turn) as k from t),
    n as (select *, row_number() over (partition by track_no order by turn) as n from o where k = 1) select track_no, frame_number, role, path from n where n <= 3"""
)
def representative_crops(spark, sf_dir):
    """The three crops that stand for each track."""
    crops = observations(spark, sf_dir).selectExpr(*(f"{e} as {n}" for n, e in _CROPS.items()))
    return selection.representatives(crops, ["track_no"], [F.col("confidence"), F.col("area")], 3).select("track_no", "frame_number", "role", "path")


_WIDTH = "cast(x2 - x1 as int)"
_SAMPLE = {"bucket": f"cast(floor({_WIDTH} / 10) as int)", "track_no": "track_no", "frame_number": "frame_number", "width": _WIDTH, "inside": "y2 < 90"}
_BEST = f"b as (select track_no, max({{'inside': inside, 'width': width, 'frame_number': frame_number, 'bucket': bucket}}) as m from (select {', '.join(f'{e} as {n}' for n, e in _SAMPLE.items())} from ({OBSERVATIONS}) o where raw_class_name = 'motorcycle') s group by 1)"


@query(
    f"""with {_BEST}, s as (select track_no, m.bucket as bucket, m.width as width, m.inside as inside from b), q as (select *, row_number() over (partition by bucket order by not inside, width desc, track_no) as nth from s),
    f as (select *, row_number() over (order by case when nth = 1 then 0 else 1 end, bucket, case when nth = 1 then 0 else -width end, track_no) as pick from q) select bucket, track_no, width, inside, cast(pick as int) as pick from f where pick <= 20"""
)
def sample_by_width(spark, sf_dir):
    """Twenty motorcycles: one of each width, then narrow ones first, of equal width class the widest."""
    rows = observations(spark, sf_dir).where("raw_class_name = 'motorcycle'").selectExpr(*(f"{e} as {n}" for n, e in _SAMPLE.items()))
    best = rows.groupBy("track_no").agg(F.max(F.struct("inside", "width", "frame_number", "bucket")).alias("m")).select("m.bucket", "track_no", "m.width", "m.inside")
    return selection.stratified(best, "bucket", [~F.col("inside"), F.desc("width"), F.col("track_no")], [F.col("bucket"), F.desc("width"), F.col("track_no")], 20)


_BUCKETS = {
    "unknown_class": "vehicle_class = 'UNKNOWN' and colour <> 'UNKNOWN'", "unknown_colour": "vehicle_class <> 'UNKNOWN' and colour = 'UNKNOWN'", "no_plate": "plate_text is null", "discarded": "status = 'DISCARDED'",
    "all_unknown": "vehicle_class = 'UNKNOWN' and colour = 'UNKNOWN'", "never": "track_no < 0", "any": "true",
}


def _picks_sql() -> str:
    """One bucket after another: the first row that no bucket before has."""
    parts, names = [], []
    for i, (name, fits) in enumerate(_BUCKETS.items()):
        gone = "".join(f" and (run_id, vehicle_id) not in (select (run_id, vehicle_id) from p{j})" for j in range(i))
        parts.append(f"p{i} as (select '{name}' as bucket, run_id, vehicle_id, track_no from v where {fits}{gone} order by run_id, track_no limit 1)")
        names.append(f"select bucket, run_id, vehicle_id, track_no from p{i}")
    return f"with v as ({VEHICLES}), {', '.join(parts)} {' union all '.join(names)}"


@query(_picks_sql())
def review_samples(spark, sf_dir):
    """One vehicle for each question of a review, none twice."""
    rows = vehicle_records(spark, sf_dir).select("run_id", "track_no", "vehicle_id", "vehicle_class", "colour", "plate_text", "status")
    picks = selection.one_of_each(rows, ["run_id", "vehicle_id"], ["run_id", "track_no"], {n: F.expr(f) for n, f in _BUCKETS.items()})
    return picks.select("bucket", "run_id", "vehicle_id", "track_no")
