"""Queries over detections: gates, regions and funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import box
from ..operators import quality
from ..operators.quality import Profile
from ..sources.testdata import OBSERVATIONS, observations
from .registry import query

O = f"with o as ({OBSERVATIONS}) "  # noqa: E741
WIDTH, HEIGHT = 2000.0, 400.0
PROFILES = {"car": Profile(min_width=10, min_height=22, max_aspect=1.6, margin=3, edge_mode="LEGACY"), "truck": Profile(min_width=14, min_height=24, min_area=0.0008, edge_mode="B")}
DEFAULT = Profile(min_width=6, min_height=21, max_area=0.002, edge_mode="C")


def _rule(p: Profile) -> str:
    w, h, edge = "(x2 - x1)", "(y2 - y1)", f"(x1 <= {p.margin} or x2 >= {WIDTH} - {p.margin} or y1 <= {p.margin} or y2 >= {HEIGHT} - {p.margin})"
    share = f"({w} * {h} / {WIDTH * HEIGHT}e0)"
    edge_rule = {"A": "false", "B": f"{edge} and {share} < {p.min_area}", "C": f"{edge} and ({w} < {p.min_width} or {h} < {p.min_height})", "LEGACY": edge}[p.edge_mode]
    return f"""case when {w} < {p.min_width} then 'BBOX_TOO_NARROW' when {h} < {p.min_height} then 'BBOX_TOO_SHORT' when {share} < {p.min_area} then 'BBOX_TOO_SMALL' when {share} > {p.max_area} then 'BBOX_TOO_LARGE'
      when {w} / {h} < {p.min_aspect} then 'ASPECT_RATIO_TOO_LOW' when {w} / {h} > {p.max_aspect} then 'ASPECT_RATIO_TOO_HIGH' when {edge_rule} then 'EDGE_TRUNCATED' end"""


_GATED = O + f", g as (select *, case raw_class_name when 'car' then {_rule(PROFILES['car'])} when 'truck' then {_rule(PROFILES['truck'])} else {_rule(DEFAULT)} end as rejection_reason from o) "


def _gated(spark, sf_dir):
    return quality.gate(observations(spark, sf_dir), PROFILES, DEFAULT, WIDTH, HEIGHT)


@query(_GATED + "select track_no, frame_number, raw_class_name, rejection_reason from g")
def bbox_quality_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("track_no", "frame_number", "raw_class_name", "rejection_reason")


@query(_GATED + "select camera_id, raw_class_name, coalesce(rejection_reason, 'ACCEPTED') as reason, count(*) as n, count(distinct track_no) as tracks from g group by 1, 2, 3")
def detection_funnel(spark, sf_dir):
    return quality.funnel(_gated(spark, sf_dir), "camera_id", "raw_class_name")


@query(_GATED + "select camera_id, raw_class_name, rejection_reason, count(*) as n from g where rejection_reason is not null group by grouping sets ((camera_id), (raw_class_name), (rejection_reason))")
def rejection_grouping_sets(spark, sf_dir):
    rows = _gated(spark, sf_dir).where("rejection_reason is not null")
    return rows.groupingSets([["camera_id"], ["raw_class_name"], ["rejection_reason"]], "camera_id", "raw_class_name", "rejection_reason").agg(F.count("*").alias("n"))


@query(O + "select track_no, frame_number from o where y2 between 60 and 100")
def roi_band(spark, sf_dir):
    return observations(spark, sf_dir).where(quality.inside_band(box(), HEIGHT, 0.15, 0.2501)).select("track_no", "frame_number")


@query(
    O
    + """, b as (select track_no, frame_number, x1, y1, case track_no % 5 when 0 then x1 - 1 when 1 then cast('nan' as double) when 2 then cast('infinity' as double) when 3 then null else x2 end as x2, y2 from o)
    select track_no, frame_number, coalesce(isfinite(x1) and isfinite(y1) and isfinite(x2) and isfinite(y2) and x2 > x1 and y2 > y1, false) as valid from b"""
)
def bbox_validity(spark, sf_dir):
    """Whether boxes have finite corners in order; some are spoilt here."""
    n = F.col("track_no") % 5
    x2 = F.when(n == 0, F.col("x1") - 1).when(n == 1, F.lit(float("nan"))).when(n == 2, F.lit(float("inf"))).when(n == 3, F.lit(None)).otherwise(F.col("x2"))
    return observations(spark, sf_dir).withColumn("x2", x2).select("track_no", "frame_number", quality.valid(box()).alias("valid"))


@query(O + "select track_no, frame_number from o where (x1 + x2) / 2 between 200 and 1000 and y2 between 40 and 80")
def roi_rect(spark, sf_dir):
    return observations(spark, sf_dir).where(quality.inside_rectangle(box(), WIDTH, HEIGHT, 0.1, 0.5, 0.1, 0.2)).select("track_no", "frame_number")


@query(O + ", f as (select distinct camera_id, frame_number from o where frame_number % 7 = 0), r as (select *, row_number() over (partition by camera_id order by frame_number) as place from f) select camera_id, frame_number, place from r where place <= 40")
def sampling_every_n(spark, sf_dir):
    return quality.sampled_frames(observations(spark, sf_dir), 7, 40)


@query(O + "select case when (x2 - x1) * (y2 - y1) / 20000.0e0 < 0.015 then 'small' when (x2 - x1) * (y2 - y1) / 20000.0e0 < 0.06 then 'medium' else 'large' end as size, count(*) as n, avg(confidence) as mean_confidence from o group by 1")
def size_buckets(spark, sf_dir):
    return observations(spark, sf_dir).groupBy(quality.size_bucket(box(), 20000.0).alias("size")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


@query(
    O
    + """, c as (select track_no, frame_number, (x2 - x1) * (y2 - y1) * 10 as a, weight * 10 as s, confidence, case when frame_number % 3 = 0 then 'LARGEST' when frame_number % 3 = 1 then 'FIRST' else 'OTHER' end as role, weight * 60 + 20 as b from o)
    select track_no, frame_number, round(greatest(0, least(1, (0.25 * greatest(0, least(1, (a - 7000) / 21000.0)) + 0.25 * greatest(0, least(1, s / 40.0)) + 0.20 * greatest(0, least(1, confidence))
      + 0.15 * case role when 'LARGEST' then 0.90 when 'FIRST' then 0.65 else 0.50 end) / 0.85e0 - 0.35 * (0.05 * 0.1 + 0.05 * 0.2 + 0.05 * case when b < 40 then (40 - b) / 40.0 when b > 215 then least(1, (b - 215) / 40.0) else 0 end) / 0.15e0)), 6) as quality from c"""
)
def crop_quality(spark, sf_dir):
    frame = F.col("frame_number") % 3
    role = F.when(frame == 0, "LARGEST").when(frame == 1, "FIRST").otherwise("OTHER")
    a = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) * 10
    score = quality.crop_quality(a, F.col("weight") * 10, F.col("confidence"), role, F.lit(0.1), F.lit(0.2), F.col("weight") * 60 + 20)
    return observations(spark, sf_dir).select("track_no", "frame_number", F.round(score, 6).alias("quality"))
