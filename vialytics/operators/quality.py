"""Gates on detections and crops: which boxes are usable, inside the region, and good enough."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, area, box, clip, height, width


@dataclass(frozen=True)
class Profile:
    """Limits of a class's boxes. edge_mode: A never rejects at the edge, B small boxes, C narrow or short ones, LEGACY all."""

    min_width: float = 20.0
    min_height: float = 20.0
    min_area: float = 0.0
    max_area: float = 1.0
    min_aspect: float = 0.2
    max_aspect: float = 6.0
    margin: float = 2.0
    edge_mode: str = "A"


def at_edge(b: Box, frame_width: Column, frame_height: Column, margin: float) -> Column:
    return (b[0] <= margin) | (b[2] >= frame_width - margin) | (b[1] <= margin) | (b[3] >= frame_height - margin)


def rejection(b: Box, frame_width: Column, frame_height: Column, p: Profile) -> Column:
    """The first rule that a box breaks, null if none."""
    w, h = width(b), height(b)
    share = F.coalesce(F.try_divide(w * h, frame_width * frame_height), F.lit(0.0))
    aspect = F.when(h > 0, w / h).otherwise(F.lit(float("inf")))
    edge = at_edge(b, frame_width, frame_height, p.margin)
    edge_rule = {"A": F.lit(False), "B": edge & (share < p.min_area), "C": edge & ((w < p.min_width) | (h < p.min_height)), "LEGACY": edge}[p.edge_mode]
    return (
        F.when(w < p.min_width, "BBOX_TOO_NARROW").when(h < p.min_height, "BBOX_TOO_SHORT").when(share < p.min_area, "BBOX_TOO_SMALL").when(share > p.max_area, "BBOX_TOO_LARGE")
        .when(aspect < p.min_aspect, "ASPECT_RATIO_TOO_LOW").when(aspect > p.max_aspect, "ASPECT_RATIO_TOO_HIGH").when(edge_rule, "EDGE_TRUNCATED")
    )


def gate(rows: DataFrame, profiles: dict[str, Profile], default: Profile, frame_width: float, frame_height: float) -> DataFrame:
    """rows with rejection_reason by the profile of their class."""
    fw, fh = F.lit(float(frame_width)), F.lit(float(frame_height))
    reason = rejection(box(), fw, fh, default)
    for name, p in profiles.items():
        reason = F.when(F.col("raw_class_name") == name, rejection(box(), fw, fh, p)).otherwise(reason)
    return rows.withColumn("rejection_reason", reason)


def valid(b: Box) -> Column:
    """Finite corners in order."""
    finite = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in b]
    return F.coalesce(finite[0] & finite[1] & finite[2] & finite[3] & (b[2] > b[0]) & (b[3] > b[1]), F.lit(False))


def inside_band(b: Box, frame_height: float, top: float, bottom: float) -> Column:
    """The box's lower edge lies in a band of the frame; the band's edges are whole pixels."""
    return b[3].between(float(int(frame_height * top)), float(int(frame_height * bottom)))


def inside_rectangle(b: Box, frame_width: float, frame_height: float, x_min: float, x_max: float, y_min: float, y_max: float) -> Column:
    """The middle of the box's lower edge lies in a rectangle of the frame."""
    return ((b[0] + b[2]) / 2).between(frame_width * x_min, frame_width * x_max) & b[3].between(frame_height * y_min, frame_height * y_max)


def funnel(gated: DataFrame, *keys: str) -> DataFrame:
    """Detections, accepted ones and distinct tracks by key and reason."""
    reason = F.coalesce("rejection_reason", F.lit("ACCEPTED"))
    return gated.groupBy(*keys, reason.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("track_no").alias("tracks"))


def sampled_frames(rows: DataFrame, every: int, most: int) -> DataFrame:
    """Of each camera's frames whose number divides by `every`, the first `most`."""
    from pyspark.sql.window import Window

    frames = rows.select("camera_id", "frame_number").distinct().where(F.col("frame_number") % every == 0)
    place = F.row_number().over(Window.partitionBy("camera_id").orderBy("frame_number"))
    return frames.withColumn("place", place.cast("long")).where(F.col("place") <= most)


#: What an evidence role adds to a crop's quality.
ROLE_SCORES = {"BEST_OVERALL": 1.0, "SHARPEST": 0.95, "LARGEST": 0.90, "HIGHEST_CONFIDENCE": 0.85, "MIDDLE": 0.75, "FIRST": 0.65, "LAST": 0.65}
#: Weights of a crop's merits and faults, and the smallest crop.
MERITS = {"area": 0.25, "sharpness": 0.25, "confidence": 0.20, "role": 0.15}
FAULTS = {"border": 0.05, "clipping": 0.05, "brightness": 0.05}
MIN_CROP = (100, 70)


def brightness_fault(brightness: Column) -> Column:
    return F.when(brightness < 40.0, clip((40.0 - brightness) / 40.0)).when(brightness > 215.0, clip((brightness - 215.0) / 40.0)).otherwise(F.lit(0.0))


def crop_quality(crop_area: Column, sharpness: Column, confidence: Column, role: Column, border: Column, clipping: Column, brightness: Column, min_sharpness: float = 10.0) -> Column:
    """Merits less 0.35 of the faults, each a weighted mean, between 0 and 1."""
    least = MIN_CROP[0] * MIN_CROP[1]
    roles = F.coalesce(F.create_map(*(F.lit(x) for kv in ROLE_SCORES.items() for x in kv))[F.upper(role)], F.lit(0.50))
    merit = {"area": clip((crop_area - least) / (3.0 * least)), "sharpness": clip(sharpness / (4 * min_sharpness)), "confidence": clip(confidence), "role": roles}
    fault = {"border": border, "clipping": clipping, "brightness": brightness_fault(brightness)}
    good = sum((merit[k] * w for k, w in MERITS.items()), F.lit(0.0)) / sum(MERITS.values())
    bad = sum((fault[k] * w for k, w in FAULTS.items()), F.lit(0.0)) / sum(FAULTS.values())
    return clip(good - bad * 0.35)


def size_bucket(b: Box, frame_area: float) -> Column:
    share = area(b) / frame_area
    return F.when(share < 0.015, "small").when(share < 0.06, "medium").otherwise("large")
