"""Plates of tracks: who owns a plate, who loses it in a conflict, and how good a reading is."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import Box, area, box, center, clip, height, intersection, width
from ..functions.plates import validated
from .places import cell_side, extent, in_cells

#: So many frames are sent to all tasks rather than all plates dealt anew.
FEW = 200_000
OWNER_MARGIN, CLUSTER_SECONDS, CLUSTER_MARGIN = 0.05, 2.0, 0.03


def owner_score(plate: Box, vehicle: Box, confidence: Column) -> Column:
    """How well a vehicle's box holds a plate's: containment, closeness to its centre, size and confidence; null if outside."""
    contained = intersection(plate, vehicle) / F.greatest(area(plate), F.lit(1.0))
    sized = F.least(F.lit(1.0), area(plate) / (F.greatest(area(vehicle), F.lit(1.0)) * 0.02))
    (px, py), (vx, vy) = center(plate), center(vehicle)
    off = F.hypot(F.abs(px - vx) / F.greatest(width(vehicle), F.lit(1.0)), F.abs(py - vy) / F.greatest(height(vehicle), F.lit(1.0)))
    return F.when(contained > 0, contained * 1.5 + clip(1 - off) * 0.75 + sized * 0.35 + confidence * 0.25)


def owners(plates: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Each plate's best owner among the vehicles of its camera and frame.

    plates: camera_id, frame_number, track_no, confidence and the plate's box as p_x1 ..., one for each of the first three;
    vehicles: camera_id, frame_number, track_no and box. A plate lies in one cell of space, that of its first corner; a
    vehicle in all from which a plate may reach it. So the pairs of a plate meet in one place and are as many as share space,
    not as the frame holds. Boxes that miss a corner have no cell: if there are any, all meet by frame alone.
    """
    (wide, high, lost), (w, h, missing) = extent(plates, box("p_")), extent(vehicles, box())
    side = cell_side(wide, high, w, h) if not lost + missing else math.inf
    if side == math.inf:
        cells = {"cell_x": F.lit(0), "cell_y": F.lit(0)}
        p, v = plates.withColumns(cells), vehicles.withColumns(cells)
    else:
        p = plates.withColumns({f"cell_{c}": F.floor(F.least(f"p_{c}1", f"p_{c}2") / side) for c in "xy"})
        (x1, y1, x2, y2) = box()
        v = in_cells(vehicles, (F.least(x1, x2) - wide, F.least(y1, y2) - high, F.greatest(x1, x2), F.greatest(y1, y2)), side)
    place = ["camera_id", "frame_number", "cell_x", "cell_y"]
    v = v.select(*place, F.col("track_no").alias("owner"), "x1", "y1", "x2", "y2", F.lit(True).alias("there"))
    score = F.when(F.col("there"), owner_score(box("p_"), box(), F.col("confidence")))
    pairs = p.join(v, place, "left").withColumn("score", score)
    keys = ["camera_id", "frame_number", "track_no"]
    best = F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("owner")).alias("minus"))))
    own = F.max(F.when(F.col("owner") == F.col("track_no"), F.col("score")))
    found = pairs.groupBy(*keys, "cell_x", "cell_y").agg(best.alias("best"), own.alias("own"))
    held = vehicles.select("camera_id", "frame_number").distinct()
    held = F.broadcast(held) if held.count() <= FEW else held
    found = found.join(held, ["camera_id", "frame_number"], "left_semi")  # plates of frames without vehicles are not listed
    owner = -F.col("best.minus")
    verdict = (
        F.when(F.col("best").isNull(), "no_geometric_owner").when(F.col("own").isNull(), "target_not_in_owner_pool")
        .when((owner != F.col("track_no")) & (F.col("best.score") - F.col("own") >= OWNER_MARGIN), "geometric_owner").otherwise("kept")
    )
    return found.select(*keys, owner.alias("owner"), F.col("best.score").alias("best_score"), verdict.alias("verdict"))


def conflicts(readings: DataFrame) -> DataFrame:
    """readings (camera_id, plate_text, track_no, read_at, score) with cluster and verdict.

    Readings of one plate on a camera chain while they are at most two seconds apart. In a cluster of several tracks the
    best keeps the plate, unless the second is too close: then all lose it.
    """
    plate = Window.partitionBy("camera_id", "plate_text").orderBy("read_at", F.desc("score"), "track_no")
    starts = F.coalesce(F.col("read_at") - F.lag("read_at").over(plate) > CLUSTER_SECONDS, F.lit(True)).cast("int")
    parts = readings.withColumn("starts", starts).withColumn("cluster", F.sum("starts").over(plate.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")
    cluster = Window.partitionBy("camera_id", "plate_text", "cluster")
    order = cluster.orderBy(F.desc("score"), "read_at", "track_no")
    ranked = parts.withColumns(
        {
            "place": F.row_number().over(order),
            "several": F.min("track_no").over(cluster) != F.max("track_no").over(cluster),
            "second": F.max("score").over(cluster) - F.coalesce(F.nth_value("score", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("-inf"))),
        }
    )
    verdict = F.when(~F.col("several"), "kept").when(F.col("second") < CLUSTER_MARGIN, "ambiguous_owner").when(F.col("place") == 1, "kept").otherwise("duplicate_owner")
    return ranked.withColumn("verdict", verdict).select("camera_id", "plate_text", "track_no", "read_at", "score", F.col("cluster").cast("long").alias("cluster"), "verdict")


def reliability(plate: Column, detected: Column, detection: Column, reading: Column, accepted: Column, reason: Column | None = None) -> tuple[Column, Column]:
    """(score, HIGH / MEDIUM / LOW / UNUSABLE) of a reading; a reading without its own confidence takes the detection's.

    A reading that ended for another reason than completion or validation is LOW, whatever its confidences.
    """
    det = F.coalesce(detection, F.lit(0.0))
    ocr = F.coalesce(reading, det)
    usable = F.coalesce(detected & (F.length(plate) >= 6), F.lit(False))
    told = F.lower(F.trim(F.coalesce(F.lit("") if reason is None else reason, F.lit(""))))
    other = ~told.isin("", "ocr_completed", "completed") & ~told.startswith("validated_")
    full = 0.42 * det + 0.42 * ocr + 0.16 * F.when(accepted, 1.0).otherwise(0.35)
    score = F.when(~usable, F.lit(0.0)).when(other, 0.15).otherwise(full)
    label = F.when(~usable, "UNUSABLE").when(other, "LOW").when((score >= 0.72) & (det >= 0.70) & (ocr >= 0.70), "HIGH").when(score >= 0.55, "MEDIUM").otherwise("LOW")
    return score, label


def audit(readings: DataFrame, text: str, *keys: str) -> DataFrame:
    """Totals, valid and invalid readings and formats by key."""
    checked = readings.withColumn("check", validated(F.col(text)))
    valid = F.col("check.valid")
    return checked.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"), F.count_if(F.col("check.format") == "standard_private").alias("standard"),
        F.count_if(F.col("check.format") == "bharat_series").alias("bharat"), F.count_if(F.col("check.corrected")).alias("corrected"),
    )
