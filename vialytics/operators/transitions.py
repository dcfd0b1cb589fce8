"""What happened between two tracks of one vehicle: boundaries, the frames around them, states, and the likely cause.

Detections meet a window by run, camera, slot of frames and cell of space; a frame's row is kept where nothing was detected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import area, box, center, distance, height, iou, width
from ..sources.shared import written
from .places import cell_side, extent, in_cells, meet_here

FRAME = ["run_id", "camera_id", "frame_number"]
PAIR = ["old_no", "new_no"]
#: Frames around a boundary, frames that a track counts as lost, and limits of detections.
MARGIN, LOST_FRAMES, TARGET_IOU, AROUND, OTHER_IOU, LOW, JUMP = 10, 40, 0.08, 80.0, 0.05, 0.1, 0.45
TARGETS, LARGE = ("truck", "bus", "car"), ("truck", "bus")
#: Causes of a transition and what several of them amount to.
DROPOUT, WEAK = "YOLO DETECTION DROPOUT / ROI-PASSED DETECTION ABSENCE", "LOW-CONFIDENCE DETECTIONS ARE NOT BEING RECOVERED"
UNSTABLE, ASSOCIATION, SEVERAL = "YOLO BOUNDING-BOX INSTABILITY IS PRIMARY", "BYTETrack ASSOCIATION IS PRIMARY", "MULTIPLE FACTORS ARE CONTRIBUTING"
DROPOUT_AND_WEAK = (
    "MULTIPLE FACTORS ARE CONTRIBUTING: YOLO/ROI-passed truck detections drop out or fall into ByteTrack's low-confidence path, then ByteTrack emits a new native ID instead of reactivating the lost one."
)
#: Frames of a slot.
SLOT = 32
BOX = ("x1", "y1", "x2", "y2")


def boundaries(pairs: DataFrame, observations: DataFrame) -> DataFrame:
    """pairs (run_id, camera_id, old_no, new_no) with the old track's last and the new track's first frame and time, the gap,
    the first and last frame of both, and the median box of their observations as the target."""
    ends = observations.groupBy("track_no").agg(
        F.min(F.struct("frame_number", "timestamp_seconds")).alias("first"), F.max(F.struct("frame_number", "timestamp_seconds")).alias("last"),
    )
    of = lambda w: ends.select(F.col("track_no").alias(f"{w}_no"), F.col("first.frame_number").alias(f"{w}_first_frame"), F.col("last.frame_number").alias(f"{w}_last_frame"), F.col("first.timestamp_seconds").alias(f"{w}_first_seconds"), F.col("last.timestamp_seconds").alias(f"{w}_last_seconds"))
    both = pairs.select("old_no", "new_no", F.explode(F.array("old_no", "new_no")).alias("track_no"))
    target = both.join(observations.select("track_no", *BOX), "track_no").groupBy(*PAIR).agg(*(F.percentile(c, 0.5).alias(f"t_{c}") for c in BOX))
    out = pairs.join(of("old"), "old_no").join(of("new"), "new_no").join(target, PAIR)
    return out.withColumns({"gap_frames": F.col("new_first_frame") - F.col("old_last_frame"), "gap_seconds": F.col("new_first_seconds") - F.col("old_last_seconds")})


def manager_state(frame: Column, first: Column, last: Column, observed: Column) -> Column:
    """What the track's manager held of it at a frame."""
    return F.when(first.isNull(), "UNKNOWN").when(observed, "ACTIVE").when(frame < first, "NOT_CREATED").when(frame <= last + LOST_FRAMES, "LOST").otherwise("COMPLETED")


def frame_windows(bounds: DataFrame, detections: DataFrame, observations: DataFrame, activation: float, margin: int = MARGIN) -> DataFrame:
    """A row for each transition and frame from `margin` before the gap to `margin` behind it.

    detections: (run_id, camera_id, frame_number, class_name, box, confidence, passed). A frame's primary detection is the
    one that overlaps the target most (then the most confident) of those that passed, else of all; the overlap, shift and
    ratios are those to the last primary before it, however many frames ago.
    """
    bounds = written(bounds, "bounds")
    span = F.sequence(F.greatest(F.lit(0), F.col("old_last_frame") - margin), F.col("new_first_frame") + margin)
    framed = bounds.withColumn("span", span).withColumns({"span_from": F.array_min("span"), "span_to": F.array_max("span")})
    target, here, t = box("t_"), box(), {c: F.col(f"t_{c}") for c in BOX}
    # around the target: what is near it or overlaps it; a window meets detections by slots of frames and cells of space
    around = tuple(f(t[f"{c}1"], t[f"{c}2"]) + d for f, d in ((F.least, -AROUND), (F.greatest, AROUND)) for c in "xy")
    sizes = [extent(bounds, target), extent(detections, here)]
    whole = any(missing for *_, missing in sizes)  # boxes that miss a corner have no cell
    side = math.inf if whole else cell_side(*(x for size in sizes for x in size[:2]))
    cells = lambda df, b: df.withColumns({"cell_x": F.lit(0), "cell_y": F.lit(0)}) if side == math.inf else in_cells(df, b, side)
    once = lambda a, b: F.lit(True) if side == math.inf else meet_here(a, b, side)
    place = ["run_id", "camera_id", "cell_x", "cell_y"]
    slots = F.explode(F.sequence(F.floor(F.col("span_from") / SLOT), F.floor(F.col("span_to") / SLOT))).alias("slot")
    windows = cells(framed.select("run_id", "camera_id", *PAIR, *t.values(), "span_from", "span_to", slots), around)
    found = cells(detections.withColumn("slot", F.floor(F.col("frame_number") / SLOT)), here)
    met = windows.join(found, [*place, "slot"]).where(F.col("frame_number").between(F.col("span_from"), F.col("span_to")) & once(around, here))
    cx, cy = center(here)
    near = (cx >= F.col("t_x1") - AROUND) & (cx <= F.col("t_x2") + AROUND) & (cy >= F.col("t_y1") - AROUND) & (cy <= F.col("t_y2") + AROUND)
    met = met.withColumn("target_iou", iou(here, target))
    held = F.coalesce(F.lower("class_name").isin(*TARGETS) & ((F.col("target_iou") >= TARGET_IOU) | near), F.lit(False))
    other = lambda b: F.coalesce(~F.lower("class_name").isin(*LARGE) & (iou(here, b) > OTHER_IOU), F.lit(False))
    met = met.withColumns({"held": held, "aside": other(target)}).where("held or aside")
    best = F.max(F.when(F.col("held"), F.struct("passed", "target_iou", "confidence", "class_name", *BOX))).alias("best")
    counts = (F.count_if("held").alias("raw_count"), F.count_if(F.col("held") & F.col("passed")).alias("passed_count"), best, F.count_if("aside").alias("aside"), *(F.first(x).alias(f"t_{c}") for c, x in t.items()))
    seen = written(met.groupBy("run_id", "camera_id", *PAIR, "frame_number").agg(*counts), "primaries")
    # boxes over the primary, or over the target where there is none
    primary = seen.where("best is not null").select(*FRAME, *PAIR, *(F.coalesce(f"best.{c}", x).alias(f"p_{c}") for c, x in t.items()))
    over = cells(primary, box("p_")).join(cells(detections, here), [*FRAME, "cell_x", "cell_y"]).where(once(box("p_"), here) & other(box("p_")))
    over = over.groupBy(*PAIR, "frame_number").agg(F.count("*").alias("over"))
    inside = F.filter("frames", lambda x: x.between(F.col("span_from"), F.col("span_to")))
    own = observations.groupBy("track_no").agg(F.collect_set("frame_number").alias("frames"))
    for w in ("old", "new"):  # the frames of a window that show the track
        framed = framed.join(own.withColumnRenamed("track_no", f"{w}_no"), f"{w}_no", "left").withColumn(f"{w}_frames", inside).drop("frames")
    rows = framed.withColumn("frame_number", F.explode("span")).withColumns({f"{w}_seen": F.array_contains(f"{w}_frames", F.col("frame_number")) for w in ("old", "new")})
    rows = rows.drop("span", "span_from", "span_to", "old_frames", "new_frames").join(seen.drop("run_id", "camera_id", *(f"t_{c}" for c in BOX)), [*PAIR, "frame_number"], "left").join(over, [*PAIR, "frame_number"], "left")
    rows = rows.withColumn("others", F.coalesce(F.when(F.col("best").isNull(), F.col("aside")).otherwise(F.col("over")), F.lit(0)))
    before = Window.partitionBy(*PAIR).orderBy("frame_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("previous", F.last("best", ignorenulls=True).over(before))
    p, q = (tuple(F.col(f"{w}.{c}") for c in BOX) for w in ("best", "previous"))
    sure = F.col("best.confidence")
    state = lambda w: manager_state(F.col("frame_number"), F.col(f"{w}_first_frame"), F.col(f"{w}_last_frame"), F.coalesce(f"{w}_seen", F.lit(False)))
    ratio = lambda f: F.when(F.col("best").isNotNull() & F.col("previous").isNotNull(), f(p) / F.greatest(f(q), F.lit(1e-6)))
    both = F.col("best").isNotNull() & F.col("previous").isNotNull()
    return rows.select(
        "run_id", "camera_id", *PAIR, "frame_number", ((F.col("frame_number") > F.col("old_last_frame")) & (F.col("frame_number") < F.col("new_first_frame"))).alias("in_gap"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("raw_count", "passed_count")), F.col("best.class_name").alias("primary_class"), sure.alias("primary_confidence"),
        F.when(F.col("best").isNull(), "missing").when(sure > activation, "high_confidence_path").when(sure > LOW, "low_confidence_path").otherwise("below_bytetrack_low_confidence").alias("band"),
        F.when(both, iou(p, q)).alias("iou"), F.when(both, distance(center(p), center(q))).alias("shift"), ratio(width).alias("width_ratio"), ratio(height).alias("height_ratio"), ratio(area).alias("area_ratio"),
        state("old").alias("old_state"), state("new").alias("new_state"), "others",
    )


def transition_summaries(windows: DataFrame, activation: float, rejected: DataFrame | None = None) -> DataFrame:
    """A row for each transition: missing and weak frames of the gap, the least overlap of consecutive primaries, other
    boxes in the way, and the root cause. rejected: transitions (old_no, new_no) whose association the tracker refused."""
    gap, found = F.col("in_gap"), F.col("primary_confidence").isNotNull()
    numbers = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("frame_number"))))
    out = windows.groupBy("run_id", "camera_id", *PAIR).agg(
        numbers(gap & ~found).alias("missing_frames"), numbers(gap & (F.col("primary_confidence") <= activation)).alias("low_frames"), F.min("iou").alias("least_iou"), F.max("others").alias("most_others")
    )
    refused = (rejected.select(*PAIR).distinct() if rejected is not None else windows.select(*PAIR).limit(0)).withColumn("refused", F.lit(True))
    out = out.join(refused, PAIR, "left").withColumns({"dropout": F.size("missing_frames") > 0, "box_jump": F.col("least_iou") < JUMP, "occlusion": F.col("most_others") > 0})
    cause = F.when(F.col("dropout"), DROPOUT).when(F.size("low_frames") > 0, WEAK).when(F.col("box_jump"), UNSTABLE).when(F.col("refused"), ASSOCIATION).otherwise(SEVERAL)
    return out.withColumn("root_cause", cause).drop("refused")


def conclusions(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, transitions, conclusion): the one cause of all transitions, or what their causes amount to."""
    cause = F.col("root_cause")
    rows = summaries.groupBy(*keys).agg(F.count("*").alias("transitions"), F.min(cause).alias("least"), F.max(cause).alias("most"), F.bool_or(cause.contains("DROPOUT")).alias("dropped"), F.bool_or(cause.contains("LOW-CONFIDENCE")).alias("weak"))
    said = F.when(F.col("least") == F.col("most"), F.col("least")).when(F.col("dropped") & F.col("weak"), DROPOUT_AND_WEAK).when(F.col("weak"), WEAK).otherwise(SEVERAL)
    return rows.select(*keys, "transitions", said.alias("conclusion"))
