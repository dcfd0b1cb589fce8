"""Tracks from observations: order checks, life cycles, classes, and what happens from frame to frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import box, iou

MAX_LOST, MIN_OBSERVATIONS, CLASS_OBSERVATIONS, WINNER_RATIO = 30, 3, 3, 0.60


def order_violations(rows: DataFrame, keys: list[str], arrival: str, frame: str = "frame_number") -> DataFrame:
    """Rows whose frame is smaller than that of the row that arrived before it."""
    before = F.lag(frame).over(Window.partitionBy(*keys).orderBy(arrival))
    return rows.withColumn("previous_frame", before).where(F.col(frame) < F.col("previous_frame"))


def frame_index(frames: DataFrame) -> DataFrame:
    """(camera_id, frame_number, idx, last_idx): the dense number of each processed frame of a camera, empty frames included."""
    camera = Window.partitionBy("camera_id")
    numbered = frames.select("camera_id", "frame_number").distinct().withColumn("idx", F.row_number().over(camera.orderBy("frame_number")).cast("long"))
    return numbered.withColumn("last_idx", F.max("idx").over(camera))


def lifecycles(rows: DataFrame, frames: DataFrame, max_lost: int = MAX_LOST, least: int = MIN_OBSERVATIONS) -> DataFrame:
    """Tracks of a tracker's ids: an id that stays away for more than max_lost frames of its camera begins a new track.

    rows: camera_id, native_id, frame_number, confidence, raw_class_name; frames: the processed frames of each camera.
    Returns one row per track with its number on the camera, frames, status and the reason why it ended.
    """
    known = rows.join(frame_index(frames), ["camera_id", "frame_number"])
    own = Window.partitionBy("camera_id", "native_id").orderBy("idx")
    starts = F.coalesce(F.col("idx") - F.lag("idx").over(own) > max_lost + 1, F.lit(True))
    parts = known.withColumn("part", F.sum(starts.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    tracks = parts.groupBy("camera_id", "native_id", "part").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("end_idx"), F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"),
        F.count("*").alias("observations"), F.max("last_idx").alias("camera_last_idx"),
    )
    number = F.row_number().over(Window.partitionBy("camera_id").orderBy("first_idx", "native_id"))
    timed_out = F.col("camera_last_idx") - F.col("end_idx") > max_lost
    enough = F.col("observations") >= least
    return tracks.select(
        "camera_id", "native_id", "part", number.cast("long").alias("track_number"), "first_frame", "last_frame", "observations",
        F.when(enough, "COMPLETED").otherwise("DISCARDED").alias("status"),
        F.when(~timed_out, "END_OF_STREAM").when(enough, "LOST_TIMEOUT").otherwise("INSUFFICIENT_OBSERVATIONS").alias("reason"),
    )


def lifecycle_metrics(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("camera_id").agg(
        F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "DISCARDED").alias("discarded"),
        F.count_if(F.col("reason") == "LOST_TIMEOUT").alias("lost_timeouts"), F.avg("observations").alias("mean_observations"),
    )


def final_class(observations: DataFrame, *keys: str) -> DataFrame:
    """Each track's class by summed confidence, ties to the larger name; UNKNOWN with the reason where no class is clear."""
    per_class = observations.groupBy(*keys, "raw_class_name").agg(F.sum("confidence").alias("weight"), F.count("*").alias("n"))
    per_class = per_class.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), F.desc("raw_class_name"))))
    first, second = F.col("rank") == 1, F.col("rank") == 2
    votes = per_class.groupBy(*keys).agg(
        F.sum("n").alias("observations"), F.max(F.when(first, F.col("raw_class_name"))).alias("winner"), F.max(F.when(first, F.col("n"))).alias("winner_n"),
        F.max(F.when(first, F.col("weight"))).alias("weight"), F.max(F.when(second, F.col("weight"))).alias("runner_up"),
    )
    few = F.col("observations") < CLASS_OBSERVATIONS
    low = F.col("winner_n") / F.col("observations") < WINNER_RATIO
    tied = F.coalesce(F.col("weight") <= F.col("runner_up"), F.lit(False))
    reason = F.when(few, "INSUFFICIENT_OBSERVATIONS").when(low, "WINNER_RATIO_TOO_LOW").when(tied, "NO_CLEAR_WINNER").otherwise("WEIGHTED_MAJORITY")
    return votes.select(*keys, "observations", F.when(few | low | tied, "UNKNOWN").otherwise(F.col("winner")).alias("final_class"), reason.alias("reason"))


def rebuilt(observations: DataFrame, *keys: str) -> DataFrame:
    """The track table from observations: span, count, mean confidence and counts by class."""
    per_class = observations.groupBy(*keys, "raw_class_name").agg(F.count("*").alias("n"), F.min("frame_number").alias("a"), F.max("frame_number").alias("b"), F.sum("confidence").alias("c"))
    counts = F.array_join(F.array_sort(F.collect_list(F.concat("raw_class_name", F.lit("="), F.col("n").cast("string")))), ",")
    return per_class.groupBy(*keys).agg(F.min("a").alias("first_frame"), F.max("b").alias("last_frame"), F.sum("n").alias("observations"), (F.sum("c") / F.sum("n")).alias("mean_confidence"), counts.alias("class_counts"))


def gaps(observations: DataFrame, *keys: str) -> DataFrame:
    """(keys, frame_number, gap, overlap): steps over missing frames, with the overlap of the boxes on both sides."""
    own = Window.partitionBy(*keys).orderBy("frame_number")
    last = tuple(F.lag(c).over(own).alias(f"last_{c}") for c in ("x1", "y1", "x2", "y2"))
    steps = observations.select(*keys, "frame_number", "x1", "y1", "x2", "y2", (F.col("frame_number") - F.lag("frame_number").over(own)).alias("gap"), *last)
    return steps.where("gap > 1").select(*keys, "frame_number", "gap", iou(box(), box("last_")).alias("overlap"))


def suspected_switches(observations: DataFrame, *keys: str, least_overlap: float = 0.12) -> DataFrame:
    """Returns after a gap to a place that hardly overlaps the last one."""
    return gaps(observations, *keys).where(F.col("overlap") < least_overlap)


def arrivals(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """(camera_id, frame_number, new_ids, back_ids, lost_ids): ids seen first, again after a pause, or no more in the next frame."""
    index = frame_index(frames)
    known = rows.select("camera_id", "native_id", "frame_number").distinct().join(index, ["camera_id", "frame_number"])
    own = Window.partitionBy("camera_id", "native_id").orderBy("idx")
    state = known.select("camera_id", "idx", "last_idx", F.lag("idx").over(own).alias("before"), F.lead("idx").over(own).alias("after"))
    came = state.select("camera_id", "idx", F.col("before").isNull().alias("new"), (F.col("before") < F.col("idx") - 1).alias("back"), F.lit(False).alias("lost"))
    gone = state.where((F.col("idx") < F.col("last_idx")) & F.coalesce(F.col("after") > F.col("idx") + 1, F.lit(True)))
    gone = gone.select("camera_id", (F.col("idx") + 1).alias("idx"), F.lit(False).alias("new"), F.lit(False).alias("back"), F.lit(True).alias("lost"))
    counts = came.unionByName(gone).groupBy("camera_id", "idx").agg(*(F.count_if(n).alias(f"{n}_ids") for n in ("new", "back", "lost")))
    return counts.join(index, ["camera_id", "idx"]).select("camera_id", "frame_number", "new_ids", "back_ids", "lost_ids")


def frame_rate(frames: DataFrame, key: str, time: Column, last: int = 32) -> DataFrame:
    """Frames a second over the last `last` frame times of each camera."""
    own = Window.partitionBy(key).orderBy("frame_number").rowsBetween(-(last - 1), 0)
    timed = frames.withColumn("t", time)
    span = F.max("t").over(own) - F.min("t").over(own)
    return timed.select(key, "frame_number", F.when(span > 0, (F.count("t").over(own) - 1) / span).otherwise(F.lit(0.0)).alias("fps"))
