"""Lists of runs, tracks, vehicles and cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(tracks: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Each run with its cameras, tracks, completed tracks and physical vehicles; each side is aggregated before the join."""
    a = tracks.groupBy("run_id").agg(F.countDistinct("camera_id").alias("cameras"), F.count("*").alias("tracks"), F.count_if(F.col("status") == "COMPLETED").alias("completed"))
    b = vehicles.groupBy("run_id").agg(F.count("*").alias("vehicles"))
    return a.join(b, "run_id", "left").select("run_id", "cameras", "tracks", "completed", F.coalesce("vehicles", F.lit(0)).cast("long").alias("vehicles"))


def latest_run(tracks: DataFrame) -> DataFrame:
    """The tracks of the run with the largest id."""
    return tracks.join(F.broadcast(tracks.agg(F.max("run_id").alias("run_id"))), "run_id", "left_semi")


def tracks_with_best(tracks: DataFrame, observations: DataFrame) -> DataFrame:
    """Each track with its best observation: the most confident, of equals the earliest. One aggregation, no subqueries."""
    best = F.max_by(F.struct("frame_number", "confidence", "raw_class_name"), F.struct("confidence", -F.col("frame_number")))
    per_track = observations.groupBy("track_no").agg(best.alias("best"), F.count("*").alias("observations"))
    joined = tracks.join(per_track, "track_no", "left")
    return joined.select(
        "run_id", "camera_id", "vehicle_id", F.col("best.frame_number").alias("best_frame"), F.col("best.confidence").alias("best_confidence"),
        F.coalesce("observations", F.lit(0)).cast("long").alias("observations"),
    )


def vehicles_with_members(members: DataFrame) -> DataFrame:
    """(run_id, vehicle_key, members, cameras, first_seen, last_seen) of groups of tracks; lists are sorted and joined by commas."""
    return members.groupBy("run_id", "vehicle_key").agg(
        F.count("*").alias("member_count"), F.array_join(F.array_sort(F.collect_list("vehicle_id")), ",").alias("members"), F.array_join(F.array_sort(F.collect_set("camera_id")), ",").alias("cameras"),
        F.min("first_seen_seconds").alias("first_seen"), F.max("last_seen_seconds").alias("last_seen"),
    )


def camera_state(observations: DataFrame) -> DataFrame:
    """Each camera's number of observations, last time, and the largest frame at that time."""
    last = F.max(F.struct("timestamp_seconds", "frame_number"))
    return observations.groupBy("run_id", "camera_id").agg(F.count("*").alias("n"), last.alias("last")).select("run_id", "camera_id", "n", "last.timestamp_seconds", "last.frame_number")


def filter_options(records: DataFrame) -> DataFrame:
    """(kind, value): what can be chosen."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("camera", "camera_id"), ("run", "run_id"), ("class", "vehicle_class"), ("colour", "colour"))))
    return records.select(F.explode(kinds).alias("o")).select("o.*").where("value is not null").distinct()


def page(rows: DataFrame, order: list, number: int, size: int = 6, *keys: str) -> DataFrame:
    """Page `number` (from 0) of each key's rows, with their place. The order must be total."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place.cast("long")).where(F.col("place").between(number * size + 1, (number + 1) * size))
