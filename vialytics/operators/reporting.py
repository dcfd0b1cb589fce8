"""Figures for reports: latencies after warm-up, percentiles, choices by rank, buckets, rates and spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TENS = (0.1, 0.25, 0.5, 0.75, 0.9)


def latency_profile(rows: DataFrame, key: str, frame: str, seconds: str, warm_up: int = 20) -> DataFrame:
    """Frames, mean, slowest and frames a second for each key, without each key's first `warm_up` frames."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(frame, seconds))
    warm = rows.select(key, frame, seconds, place.alias("_place")).where(F.col("_place") > warm_up)
    return warm.groupBy(key).agg(
        F.count("*").alias("frames"), F.round(F.avg(seconds), 6).alias("mean"), F.max(seconds).alias("slowest"), F.round(F.try_divide(F.count("*"), F.sum(seconds)), 6).alias("per_second")
    )


def percentile_table(rows: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    """p10 to p90 of value for each key, and how many values lie at or beyond the edges."""
    parts = [F.round(F.percentile(value, p), 6).alias(f"p{round(100 * p)}") for p in TENS]
    return rows.groupBy(key).agg(F.count(value).alias("n"), *parts, F.count_if(F.col(value) <= low).alias("at_low"), F.count_if(F.col(value) >= high).alias("at_high"))


def nearest_to_percentile(rows: DataFrame, key: str, value: str, share: float, tie: str) -> DataFrame:
    """For each key the row nearest to a percentile of value; of equal distances the smallest tie. The goals are one row a key."""
    goal = rows.groupBy(key).agg(F.percentile(value, share).alias("goal"))
    off = F.round(F.abs(F.col(value) - F.col("goal")), 9)
    near = rows.join(goal, key).groupBy(key).agg(F.min(F.struct(off.alias("off"), F.col(tie), F.col(value))).alias("row"))
    return near.select(key, F.col(f"row.{tie}").alias(tie), F.col(f"row.{value}").alias(value))


def best_profile(profiles: DataFrame, *objective: Column) -> DataFrame:
    """The profile that is smallest by a list of objectives, compared one after another."""
    return profiles.orderBy(*objective).limit(1)


def buckets(value: Column, edges: list[float], names: list[str]) -> Column:
    """The name of the first edge above value, the last name from the last edge on; null stays null."""
    out = F.when(value.isNull(), F.lit(None))
    for edge, name in zip(edges, names):
        out = out.when(value < edge, name)
    return out.otherwise(F.lit(names[-1]))


def frame_rate(rows: DataFrame, *keys: str) -> DataFrame:
    """Frames a second between a key's first and last frame; null for a key with one moment."""
    ends = rows.groupBy(*keys).agg(F.min(F.struct("frame_number", "timestamp_seconds")).alias("a"), F.max(F.struct("frame_number", "timestamp_seconds")).alias("b"))
    seconds = F.col("b.timestamp_seconds") - F.col("a.timestamp_seconds")
    return ends.select(*keys, F.when(seconds > 0, F.round((F.col("b.frame_number") - F.col("a.frame_number")) / seconds, 6)).alias("fps"))


def steps(rows: DataFrame, track: str) -> DataFrame:
    """(track, steps, median_step, reactivations): way between consecutive centres, and how often frames were missing in between."""
    own = Window.partitionBy(track).orderBy("frame_number")
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    way = F.hypot(cx - F.lag(cx).over(own), cy - F.lag(cy).over(own))
    moved = rows.select(track, way.alias("way"), (F.col("frame_number") - F.lag("frame_number").over(own)).alias("gap"))
    return moved.groupBy(track).agg(F.count("way").alias("steps"), F.round(F.percentile("way", 0.5), 6).alias("median_step"), F.count_if(F.col("gap") > 1).alias("reactivations"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Median centre of a key's boxes, the 75th percentile of the distance to it, and the area all boxes cover together."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    middle = rows.groupBy(key).agg(
        F.percentile(cx, 0.5).alias("mx"), F.percentile(cy, 0.5).alias("my"), ((F.max("x2") - F.min("x1")) * (F.max("y2") - F.min("y1"))).alias("footprint")
    )
    off = F.hypot(cx - F.col("mx"), cy - F.col("my"))
    out = rows.join(middle, key).groupBy(key, "mx", "my", "footprint").agg(F.round(F.percentile(off, 0.75), 6).alias("p75"))
    return out.select(key, F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"), "p75", F.round("footprint", 6).alias("footprint"))


def vector_means(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, place, mean): the mean of each place of a key's vectors; null vectors and components do not count."""
    parts = rows.select(key, F.posexplode(vector).alias("place", "x"))
    return parts.groupBy(key, "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def disagreements(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """How two sources of a label compare for each key: equal, different, and known to one alone."""
    x, y = F.col(a), F.col(b)
    known_x, known_y = x != "UNKNOWN", y != "UNKNOWN"
    return rows.groupBy(*keys).agg(
        F.count_if(x == y).alias("equal"), F.count_if(known_x & known_y & (x != y)).alias("different"), F.count_if(known_x & ~known_y).alias("only_first"), F.count_if(~known_x & known_y).alias("only_second")
    )


def recommended(profiles: DataFrame, least_match: float, least_small: float) -> DataFrame:
    """The fastest profile (name, match, small, fps) that is good enough by both rates; of equal speeds the first name; no row if none is."""
    good = profiles.where((F.col("match") >= least_match) & (F.col("small") >= least_small))
    return good.orderBy(F.desc("fps"), "name").limit(1)
