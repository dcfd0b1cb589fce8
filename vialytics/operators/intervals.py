"""Counts of two classes over a grid of time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def windows(records: DataFrame, left: str, right: str, seconds: float = 5.0) -> DataFrame:
    """(k, left_n, right_n) for every window [k * seconds, (k + 1) * seconds] up to the last time seen.

    A record counts in each window that it touches, ends included; a missing first time is the beginning, a missing last
    time the end. A record adds one where it begins and takes one behind its end, so no record is multiplied; the running
    sums go over the grid alone, which is as long as the time covered.
    """
    w = float(seconds)
    top = records.agg(F.floor(F.max(F.greatest("first_seen_seconds", "last_seen_seconds")) / w).cast("long").alias("top"))
    first = F.greatest(F.lit(0), F.ceil(F.coalesce("first_seen_seconds", F.lit(0.0)) / w) - 1).cast("long")
    last = F.floor(F.col("last_seen_seconds") / w).cast("long")
    side = records.where(F.col("vehicle_class").isin(left, right)).select((F.col("vehicle_class") == left).alias("is_left"), first.alias("k0"), (last + 1).alias("k1"))
    steps = side.select("is_left", F.explode(F.array(F.struct(F.col("k0").alias("k"), F.lit(1).alias("d")), F.struct(F.col("k1").alias("k"), F.lit(-1).alias("d")))).alias("s"))
    moved = (
        steps.where("s.k is not null").groupBy(F.col("s.k").alias("k"))
        .agg(F.sum(F.when(F.col("is_left"), F.col("s.d")).otherwise(0)).alias("dl"), F.sum(F.when(F.col("is_left"), 0).otherwise(F.col("s.d"))).alias("dr"))
    )
    grid = top.where("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("k"))
    order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(moved, "k", "left").select("k", F.sum(F.coalesce("dl", F.lit(0))).over(order).alias("left_n"), F.sum(F.coalesce("dr", F.lit(0))).over(order).alias("right_n"))


def matching(grid: DataFrame, operator: str) -> DataFrame:
    """The windows in which left compares with right as asked: >, < or =."""
    a, b = F.col("left_n"), F.col("right_n")
    return grid.where({">": a > b, "<": a < b, "=": a == b}[operator])


def merged(found: DataFrame, seconds: float = 5.0) -> DataFrame:
    """(start_time, end_time, left_n, right_n): neighbouring windows with equal counts as one."""
    order = Window.orderBy("k")
    goes_on = (F.lag("k").over(order) == F.col("k") - 1) & (F.lag("left_n").over(order) == F.col("left_n")) & (F.lag("right_n").over(order) == F.col("right_n"))
    runs = found.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("run").agg((F.min("k") * seconds).alias("start_time"), ((F.max("k") + 1) * seconds).alias("end_time"), F.first("left_n").alias("left_n"), F.first("right_n").alias("right_n")).drop("run")
