"""Samples by quota: some from every stratum, then the rest from what is left. No order of all rows is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: Evidence roles in the order in which representatives are taken.
ROLE_PRIORITY = ("BEST_OVERALL", "HIGHEST_CONFIDENCE", "LARGEST", "SHARPEST", "MIDDLE", "FIRST", "LAST")


def representatives(items: DataFrame, key: list[str], quality: list[Column], most: int = 5) -> DataFrame:
    """At most `most` items (role, path, frame_number) of each key: the best of each role in the order of ROLE_PRIORITY, then
    the best of all; a path is taken once. quality: columns, larger is better; of equal items the earlier frame, then the path.
    """
    better = [*(q.desc() for q in quality), F.col("frame_number"), F.col("path")]
    place = F.coalesce(*(F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(ROLE_PRIORITY)))
    ranked = items.withColumns({"_role": place, "_in_role": F.row_number().over(Window.partitionBy(*key, "role").orderBy(*better)), "_in_all": F.row_number().over(Window.partitionBy(*key).orderBy(*better))})
    turn = F.when(F.col("_role").isNotNull() & (F.col("_in_role") == 1), F.struct(F.lit(0).alias("round"), F.col("_role").alias("at"))).otherwise(F.struct(F.lit(1).alias("round"), F.col("_in_all").alias("at")))
    once = ranked.withColumn("_turn", turn).withColumn("_of_path", F.row_number().over(Window.partitionBy(*key, "path").orderBy("_turn")))
    taken = once.where("_of_path = 1").withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_turn"))).where(F.col("_n") <= most)
    return taken.drop("_role", "_in_role", "_in_all", "_turn", "_of_path", "_n")


def stratified(rows: DataFrame, stratum: str, order: list[Column], rest_order: list[Column], most: int, quota: int = 1) -> DataFrame:
    """At most `most` rows: the first `quota` of each stratum by order, strata by their values, then what is left by rest_order.

    Two passes: the first keeps `quota` rows a stratum; the second takes only as many as are missing. The orders should be
    total. Rows come with pick, their place in the sample.
    """
    first = Window.partitionBy(stratum).orderBy(*order)
    marked = written(rows.withColumn("_nth", F.row_number().over(first)), "strata")
    chosen = marked.where(F.col("_nth") <= quota).orderBy(stratum, "_nth").limit(most)  # the smallest of a stated number
    chosen = written(chosen.withColumn("pick", F.row_number().over(Window.orderBy(stratum, "_nth"))), "quota")
    missing = most - chosen.count()
    if missing <= 0:
        return chosen.drop("_nth")
    rest = marked.where(F.col("_nth") > quota).orderBy(*rest_order).limit(missing)
    rest = rest.withColumn("pick", F.row_number().over(Window.orderBy(*rest_order)) + (most - missing))
    return chosen.unionByName(rest).drop("_nth")


def one_of_each(rows: DataFrame, key: list[str], order: list[str], buckets: dict[str, Column]) -> DataFrame:
    """(bucket, rows' columns): for each bucket, in turn, the first row by order that fits it and was not taken before.

    Each bucket is one aggregate over the rows; a bucket that nothing fits has no row. Keys must be unique and not null.
    """
    kept = None
    place = F.struct(*order, *key)
    for name, fits in buckets.items():
        left = rows if kept is None else rows.join(kept.select(*key), key, "left_anti")
        one = left.where(fits).agg(F.min_by(F.struct("*"), place).alias("_row")).where("_row is not null").select(F.lit(name).alias("bucket"), "_row.*")
        one = written(one, "bucket")
        kept = one if kept is None else kept.unionByName(one)
    return kept
