"""Counts, summaries, rankings and comparisons of vehicle records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import taxonomy
from ..plans.compiler import condition, group_key, select
from ..plans.plan import Filter, Query


def dense_counts(records: DataFrame, column: str, labels: tuple[str, ...]) -> DataFrame:
    """(label, place, n) for every label of a taxonomy, zeros included."""
    counts = records.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return F.broadcast(taxonomy(records.sparkSession, labels)).join(counts, "label", "left").select("label", "place", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def present_labels(records: DataFrame, column: str, labels: tuple[str, ...]) -> DataFrame:
    """The labels that occur, in the taxonomy's order."""
    return dense_counts(records, column, labels).where("n > 0")


def summary(records: DataFrame) -> DataFrame:
    """One row: how many, and from when to when."""
    return records.agg(F.count("*").alias("total"), F.min("first_seen_seconds").alias("first_seen"), F.max("last_seen_seconds").alias("last_seen"))


def grouped_summary(records: DataFrame, query: Query, labels: tuple[str, ...]) -> DataFrame:
    """(key, label, n, total, first_seen, last_seen): a summary for each group with dense class counts.

    Groups and labels are few; records are aggregated once, and the labels are laid out from the aggregate.
    """
    chosen = select(records, query).withColumn("key", group_key(query))
    counted = [F.count_if(F.col("vehicle_class") == x).alias(f"n{i}") for i, x in enumerate(labels)]
    rows = chosen.groupBy("key").agg(F.count("*").alias("total"), F.min("first_seen_seconds").alias("first_seen"), F.max("last_seen_seconds").alias("last_seen"), *counted)
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(f"n{i}").alias("n")) for i, x in enumerate(labels))))
    return rows.select("key", "total", "first_seen", "last_seen", pairs.alias("p")).select("key", "total", "first_seen", "last_seen", "p.*")


def grouped_counts(records: DataFrame, query: Query) -> DataFrame:
    """(key, n) for the groups that occur."""
    return select(records, query).groupBy(group_key(query).alias("key")).agg(F.count("*").alias("n"))


def ranking(records: DataFrame, query: Query) -> DataFrame:
    """(place, key, n, winner): groups by count, ties by label. All winners are listed, and at least three groups.

    The windows run over the groups, not over the records.
    """
    counts = grouped_counts(records, query)
    by_count = F.desc("n") if query.descending else F.asc("n")
    ranked = counts.withColumn("place", F.row_number().over(Window.orderBy(by_count, "key"))).withColumn("winner", F.rank().over(Window.orderBy(by_count)) == 1)
    winners = F.count_if("winner").over(Window.partitionBy())
    shown = ranked.where(F.col("n") > 0).withColumn("shown", F.greatest(winners, F.lit(query.limit or 3), F.lit(3)))
    return shown.where("place <= shown").select(F.col("place").cast("long").alias("place"), "key", "n", "winner")


def top_group(records: DataFrame, query: Query) -> DataFrame:
    """(key, n) of the largest group; of equal ones the smallest label."""
    return grouped_counts(records, query).orderBy(F.desc("n"), "key").limit(1)


def operand(filters: Filter | None) -> Column:
    return F.count_if(condition(filters))


def comparison(records: DataFrame, query: Query, left: Filter, right: Filter, left_label: str, right_label: str) -> DataFrame:
    """Both counts in one pass, with their difference, ratio, percentage and winner."""
    counts = select(records, query).agg(operand(left).alias("left_total"), operand(right).alias("right_total"))
    a, b = F.col("left_total"), F.col("right_total")
    ratio = F.try_divide(a.cast("double"), b.cast("double"))
    return counts.select(
        "left_total", "right_total", F.abs(a - b).alias("difference"), F.round(ratio, 6).alias("ratio"), F.round(ratio * 100.0, 3).alias("percentage"),
        F.when(a > b, left_label).when(b > a, right_label).alias("winner"), (a == b).alias("is_tie"), F.when(a > b, "YES").otherwise("NO").alias("answer"),
    )


def metric(records: DataFrame, query: Query, kind: str, left: Filter | None = None, right: Filter | None = None) -> DataFrame:
    """One value: vehicle_count, a signed difference, an unrounded ratio or percentage (null over nothing)."""
    a, b = operand(left), operand(right)
    ratio = F.try_divide(a.cast("double"), b.cast("double"))
    value = {"vehicle_count": F.count("*"), "difference": a - b, "ratio": ratio, "percentage": ratio * 100.0}[kind]
    return select(records, query).agg(value.cast("double").alias("value"))


def plate_counts(records: DataFrame, query: Query) -> DataFrame:
    """How many records have a readable plate, an unreadable one, or none."""
    readable, detected = F.coalesce(F.col("plate_text") != "", F.lit(False)), F.coalesce("plate_detected", F.lit(False))
    return select(records, query).agg(
        F.count("*").alias("total"), F.count_if(readable).alias("readable"), F.count_if(detected & ~readable).alias("unreadable"), F.count_if(~detected & ~readable).alias("missing")
    )


def distribution(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, median, 95th percentile and maximum; 0 where there is nothing."""
    stats = {"mean": F.avg(value), "p50": F.percentile(value, 0.5), "p95": F.percentile(value, 0.95), "largest": F.max(value)}
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), *(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in stats.items()))
