"""Labels of a track decided by the votes of its crops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import UNKNOWN

WEAK, LEAST_GAP, GAP_SHARE, AGREEMENT = 0.40, 0.05, 0.15, 0.60


def weighted_vote(predictions: DataFrame, key: str, label: str = "label", weight: str = "weight") -> DataFrame:
    """(key, label, reason, agreement, total): the label with the largest weight, UNKNOWN where it is weak, contested or alone.

    Missing and UNKNOWN labels do not vote; tracks of which none votes are not listed.
    """
    votes = predictions.where(F.col(label).isNotNull() & (F.col(label) != UNKNOWN)).groupBy(key, label).agg(F.sum(F.coalesce(weight, F.lit(0))).alias("w"))  # a whole zero: decimals stay decimals
    ranked = votes.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("w"), F.desc(label))))
    per_key = ranked.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col(label))).alias("top"), F.max(F.when(F.col("rank") == 1, F.col("w"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("w"))).alias("second"), F.sum("w").alias("total"),
    )
    agreement = F.try_divide(F.col("first").cast("double"), F.col("total").cast("double"))
    # rounded, so that a gap of just the limit does not depend on the order of sums
    close = F.round((F.col("first") - F.col("second")).cast("double"), 9) <= F.round(F.greatest(F.lit(LEAST_GAP), GAP_SHARE * F.col("first").cast("double")), 9)
    reason = (
        F.when(F.col("second").isNull() & (F.col("first") < WEAK), "single_weak_prediction").when(F.col("second").isNull(), "weighted_agreement")
        .when(close, "conflicting_high_quality_predictions").when(agreement >= AGREEMENT, "weighted_majority").otherwise("insufficient_agreement")
    )
    return per_key.select(key, F.when(reason.isin("weighted_agreement", "weighted_majority"), F.col("top")).otherwise(UNKNOWN).alias("label"), reason.alias("reason"), agreement.alias("agreement"), "total")


def first_valid(predictions: DataFrame, key: str, order: str, label: str = "label") -> DataFrame:
    """The first label in order that is not missing or UNKNOWN."""
    usable = predictions.where(F.col(label).isNotNull() & (F.col(label) != UNKNOWN))
    return usable.groupBy(key).agg(F.min_by(label, order).alias("label"), F.min(order).alias("used"))


def best_label(predictions: DataFrame, key: str) -> DataFrame:
    """The label of the largest (confidence, weight); missing numbers count as -1."""
    order = F.struct(F.coalesce("confidence", F.lit(-1.0)), F.coalesce("weight", F.lit(-1.0)), F.col("label"))
    return predictions.groupBy(key).agg(F.max_by("label", order).alias("label"))


def unanimity(predictions: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Whether a track's labels agree: unanimous, mixed, all_unknown or mixture with UNKNOWN, and the commonest label's share."""
    counts = predictions.groupBy(key, label).agg(F.count("*").alias("n"))
    stats = counts.groupBy(key).agg(
        F.sum("n").alias("total"), F.max("n").alias("most"), F.count_if(F.col(label) != UNKNOWN).alias("labels"), F.coalesce(F.sum(F.when(F.col(label) == UNKNOWN, F.col("n"))), F.lit(0)).alias("unknown")
    )
    kind = F.when(F.col("labels") == 0, "all_unknown").when(F.col("unknown") > 0, "mixture").when(F.col("labels") == 1, "unanimous").otherwise("mixed")
    return stats.select(key, kind.alias("agreement"), (F.col("most") / F.col("total") * 100.0).alias("percent"))
