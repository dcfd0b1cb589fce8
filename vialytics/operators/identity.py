"""Physical vehicles: plate evidence between two tracks, roll-ups of member tracks, and how well a clustering did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plates import similarity, unconfused

#: Limits of plate evidence and what it does to a pair's score.
CLEAR_LITERAL, CLEAR_CONFUSED, PARTIAL = 0.62, 0.72, 0.86
EXACT_FLOOR, EXACT_BONUS, PARTIAL_BONUS, WEAK_PENALTY = 0.64, 0.34, 0.18, 0.20
#: Rejections that an equal plate does not lift.
FINAL = ("different_camera", "reliable_class_conflict", "simultaneous_occupancy_conflict", "overlap_not_same_object")


def plate_relations(pairs: DataFrame) -> DataFrame:
    """pairs (plate_a, quality_a, plate_b, quality_b) with literal, confused, edits, evidence and plate_reason.

    Only two readings of HIGH quality can prove a match or a contradiction; missing plates say nothing.
    """
    a, b = F.col("plate_a"), F.col("plate_b")
    known = (F.coalesce(F.length(a), F.lit(0)) > 0) & (F.coalesce(F.length(b), F.lit(0)) > 0)
    high = (F.col("quality_a") == "HIGH") & (F.col("quality_b") == "HIGH")
    fair = F.col("quality_a").isin("HIGH", "MEDIUM") & F.col("quality_b").isin("HIGH", "MEDIUM")
    measured = pairs.withColumns(
        {
            "literal": F.when(known, similarity(a, b)).otherwise(F.lit(0.0)),
            "confused": F.when(known, similarity(unconfused(a), unconfused(b))).otherwise(F.lit(0.0)),
            "edits": F.when(known, F.levenshtein(a, b)),
        }
    )
    clear = (F.col("literal") < CLEAR_LITERAL) & (F.col("confused") < CLEAR_CONFUSED)
    close = (F.col("edits") <= 1) | (F.col("confused") >= PARTIAL)
    rules = [
        (~known, "NEUTRAL", "PLATE_MISSING"), (high & (a == b), "STRONG_POSITIVE", "PLATE_EXACT_MATCH"), (high & clear, "STRONG_NEGATIVE", "PLATE_CONTRADICTION"),
        (fair & close, "PARTIAL_POSITIVE", "PLATE_PARTIAL_MATCH"), (high, "WEAK_NEGATIVE", "PLATE_LOW_SIMILARITY"), (F.lit(True), "NEUTRAL", "PLATE_LOW_CONFIDENCE"),
    ]
    return measured.withColumns({"evidence": _first([(c, e) for c, e, _ in rules]), "plate_reason": _first([(c, r) for c, _, r in rules])})


def _first(rules: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*(F.when(c, F.lit(v)) for c, v in rules))


def plate_adjusted(pairs: DataFrame) -> DataFrame:
    """pairs of plate_relations with score and rejection (null: none) as plate evidence leaves them.

    An equal plate lifts a rejection, but none that geometry, cameras or classes decided; a contradiction rejects.
    """
    evidence, score, reason = F.col("evidence"), F.coalesce("score", F.lit(0.0)), F.col("rejection")
    blocked = F.coalesce(reason.isin(*FINAL), F.lit(False))
    lifted = (evidence == "STRONG_POSITIVE") & ~blocked
    denied = evidence == "STRONG_NEGATIVE"
    new = (
        F.when(denied, 0.0).when(lifted, F.greatest(score, F.lit(EXACT_FLOOR)) + EXACT_BONUS)
        .when((evidence == "PARTIAL_POSITIVE") & reason.isNull(), F.least(F.lit(1.0), score + PARTIAL_BONUS))
        .when((evidence == "WEAK_NEGATIVE") & reason.isNull(), F.greatest(F.lit(0.0), score - WEAK_PENALTY)).otherwise(score)
    )
    rejection = F.when(denied, "REJECTED_BY_PLATE_CONTRADICTION").when(lifted, F.lit(None)).otherwise(reason)
    seen = F.when((evidence == "STRONG_POSITIVE") & blocked, "GEOMETRY_BLOCKED_PLATE_MATCH").otherwise(evidence)
    return pairs.withColumns({"score": F.round(new, 6), "rejection": rejection, "evidence": seen})


def weighted_label(members: DataFrame, vehicle: list[str], label: str) -> DataFrame:
    """(vehicle, label): the label with the most observations of member tracks, one at least each; of equal ones the smallest."""
    votes = members.groupBy(*vehicle, label).agg(F.sum(F.greatest("observation_count", F.lit(1))).alias("votes"))
    return votes.groupBy(*vehicle).agg(F.min_by(label, F.struct(-F.col("votes"), F.col(label))).alias(label))


def rolled_up(members: DataFrame, vehicle: list[str]) -> DataFrame:
    """One row per vehicle: members in order of their first frames, cameras, ends, labels, and its best plate."""
    order = F.array_sort(F.collect_list(F.struct("first_frame", "track_id", "camera_id")))
    high = (F.col("plate_quality") == "HIGH") & (F.coalesce(F.length("plate_text"), F.lit(0)) > 0)
    rank = F.when(F.col("plate_quality") == "HIGH", 3).when(F.col("plate_quality") == "MEDIUM", 2).when(F.col("plate_quality") == "LOW", 1).otherwise(0)
    main = members.groupBy(*vehicle).agg(
        order.alias("ordered"), F.count("*").alias("member_track_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.array_sort(F.collect_set("camera_id")).alias("camera_ids"),
        F.min(F.when(high, F.col("plate_text"))).alias("plate_text"), F.coalesce(F.max(F.when(high, F.col("plate_confidence"))), F.lit(0.0)).alias("plate_confidence"),
        F.element_at(F.array(*map(F.lit, ("UNUSABLE", "LOW", "MEDIUM", "HIGH"))), F.max(rank) + 1).alias("plate_quality"),
    )
    rows = main.withColumns(
        {
            "member_track_ids": F.transform("ordered", lambda m: m["track_id"]),
            "primary_camera_id": F.element_at("ordered", 1)["camera_id"],
            "identity_status": F.when(F.col("member_track_count") > 1, "MERGED").otherwise("SINGLE_TRACK"),
        }
    ).drop("ordered")
    for label in ("vehicle_class", "colour"):
        rows = rows.join(weighted_label(members, vehicle, label), vehicle)
    return rows


def identity_metrics(vehicles: DataFrame, members: DataFrame) -> DataFrame:
    """One row: tracks, vehicles, what merging saved, and how many tracks have plates of which use."""
    tracks = members.agg(
        F.count("*").alias("completed_tracks"), F.count_if("plate_detected").alias("with_plate"), F.count("plate_text").alias("with_text"), F.count_if(F.col("plate_quality") == "HIGH").alias("with_high_quality")
    )
    made = vehicles.agg(F.count("*").alias("vehicles"), F.count_if(F.col("member_track_count") > 1).alias("merged_vehicles"))
    return tracks.crossJoin(F.broadcast(made)).withColumn("duplicates_removed", F.col("completed_tracks") - F.col("vehicles"))  # one row each


def pair_quality(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: true, false and missed pairs, precision (1 when nothing was found), recall (1 when nothing is true) and F1."""
    both = found.select(*keys).distinct().withColumn("f", F.lit(True)).join(truth.select(*keys).distinct().withColumn("t", F.lit(True)), keys, "full")
    hit, wrong, missed = F.col("f") & F.col("t"), F.col("t").isNull(), F.col("f").isNull()
    n = both.agg(F.count_if(hit).alias("tp"), F.count_if(wrong).alias("fp"), F.count_if(missed).alias("fn"))
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(1.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return n.select("tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))
