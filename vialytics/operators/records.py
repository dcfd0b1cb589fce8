"""Vehicle records: made from tracks or from physical vehicles, cleaned, merged and deduplicated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import CLASSES, COLOURS, known, scoped_id, short_track_id
from ..functions.plates import validated

FIELDS = ["run_id", "vehicle_id", "camera_id", "vehicle_class", "colour", "first_seen_seconds", "last_seen_seconds", "status", "plate_text", "plate_detected"]


def completed(tracks: DataFrame) -> DataFrame:
    """Records of completed tracks; labels outside the taxonomies become UNKNOWN, a plate is only kept where one was detected."""
    labelled = tracks.where(F.col("status") == "COMPLETED").withColumns({"vehicle_class": known(F.col("vehicle_class"), CLASSES), "colour": known(F.col("colour"), COLOURS)})
    return labelled.withColumn("plate_text", F.when(F.col("plate_detected"), F.col("plate_text")))


def unique(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """tracks, whose keys must not repeat: a key with several rows is an error when the result is computed."""
    counted = tracks.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct("*")).alias("_row"))
    shown = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys))
    ok = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.concat(F.lit("a record is repeated: "), shown)).cast(counted.schema["_row"].dataType))
    return counted.select(ok.alias("_row")).select("_row.*")


def first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by order; the order must be total to be repeatable."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def prefer_physical(physical: DataFrame, tracks: DataFrame) -> DataFrame:
    """Physical vehicles if there is any in the whole scope, else completed tracks; both with the columns of FIELDS."""
    none = F.col("n") == 0
    count = physical.agg(F.count("*").alias("n"))
    rest = completed(tracks).select(*FIELDS).join(F.broadcast(count.where(none)), F.lit(True), "left_semi")
    return physical.select(*FIELDS).unionByName(rest)


def listing(tracks: DataFrame) -> DataFrame:
    """Short ids, durations and scoped ids beside the records."""
    seconds = F.col("last_seen_seconds") - F.col("first_seen_seconds")
    return tracks.withColumns(
        {
            "short_id": short_track_id(F.col("vehicle_id")),
            "scoped_id": scoped_id(F.col("run_id"), F.col("vehicle_id")),
            "duration_seconds": F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds)),
        }
    )


def canonical_plate(rows: DataFrame, candidates: list[str], name: str) -> DataFrame:
    """rows with the canonical form of the first candidate that is a valid plate, as it stands or corrected; null without one.

    Texts are validated once, however many rows hold them: only distinct ones reach the correction.
    """
    texts = rows.select(F.explode(F.array(*(F.col(c).cast("string") for c in candidates))).alias("_text")).where("_text is not null").distinct()
    valid = texts.withColumn("_v", validated(F.col("_text"))).where("_v.valid").select("_text", F.col("_v.canonical").alias("_plate"))
    out = rows
    for i, c in enumerate(candidates):
        out = out.join(valid.select(F.col("_text").alias(c), F.col("_plate").alias(f"_plate{i}")), c, "left")
    return out.withColumn(name, F.coalesce(*(F.col(f"_plate{i}") for i in range(len(candidates))))).drop(*(f"_plate{i}" for i in range(len(candidates))))
