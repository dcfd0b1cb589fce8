"""Taxonomies and the normal forms of labels and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"
#: Labels in the order in which dense counts list them.
CLASSES = ("3WHEELER", "BUS", "CAR", "MOTORCYCLE", "TRUCK", UNKNOWN)
COLOURS = ("BLACK", "WHITE", "GREY", "SILVER", "RED", "PINK", "BLUE", "GREEN", "YELLOW", "ORANGE", "BROWN", "BEIGE", "PURPLE", "OTHER", UNKNOWN)
#: A search for a colour may also mean these.
COLOUR_ALIASES = {"RED": ("RED", "PINK")}


def known(label: Column, taxonomy: tuple[str, ...]) -> Column:
    """The label in upper case with underscores, GRAY as GREY; anything outside the taxonomy is UNKNOWN."""
    token = F.replace(F.regexp_replace(F.upper(F.trim(label)), r"\s+", "_"), F.lit("GRAY"), F.lit("GREY"))
    return F.when(token.isin(*taxonomy), token).otherwise(F.lit(UNKNOWN))


def taxonomy(spark: SparkSession, labels: tuple[str, ...]) -> DataFrame:
    """(label, place): a table as small as the taxonomy."""
    return spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, place int")


def short_track_id(track: Column) -> Column:
    return F.element_at(F.split(track, ":"), -1)


def scoped_id(run: Column, vehicle: Column) -> Column:
    """run::vehicle; the vehicle alone where there is no run."""
    return F.when(F.coalesce(run, F.lit("")) == "", vehicle).otherwise(F.concat(run, F.lit("::"), vehicle))


def track_number(track: Column) -> Column:
    """The number behind TRACK_, 0 if there is none: the natural order of track ids."""
    return F.coalesce(F.nullif(F.regexp_extract(track, r"TRACK_(\d+)$", 1), F.lit("")).cast("long"), F.lit(0))


def yes(text: Column) -> Column:
    """Text that means true; missing text is missing."""
    return F.lower(F.trim(text)).isin("yes", "1", "true")
