"""Evidence of tracks: scores, roles, capture zones and bounded pools."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import area, box, centeredness, clip, edge_visibility, height, padded, width

#: The weights of an observation's overall score.
WEIGHTS = {"confidence": 0.35, "sharpness": 0.25, "area": 0.20, "center": 0.10, "edge": 0.10}
#: The weights of the score that an observation has as it comes, when its track's largest values are not known.
INSTANT = {"confidence": 1000.0, "sharpness": 0.5, "area": 0.01, "center": 100.0, "edge": 100.0}


def scored(rows: DataFrame, key: str, frame_width: float, frame_height: float) -> DataFrame:
    """rows (box, confidence, sharpness) with bbox_area and overall: area and sharpness relative to the track's largest."""
    fw, fh = F.lit(float(frame_width)), F.lit(float(frame_height))
    own = Window.partitionBy(key)
    part = lambda c: F.coalesce(F.try_divide(clip(F.col(c), 0.0, float("inf")), F.max(c).over(own)), F.lit(0.0))
    sized = rows.withColumn("bbox_area", area(box()))
    overall = (
        WEIGHTS["confidence"] * clip(F.col("confidence")) + WEIGHTS["sharpness"] * clip(part("sharpness")) + WEIGHTS["area"] * clip(part("bbox_area"))
        + WEIGHTS["center"] * centeredness(box(), fw, fh) + WEIGHTS["edge"] * edge_visibility(box(), fw, fh)
    )
    return sized.withColumn("overall", overall)


def instantaneous(rows: DataFrame, frame_width: float, frame_height: float) -> DataFrame:
    """rows (box, confidence, sharpness) with the padded box cx1 ... cy2 of their crop and the score they have as they come."""
    fw, fh = F.lit(float(frame_width)), F.lit(float(frame_height))
    crop = padded(box(), fw, fh)
    cut = rows.withColumns({f"c{c}": v.cast("double") for c, v in zip(("x1", "y1", "x2", "y2"), crop)})
    parts = {"confidence": F.col("confidence"), "sharpness": F.col("sharpness"), "area": width(box("c")) * height(box("c")), "center": centeredness(box(), fw, fh), "edge": edge_visibility(box(), fw, fh)}
    return cut.withColumn("instant", sum((w * parts[k] for k, w in INSTANT.items()), F.lit(0.0)))


def roles(rows: DataFrame, key: str) -> DataFrame:
    """(key, role, frame_number): the observation that plays each role. Ties go to the earliest frame."""
    frame = F.col("frame_number")
    spans = rows.groupBy(key).agg(
        F.min("frame_number").alias("FIRST"), F.max("frame_number").alias("LAST"),
        F.max_by("frame_number", F.struct("confidence", -frame)).alias("HIGHEST_CONFIDENCE"), F.max_by("frame_number", F.struct("bbox_area", -frame)).alias("LARGEST"),
        F.max_by("frame_number", F.struct("sharpness", -frame)).alias("SHARPEST"), F.max_by("frame_number", F.struct("overall", "confidence", -frame)).alias("BEST_OVERALL"),
    )
    middle = (F.col("FIRST") + F.col("LAST")) / 2.0
    near = rows.join(spans.select(key, middle.alias("midpoint")), key).groupBy(key).agg(F.min_by("frame_number", F.struct(F.abs(frame - F.col("midpoint")), frame)).alias("MIDDLE"))
    names = ["FIRST", "MIDDLE", "LAST", "HIGHEST_CONFIDENCE", "LARGEST", "SHARPEST", "BEST_OVERALL"]
    return spans.join(near, key).unpivot([key], names, "role", "frame_number")


def zone_events(rows: DataFrame, key: str, top: float, bottom: float) -> DataFrame:
    """One row per track: entries into the band between top and bottom, exits below it, and the frame of the lowest point."""
    own = Window.partitionBy(key).orderBy("frame_number")
    y = F.col("y2")
    at = rows.withColumn("position", F.when(y < top, "above").when(y > bottom, "below").otherwise("inside"))
    moved = at.withColumn("before", F.lag("position").over(own))
    enters = (F.col("position") == "inside") & ~F.col("before").eqNullSafe(F.lit("inside"))
    leaves = (F.col("position") == "below") & F.col("before").eqNullSafe(F.lit("inside"))
    return moved.groupBy(key).agg(
        F.count_if(enters).alias("entries"), F.count_if(leaves).alias("exits"), F.min(F.when(enters, F.col("frame_number"))).alias("first_entry"),
        F.max(F.when(leaves, F.col("frame_number"))).alias("last_exit"), F.max("y2").alias("max_trigger_y"), F.max_by("frame_number", F.struct("y2", "frame_number")).alias("frame_of_max"),
        F.count_if(F.col("position") == "inside").alias("candidates"),
    )


def geometry_status(zones: DataFrame, top: float) -> DataFrame:
    """(status, why) of each track: did it reach the zone, and was anything usable captured there (candidates, eligible)?"""
    short = F.col("max_trigger_y") < top
    lost = F.upper(F.coalesce("reason", F.lit(""))) == "LOST_TIMEOUT"
    status = (
        F.when(short & lost, "TRACK_ENDED_BEFORE_ZONE").when(short, "NEVER_REACHED_ZONE").when(F.col("candidates") == 0, "REACHED_ZONE_NO_CAPTURE")
        .when(F.col("eligible") > 0, "CAPTURED_ELIGIBLE").otherwise("CAPTURED_TOO_SMALL")
    )
    return zones.withColumn("geometry_status", status)


def trigger_histogram(zones: DataFrame, frame_height: float, bins: int = 5) -> DataFrame:
    """(bin, tracks): tracks by their lowest point, in equal parts of the frame."""
    part = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("max_trigger_y") / frame_height * bins)))
    return zones.groupBy(part.cast("long").alias("bin")).agg(F.count("*").alias("tracks"))


def summary(chosen: DataFrame, key: str) -> DataFrame:
    """Count and sorted distinct roles of each track's evidence."""
    return chosen.groupBy(key).agg(F.count("*").alias("items"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.countDistinct("frame_number").alias("frames"))


def _kept_in_order(rows: DataFrame, key: str, order: list, names: list[str], choose: Callable[[list[tuple]], list[int]]) -> DataFrame:
    """The rows that `choose` picks of each track's list of the named values, in order.

    Tracks are dealt by key and streamed in order, many to a batch; only the track at hand is held.
    """
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in itertools.chain(batches, [None]):
            if pdf is None:
                whole, rest = rest, None
            else:
                pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                last = pdf[key].ne(pdf[key].iloc[-1]).to_numpy().nonzero()[0] if len(pdf) else []
                cut = int(last[-1]) + 1 if len(last) else 0
                whole, rest = pdf.iloc[:cut], pdf.iloc[cut:].reset_index(drop=True)
            if whole is None or not len(whole):
                continue
            values, keep, at = list(zip(*(whole[n].tolist() for n in names))), [], 0
            for _, group in itertools.groupby(whole[key].tolist()):
                n = sum(1 for _ in group)
                keep += [at + i for i in choose(values[at : at + n])]
                at += n
            yield whole.iloc[keep][columns]

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, rows.schema)


def _overlap(a: tuple, b: tuple) -> float:
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def bounded_pool(rows: DataFrame, key: str, most: int = 7, frame_gap: int = 3, same: float = 0.85) -> DataFrame:
    """The observations of `instantaneous` that an online pool of at most `most` keeps for each track.

    They come in the order of frames and are judged by what is known then. A newcomer whose crop nearly equals that of a kept
    one close in time takes its place if it scores better, its score lifted to their overlap at least; else it goes. A full
    pool drops its weakest, of equal ones the earlier. Of a frame that comes twice the first counts.
    """

    def choose(track: list[tuple]) -> list[int]:
        pool: list[tuple[float, int, tuple, int]] = []
        for at, (frame, score, *crop) in enumerate(track):
            if any(p[1] == frame for p in pool):
                continue
            near = [(overlap, -i) for i, p in enumerate(pool) if abs(p[1] - frame) <= frame_gap and (overlap := _overlap(p[2], crop)) >= same and overlap > 0]
            if near:
                overlap, twin = max(near)
                score = max(score, overlap)
                if score > pool[-twin][0]:
                    pool.pop(-twin)
                    pool.append((score, frame, crop, at))
                continue
            pool.append((score, frame, crop, at))
            if len(pool) > most:
                pool.remove(min(pool, key=lambda p: (p[0], p[1])))
        return sorted(p[3] for p in pool)

    return _kept_in_order(rows, key, ["frame_number", F.desc("instant")], ["frame_number", "instant", "cx1", "cy1", "cx2", "cy2"], choose)


def spaced(rows: DataFrame, key: str, most: int = 3, gap: int = 3) -> DataFrame:
    """Greedy choice by score: an observation within `gap` frames of a better chosen one is passed over."""

    def choose(track: list[tuple]) -> list[int]:
        taken: list[int] = []
        for i, (frame, *_) in enumerate(track):
            if len(taken) < most and all(abs(frame - track[t][0]) > gap for t in taken):
                taken.append(i)
        return taken

    return _kept_in_order(rows, key, [F.desc("overall"), "frame_number"], ["frame_number"], choose)
