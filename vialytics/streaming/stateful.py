"""Structured Streaming forms of the observation operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIFE = "camera_id string, native_id long, first_frame long, last_frame long, observations long, reason string"
_STATE = "ids array<long>, first array<long>, last array<long>, last_idx array<long>, n array<long>, idx long, frame long"


def tumbling_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by window and key; rows later than `late` behind the newest are dropped and windows closed."""
    timed = stream.withColumn("at_time", F.col(time).cast("timestamp")).withWatermark("at_time", late)
    return timed.groupBy(F.window("at_time", width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def latest_state(stream: DataFrame, key: str, time: str, *values: str) -> DataFrame:
    """The newest values of each key."""
    newest = F.max(F.struct(time, *values))
    return stream.groupBy(key).agg(F.count("*").alias("n"), newest.alias("s")).select(key, "n", "s.*")


def lifecycles(stream: DataFrame, max_lost: int = 30) -> DataFrame:
    """Tracks that ended because their id stayed away for more than max_lost frames of its camera.

    stream: camera_id, frame_number, native_id; a frame without detections comes as a row with a null native_id. The state
    of a camera holds its open tracks alone. Frames must arrive in order; rows of older frames are left out.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, first, last, last_idx, n, idx, frame = state.get if state.exists else ([], [], [], [], [], 0, -1)
        open_ = {i: [a, b, c, d] for i, a, b, c, d in zip(ids, first, last, last_idx, n)}
        ended = []
        for f, group in pd.concat(list(batches)).sort_values("frame_number").groupby("frame_number"):
            if f <= frame:
                continue
            frame, idx = int(f), idx + 1
            for i in [i for i, t in open_.items() if idx - t[2] > max_lost + 1]:
                ended.append((key[0], i, open_[i][0], open_[i][1], open_[i][3], "LOST_TIMEOUT"))
                del open_[i]
            for i in group["native_id"].dropna().astype("int64").unique().tolist():
                t = open_.setdefault(i, [frame, frame, idx, 0])
                t[1], t[2], t[3] = frame, idx, t[3] + 1
        columns = list(zip(*open_.values())) or [()] * 4
        state.update((list(open_), *map(list, columns), idx, frame))
        yield pd.DataFrame(ended, columns=["camera_id", "native_id", "first_frame", "last_frame", "observations", "reason"])

    return stream.groupBy("camera_id").applyInPandasWithState(run, LIFE, _STATE, "append", GroupStateTimeout.NoTimeout)
