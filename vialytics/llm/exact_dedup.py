"""Exact deduplication by a Golomb-coded fingerprint exchange.

Partitions hash every text, sort the fingerprints of each owner (a range of the hash space) and send them Golomb
coded. Owners decode, find values that occur more than once and return one bitmap per sender. Senders mark the set
bits as suspects; only the suspects' texts are shuffled and compared byte for byte.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, batches, frugal, materialize

SPACES = re.compile(rb"[\x20\x09-\x0D]+")
FP_BITS = 48
_ROWS = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary())])


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code of sorted non-negative integers: delta >> k in unary, then k low bits."""
    if not len(values):
        return b""
    delta = np.diff(values.astype(np.int64), prepend=0)
    quot = delta >> k
    width = quot + 1 + k
    start = np.concatenate([[0], np.cumsum(width)[:-1]])
    bits = np.zeros(int(width.sum()), dtype=np.uint8)
    ones = np.repeat(start, quot) + (np.arange(int(quot.sum())) - np.repeat(np.cumsum(quot) - quot, quot))
    bits[ones] = 1
    for i in range(k):
        bits[start + quot + 1 + i] = (delta >> (k - 1 - i)) & 1
    return np.packbits(bits).tobytes()


def golomb_decode(data: bytes, k: int, n: int) -> np.ndarray:
    """The n values that golomb_encode coded. Unary ends are found by following zero bits, code by code."""
    if not n:
        return np.zeros(0, dtype=np.int64)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8))
    # the next zero at or after every position
    zeros = np.flatnonzero(bits == 0)
    nxt = np.searchsorted(zeros, np.arange(len(bits)))
    ends = np.empty(n, dtype=np.int64)
    pos = 0
    for i in range(n):
        ends[i] = zeros[nxt[pos]]
        pos = ends[i] + 1 + k
    starts = np.concatenate([[0], ends[:-1] + 1 + k])
    low = np.zeros(n, dtype=np.int64)
    for i in range(k):
        low = (low << 1) | bits[ends + 1 + i]
    return np.cumsum(((ends - starts) << k) | low)


def _rice(span: int, n: int) -> int:
    return max(0, (max(1, span // max(n, 1))).bit_length() - 1)


def _digest(it):
    part, seq = TaskContext.get().partitionId(), 0
    for ids, texts in batches(it, "doc_id", "text"):
        sha = [hashlib.sha256(SPACES.sub(b" ", (t or "").encode())).digest() for t in texts.to_pylist()]
        yield arrow_rows(_ROWS, part=[part] * len(sha), seq=range(seq, seq + len(sha)), doc_id=ids, sha=sha)
        seq += len(sha)


def _fingerprints(sha: pd.Series) -> np.ndarray:
    raw = np.frombuffer(b"".join(bytes(x)[:8] for x in sha), dtype=">u8").astype(np.uint64)
    return (raw >> np.uint64(64 - FP_BITS)).astype(np.int64)


def normalized(text) -> F.Column:
    """Every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, part, seq.

    Null texts are empty texts and equal each other. Of equal texts the smallest doc_id stays (null ids come last);
    of rows that repeat id and text, one is kept. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    owners = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = -(-(1 << FP_BITS) // owners)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(docs.mapInArrow(frugal(_digest), "part long, seq long, doc_id long, sha binary"), "fingerprints")

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(_fingerprints(pdf["sha"]))
        out = []
        for o, own in zip(*_runs(fp // span, fp)):
            k = _rice(span, len(own))
            out.append((int(pdf["part"].iloc[0]), int(o), k, len(own), golomb_encode(own - o * span, k)))
        return pd.DataFrame(out, columns=["part", "owner", "k", "n", "code"])

    def answer(it):
        """All messages of the owners of this task: two passes over the codes, values that repeat are set in bitmaps."""
        got = [p for p in it if len(p)]
        if not got:
            return
        msgs = pd.concat(got, ignore_index=True)
        for _, m in msgs.groupby("owner", sort=False):
            lists = [golomb_decode(bytes(c), int(k), int(n)) for c, k, n in zip(m["code"], m["k"], m["n"])]
            values, count = np.unique(np.concatenate(lists), return_counts=True)
            again = values[count > 1]
            bits = [np.packbits(np.isin(x, again)).tobytes() for x in lists]
            yield pd.DataFrame({"part": m["part"], "owner": m["owner"], "bits": bits})

    def mark(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        fp = _fingerprints(left["sha"])
        order = np.argsort(fp, kind="stable")
        own = fp[order] // span
        flags = np.zeros(len(left), dtype=bool)
        for o, b in zip(right["owner"], right["bits"]):
            lo, hi = np.searchsorted(own, o), np.searchsorted(own, o, side="right")
            flags[order[lo:hi]] = np.unpackbits(np.frombuffer(bytes(b), dtype=np.uint8))[: hi - lo].astype(bool)
        return left.loc[flags, ["doc_id"]]

    sent = rows.groupBy("part").applyInPandas(send, "part long, owner long, k int, n int, code binary")
    bitmaps = sent.repartition(owners, "owner").mapInPandas(answer, "part long, owner long, bits binary")
    suspects = rows.groupBy("part").cogroup(bitmaps.groupBy("part")).applyInPandas(mark, "doc_id long")
    suspects = materialize(suspects.distinct(), "suspects")
    texts = docs.join(suspects, docs["doc_id"].eqNullSafe(suspects["doc_id"]), "left_semi").select("doc_id", normalized(F.col("text")).alias("norm"))
    groups = texts.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = materialize(groups.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "groups")
    first = F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy("part", "seq")) == 1
    ranked = rows.withColumn("first", first)
    out = materialize(ranked, "ranked").join(groups, "sha", "left")
    return out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first") & (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "part",
        "seq",
    )


def _runs(keys: np.ndarray, values: np.ndarray):
    """Consecutive equal keys and the values of each run."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate([[0], cut])] if len(keys) else keys, np.split(values, cut) if len(values) else []


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns: one row of each group of equal texts.

    Texts are shuffled once, to meet the ids that stay; only rows that repeat id and text are compared again.
    """
    groups = exact_groups(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept")
    kept = materialize(groups.select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_key"), F.col("n").alias("_n")), "kept")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.unhex(F.sha2(normalized(F.col("text")), 256)).alias("sha"))
    stay = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["sha"] == kept["_key"]))
    once = stay.where("_n = 1").select("row.*")
    if not kept.where("_n > 1").limit(1).count():
        return once
    return once.unionByName(stay.where("_n > 1").dropDuplicates(["doc_id", "sha"]).select("row.*"))
