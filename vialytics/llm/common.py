"""Shared helpers: the shared folder, written intermediate tables, hashing and connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of rows kept for training: crc32(doc_id as text) mod FOLDS is not 0; the rest is held out.
FOLDS = 5


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vialytics-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_base(spark)}/vialytics-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote, once everything made from them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession, *broadcasts) -> None:
    """After a large step: Spark deletes shuffle files of finished steps when the driver collects garbage. Destroys the broadcasts."""
    for b in broadcasts:
        b.destroy()
    gc.collect()
    spark._jvm.System.gc()


#: Caches of this Python worker that outlive a task, by name: how each is emptied.
CACHES: dict[str, Callable[[], None]] = {}


def give_back(keep: str | None = None) -> None:
    """Empty all caches but `keep` and return unused memory: workers are reused, and an executor's memory is shared."""
    for name, clear in CACHES.items():
        if name != keep:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def begin(keep: str | None = None) -> None:
    """Before a task: caches that other operators left go. What a new worker has imported is set apart from garbage collection
    for good, as each full one would walk all of it, and a task asks for three of them, however few rows it has."""
    if not gc.get_freeze_count():
        gc.collect()
        gc.freeze()
    if any(name != keep for name in CACHES):
        give_back(keep)


def frugal(run: Callable, keep: str | None = None) -> Callable:
    """run for mapInArrow. Caches that other operators left go when its task begins, unused memory when it ends."""

    @functools.wraps(run)
    def task(it):
        begin(keep)
        try:
            yield from run(it)
        finally:
            give_back(keep)

    return task


def fresh(name: str, taken: list[str]) -> str:
    """A column name that differs from all of `taken`, also in lower case."""
    low = {c.lower() for c in taken}
    return next(n for k in range(len(low) + 1) if (n := f"{name}{k}").lower() not in low)


def held_out(doc_id) -> F.Column:
    """True for rows whose label or language no model may learn (null ids count as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur-style) over a uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    made = [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, type=f.type) for f in schema]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) for the members of each component of the edges a-b, roots left out."""
    if not len(a):
        return a[:0], a[:0]
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:  # min-label hooking with pointer jumping; nodes are sorted, so labels order as ids do
        lx, ly = label[x], label[y]
        low = np.minimum(lx, ly)
        new = label.copy()
        np.minimum.at(new, lx, low)
        np.minimum.at(new, ly, low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forests(it):
    """The edges of one task as (member, smallest member) of each component that they make."""
    edges = [[c.to_numpy() for c in columns] for columns in batches(it, "a", "b")]
    if edges:
        a, b = local_forest(*(np.concatenate(c) for c in zip(*edges)))
        for lo in range(0, len(a), 50_000):
            yield arrow_rows(_EDGE, a=a[lo : lo + 50_000], b=b[lo : lo + 50_000])


def connected_components(edges: DataFrame, tag: str = "cc", max_rounds: int = 40) -> DataFrame:
    """(id, component_id = smallest id reachable) for every id in edges (a, b), by alternating star rounds.

    Each round aggregates the smallest neighbour and joins it back; both sides of that join are plain exchanges,
    so adaptive execution can split a hub with a third of all edges. Then tasks join what the larger ends of their edges
    have in common; a hub is the smaller end of its edges, so these are spread. Rounds are written to the shared folder
    and end when each node is either the root of others or hangs under one root.
    Nothing but one counter reaches the driver. Null endpoints and self-loops are ignored.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = lambda rows: materialize(rows.repartition(parts, "a").mapInArrow(frugal(_forests), "a long, b long"), tag)
    cur = folded(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(max_rounds):
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max(F.when(F.col("b") < F.col("a"), F.col("b"))).alias("above"))
        # a node under another that has nodes of its own or hangs under two
        open_ = F.coalesce((F.col("high") > F.col("a")) | (F.col("above") != F.col("low")), F.lit(False)) & F.col("above").isNotNull()
        low = materialize(ends.select("a", F.least("a", "low").alias("m"), open_.alias("open")), tag)
        if not low.agg(F.count_if("open")).first()[0]:
            discard(cur)
            return low.select(F.col("a").alias("id"), F.col("m").alias("component_id"))
        # every larger neighbour of u is hung under u's smallest neighbour
        up = both.where("b > a").join(low.select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, cur = cur, folded(up)
        discard(last, low)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def batches(it: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[pa.Array]]:
    """The named columns of each batch that has rows."""
    for b in it:
        if b.num_rows:
            yield [b.column(b.schema.get_field_index(n)) for n in names]
