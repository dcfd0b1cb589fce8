"""Embedding near-dedup: an exact metric range join inside each label.

Every label gets pivots in proportion to its size, which cut the unit sphere into cells. By the triangle inequality a
vector can only reach into another cell if it lies close enough to the plane between the two pivots; only there it is
replicated. Cells join independently, in blocks. Pivots are rows of a table: they travel beside the vectors they place.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, batches, connected_components, discard, frugal, materialize

CELL = 1000  # vectors for each pivot; from CELL squared on, a label of n vectors has sqrt(n) pivots
PLACE = 20_000  # vectors that one task places among the pivots of their label
BLOCK = 3000
_VALID = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("key", pa.binary()), ("vector", pa.binary())])


def _clean(it):
    """key and vector are null for what links with nothing: null ids, labels and vectors, zero and non-finite ones."""
    for ids, labels, vectors in batches(it, "vec_id", "label", "embedding"):
        keys, out = [], []
        for i, lab, v in zip(ids.to_pylist(), labels.to_pylist(), vectors.to_pylist()):
            key = raw = None
            if i is not None and lab is not None and v and None not in v:
                x = np.array(v, dtype=np.float64)
                scale = np.max(np.abs(x))
                if np.isfinite(scale) and scale > 0:
                    raw = (x / scale).tobytes()  # cosines keep, squares neither overflow nor vanish
                    key = hashlib.blake2b(raw, digest_size=16).digest()
            keys.append(key)
            out.append(raw)
        yield arrow_rows(_VALID, vec_id=ids, label=labels, key=keys, vector=out)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, dtype=np.float64) for r in raw])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_PLACED = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int64()), ("home", pa.bool_()), ("cid", pa.int64()), ("weight", pa.int64()), ("vector", pa.binary())])


def _place(reach: float):
    """Rows sorted by task, pivots first: (cell, home) for each vector, its nearest pivot's cell and those whose plane lies within reach."""

    def placed(pivots, own, rows):
        out = []
        x = _unit([r[4] for r in rows])
        for lo in range(0, len(rows), 256):
            cos = x[lo : lo + 256] @ pivots.T
            nearest = np.argmax(cos, axis=1)
            for p in np.unique(nearest):
                # from differences: 2 - 2 cos would lose the distance of pivots that are nearly one vector
                between = np.linalg.norm(pivots - pivots[p], axis=1)
                for k in np.flatnonzero(nearest == p).tolist():
                    label, dim, cid, weight, raw = rows[lo + k]
                    # distance to the plane between p and q: (cos_p - cos_q) / |p - q|
                    for q in np.flatnonzero(cos[k, p] - cos[k] - reach * between <= 1e-9).tolist():
                        out.append((label, dim, own[q], q == p, cid, weight, raw))
        for lo in range(0, len(out), 2000):
            yield arrow_rows(_PLACED, **dict(zip(_PLACED.names, zip(*out[lo : lo + 2000]))))

    def run(it):
        task, raws, own, rows, pivots = None, [], [], [], None
        for tasks, pivot, *cols in batches(it, "task", "pivot", "label", "dim", "cid", "weight", "vector"):
            for t, is_pivot, *row in zip(tasks.to_pylist(), pivot.to_pylist(), *(c.to_pylist() for c in cols)):
                if t != task or len(rows) == 2000:
                    if rows:
                        yield from placed(pivots, own, rows)
                    rows = []
                    if t != task:
                        task, raws, own, pivots = t, [], [], None
                if is_pivot:
                    raws.append(row[4])
                    own.append(row[2])
                    continue
                if pivots is None:
                    pivots = _unit(raws)
                rows.append(row)
        if rows:
            yield from placed(pivots, own, rows)

    return run


_RESULT = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _join_blocks(least: float):
    """Rows sorted by task: homes of one block against all of another. Links are counted, and joined into local components."""

    def join(rows):
        side, cids, weights, raw = zip(*rows)
        side, cids, weights = np.array(side), np.array(cids), np.array(weights)
        left, right = side == 0, side == 1
        if not left.any() or not right.any():
            return
        x = np.stack([np.frombuffer(r, dtype=np.float64) for r in raw])
        norm = np.linalg.norm(x, axis=1)
        a, b, na, nb = x[left], x[right], norm[left], norm[right]
        ia, ib, wb = cids[left], cids[right], weights[right]
        linked = np.empty((len(a), len(b)), dtype=bool)
        for lo in range(0, len(a), 512):
            cos = (a[lo : lo + 512] @ b.T) / (na[lo : lo + 512, None] * nb[None, :])
            linked[lo : lo + 512] = (cos >= least) & (ia[lo : lo + 512, None] != ib[None, :])
        n = linked @ wb
        rows_on, cols_on = linked.any(axis=1), linked.any(axis=0)
        small = linked[np.ix_(rows_on, cols_on)]
        la, lb = ia[rows_on].copy(), ib[cols_on].copy()
        top = np.iinfo(np.int64).max
        while len(la):
            na_ = np.array([np.where(r, lb, top).min() for r in small]) if len(lb) else la
            na_ = np.minimum(la, na_)
            nb_ = np.minimum(lb, np.array([np.where(c, na_, top).min() for c in small.T]))
            if np.array_equal(na_, la) and np.array_equal(nb_, lb):
                break
            la, lb = na_, nb_
        yield from zip(ia.tolist(), n.tolist(), [None] * len(ia), [None] * len(ia))
        for ids, labels in ((ia[rows_on], la), (ib[cols_on], lb)):
            yield from ((None, None, i, m) for i, m in zip(ids.tolist(), labels.tolist()) if i != m)

    def run(it):
        task, rows, out = None, [], []
        for t, side, cids, weights, raw in batches(it, "task", "side", "cid", "weight", "vector"):
            for key, *row in zip(t.to_pylist(), side.to_pylist(), cids.to_pylist(), weights.to_pylist(), raw.to_pylist()):
                if key != task:
                    if rows:
                        out += join(rows)
                    task, rows = key, []
                rows.append(row)
                if len(out) > 20_000:
                    yield arrow_rows(_RESULT, **dict(zip(_RESULT.names, zip(*out))))
                    out = []
        if rows:
            out += join(rows)
        for lo in range(0, len(out), 20_000):
            yield arrow_rows(_RESULT, **dict(zip(_RESULT.names, zip(*out[lo : lo + 20_000]))))

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels link when their cosine in double precision is at least `least`. Null ids, labels
    and vectors, vectors with null or non-finite components and zero vectors link with nothing and are components of
    their own (null for a null id, which is never kept). Vectors of different lengths do not link. Rows that are equal up
    to scale are one class: they count as links of one another. Rows that repeat a vec_id with other vectors are judged
    each by its own vector; component_id is the smallest vec_id among the rows reached. Labels may be of any type, other
    columns are ignored, and an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(cols.mapInArrow(frugal(_clean), "vec_id long, label string, key binary, vector binary"), "vectors")
    good = rows.where("key is not null")
    classes = good.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("vector").alias("vector"))
    classes = materialize(classes.select("*", (F.length("vector") / 8).cast("int").alias("dim"), F.monotonically_increasing_id().alias("cid")), "classes")
    of = ["label", "dim"]
    sizes = classes.groupBy(*of).agg(F.count("*").alias("n"), F.min("cid").alias("one"))
    sizes = materialize(sizes.select("*", F.ceil(F.col("n") / F.greatest(F.lit(CELL), F.sqrt("n"))).alias("pivots"), F.ceil(F.col("n") / PLACE).alias("subs")), "label-sizes")
    sized = classes.join(sizes, of).select(*of, "cid", "weight", "vector", "n", "one", "pivots", "subs")
    # a random share of each label, by hash: about `pivots` of them but one at least, without ranking a label in one task
    drawn = F.pmod(F.xxhash64("cid", F.lit(17)), F.lit(1 << 40)) < F.col("pivots") / F.col("n") * float(1 << 40)
    chosen = sized.where(drawn | (F.col("cid") == F.col("one")))
    shape = [*of, "cid", "weight", "vector"]
    beside = chosen.select(*shape, F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.lit(True).alias("pivot"))
    plain = sized.select(*shape, F.pmod(F.xxhash64("cid"), F.col("subs")).alias("sub"), F.lit(False).alias("pivot"))
    tasks = plain.unionByName(beside).select(F.xxhash64(*of, "sub").alias("task"), "pivot", *shape)
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    dealt = tasks.repartition(parts, "task").sortWithinPartitions("task", F.desc("pivot"))
    placed = materialize(dealt.mapInArrow(frugal(_place(reach)), "label string, dim int, cell long, home boolean, cid long, weight long, vector binary"), "placed")
    cell = [*of, "cell"]
    load = placed.groupBy(*cell).agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("lefts"), F.ceil(F.count("*") / BLOCK).cast("int").alias("rights"))
    blocked = placed.join(materialize(load, "load"), cell)
    left_block, right_block = (F.pmod(F.xxhash64("cid"), F.col(c)).cast("int") for c in ("lefts", "rights"))
    pair = [*cell, "side", "cid", "weight", "vector", "i", "j"]
    left = blocked.where("home").select("*", F.lit(0).alias("side"), left_block.alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"))
    right = blocked.where("lefts > 0").select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), right_block.alias("j"))
    pairs = left.select(*pair).unionByName(right.select(*pair)).select(F.xxhash64(*cell, "i", "j").alias("task"), "side", "cid", "weight", "vector")
    joined = pairs.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(frugal(_join_blocks(least)), "cid long, n long, a long, b long")
    joined = materialize(joined, "joined")
    discard(placed)
    counts = joined.where("cid is not null").groupBy("cid").agg(F.sum("n").alias("n"))
    reached = connected_components(joined.where("a is not null").select("a", "b"), "vector-links")
    named = classes.select("label", "key", "cid", "rep", "weight").join(reached, F.col("cid") == reached["id"], "left")
    named = materialize(named.select("label", "key", "cid", "rep", "weight", F.coalesce("component_id", "cid").alias("part")), "parts")
    lowest = named.groupBy("part").agg(F.min("rep").alias("component"))
    out = named.join(lowest, "part").join(counts, "cid", "left").select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), "component")
    out = rows.select("vec_id", "label", "key").join(materialize(out, "linked"), ["label", "key"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
