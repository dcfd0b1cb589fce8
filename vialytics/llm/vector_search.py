"""Approximate nearest neighbours by a forest of random-projection trees.

A tree halves a bounded sample of vectors again and again, each time by the difference of two of them; every vector is then
placed in one leaf of each tree. A query takes up leaves of all trees from one priority queue, nearest first by the largest
margin on the way, until the leaves hold a given number of vectors, and what is in them is reranked by exact inner
products. That number is not set but measured: for a bounded sample of queries the true neighbours are found by brute
force over all vectors, and the budget is the least one whose leaves would have held `TARGET` of them. So structured
vectors are searched in few leaves, while vectors without structure take a large share of all, at every size.

Work is dealt by cells, runs of neighbouring leaves of a tree with a bounded number of vectors: a query goes to a cell once,
with the leaves it wants there, and a vector that it wants in several trees is scored in the first. Equal vectors are one
entry of the index that names its smallest ids, as ties go to smaller ids; queries of equal vectors are searched once.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id. Shorter
vectors count as padded with zeros. Rows that repeat id and vector count once; an id with several vectors stands for each
of them, as a query and as a candidate, never for itself. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, batches, discard, frugal, materialize, sweep

#: The forest: trees, sampled vectors that it is fitted on (at most, up to chance), and the most of them in a leaf.
TREES, SAMPLE, LEAF = 4, 40_000, 100
#: Queries that the budget is measured on, and the share of their true neighbours that its leaves must hold.
MEASURED, TARGET = 64, 0.95
#: Vectors and queries that one task joins.
CELL, QUERIES = 25_000, 2000
_PLACED = pa.schema([("rep", pa.int64()), ("vector", pa.binary()), ("leaves", pa.list_(pa.int32()))])
_PROBE = pa.schema([("cell", pa.int64()), ("rep", pa.int64()), ("vector", pa.binary()), ("wanted", pa.binary())])
_FOUND = pa.schema([("rep", pa.int64()), ("near", pa.int64()), ("score", pa.float64())])


class Tree:
    """Node i sends a vector to low[i] if its product with normal[i] is below at[i], else to high[i]; leaf -1-j is negative."""

    def __init__(self, vectors: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normal, self.at, self.low, self.high, self.leaves = [], [], [], [], 0
        self.root = self._grow(vectors, np.arange(len(vectors)), leaf, rng)
        self.normal = np.array(self.normal).reshape(len(self.at), vectors.shape[1])

    def _grow(self, vectors: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) > leaf:
            for _ in range(3):
                a, b = vectors[rng.choice(rows, 2, replace=False)]
                if (length := np.linalg.norm(a - b)) > 0:
                    normal = (a - b) / length
                    away = vectors[rows] @ normal
                    at = np.median(away)
                    below = away < at
                    if 0.1 < below.mean() < 0.9:
                        me = len(self.at)
                        for x, y in ((self.normal, normal), (self.at, at), (self.low, 0), (self.high, 0)):
                            x.append(y)
                        self.low[me] = self._grow(vectors, rows[below], leaf, rng)
                        self.high[me] = self._grow(vectors, rows[~below], leaf, rng)
                        return me
        self.leaves += 1
        return -self.leaves

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out, waiting = np.zeros(len(vectors), np.int32), [(self.root, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                below = np.einsum("ij,j->i", vectors[rows], self.normal[node]) < self.at[node]
                waiting += [(self.low[node], rows[below]), (self.high[node], rows[~below])]
        return out


class Forest:
    """Trees over one numbering of leaves; size[leaf] is how many vectors of the whole table each leaf holds."""

    def __init__(self, vectors: np.ndarray, trees: int, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = [Tree(vectors, leaf, rng) for _ in range(trees)]
        self.first = np.cumsum([0, *(t.leaves for t in self.trees)])
        self.size = np.zeros(self.first[-1], np.int64)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """One row for each vector: its leaf in each tree."""
        return np.stack([t.place(vectors) + f for t, f in zip(self.trees, self.first)], axis=1)

    def margins(self, vectors: np.ndarray) -> list[list[np.ndarray]]:
        """For each vector and tree its signed distances from the planes of all nodes."""
        each = [vectors @ t.normal.T - np.array(t.at) for t in self.trees]
        return [[m[i].tolist() for m in each] for i in range(len(vectors))]

    def taken(self, margins: list, budget: float):
        """Leaves in the order in which the shared queue gives them, until they hold `budget` vectors."""
        queue, held = [(0.0, k, t.root) for k, t in enumerate(self.trees)], 0
        heapq.heapify(queue)
        while queue and held < budget:
            away, k, node = heapq.heappop(queue)
            tree, m = self.trees[k], margins[k]
            while node >= 0:
                d = m[node]
                near, far = (tree.low[node], tree.high[node]) if d < 0 else (tree.high[node], tree.low[node])
                heapq.heappush(queue, (max(away, abs(d)), k, far))
                node = near
            leaf = int(self.first[k]) - 1 - node
            held += int(self.size[leaf])
            yield leaf

    def cells(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, parts) of each leaf: leaves side by side share a cell of at most `most` vectors; a larger leaf has parts."""
        cell, parts, now, held = np.zeros(len(self.size), np.int64), np.ones(len(self.size), np.int64), -1, 0
        for f, t in zip(self.first, self.trees):
            held = most
            for leaf in range(f, f + t.leaves):
                n = int(self.size[leaf])
                if held + n > most:
                    now, held = now + 1, 0
                cell[leaf], parts[leaf] = now, max(1, math.ceil(n / most))
                held += n
        return cell, parts


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), dtype=np.float64).reshape(len(vectors), -1)


def _entries(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """((vec_id, rep), (rep, vector binary), components) for the rows that take part; rep is the smallest id of equal vectors."""
    spark = vectors.sparkSession
    rows = vectors.selectExpr("cast(vec_id as long) as vec_id", "cast(embedding as array<double>) as v").where("vec_id is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    padded = rows.selectExpr("vec_id", f"concat(transform(v, x -> x + 0.0d), array_repeat(0.0d, {dims} - size(v))) as v")
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary())])

    def pack(it):
        for ids, vs in batches(it, "vec_id", "v"):
            flat = np.ascontiguousarray(pa.compute.list_flatten(vs).to_numpy()).reshape(len(ids), dims)
            yield arrow_rows(schema, vec_id=ids, vector=[x.tobytes() for x in flat])

    kept = materialize(padded.mapInArrow(pack, "vec_id long, vector binary").distinct(), "ann-rows")
    reps = materialize(kept.groupBy("vector").agg(F.min("vec_id").alias("rep")), "ann-reps")
    # an id with several vectors may be the smallest of more than one: those get numbers of their own by their vector
    names = Window.partitionBy("rep").orderBy("vector")
    reps = reps.withColumn("nth", F.row_number().over(names))
    named = materialize(reps.select("vector", "rep", F.when(F.col("nth") == 1, F.col("rep")).otherwise(F.xxhash64("rep", "vector")).alias("name")), "ann-names")
    ids = materialize(kept.join(named, "vector").select("vec_id", F.col("name").alias("rep")), "ann-ids")
    return ids, named.select(F.col("name").alias("rep"), "vector"), dims


def build(entries: DataFrame, dims: int) -> tuple[Forest, DataFrame]:
    """The forest, fitted on about SAMPLE entries at most, and (rep, vector, leaves) for every entry, as a written table."""
    n = entries.count()
    part = entries if n <= SAMPLE else entries.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30)))
    sample = part.orderBy("rep").toArrow()["vector"].combine_chunks() if n else pa.array([], pa.binary())
    forest = Forest(_matrix(sample) if len(sample) else np.zeros((0, dims)), TREES, LEAF)
    sent = entries.sparkSession.sparkContext.broadcast(forest)

    def place(it):
        for reps, raw in batches(it, "rep", "vector"):
            found = sent.value.place(_matrix(raw))
            at = pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32())
            yield arrow_rows(_PLACED, rep=reps, vector=raw, leaves=pa.ListArray.from_arrays(at, pa.array(found.ravel().astype(np.int32))))

    placed = materialize(entries.mapInArrow(frugal(place), "rep long, vector binary, leaves array<int>"), "ann-placed")
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # no more rows than leaves
        forest.size[r["leaf"]] = r["count"]
    sweep(entries.sparkSession, sent)
    return forest, placed


def measure(forest: Forest, placed: DataFrame, asked: DataFrame, k: int) -> tuple[int, float]:
    """(budget in vectors, share of true neighbours it reaches) on MEASURED of the query entries against brute force."""
    some = asked.orderBy(F.xxhash64("rep"), "rep").limit(MEASURED).toArrow()
    if not len(some):
        return 0, 1.0
    reps, matrix = some["rep"].to_numpy(), _matrix(some["vector"].combine_chunks())
    schema = pa.schema([("q", pa.int32()), ("score", pa.float64()), ("leaves", pa.list_(pa.int32()))])

    def nearest(it):
        for ids, raw, leaves in batches(it, "rep", "vector", "leaves"):
            scores = matrix @ _matrix(raw).T
            scores[reps[:, None] == ids.to_numpy()[None, :]] = -np.inf
            top = np.argpartition(-scores, min(k, len(ids)) - 1, axis=1)[:, :k]
            q = np.repeat(np.arange(len(reps)), top.shape[1])
            yield arrow_rows(schema, q=q.astype(np.int32), score=scores[q, top.ravel()], leaves=leaves.take(pa.array(top.ravel())))

    best = Window.partitionBy("q").orderBy(F.col("score").desc())
    near = placed.mapInArrow(nearest, "q int, score double, leaves array<int>").where(F.col("score") > float("-inf"))
    truth = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q", "leaves").collect()
    reached = [np.full(len(forest.size), np.inf) for _ in reps]
    for out, margins in zip(reached, forest.margins(matrix)):
        held = 0
        for leaf in forest.taken(margins, math.inf):
            held += int(forest.size[leaf])
            out[leaf] = held
    needs = np.sort([min(reached[r.q][x] for x in r.leaves) for r in truth])
    if not len(needs):
        return 0, 1.0
    at = min(len(needs), math.ceil(TARGET * len(needs))) - 1
    return int(needs[at]), float((needs <= needs[at]).mean())


def _probes(forest: Forest, asked: DataFrame, budget: int, cell: np.ndarray, parts: np.ndarray) -> DataFrame:
    """(cell, rep, vector, wanted): a row for each query entry and cell; wanted holds a bit for each leaf it takes up."""
    sent = asked.sparkSession.sparkContext.broadcast((forest, cell))

    def run(it):
        forest, cell = sent.value
        for reps, raw in batches(it, "rep", "vector"):
            for lo in range(0, len(reps), 256):
                part, ids = raw.slice(lo, 256), reps.slice(lo, 256)
                rows = []
                for margins, rep, v in zip(forest.margins(_matrix(part)), ids.to_pylist(), part.to_pylist()):
                    leaves = np.fromiter(forest.taken(margins, budget), dtype=np.int64)
                    bits = np.zeros(len(forest.size), np.uint8)
                    bits[leaves] = 1
                    wanted = np.packbits(bits).tobytes()
                    rows += [(c, rep, v, wanted) for c in np.unique(cell[leaves]).tolist()]
                if rows:
                    yield arrow_rows(_PROBE, **dict(zip(_PROBE.names, zip(*rows))))

    return materialize(asked.mapInArrow(frugal(run), "cell long, rep long, vector binary, wanted binary"), "ann-probes")


def _near(n_leaves: int, keep: int):
    """For a cogroup of entries and query entries of one cell: the best `keep` of the entries for each query."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return _FOUND.empty_table()
        x, y = (_matrix(t["vector"].combine_chunks()) for t in (rows, queries))
        ids, asked = rows["rep"].to_numpy(), queries["rep"].to_numpy()
        tree, leaves = rows["tree"].to_numpy(), np.array(rows["leaves"].to_pylist())
        wanted = np.unpackbits(np.frombuffer(b"".join(queries["wanted"].to_pylist()), np.uint8).reshape(len(y), -1), axis=1, count=n_leaves).astype(bool)
        out = []
        for lo in range(0, len(y), 250):
            want = wanted[lo : lo + 250]
            mine = want[:, leaves[np.arange(len(x)), tree]]
            for t in range(leaves.shape[1] - 1):  # what an earlier tree has shown is scored there
                mine &= ~(want[:, leaves[:, t]] & (tree > t)[None, :])
            score = np.where(mine, y[lo : lo + 250] @ x.T, -np.inf)
            most = min(keep + 4, len(x))
            top = np.argpartition(-score, most - 1, axis=1)[:, :most]
            q, e = np.repeat(np.arange(len(want)), most), top.ravel()
            ok = mine[q, e]
            q, e = q[ok], e[ok]
            exact = np.einsum("ij,ij->i", y[lo + q], x[e])  # the same sum whatever the block
            order = np.lexsort((ids[e], -exact, q))
            q, e, exact = q[order], e[order], exact[order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < keep
            out.append(pa.table([asked[lo + q[first]], ids[e[first]], exact[first]], schema=_FOUND))
        return pa.concat_tables(out)

    return run


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by `every`."""
    ids, entries, dims = _entries(vectors)
    forest, placed = build(entries, dims)
    keep = k + (ids.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1)
    queries = ids.where(F.col("vec_id") % every == 0)
    asked = materialize(placed.select("rep", "vector").join(queries.select("rep").distinct(), "rep"), "ann-asked")
    budget, _ = measure(forest, placed, asked, k)
    cell, parts = forest.cells(CELL)
    probes = _probes(forest, asked, budget, cell, parts)
    # cells with many queries are joined in blocks of these, leaves with many entries in parts of those
    load = probes.groupBy("cell").count().select("cell", F.ceil(F.col("count") / QUERIES).cast("int").alias("blocks"))
    of_leaf = vectors.sparkSession.createDataFrame([(i, int(c), int(p)) for i, (c, p) in enumerate(zip(cell, parts))], "leaf int, cell long, parts int")
    leaf_rows = placed.select("rep", "vector", "leaves", F.posexplode("leaves").alias("tree", "leaf")).join(F.broadcast(of_leaf), "leaf")
    rows = leaf_rows.join(load, "cell").select(
        "cell", "rep", "vector", "leaves", "tree", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    parts_of = of_leaf.groupBy("cell").agg(F.max("parts").alias("parts"))
    dealt = probes.join(load, "cell").join(F.broadcast(parts_of), "cell").select(
        "cell", "rep", "vector", "wanted", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    key = ["cell", "part", "block"]
    near = rows.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(_near(len(forest.size), keep), "rep long, near long, score double")
    first = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    # ties go to the smallest id of an entry, so `keep` entries and ids of each suffice, the query's own among them
    least = materialize(ids.withColumn("nth", first("rep", "vec_id")).where(F.col("nth") <= keep).select("rep", "vec_id"), "ann-least")
    lowest = least.groupBy("rep").agg(F.min("vec_id").alias("low"))
    best = materialize(near.join(lowest.withColumnRenamed("rep", "near"), "near").withColumn("nth", first("rep", F.col("score").desc(), "low", "near")).where(F.col("nth") <= keep).select("rep", "near", "score"), "ann-best")
    named = best.join(least.withColumnRenamed("rep", "near"), "near").withColumn("nth", first("rep", F.col("score").desc(), "vec_id")).where(F.col("nth") <= keep)
    named = materialize(named.select("rep", "vec_id", "score"), "ann-named")
    discard(probes)
    found = queries.select(F.col("vec_id").alias("query_id"), "rep").join(named, "rep").where("vec_id <> query_id")
    # a struct, else the rows of one entry's queries would stay in the task that joined them
    order = Window.partitionBy(F.struct("query_id", "rep")).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
