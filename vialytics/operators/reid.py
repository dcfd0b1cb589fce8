"""Appearance vectors: similarity, ranks and how well they tell vehicles apart."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors as unit vectors in double precision; null and zero vectors go."""
    v = vectors.withColumn("unit", F.col(vector).cast("array<double>"))
    v = v.withColumn("norm", F.sqrt(dot(F.col("unit"), F.col("unit")))).where("norm > 0")
    # the norm is bound once for a vector: named in the inner function alone, Spark would compute it for each component
    units = F.transform(F.array("norm"), lambda n: F.transform("unit", lambda x: x / n))
    return v.withColumn("unit", F.get(units, F.lit(0))).drop("norm")


BLOCK = 1000
#: The most queries that meet a part of a gallery in one task, and about the most vectors of a part.
QUERIES, GALLERY = 10_000, 20_000


def _matrix(units: pa.ChunkedArray, size: int) -> np.ndarray:
    """A row for each vector, with zeros behind the shorter ones."""
    units = units.combine_chunks()
    lengths, values = pc.list_value_length(units).to_numpy(zero_copy_only=False), pc.list_flatten(units).to_numpy(zero_copy_only=False)
    out = np.zeros((len(units), size))
    out[np.arange(size) < lengths[:, None]] = values
    return out


def _closest(queries: pa.Table, gallery: pa.Table, most: int) -> pa.Table:
    """(query_id, query_label, vec_id, label, similarity) of the `most` closest of a part of the gallery for each query.

    Products of matrices choose; what is chosen is summed in the vectors' own order, so that it rests on no block's shape.
    """
    names, rows = ["query_id", "query_label", "vec_id", "label", "similarity"], []
    if len(queries) and len(gallery):
        size = max(pc.max(pc.list_value_length(c)).as_py() or 0 for c in (queries["query_unit"], gallery["unit"]))
        a, b = _matrix(queries["query_unit"], size), _matrix(gallery["unit"], size)
        asked, ids = queries["query_id"].to_numpy(), gallery["vec_id"].to_numpy()
        for lo in range(0, len(a), 50):
            near = a[lo : lo + 50] @ b.T
            near[np.isnan(near)] = np.inf  # as Spark's order has it
            near[asked[lo : lo + 50, None] == ids] = -np.inf
            least = np.partition(near, -most, axis=1)[:, -most] if most < len(ids) else np.full(len(near), -np.inf)
            q, g = np.nonzero((near >= least[:, None] - 2e-9) & (near > -np.inf))
            exact = np.zeros(len(q))
            for d in range(size):
                exact += a[lo + q, d] * b[g, d]
            exact = np.rint(exact * 1e9)
            order = np.lexsort((ids[g], -np.where(np.isnan(exact), np.inf, exact), q))
            starts = np.searchsorted(q[order], q[order], side="left")
            kept = order[np.arange(len(order)) - starts < most]
            rows.append((lo + q[kept], g[kept], exact[kept] / 1e9))
    at, of, similarity = (np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    columns = [queries["query_id"].take(at), queries["query_label"].take(at), gallery["vec_id"].take(of), gallery["label"].take(of), pa.array(similarity)]
    return pa.table(columns, names=names)


def neighbours(queries: DataFrame, gallery: DataFrame, most: int) -> DataFrame:
    """(query_id, query_label, vec_id, label, similarity, rank): the closest `most` vectors of a gallery for each of a stated set of queries.

    A query does not meet itself. Queries in blocks of about QUERIES meet the gallery in parts of about GALLERY, block by
    part in a task of its own; a part gives each query its closest `most`, the closest of these are the gallery's.
    """
    count = lambda rows, n: max(1, -(-rows.count() // n))
    blocks, parts = count(queries, QUERIES), count(gallery, GALLERY)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    number = F.col("vec_id").cast("long")
    asked = [number.alias("query_id"), F.col("label").alias("query_label"), F.col("unit").alias("query_unit")]
    left = queries.where("vec_id is not null").select(*asked, place(blocks).alias("block"), every(parts).alias("part"))
    right = gallery.where("vec_id is not null").select(number.alias("vec_id"), "label", "unit", every(blocks).alias("block"), place(parts).alias("part"))
    label = gallery.schema["label"].dataType.simpleString()
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    found = met.applyInArrow(lambda a, b: _closest(a, b, most), f"query_id long, query_label {label}, vec_id long, label {label}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def hit_rates(ranked: DataFrame) -> DataFrame:
    """The share of queries with a vector of their own label at rank 1, and among the first 3."""
    per_query = ranked.groupBy("query_id").agg(F.max(((F.col("label") == F.col("query_label")) & (F.col("rank") == 1)).cast("int")).alias("one"), F.max(((F.col("label") == F.col("query_label")) & (F.col("rank") <= 3)).cast("int")).alias("three"))
    return per_query.agg(F.count("*").alias("queries"), F.avg("one").alias("rank_1"), F.avg("three").alias("rank_3"))


def distribution(ranked: DataFrame) -> DataFrame:
    """Similarities of equal and of different labels: count, range, mean and median."""
    same = F.when(F.col("label") == F.col("query_label"), "same").otherwise("different")
    return ranked.groupBy(same.alias("pairs")).agg(
        F.count("*").alias("n"), F.min("similarity").alias("least"), F.max("similarity").alias("most"), F.avg("similarity").alias("mean"), F.percentile("similarity", 0.5).alias("median")
    )


#: Similarities are counted in billionths; a bin holds BIN of them, and a task at most about PART vectors of the gallery.
UNIT, BIN, PART = 10**9, 50_000, 20_000


def _scores(queries: pa.Table, gallery: pa.Table):
    """(same label, similarities in billionths) of all pairs of two tables, some queries at a time."""

    def columns(t):
        x = pc.list_flatten(t["unit"]).to_numpy().reshape(len(t), -1)
        fine = np.isfinite(x).all(axis=1)
        known = pc.is_valid(t["label"]).to_numpy()
        return x[fine], t["vec_id"].to_numpy()[fine], pc.fill_null(t["label"], 0).to_numpy()[fine], known[fine]

    if not len(queries) or not len(gallery):
        return
    (a, ids, labels, known), (b, other, others, sure) = columns(queries), columns(gallery)
    for lo in range(0, len(a), 50):
        s = slice(lo, lo + 50)
        scored = np.rint(a[s] @ b.T * UNIT).astype(np.int64)
        same = (labels[s, None] == others) & known[s, None] & sure
        apart = ids[s, None] != other
        for kind in (True, False):
            yield kind, scored[apart & (same == kind)]


def all_pairs_distribution(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """distribution() over every pair of a stated set of queries with a gallery; a query does not meet itself.

    Tasks count their pairs in bins, then the similarities inside the bins that hold the middle ranks: exact, and what is
    sent and gathered is bounded by the number of bins, not by that of pairs. Vectors with non-finite components and
    pairs of vectors of different lengths have no similarity; unknown labels are different from all.
    """
    spark = gallery.sparkSession
    count = lambda rows, most: max(1, -(-rows.count() // most))
    blocks, parts = count(queries, BLOCK), max(int(spark.conf.get("spark.sql.shuffle.partitions")), count(gallery, PART))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    cols = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "unit", F.size("unit").alias("size")]
    left = queries.where("vec_id is not null").select(*cols, place(blocks).alias("block"), every(parts).alias("part"))
    right = gallery.where("vec_id is not null").select(*cols, every(blocks).alias("block"), place(parts).alias("part"))
    key = ["block", "part", "size"]
    tasks = left.groupBy(*key).cogroup(right.groupBy(*key))

    def binned(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = []
        for kind, scored in _scores(a, b):
            if len(scored):
                bins, at = np.unique(scored // BIN, return_inverse=True)
                rest = np.bincount(at, weights=scored % BIN).astype(np.int64)  # of at most 50 rows: exact
                size = len(bins)
                rows.append((np.full(size, kind), bins, np.bincount(at), rest, np.full(size, scored.min()), np.full(size, scored.max())))
        names = ["same", "bin", "n", "rest", "least", "most"]
        return pa.table([np.concatenate(c) for c in zip(*rows)] if rows else [pa.array([], pa.bool_())] + [pa.array([], pa.int64())] * 5, names=names)

    sums = tasks.applyInArrow(binned, "same boolean, bin long, n long, rest long, least long, most long").groupBy("same", "bin")
    found: dict[bool, list] = {}
    for r in sums.agg(F.sum("n").alias("n"), F.sum("rest").alias("rest"), F.min("least").alias("least"), F.max("most").alias("most")).collect():
        found.setdefault(r.same, []).append(r)
    middle = {}  # the bins of the two middle ranks, and the ranks inside them
    for same, rows in found.items():
        rows.sort(key=lambda r: r.bin)
        n, before, spots = sum(r.n for r in rows), 0, []
        for r in rows:
            spots += [(r.bin, rank - before) for rank in ((n - 1) // 2, n // 2) if before <= rank < before + r.n]
            before += r.n
        middle[same] = spots
    wanted = {same: np.unique([b for b, _ in spots]) for same, spots in middle.items()}

    def inside(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = [(np.full(len(v), kind), v, n) for kind, scored in _scores(a, b) if kind in wanted for v, n in [np.unique(scored[np.isin(scored // BIN, wanted[kind])], return_counts=True)]]
        return pa.table([np.concatenate(c) for c in zip(*rows)] if rows else [pa.array([], pa.bool_())] + [pa.array([], pa.int64())] * 2, names=["same", "value", "n"])

    values: dict[tuple[bool, int], list] = {}
    for r in tasks.applyInArrow(inside, "same boolean, value long, n long").groupBy("same", "value").agg(F.sum("n").alias("n")).collect() if found else []:
        values.setdefault((r.same, r.value // BIN), []).append((r.value, r.n))

    def at(same, spot):
        rank = spot[1]
        for value, n in sorted(values[same, spot[0]]):
            if rank < n:
                return value
            rank -= n

    out = []
    for same, rows in sorted(found.items()):
        n, total = sum(r.n for r in rows), sum(r.bin * BIN * r.n + r.rest for r in rows)
        low, high = (at(same, spot) for spot in middle[same])
        out.append(("same" if same else "different", n, min(r.least for r in rows) / UNIT, max(r.most for r in rows) / UNIT, total / (n * UNIT), (low + high) / (2 * UNIT)))
    return spark.createDataFrame(out, "pairs string, n long, least double, most double, mean double, median double")
