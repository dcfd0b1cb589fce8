"""Ranked lexical search with inverted treaps.

One pass over the documents keeps, of each, its length and the terms that queries ask for. Documents are dealt to shards
of bounded size. A shard holds a treap for each term: a binary search tree by doc_id whose nodes are in heap order of
their impact, so the root of any subtree has its largest impact. Queries walk the treaps of their terms together: an
interval of doc_ids with the subtrees that reach into it is bounded by the sum of the subtrees' roots. It is dropped once
that sum cannot enter the query's best k, else it is cut at the document of its largest root, which is scored. Intervals
of many queries are walked as arrays, those of the highest bounds first. Each shard returns its best k for each query;
they are merged by a window over k rows a shard.

Null texts and texts without terms count for nothing. Documents and queries whose id is null take no part. Rows repeat as
they are: equal doc_ids are ranked as documents of their own, equal item_ids as queries of their own. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CACHES, arrow_rows, batches, discard, frugal, materialize, mix64, sweep

#: Documents of one shard, and terms of queries (with repeats over queries) that one pass over the shards answers.
SHARD_DOCS, PASS_TERMS = 16_000, 400_000
#: Size of the bitmap that tells which terms queries may ask for: it is fixed, so it may be broadcast.
BITS = 1 << 21
#: Queries that a shard walks together, and intervals that it cuts in one step.
TOGETHER, STEP = 25, 1 << 14
#: What separates terms, as bytes; only A-Z are lower-cased.
_SEPARATE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])
_FOUND = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SEPARATE).split()


class _Asked(dict):
    """Term -> its string if its bit is set, else None; emptied when full."""

    def __init__(self, bitmap: bytes):
        super().__init__()
        self.bitmap = bitmap

    def __missing__(self, term: bytes) -> str | None:
        at = xxhash.xxh3_64_intdigest(term) % BITS
        out = term.decode() if self.bitmap[at >> 3] >> (at & 7) & 1 else None
        if len(term) <= 32:
            if len(self) >= 300_000:
                self.clear()
            self[term] = out
        return out


_ASKED: dict[bytes, _Asked] = {}
CACHES["lexical_search"] = _ASKED.clear


def query_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(query, item_id, terms array<string>): the distinct terms of each row of items, as a written table."""
    schema = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.string()))])

    def run(it):
        for ids, texts in batches(it, "item_id", "text"):
            yield arrow_rows(schema, item_id=ids, terms=[[t.decode() for t in dict.fromkeys(terms_of(x))] for x in texts.to_pylist()])

    cols = items.selectExpr(f"cast(`{item}` as long) as item_id", f"cast(`{text}` as string) as text").where("item_id is not null")
    made = cols.mapInArrow(run, "item_id long, terms array<string>").where(F.size("terms") > 0)
    return materialize(made.select(F.monotonically_increasing_id().alias("query"), "item_id", "terms"), "lexical-queries")


def asked_bitmap(queries: DataFrame) -> bytes:
    """The bits of all terms of queries. Only bits that are set come to the driver, at most BITS of them."""

    def run(it):
        schema = pa.schema([("at", pa.int32())])
        for (terms,) in batches(it, "terms"):
            yield arrow_rows(schema, at=list({xxhash.xxh3_64_intdigest(t.encode()) % BITS for t in pa.compute.list_flatten(terms).to_pylist()}))

    bits = np.zeros(BITS, dtype=np.uint8)
    bits[[r.at for r in queries.select("terms").mapInArrow(run, "at int").distinct().collect()]] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def postings(docs: DataFrame, bitmap: Broadcast) -> DataFrame:
    """(row, doc_id, n, terms, tfs) for each document that has terms: its length and the terms that may be asked for, as a written table."""

    def run(it):
        key = xxhash.xxh3_64_digest(bitmap.value)
        if key not in _ASKED:
            _ASKED.clear()
            _ASKED[key] = _Asked(bitmap.value)
        asked = _ASKED[key]
        for ids, texts in batches(it, "doc_id", "text"):
            for lo in range(0, len(texts), 64):
                rows = []
                for i, t in zip(ids.slice(lo, 64).to_pylist(), texts.slice(lo, 64)):
                    words = terms_of(t.as_py())
                    if words:
                        held = [(a, c) for w, c in Counter(words).items() if (a := asked[w]) is not None]
                        rows.append((i, len(words), [a for a, _ in held], [c for _, c in held]))
                if rows:
                    yield arrow_rows(_POSTINGS, **dict(zip(_POSTINGS.names, zip(*rows))))

    cols = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").where("doc_id is not null")
    made = cols.mapInArrow(frugal(run, "lexical_search"), "doc_id long, n long, terms array<string>, tfs array<long>")
    return materialize(made.select(F.monotonically_increasing_id().alias("row"), "*"), "lexical-postings")


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Treaps:
    """The treaps of one shard: arrays over all nodes; the nodes of term t are first[t] <= node < first[t + 1], by document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int, docs: int):
        order = np.lexsort((doc, term))
        self.doc, self.impact, self.docs = doc[order].astype(np.int64), impact[order], docs
        self.first = np.searchsorted(term[order], np.arange(terms + 1))
        self.key = term[order].astype(np.int64) * docs + self.doc
        self.left, self.right = np.full(len(doc), -1, np.int64), np.full(len(doc), -1, np.int64)
        self.root = np.full(terms, -1, np.int64)
        # equal impacts are in heap order of a hash, else a term of one impact would be a list
        heap = np.lexsort((mix64(self.key.astype(np.uint64)), self.impact))
        rank = np.empty(len(heap), np.int64)
        rank[heap] = np.arange(len(heap))
        for t in range(terms):
            self._grow(t, int(self.first[t]), int(self.first[t + 1]), rank)

    def _grow(self, t: int, lo: int, hi: int, rank: np.ndarray) -> None:
        """The treap of nodes that are already in search order: the right spine as a stack."""
        if lo == hi:
            return
        of = rank[lo:hi].tolist()
        left, right, spine = [-1] * len(of), [-1] * len(of), []
        for i, r in enumerate(of):
            below = -1
            while spine and of[spine[-1]] < r:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        for side, made in ((self.left, left), (self.right, right)):
            made = np.array(made)
            side[lo:hi] = np.where(made < 0, -1, made + lo)
        self.root[t] = spine[0] + lo

    def clip(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The root of what each subtree has between lo and hi (both outside), -1 if nothing."""
        node = node.copy()
        open_ = np.flatnonzero(node >= 0)
        while len(open_):
            at = node[open_]
            d = self.doc[at]
            low, high = d <= lo[open_], d >= hi[open_]
            node[open_] = np.where(low, self.right[at], np.where(high, self.left[at], at))
            open_ = open_[(low | high) & (node[open_] >= 0)]
        return node


class _Best:
    """The k best (score, document) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.query, self.doc, self.score = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.least, self.last = np.zeros(queries, np.int64), np.full(queries, -1, np.int64)

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Scored documents, each new to its query."""
        ok = (score > 0) & (score >= self.least[query])
        query, doc, score = (np.concatenate(x) for x in ((self.query, query[ok]), (self.doc, doc[ok]), (self.score, score[ok])))
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        ok = rank < self.k
        self.query, self.doc, self.score = query[ok], doc[ok], score[ok]
        full = rank == self.k - 1
        self.least[query[full]], self.last[query[full]] = score[full], doc[full]

    def may_enter(self, query: np.ndarray, bound: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Whether documents behind lo with scores up to bound can enter; of equal scores the smaller document wins."""
        least = self.least[query]
        return (bound > least) | ((bound == least) & (least > 0) & (lo < self.last[query]))


def search(treaps: Treaps, queries: list[tuple[list[int], list[int]]], k: int) -> _Best:
    """The k best documents of each query, given as terms (numbers in the treaps) and their weights."""
    best = _Best(len(queries), k)
    of = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
    term, w = (np.array([x for q in queries for x in q[i]], dtype=np.int64) for i in (0, 1))
    # an interval is a query, lo and hi; its entries are (interval, term, weight, node), sorted by interval
    intervals = np.arange(len(queries)), np.full(len(queries), -1), np.full(len(queries), treaps.docs)
    node = treaps.root[term]
    held = node >= 0
    waiting = [(intervals, (of[held], term[held], w[held], node[held]))]
    while waiting:
        (query, lo, hi), (at, term, w, node) = waiting.pop()
        if not len(at):
            continue
        part = w * treaps.impact[node]
        bound = _sums(at, part, len(query))
        alive = (bound > 0) & best.may_enter(query, bound, lo)
        if not alive.any():
            continue
        if alive.sum() > STEP:  # the highest bounds go first, the rest waits
            most = np.flatnonzero(alive)[np.argsort(-bound[alive], kind="stable")]
            first = np.zeros(len(query), bool)
            first[most[:STEP]] = True
            waiting.append(_kept(alive & ~first, (query, lo, hi), (at, term, w, node)))
            alive = first
        kept = alive[at]
        (query, lo, hi), (at, term, w, node), part = *_kept(alive, (query, lo, hi), (at, term, w, node)), part[kept]
        begin = np.searchsorted(at, np.arange(len(query)))
        top = np.maximum.reduceat(part, begin)
        is_top = np.flatnonzero(part == top[at])
        cut = np.zeros(len(query), np.int64)
        cut[at[is_top]] = treaps.doc[node[is_top]]
        want = term * treaps.docs + cut[at]
        found = np.minimum(np.searchsorted(treaps.key, want), len(treaps.key) - 1)
        best.add(query, cut, _sums(at, np.where(treaps.key[found] == want, w * treaps.impact[found], 0), len(query)))
        for low, high in ((cut, hi), (lo, cut)):  # what lies before the cut is taken up first
            inside = treaps.clip(node, low[at], high[at])
            some = inside >= 0
            waiting.append(((query, low, high), (at[some], term[some], w[some], inside[some])))
        if len(waiting) > 1 and sum(len(x[0][0]) for x in waiting[-2:]) <= 4 * STEP:
            waiting.append(_joined(waiting.pop(), waiting.pop()))
    return best


def _sums(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of x by at, in 64-bit integers."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(x)])
    edges = np.searchsorted(at, np.arange(n + 1))
    return total[edges[1:]] - total[edges[:-1]]


def _kept(alive: np.ndarray, intervals: tuple, entries: tuple) -> tuple[tuple, tuple]:
    number = np.cumsum(alive) - 1
    kept = alive[entries[0]]
    return tuple(x[alive] for x in intervals), (number[entries[0][kept]], *(x[kept] for x in entries[1:]))


def _joined(a: tuple, b: tuple) -> tuple[tuple, tuple]:
    moved = (b[1][0] + len(a[0][0]), *b[1][1:])
    return tuple(map(np.concatenate, zip(a[0], b[0]))), tuple(map(np.concatenate, zip(a[1], moved)))


def _search_shard(asked: Broadcast, n_docs: int, n_terms: int, k: int):
    """For applyInArrow over the postings of one shard. asked: (term numbers, queries as (query, terms, weights))."""

    def run(shard: pa.Table) -> pa.Table:
        numbers, queries = asked.value
        shard = shard.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        doc_ids, n = shard["doc_id"].to_numpy(), shard["n"].to_numpy()
        sizes = pa.compute.list_value_length(shard["terms"]).to_numpy()
        coded = pa.compute.list_flatten(shard["terms"]).combine_chunks().dictionary_encode()
        known = np.array([numbers.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)
        term = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
        tf, doc = pa.compute.list_flatten(shard["tfs"]).to_numpy(), np.repeat(np.arange(len(n)), sizes)
        long_ = 100 - 90 + 90 * n * n_docs // n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * long_[doc])
        ok = term >= 0
        treaps = Treaps(term[ok], doc[ok], impact[ok], len(numbers), len(n))
        out = []
        for i in range(0, len(queries), TOGETHER):
            part = queries[i : i + TOGETHER]
            best = search(treaps, [(t, w) for _, t, w in part], k)
            out.append(arrow_rows(_FOUND, query=np.array([q for q, _, _ in part])[best.query] if len(best.query) else best.query, doc_id=doc_ids[best.doc], score=best.score))
        return pa.Table.from_batches(out, schema=_FOUND)

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, equal scores by doc_id."""
    spark = docs.sparkSession
    queries = query_terms(items, item, text)
    bitmap = spark.sparkContext.broadcast(asked_bitmap(queries))
    held = postings(docs, bitmap)
    sweep(spark, bitmap)
    n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
    size = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, math.ceil(size / PASS_TERMS))
    shards = max(1, math.ceil(n_docs / SHARD_DOCS))
    terms = queries.select(F.explode("terms").alias("term")).distinct()
    df = materialize(held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(terms, "term"), "lexical-df")
    dealt = held.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    found = None
    for p in range(passes):  # the stated queries in blocks; each block's terms are bounded, so they may be broadcast
        block = queries.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == p)
        freq = {r.term: r.df for r in block.select(F.explode("terms").alias("term")).distinct().join(df, "term").collect()}
        numbers = {t: i for i, t in enumerate(sorted(freq))}
        w = {t: weight(n_docs, n) for t, n in freq.items()}
        asked = [(r.query, [numbers[t] for t in r.terms if t in w], [w[t] for t in r.terms if t in w]) for r in block.select("query", "terms").collect()]
        send = spark.sparkContext.broadcast((numbers, [q for q in asked if q[1]]))
        best = materialize(dealt.groupBy("shard").applyInArrow(_search_shard(send, n_docs, n_terms, k), "query long, doc_id long, score long"), "lexical-best")
        sweep(spark, send)
        found = best if found is None else found.unionByName(best)
    discard(held)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
