"""N-gram Jaccard join with prefix trees.

1. Every document becomes the set of its hashed word n-grams. In one global order, that of the hashes, linked sets have some
   of their first n-grams in common: tasks send short keys of these to owners, which give a row for each that others sent too.
2. By the pigeonhole principle two sets that may link agree on at least one of a few parts of the hash space, so documents
   that share no part signature cannot link. Tasks fold equal signatures of their own documents first and send sorted
   signature lists to their owners.
3. Documents that signatures connect form candidate cells; every link lies inside one cell.
4. In a cell the sets, ordered by global frequency in the cell, are stored in a trie. A probe walks it once, shares the
   overlap of common prefixes, and prunes a subtree when even its whole rest could not reach the threshold.
   Of large cells only sets whose n-grams are shared often enough to link at all go on. They probe tries of a few leaders
   first; sets that leaders left apart meet in tries of blocks of like sizes.
"""

from __future__ import annotations

from bisect import bisect_right
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, batches, connected_components, discard, frugal, local_forest, materialize, mix64, sweep

CELL = 1500
LEADERS = 16
FLUSH = 400_000
_U = np.uint64
_STEP, _BAND, _EMPTY = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
_MESSAGE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])
SIGNATURE, COPY, CANDIDATE, SURE = range(4)
OPEN, SHARED, COUNTED, META = range(4)
_COUNT = pa.schema([("doc_id", pa.int64()), ("kind", pa.int32()), ("n", pa.int64())])
#: Of an n-gram that is only counted 32 bits go beside its owner's number: a key that two share lets a set through, never stops one.
SHORT = np.uint32
#: Linked sets share at least this part of the smaller one's n-grams among their first ones, so as many more are sent of each.
FIRST = Fraction(7, 20)
#: Owners for each task: a task holds the messages of one owner at a time.
OWNERS = 8
#: Bits of the filter that spares documents without candidates the way to the cells: 8 MB, whatever the input.
FILTER_BITS = 1 << 26


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the n-grams of ASCII-lower-cased words; of all words at once if there are fewer."""
    words = (text or "").encode().lower().split()  # bytes: splits at ASCII white space, lowers A-Z alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(n, len(h))
    total = h[: len(h) - width + 1] * _STEP
    for j in range(1, width):
        total = mix64(total) + h[j : len(h) - width + 1 + j] * _STEP
    return np.unique(mix64(total + _U(width)))


class Bands:
    """Size classes such that linked sets lie in one class or in neighbouring ones."""

    def __init__(self, threshold: Fraction):
        self.t, self.low, self.high = threshold, [1], [int(1 / threshold)]

    def of(self, n: int) -> int:
        while self.high[-1] < n:
            self.low.append(self.high[-1] + 1)
            self.high.append(int(self.low[-1] / self.t))
        return bisect_right(self.low, n) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """(number of parts, empty parts that a set may have unsaid) for sets of this class and the one below."""
        while len(self.high) <= band:
            self.of(self.high[-1] + 1)
        most = int((1 - self.t) / (1 + self.t) * 2 * self.high[band])  # elements in which linked sets can differ
        spare = most // 32 + 1 if most else 0
        return most + 1 + spare, spare


def signatures(h: np.ndarray, bands: Bands) -> np.ndarray:
    """A hash for each part of the set, in its own class and in the next.

    Of `parts` parts linked sets differ in at most parts - 1 - spare, so they agree on spare + 1 or more. Parts empty in
    both are left out unless a set has more than spare of them.
    """
    own, mixed, out = bands.of(len(h)), mix64(h), []
    for band in (own, own + 1):
        k, spare = bands.parts(band)
        part = ((h >> _U(32)) * _U(k)) >> _U(32)
        start = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        seed = _U(band + 1) * _BAND
        sums = np.add.reduceat(mixed, start)
        out.append(mix64(mix64(sums + seed) + part[start] * _STEP))
        if k - len(start) > spare:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), part[start])
            out.append(mix64(mix64(_EMPTY + seed) + empty * _STEP))
    return np.concatenate(out)


def _messages(kind: int, keys: np.ndarray, ids: np.ndarray, buckets: int, key: type = np.uint64):
    """Sorted keys cut by owner; ids as indexes into a table of their distinct values. Short keys keep a key's low bits."""
    owner = (((keys >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]]) if len(owner) else [0]
    for lo, hi in zip(cut[:-1], cut[1:]):
        table, index = np.unique(ids[lo:hi], return_inverse=True)
        wide = np.uint16 if len(table) <= 65535 else np.uint32
        yield int(owner[lo]), kind, np.array([hi - lo, len(table)], dtype=np.int64).tobytes() + keys[lo:hi].astype(key).tobytes() + table.tobytes() + index.astype(wide).tobytes()


def _read_message(raw: bytes, key: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(raw, dtype=np.int64, count=2)
    keys = np.frombuffer(raw, dtype=key, count=n, offset=16)
    at = 16 + keys.itemsize * n
    table = np.frombuffer(raw, dtype=np.int64, count=m, offset=at)
    return keys, table[np.frombuffer(raw, dtype=np.uint16 if m <= 65535 else np.uint32, count=n, offset=at + 8 * m)]


def _first_of_runs(keys: np.ndarray, ids: np.ndarray):
    """Sorted by key and id: the first of each run of equal keys, and (other, first) for the rest."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    head = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=bool)
    first = ids[head][np.cumsum(head) - 1]
    rest = ~head & (ids != first)
    return keys[head], ids[head], keys[rest], ids[rest], first[rest]


def _scan(n: int, threshold: Fraction, buckets: int):
    def run(it):
        bands = Bands(threshold)
        docs: list[tuple[int, np.ndarray]] = []
        size, serial = 0, TaskContext.get().partitionId() * 31

        def flush():
            nonlocal serial
            rows = []
            ids = np.array([d for d, _ in docs], dtype=np.int64)
            fps = np.array([mix64(h.sum(dtype=np.uint64, keepdims=True) + _U(len(h)))[0] for _, h in docs], dtype=np.uint64)
            keys, firsts, key, other, root = _first_of_runs(fps, ids)
            rows += _messages(COPY, keys, firsts, buckets)
            serial += 1
            at = serial % buckets
            if len(other):
                rows.append((at, SURE, np.stack([other, root, key.view(np.int64)]).tobytes()))
            alone = set(firsts.tolist())
            seen: set[int] = set()
            sigs, owners = [], []
            for (d, h), fp in zip(docs, fps.tolist()):
                if d in alone and fp not in seen:  # a copy within the task shares its first's signatures
                    seen.add(fp)
                    sigs.append(signatures(h, bands))
                    owners.append(np.full(len(sigs[-1]), d, dtype=np.int64))
            if sigs:
                keys, firsts, _, other, root = _first_of_runs(np.concatenate(sigs), np.concatenate(owners))
                rows += _messages(SIGNATURE, keys, firsts, buckets)
                a, b = local_forest(other, root)
                if len(a):
                    rows.append(((at + 1) % buckets, CANDIDATE, np.stack([a, b]).tobytes()))
            docs.clear()
            for lo in range(0, len(rows), 64):
                o, k, p = zip(*rows[lo : lo + 64])
                yield arrow_rows(_MESSAGE, bucket=o, kind=k, payload=p)

        for ids, texts in batches(it, "doc_id", "text"):
            for d, t in zip(ids.to_pylist(), texts):
                h = shingles(t.as_py(), n)
                if d is not None and len(h):
                    docs.append((d, h))
                    size += len(h)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if docs:
            yield from flush()

    return run


def _by_owner(it):
    """(owner, {kind: payloads}) for messages sorted by owner."""
    owner, got = None, {}
    for buckets, kinds, payloads in batches(it, "bucket", "kind", "payload"):
        for bucket, k, p in zip(buckets.to_pylist(), kinds.to_pylist(), payloads):
            if bucket != owner:
                if got:
                    yield owner, got
                owner, got = bucket, {}
            got.setdefault(k, []).append(p.as_py())
    if got:
        yield owner, got


def _own(it):
    """What meets at one owner: copies and candidates as links to the smallest id, the rest passed on."""

    def rows(kind, a, b, c=None):
        for lo in range(0, len(a), 50_000):
            s = slice(lo, lo + 50_000)
            yield arrow_rows(_FOUND, kind=np.full(len(b[s]), kind, dtype=np.int32), a=a[s], b=b[s], c=np.zeros(len(b[s]), dtype=np.int64) if c is None else c[s])

    for _, got in _by_owner(it):
        for p in got.pop(SURE, ()):
            yield from rows(SURE, *np.frombuffer(p, dtype=np.int64).reshape(3, -1))
        if COPY in got:
            keys, ids = (np.concatenate(x) for x in zip(*map(_read_message, got.pop(COPY))))
            _, _, key, other, root = _first_of_runs(keys, ids)
            yield from rows(SURE, other, root, key.view(np.int64))
        pairs = [np.frombuffer(p, dtype=np.int64).reshape(2, -1) for p in got.pop(CANDIDATE, ())]
        if SIGNATURE in got:
            keys, ids = (np.concatenate(x) for x in zip(*map(_read_message, got.pop(SIGNATURE))))
            _, _, _, other, root = _first_of_runs(keys, ids)
            pairs.append(np.stack([other, root]))
        if pairs:
            yield from rows(CANDIDATE, *local_forest(*np.concatenate(pairs, axis=1)))


def _exchange(rows: DataFrame, scan, own, schema: str) -> DataFrame:
    """scan sends messages to owners, own reads those of each owner in turn."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.mapInArrow(frugal(scan(OWNERS * parts)), "bucket int, kind int, payload binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(own), schema)


class _Node:
    __slots__ = ("label", "children", "least", "deepest", "rep", "pure", "leaves")

    def __init__(self, label, least, deepest, rep):
        self.label, self.children, self.leaves = label, {}, []
        self.least, self.deepest, self.rep, self.pure = least, deepest, rep, True


def trie_links(ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, homes: np.ndarray, threshold: Fraction) -> list[tuple[int, int]]:
    """Links that join all linked sets of a cell. side 0: stored and probed, 1: probed, 2: stored.

    Sets of one home are known to be connected. A subtree is skipped when all of it is already connected to the probe;
    every link between sets not connected otherwise is found.
    """
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), dtype=np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))  # global order: frequent n-grams first, so prefixes are shared
    shared = count[inverse] > 1
    cut = np.cumsum([len(s) for s in sets])[:-1]
    paths = [np.sort(r[m]) for r, m in zip(np.split(rank[inverse], cut), np.split(shared, cut))]
    sizes = [len(s) for s in sets]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict[int, int] = {}
    for i, home in enumerate(homes.tolist()):
        parent[find(i)] = find(first.setdefault(home, i))
    p, q = threshold.numerator, threshold.denominator
    links = []
    root = _Node(paths[0][:0], 0, 0, 0)
    root.pure = False

    def probe(x):
        own, nx = paths[x], sizes[x]
        stack = [(c, 0, 0) for c in root.children.values()]
        while stack:
            node, overlap, depth = stack.pop()
            if node.pure and find(node.rep) == find(x):
                continue
            label = node.label
            at = np.searchsorted(own, label)
            at[at == len(own)] = 0
            overlap += int(np.count_nonzero(own[at] == label)) if len(own) else 0
            depth += len(label)
            left = min(len(own) - int(np.searchsorted(own, label[-1], side="right")), node.deepest - depth)
            if (q + p) * (overlap + left) < p * (nx + node.least):
                continue
            for y in node.leaves:
                if (q + p) * overlap >= p * (nx + sizes[y]) and find(y) != find(x):
                    links.append((x, y))
                    parent[find(x)] = find(y)
            stack.extend((c, overlap, depth) for c in node.children.values())

    def insert(x):
        path, n, node, at = paths[x], sizes[x], root, 0
        while at < len(path):
            child = node.children.get(int(path[at]))
            if child is None:
                node.children[int(path[at])] = leaf = _Node(path[at:], n, len(path), x)
                leaf.leaves.append(x)
                return
            m = min(len(child.label), len(path) - at)
            differ = np.flatnonzero(child.label[:m] != path[at : at + m])
            k = int(differ[0]) if len(differ) else m
            if k < len(child.label):  # split the edge
                upper = _Node(child.label[:k], child.least, child.deepest, child.rep)
                upper.pure = child.pure
                child.label = child.label[k:]
                upper.children[int(child.label[0])] = child
                node.children[int(path[at])] = upper
                child = upper
            child.least, child.deepest = min(child.least, n), max(child.deepest, len(path))
            child.pure = child.pure and find(child.rep) == find(x)
            node, at = child, at + k
        node.leaves.append(x)

    for x in np.argsort(sides != 2, kind="stable").tolist():  # stored-only sets first
        if not len(paths[x]):
            continue  # shares nothing with any other set
        if sides[x] != 2:
            probe(x)
        if sides[x] != 1:
            insert(x)
    return [(int(ids[x]), int(ids[y])) for x, y in links]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _join_cells(threshold: Fraction):
    """Rows sorted by task; each task's sets are joined in one trie."""

    def run(it):
        def done(rows):
            if len(rows) < 2:
                return []
            side, ids, homes, sets = zip(*rows)
            return trie_links(np.array(ids), [np.frombuffer(s, dtype=np.uint64) for s in sets], np.array(side), np.array(homes), threshold)

        task, rows, out = None, [], []
        for t, side, ids, homes, sets in batches(it, "task", "side", "doc_id", "home", "grams"):
            for key, *row in zip(t.to_pylist(), side.to_pylist(), ids.to_pylist(), homes.to_pylist(), sets.to_pylist()):
                if key != task:
                    out += done(rows)
                    task, rows = key, []
                rows.append(row)
            if len(out) > 10_000:
                a, b = zip(*out)
                yield arrow_rows(_LINK, a=a, b=b)
                out = []
        if out := out + done(rows):
            a, b = zip(*out)
            yield arrow_rows(_LINK, a=a, b=b)

    return run


def _tries(tasks: DataFrame, threshold: Fraction) -> DataFrame:
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tasks.select("task", "side", "doc_id", "home", "grams").repartition(parts, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(frugal(_join_cells(threshold)), "a long, b long")


def first_grams(size: int, threshold: Fraction) -> int:
    """How many n-grams of a set are sent, in the order of their hashes: as many as a link may lack, and a part more.

    A link of sets x and y has at least ceil(t * size) of either set's n-grams. So of what they share the k-th in order is
    among the first size - ceil(t * size) + k of either; k is what `first_shared` gives for the smaller of both.
    """
    return size - ceil(threshold * size) + _more(size, threshold)


def first_shared(size: int, threshold: Fraction) -> int:
    """How many of these n-grams a linked set has in common with the other, whose size is at least ceil(t * size)."""
    return _more(ceil(threshold * size), threshold)


def _more(size: int, threshold: Fraction) -> int:
    return max(1, int(min(FIRST, threshold) * size)) if size else 0


def _of_cell(threshold: Fraction):
    """(doc_id, keys of the first n-grams, None) of sets; the same n-gram has another key in another cell."""

    def run(it):
        for cells, docs, grams in batches(it, "cell", "doc_id", "grams"):
            for c, d, g in zip(cells.to_numpy(), docs.to_pylist(), grams):
                h = np.frombuffer(g.as_py(), dtype=np.uint64)
                yield d, mix64(h[: first_grams(len(h), threshold)] + c.astype(np.uint64) * _STEP), None

    return run


def _of_text(n: int, threshold: Fraction):
    """(doc_id, keys of the first n-grams, number of all) of texts. Keys are mixed, as first hashes are small ones."""

    def run(it):
        for docs, texts in batches(it, "doc_id", "text"):
            for d, t in zip(docs.to_pylist(), texts):
                h = shingles(t.as_py(), n)
                yield d, mix64(h[: first_grams(len(h), threshold) if d is not None else 0]), len(h)

    return run


def _scan_shared(read, buckets: int):
    """Sends each key once from every chunk; keys that sets of one chunk share are counted at once."""

    def run(it):
        keys, ids, metas, size, serial = [], [], [], 0, TaskContext.get().partitionId() * 31

        def flush():
            head, first, again, other, _ = _first_of_runs(*(np.concatenate([np.zeros(0, dtype=t), *x]) for x, t in ((keys, np.uint64), (ids, np.int64))))
            known = np.isin(head, again)
            rows = [*_messages(OPEN, head[~known], first[~known], buckets, SHORT), *_messages(SHARED, head[known], first[known], buckets, SHORT)]
            if len(other):
                rows.append((serial % buckets, COUNTED, np.stack(np.unique(np.concatenate([other, first[known]]), return_counts=True)).tobytes()))
            if metas:
                rows.append(((serial + 1) % buckets, META, np.array(metas, dtype=np.int64).T.tobytes()))
            for lo in range(0, len(rows), 64):
                o, k, p = zip(*rows[lo : lo + 64])
                yield arrow_rows(_MESSAGE, bucket=o, kind=k, payload=p)

        for d, h, n in read(it):
            if n is not None:
                metas.append((0 if d is None else d, n if d is not None else -1 - n))
            if len(h):
                keys.append(h)
                ids.append(np.full(len(h), d, dtype=np.int64))
                size += len(h)
            if size >= FLUSH or len(metas) >= 20_000:
                serial += 1
                yield from flush()
                keys, ids, metas, size = [], [], [], 0
        if keys or metas:
            serial += 1
            yield from flush()

    return run


def _own_shared(it):
    """(doc_id, COUNTED, 1) for each key of a set that another chunk has too, counts of those that sets of its own chunk share,
    and (doc_id, META, size of the set).

    Spark sums. Rows are not summed for each task here: their number would be that of documents times tasks.
    """

    def rows(kind, ids, n, valid=None):
        for lo in range(0, len(ids), 50_000):
            s = slice(lo, lo + 50_000)
            yield arrow_rows(_COUNT, doc_id=pa.array(ids[s], mask=None if valid is None else ~valid[s]), kind=np.full(len(n[s]), kind, dtype=np.int32), n=n[s])

    for _, got in _by_owner(it):
        for p in got.get(META, ()):
            ids, n = np.frombuffer(p, dtype=np.int64).reshape(2, -1)
            yield from rows(META, ids, np.where(n < 0, -1 - n, n), n >= 0)
        for p in got.get(COUNTED, ()):
            yield from rows(COUNTED, *np.frombuffer(p, dtype=np.int64).reshape(2, -1))
        if OPEN in got:
            keys, ids = (np.concatenate(x) for x in zip(*(_read_message(p, SHORT) for p in got[OPEN])))
            _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
            more = times[inverse] > 1
            if SHARED in got:
                more |= np.isin(keys, np.concatenate([_read_message(p, SHORT)[0] for p in got[SHARED]]))
            yield from rows(COUNTED, ids[more], np.ones(np.count_nonzero(more), dtype=np.int64))


def _enough(shared: str, size, threshold: Fraction):
    """Whether so many shared n-grams among the first allow a link: `first_shared` as a column."""
    least, part = F.ceil(size * threshold.numerator / threshold.denominator), min(FIRST, threshold)  # whole numbers until they are divided
    return F.col(shared) >= F.greatest(F.lit(1), F.floor(least * part.numerator / part.denominator))


def _linkable(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The sets that may link: a link needs enough of a set's first n-grams in other sets of its cell."""
    sent = _exchange(sets.select("cell", "doc_id", "grams"), lambda buckets: _scan_shared(_of_cell(threshold), buckets), _own_shared, "doc_id long, kind int, n long")
    count = sent.groupBy("doc_id").agg(F.sum("n").alias("n"))
    count = materialize(count, "shared-grams")
    kept = materialize(sets.join(count, "doc_id").where(_enough("n", F.length("grams") / 8, threshold)).select("cell", "doc_id", "grams"), "linkable")
    discard(count)
    return kept


def _member_filter(members: DataFrame):
    """A bitmap of FILTER_BITS hashed ids of members, gathered in pieces of 4 kB that Spark makes; its size never grows."""
    bit = (F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1).alias("bit")  # Spark numbers bits from 1
    pieces = members.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8 + 4096, dtype=np.uint8)
    for r in pieces.collect():
        at = (r.piece - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return members.sparkSession.sparkContext.broadcast(out)


_ROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _may_be_members(bits):
    """The texts of documents that the filter lets through: all that have candidates, and few others."""

    def run(it):
        for ids, texts, bit in batches(it, "doc_id", "text", "bit"):
            at = bit.to_numpy()
            yield pa.RecordBatch.from_arrays([ids, texts], schema=_ROW).filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    return run


def _contract_large(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Links inside cells of more than CELL sets: tries of leaders first, then of blocks that leaders left apart.

    A block holds sets of one size class; only blocks of the same or neighbouring classes can link and meet. Blocks are half
    a cell at most: a trie of sets that leaders left apart prunes little, and a pair of blocks is one task's work.
    """
    most = max(1, CELL // 2)
    subs = materialize(sets.groupBy("cell").agg(F.ceil(F.count("*") / CELL).alias("subs")), "subs")
    order = Window.partitionBy("cell").orderBy(F.xxhash64("doc_id"), "doc_id")
    leaders = materialize(sets.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEADERS).drop("place"), "leaders")
    led = leaders.join(subs, "cell").select("cell", "doc_id", "grams", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.lit(2).alias("side"))
    probing = sets.join(subs, "cell").select("cell", "doc_id", "grams", F.pmod(F.xxhash64("doc_id"), F.col("subs")).alias("sub"), F.lit(1).alias("side"))
    rows = probing.unionByName(led).select(F.xxhash64("cell", "sub").alias("task"), "side", "doc_id", F.col("doc_id").alias("home"), "grams")
    near = materialize(_tries(rows, threshold), "near-leaders")
    home = connected_components(near, "homes")
    # a little wider than a link's ratio of sizes, so that rounding cannot put linked sets two bands apart
    bands = F.floor(F.log(F.length("grams") / 8) / float(1.001 * np.log(threshold.denominator / threshold.numerator)))
    homed = sets.join(home, sets["doc_id"] == home["id"], "left").select("cell", "doc_id", "grams", F.coalesce("component_id", "doc_id").alias("home"), bands.alias("band"))
    homed = materialize(homed, "homed")
    count = homed.groupBy("cell").agg(F.count_distinct("home").alias("homes"))
    apart = homed.join(count.where("homes > 1").select("cell"), "cell", "left_semi")
    in_home = materialize(apart.groupBy("cell", "band", "home").agg(F.count("*").alias("n")), "in-home")
    rest = in_home.groupBy("cell", "band").agg(F.sum(F.when(F.col("n") <= most, F.col("n"))).alias("rest"))
    load = in_home.join(rest, ["cell", "band"])
    block = F.when(F.col("n") > most, F.xxhash64("home", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / most)))).otherwise(F.pmod(F.xxhash64("home"), F.ceil(F.col("rest") / most)))
    placed = apart.join(load, ["cell", "band", "home"]).select("cell", "doc_id", "home", "grams", "band", block.alias("block"))
    placed = materialize(placed, "placed")
    blocks = materialize(placed.groupBy("cell", "band", "block").agg(F.min("home").alias("low"), F.max("home").alias("high")), "blocks")
    left, right = (blocks.select("cell", *(F.col(c).alias(f"{c}_{k}") for c in ("band", "block", "low", "high"))) for k in "xy")
    ordered = (F.col("band_x") < F.col("band_y")) | ((F.col("band_x") == F.col("band_y")) & (F.col("block_x") <= F.col("block_y")))
    one_home = (F.least("low_x", "low_y") == F.greatest("high_x", "high_y"))  # all of both are connected already
    near_size = F.explode(F.sequence(F.col("band_x"), F.col("band_x") + 1))
    pairs = left.withColumn("band_y", near_size).join(right, ["cell", "band_y"]).where(ordered & ~one_home)
    pairs = materialize(pairs.withColumn("task", F.xxhash64("cell", "band_x", "block_x", "band_y", "block_y")), "block-pairs")
    same = (F.col("band_x") == F.col("band_y")) & (F.col("block_x") == F.col("block_y"))
    sides = pairs.select("cell", "task", F.col("band_x").alias("band"), F.col("block_x").alias("block"), F.when(same, 0).otherwise(1).alias("side")).unionByName(
        pairs.where(~same).select("cell", "task", F.col("band_y").alias("band"), F.col("block_y").alias("block"), F.lit(2).alias("side"))
    )
    dealt = placed.join(sides, ["cell", "band", "block"])
    far = materialize(_tries(dealt, threshold), "far-links")
    discard(leaders, homed, placed)
    return near.unionByName(far)


def jaccard_components(docs: DataFrame, n: int = 5, threshold: str | float = "0.8") -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id = smallest doc_id reachable by links.

    Two documents link when intersection >= threshold * union of their n-gram sets. Null and empty texts, and texts of
    white space, have an empty set and link with nothing. Rows with a null doc_id link with nothing and have a null
    component_id. Rows that repeat a doc_id are one node. Every other column is ignored.
    """
    t = Fraction(str(threshold))
    spark = docs.sparkSession
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = _exchange(cols, lambda buckets: _scan_shared(_of_text(n, t), buckets), _own_shared, "doc_id long, kind int, n long")
    counted = materialize(counted.groupBy("doc_id", "kind", F.when(F.col("kind") == META, F.col("n")).alias("size")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "counted")
    sizes = counted.where((F.col("kind") == META) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("size").alias("least"), F.sum("rows").alias("rows"))
    shared = counted.where(F.col("kind") == COUNTED).groupBy("doc_id").agg(F.sum("n").alias("shared"))
    may = sizes.join(shared, "doc_id", "left").where(_enough("shared", F.col("least"), t) | (F.col("rows") > 1))
    held = _member_filter(may.select(F.col("doc_id").alias("id")))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit")
    may_link = cols.where("doc_id is not null").select("doc_id", "text", bit).mapInArrow(frugal(_may_be_members(held)), "doc_id long, text string")
    found = _exchange(may_link, lambda buckets: _scan(n, t, buckets), _own, "kind int, a long, b long, c long")
    found = materialize(found, "found")
    sweep(spark, held)
    sure = found.where(F.col("kind") == SURE)
    edges = found.where(F.col("kind").isin(SURE, CANDIDATE)).select("a", "b")
    cells = connected_components(edges, "cells")
    copies = sure.groupBy("a").agg(F.max("c").alias("copied"))
    # a copy is linked already and its first stands for it, unless its id is repeated with other texts
    rows = sizes.select(F.col("doc_id").alias("row_id"), F.col("rows").alias("n"))
    live = cells.join(copies, cells["id"] == copies["a"], "left").join(rows, F.col("id") == F.col("row_id")).where("copied is null or n > 1")
    live = materialize(live.select("id", F.col("component_id").alias("cell"), "copied", "n"), "live")
    members = materialize(live.join(live.groupBy("cell").agg(F.sum("n").alias("size")), "cell").where("size > 1").select("id", "cell", "copied", "size"), "members")
    schema = pa.schema([("cell", pa.int64()), ("size", pa.int64()), ("doc_id", pa.int64()), ("grams", pa.binary())])

    def expand(it):
        for ids, texts, cell, copied, size in batches(it, "doc_id", "text", "cell", "copied", "size"):
            out = []
            for d, x, c, k, m in zip(ids.to_pylist(), texts, cell.to_pylist(), copied.to_pylist(), size.to_pylist()):
                h = shingles(x.as_py(), n)
                fp = mix64(h.sum(dtype=np.uint64, keepdims=True) + _U(len(h))).view(np.int64)[0]
                if len(h) and fp != k:
                    out.append((c, m, d, h.tobytes()))
            for lo in range(0, len(out), 500):
                yield arrow_rows(schema, **dict(zip(schema.names, zip(*out[lo : lo + 500]))))

    held = _member_filter(members)
    texts = cols.where("doc_id is not null").select("doc_id", "text", bit).mapInArrow(frugal(_may_be_members(held)), "doc_id long, text string")
    joined = texts.join(members, texts["doc_id"] == members["id"]).select("doc_id", "text", "cell", "copied", "size")
    sets = materialize(joined.mapInArrow(frugal(expand), "cell long, size long, doc_id long, grams binary"), "sets")
    sweep(spark, held)
    small = sets.where(F.col("size") <= CELL).drop("size")
    large = sets.where(F.col("size") > CELL)
    unlinked = []
    if large.limit(1).count():
        kept = _linkable(large, t)
        sizes = materialize(kept.groupBy("cell").agg(F.count("*").alias("size")), "sizes")
        small = small.unionByName(kept.join(sizes.where(F.col("size").between(2, CELL)), "cell").drop("size"))
        large = materialize(kept.join(sizes.where(F.col("size") > CELL), "cell").drop("size"), "large-cells")
        unlinked = [kept, large]
    links = materialize(_tries(small.select(F.col("cell").alias("task"), F.lit(0).alias("side"), "doc_id", F.col("doc_id").alias("home"), "grams"), t), "small-links")
    if unlinked and large.limit(1).count():
        links = links.unionByName(_contract_large(large, t))
    discard(sets, *unlinked)
    sweep(spark)
    component = connected_components(links.unionByName(sure.select("a", "b")), "links")
    meta = counted.where(F.col("kind") == META).select("doc_id", F.col("size").alias("n_shingles"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"))
    out = meta.join(component, meta["doc_id"] == component["id"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, threshold: str | float = "0.8") -> DataFrame:
    """The rows of docs that stay: of each group of linked documents the one with the smallest id, and all without links.

    Rows with a null doc_id or an empty text stay, rows that repeat an id stay or go together; all columns are kept.
    """
    joined = jaccard_components(docs, n, threshold)
    gone = joined.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = materialize(gone, "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"))
    return rows.join(gone, rows["key"] == gone["_gone"], "left_anti").select("row.*")
