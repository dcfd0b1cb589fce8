"""Similarity joins and substring dedup against brute force."""

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from vialytics.llm import common, metric_join, ngram_join, span_dedup
from vialytics.llm.common import connected_components
from vialytics.llm.common import materialize as _materialize


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def grams(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, n, t):
    sets = {i: grams(x, n) for i, x in docs}
    ids = [i for i in sets if i is not None]
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= t * len(sets[a] | sets[b]):
                links.append((a, b))
    return {i: len(s) for i, s in sets.items()}, components(ids, links)


def near_copies(seed, docs=220):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(docs):
        if out and rng.random() < 0.6:
            words = rng.choice(out)[:]
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                if words and rng.random() < 0.7:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
                else:
                    words.insert(rng.randrange(len(words) + 1), rng.choice(vocab))
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 60, 150, 400]))]
        out.append(words)
    return [" ".join(w).title() if rng.random() < 0.2 else " \t".join(w) for w in out]


@pytest.mark.parametrize("n, t, cell", [(4, "0.85", 1500), (5, "0.8", 1500), (4, "0.85", 6), (2, "0.5", 10)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, n, t, cell):
    monkeypatch.setattr(ngram_join, "CELL", cell)
    monkeypatch.setattr(ngram_join, "LEADERS", 2 if cell < 100 else 16)
    texts = near_copies(cell) + [None, "", " \n", "One", "one", "a b", "A  b", "x" * 5000, "long words " * 3000]
    docs = [(7 * i % 1009, x) for i, x in enumerate(texts)]
    frame = spark.createDataFrame([(i, x, 1, "c") for i, x in docs] + [(None, texts[0], 1, "c")], "doc_id long, text string, cell int, side string")
    sizes, want = brute(docs, n, Fraction(t))
    got = ngram_join.jaccard_components(frame.repartition(3), n, t).collect()
    assert len(got) == len(docs) + 1
    named = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {i: r.n_shingles for i, r in named.items()} == sizes
    assert {i: r.component_id for i, r in named.items()} == want
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(len(grams(texts[0], n)), None)]


def test_ngram_join_keeps_one_and_takes_empty_tables(spark):
    frame = spark.createDataFrame([(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "other words", "z"), (1, "a b c d e f", "y")], "doc_id long, text string, row string")
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 2]
    assert ngram_join.jaccard_components(frame.limit(0)).count() == 0


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [0, 2, 1, 3]])
def test_ngram_join_links_each_text_of_a_repeated_id(spark, order):
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(3, x), (5, x), (5, y), (9, y + " y40")]
    frame = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in ngram_join.jaccard_components(frame).collect()} == {3}


def test_shared_grams_rows_do_not_grow_with_tasks(spark):
    texts = near_copies(3, 160)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6).cache()
    shared = Fraction("0.85")
    rows, parts = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for tasks in ("2", "4", "48"):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            made = ngram_join._exchange(frame, lambda buckets: ngram_join._scan_shared(ngram_join._of_text(4, shared), buckets), ngram_join._own_shared, "doc_id long, kind int, n long")
            rows.append(made.where(F.col("kind") == ngram_join.COUNTED).count())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert rows[0] == rows[1] == rows[2] > 160


@pytest.mark.parametrize("t", [Fraction("0.85"), Fraction("0.8"), Fraction("0.5"), Fraction("0.2"), Fraction(1)])
def test_first_grams_of_linked_sets_have_enough_in_common(t):
    rng, linked = random.Random(int(t * 100)), 0
    for _ in range(3000):
        x = set(rng.sample(range(10**6), rng.randrange(1, 80)))
        y = {v for v in x if rng.random() < rng.choice([0.7, 0.9, 0.97, 1])} | set(rng.sample(range(10**6), rng.choice([0, 0, 1, 3, 9])))
        if len(x & y) >= t * len(x | y):
            linked += 1
            first = [set(sorted(s)[: ngram_join.first_grams(len(s), t)]) for s in (x, y)]
            assert all(len(first[0] & first[1]) >= ngram_join.first_shared(len(s), t) >= 1 for s in (x, y))
    assert linked > 100


def test_enough_is_what_first_shared_says(spark):
    for t in (Fraction("0.85"), Fraction("0.8"), Fraction("0.5")):
        rows = [(n, n and ngram_join.first_shared(n, t)) for n in range(1, 400)]
        sets = spark.createDataFrame([(n, k, k - 1) for n, k in rows], "n int, shared int, fewer int")
        assert sets.where(~ngram_join._enough("shared", F.col("n"), t)).count() == 0
        assert sets.where(ngram_join._enough("fewer", F.col("n"), t)).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1001 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(0, 60)]
    nodes = {n for e in links if e[0] != e[1] for n in e}
    edges = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert {r.id: r.component_id for r in connected_components(edges).collect()} == components(nodes, links)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (None, 4)], "a long, b long")
    assert {(r.id, r.component_id) for r in connected_components(edges).collect()} == {(i, 0) for i in range(301)}


def test_metric_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 20)
    monkeypatch.setattr(metric_join, "BLOCK", 40)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 8))
    rows = []
    for i in range(300):
        v = base[rng.integers(30)] * rng.uniform(0.5, 2) + rng.normal(size=8) * rng.choice([0, 0.02, 0.1, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)) if i % 17 else None))
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] + [1.0] * 7, 1), (303, [None] + [1.0] * 7, 1), (304, [1.0] * 4, 1), (305, [], 1), (306, [2.0] * 4, 1), (None, [1.0] * 4, 1)]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "vec_id long, embedding array<float>, label int, key string, rep int").repartition(3)
    ok = {i: np.array(v) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = [
        (a, b) for a in ok for b in ok
        if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= 0.98
    ]
    want = components([i for i, _, _ in rows if i is not None], links)
    degree = {i: sum(i in p for p in links) for i in want}
    got = metric_join.near_vectors(frame).collect()
    assert len(got) == len(rows) and len(links) > 50
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {i: (degree[i], want[i], want[i] == i) for i in want}
    assert metric_join.near_vectors(frame.limit(0)).count() == 0
    named = frame.selectExpr("vec_id", "embedding", "'label ' || label as label")
    assert sorted(metric_join.near_vectors(named).collect(), key=str) == sorted(got, key=str)


def test_metric_join_judges_repeated_ids_by_their_own_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01])]
    got = metric_join.near_vectors(spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_metric_join_work_grows_less_than_quadratically(spark, monkeypatch):
    """On directions in three dimensions; in many dimensions no metric partition helps vectors that are all far apart."""
    monkeypatch.setattr(metric_join, "CELL", 16)
    work = []

    def watched(df, tag):
        out = _materialize(df, tag)
        if tag == "placed":
            cells = out.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("members"))
            work.append(cells.selectExpr("sum(homes * members) as w").first().w)
        return out

    monkeypatch.setattr(metric_join, "materialize", watched)
    rng = np.random.default_rng(8)
    for n in (400, 1600):
        x = rng.normal(size=(n, 3))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
        linked = (x @ x.T >= 0.9999).sum(axis=1) - 1
        assert [r.n_links for r in sorted(metric_join.near_vectors(frame, 0.9999).collect())] == linked.tolist()
    assert work[1] < 9 * work[0]  # four times the vectors; all pairs would be 16 times


def test_metric_join_keeps_links_across_pivots_one_ulp_apart(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 1)  # every vector of the label is a pivot
    base = np.random.default_rng(5).normal(size=(60, 64)).astype(np.float32)
    base[:, 0] = 9  # the largest component scales both twins alike
    twin = base.copy()
    twin[:, 7] = np.nextafter(twin[:, 7], np.float32(100))
    rows = [(2 * i + k, v[i].tolist(), 1) for i in range(60) for k, v in enumerate((base, twin))]
    x = np.array([v for _, v, _ in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.98
    want = {i: (int(linked[i].sum()) - 1, int(np.flatnonzero(linked[i]).min())) for i in range(120)}
    assert set(want.values()) == {(1, 2 * i) for i in range(60)}
    got = metric_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


@pytest.mark.parametrize("least", [span_dedup.RUN_WORDS, 25])
def test_spans_against_brute_force(spark, least):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(80)]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 15))) + rng.choice([". ", "! ", "?\n", "\n"]) for _ in range(400)]
    passage = "".join(pool[:9])
    texts = []
    for i in range(60):
        parts = [rng.choice(pool) for _ in range(rng.randrange(0, 12))]
        if rng.random() < 0.4:
            parts.insert(rng.randrange(len(parts) + 1), passage.upper() if rng.random() < 0.3 else passage)
        texts.append("".join(parts))
    docs = [(5 * i % 61, t) for i, t in enumerate(texts + [texts[0], "", "w " * 20000])] + [(None, passage), (90, None)]
    docs = [(i if k < 61 else 100 + k, t) if i is not None else (i, t) for k, (i, t) in enumerate(docs)]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, th int, lo int").repartition(3)
    seen = {}
    for i, t in docs:
        parts = [p.lower().split() for p in span_dedup.sentences(t or "")]
        used = [k for k, w in enumerate(parts) if w]
        for a in range(len(used)):  # every run, not only the shortest
            for b in range(a + 1, len(used) + 1):
                words = [w for k in used[a:b] for w in parts[k]]
                if len(words) >= (least if b > a + 1 else 50):
                    seen.setdefault(" ".join(words), []).append((span_dedup.NO_ID if i is None else i, used[a], used[b - 1] + 1))
    gone = {}
    for spots in seen.values():
        for i, lo, hi in sorted(spots)[1:]:
            gone.setdefault(i, set()).update(range(lo, hi))
    got = {span_dedup.NO_ID if r.doc_id is None else r.doc_id: r for r in span_dedup.remove_repeats(frame, least).collect()}
    assert len(got) == len(docs) and sum(map(len, gone.values())) > 50
    for i, t in docs:
        i = span_dedup.NO_ID if i is None else i
        parts = span_dedup.sentences(t or "")
        assert got[i].text == "".join(p for k, p in enumerate(parts) if k not in gone.get(i, ()))
        assert (got[i].n_sentences, got[i].n_removed) == (len(parts), len(gone.get(i, ())))
        cut = t or ""
        for a, b in reversed(got[i].removed):
            cut = cut[:a] + cut[b:]
        assert cut == got[i].text
    holders = [i for i, t in docs if t and passage.lower() in t.lower()]
    assert sum(passage.lower() in got[span_dedup.NO_ID if i is None else i].text.lower() for i in holders) == 1
    left = span_dedup.clean(frame, least)
    assert left.columns == frame.columns
    assert sorted(r.text for r in left.collect() if r.text) == sorted(r.text for r in got.values() if r.text.strip())
    assert span_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_short_runs_of_two_sentences_count(spark):
    twice = "The small red cat sat here. The dog ran off again today."
    docs = spark.createDataFrame([(1, f"Alone it stands. {twice}"), (2, f"{twice} Another end."), (3, "The dog ran off again today. Nothing else.")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in span_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 2, 3: 0}
    assert {r.n_removed for r in span_dedup.remove_repeats(docs, 25).collect()} == {0}


def test_runs_cover_a_passage_from_both_ends():
    parts = ["one two three. ", "word " * 60 + ". ", "the tail. "]
    h, lo, hi = span_dedup.runs(parts, 25)
    assert set(zip(lo.tolist(), hi.tolist())) == {(0, 2), (1, 2), (1, 3)} and h.shape == (3, 2)
    assert span_dedup.sentences("一二三。四五六。 x. y") == ["一二三。", "四五六。 ", "x. ", "y"]
    assert len(span_dedup.runs(["一二三四五六七八九十" * 2 + "。", "四五六七八九十" * 2 + "。"], 25)[0]) == 1


def test_components_of_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(common, "materialize", lambda df, tag: written.append(tag) or _materialize(df, tag))
    edges = spark.createDataFrame([(10 * i + k, 10 * i) for i in range(50) for k in range(1, 9)], "a long, b long").repartition(5)
    assert {(r.id, r.component_id) for r in connected_components(edges).collect()} == {(10 * i + k, 10 * i) for i in range(50) for k in range(9)}
    assert len(written) == 2  # was 9: two rounds of four tables after the first


def test_tasks_do_not_walk_what_the_worker_imported(spark):
    def run(it):
        import gc

        for b in it:
            yield pa.RecordBatch.from_pydict({"tracked": [len(gc.get_objects())], "apart": [gc.get_freeze_count()]})

    row = spark.range(3).coalesce(1).mapInArrow(common.frugal(run), "tracked long, apart long").first()
    assert row.apart > row.tracked


def test_pairs_of_blocks_stay_small(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 40)
    tried = []

    def tries(tasks, threshold, old=ngram_join._tries):
        tried.append(tasks.groupBy("task").count().agg(F.max("count")).first()[0])
        return old(tasks, threshold)

    monkeypatch.setattr(ngram_join, "_tries", tries)
    rng = np.random.default_rng(1)
    sets = [(1, i, bytearray(np.unique(rng.integers(0, 2**63, 20).astype(np.uint64)).tobytes())) for i in range(120)]
    sets[7] = (1, 7, sets[100][2])
    made = _materialize(spark.createDataFrame(sets, "cell long, doc_id long, grams binary"), "made")
    links = ngram_join._contract_large(made, Fraction("0.8")).collect()
    assert {frozenset(r) for r in links} == {frozenset((7, 100))}
    assert tried[1] <= 70  # two blocks; blocks of whole cells make 80 and more
