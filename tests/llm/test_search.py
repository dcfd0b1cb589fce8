"""Lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from vialytics.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def every_score(docs, items, k):
    held = [(d, words(t)) for d, t in docs if d is not None]
    held = [(d, Counter(w), len(w)) for d, w in held if w]
    total = sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m = 100 - 90 + 90 * n * len(held) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if s > 0:
                scored.append((-s, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])] if item is not None else []
    return sorted(out)


@pytest.mark.parametrize("shard, pass_terms, step, together", [(16_000, 400_000, 1 << 14, 25), (40, 12, 3, 2)])
def test_equals_scoring_every_document(spark, monkeypatch, shard, pass_terms, step, together):
    for name, x in (("SHARD_DOCS", shard), ("PASS_TERMS", pass_terms), ("STEP", step), ("TOGETHER", together)):
        monkeypatch.setattr(ls, name, x)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "日本", "x_y", "A-B", "the", "The"]
    text = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.1)), 45)] for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(200)]
    docs += [(300 + i, "w1 w2 w3 the") for i in range(30)] + [(400, ""), (401, None), (402, "-- !"), (None, "w1 w2"), (7, "w1 w2 w9"), (500, "w1 " * 5000)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(12)] + [(20, "w1 w2 w3 the the"), (21, ""), (22, None), (23, "nothing here"), (None, "w1"), (24, "THE, été 日本"), (25, "w1")]
    d = spark.createDataFrame([(i, t, "a", 1, "s") for i, t in docs], "doc_id long, text string, terms string, row int, score string").repartition(3)
    q = spark.createDataFrame([(i, t, "b") for i, t in items], "item_id int, text string, doc_id string")
    got = ls.rank_documents(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == every_score(docs, items, 10)
    assert ls.rank_documents(d.limit(0), q).count() == 0 and ls.rank_documents(d, q.limit(0)).count() == 0


def test_treaps_are_search_trees_in_heap_order_and_subtrees_are_pruned():
    rng = np.random.default_rng(1)
    n_docs, n_terms = 3000, 12
    pairs = np.unique(rng.integers(0, n_docs * n_terms, 9000))
    term, doc, impact = pairs // n_docs, pairs % n_docs, rng.integers(1, 50, len(pairs))
    t = ls.Treaps(term, doc, impact, n_terms, n_docs)
    for side, sign in ((t.left, -1), (t.right, 1)):
        up = np.flatnonzero(side >= 0)
        assert (np.sign(t.doc[side[up]] - t.doc[up]) == sign).all() and (t.impact[side[up]] <= t.impact[up]).all()
    scored = []
    add = ls._Best.add
    ls._Best.add = lambda self, q, d, s: (scored.append(len(d)), add(self, q, d, s))[1]
    try:
        best = ls.search(t, [([0, 1, 2], [3, 2, 1])], 10)
    finally:
        ls._Best.add = add
    full = np.zeros(n_docs, np.int64)
    for x, w in ((0, 3), (1, 2), (2, 1)):
        np.add.at(full, doc[term == x], w * impact[term == x])
    order = np.lexsort((np.arange(n_docs), -full))[:10]
    assert best.doc.tolist() == order.tolist() and best.score.tolist() == full[order].tolist()
    assert sum(scored) < np.count_nonzero(full) / 2


def brute_force(rows, k, every):
    """{(query_id, vector bytes): [(vec_id, score)]} over distinct (id, vector) rows, vectors padded with zeros."""
    ok = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    d = max(len(v) for _, v in ok)
    seen = sorted({(i, tuple(float(x) + 0.0 for x in v) + (0.0,) * (d - len(v))) for i, v in ok})
    ids, x = np.array([i for i, _ in seen]), np.array([v for _, v in seen])
    out = {}
    for i, v in seen:
        if i % every == 0:
            s = np.einsum("ij,ij->i", np.repeat([v], len(x), axis=0), x)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i, v] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_vector_search_finds_what_brute_force_finds(spark, monkeypatch):
    from vialytics.llm import vector_search as vs

    for name, x in (("LEAF", 12), ("SAMPLE", 300), ("CELL", 60), ("QUERIES", 7)):
        monkeypatch.setattr(vs, name, x)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.2 * rng.normal(size=8)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(90)] + [(2000, [0.0] * 8), (2020, None), (2040, [1.0, float("nan")] + [0.0] * 6), (2060, [None] * 8), (2080, []), (None, rows[1][1]), (2100, [1.0, 2.0]), (20, rows[20][1]), (40, rows[3][1]), (2120, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, "l", 1) for i, v in rows], "vec_id long, embedding array<double>, rep string, score int").repartition(3)
    got = vs.search(df, k=20, every=20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_force(rows, 20, 20)
    assert set(found) == {i for i, _ in want} and not {2000, 2020, 2040, 2060, 2080, 2120} & set(found)
    hits = total = 0
    for (i, _), near in want.items():
        if sum(j == i for j, _ in want) > 1:
            assert sorted(r for r, _, _ in found[i]) == sorted([*range(1, 21)] * 2)
            continue
        mine = sorted(found[i])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert [(v, s) for _, v, s in mine] == [(v, s) for v, s in sorted(((v, s) for _, v, s in mine), key=lambda p: (-p[1], p[0]))]
        hits += len({v for _, v, _ in mine} & {v for v, _ in near})
        total += len(near)
        if 1000 <= i < 1090:  # a copy: its ties are the smallest ids, itself left out
            copies = [v for _, v, _ in mine if v == 5 or 1000 <= v < 1090]
            assert len(copies) > 5 and copies == [v for v in [5, *range(1000, 1090)] if v != i][: len(copies)]
    assert hits >= 0.9 * total
    assert vs.search(df.limit(0)).count() == 0 and vs.search(df.where("vec_id = 20")).count() == 0


def test_forest_takes_the_leaves_of_all_trees_by_margin_and_budgets_follow_structure(spark):
    from vialytics.llm import vector_search as vs

    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16))
    forest = vs.Forest(x, 3, 50)
    placed = forest.place(x)
    forest.size = np.bincount(placed.ravel(), minlength=len(forest.size))
    assert forest.size.sum() == 3 * len(x) and all(placed[:, t].min() >= forest.first[t] and placed[:, t].max() < forest.first[t + 1] for t in range(3))
    margins = forest.margins(x[:1])[0]
    order = list(forest.taken(margins, math.inf))
    assert sorted(order) == list(range(len(forest.size))) and set(order[:3]) == set(placed[0].tolist())
    assert list(forest.taken(margins, 100)) == order[: len(list(forest.taken(margins, 100)))] and forest.size[list(forest.taken(margins, 100))].sum() >= 100
    cell, parts = forest.cells(200)
    assert np.bincount(cell, weights=forest.size).max() <= 200 and parts.max() == 1
    shares = []
    for spread in (0.05, 10.0):
        points = (rng.normal(size=(100, 16))[rng.integers(0, 100, 3000)] + spread * rng.normal(size=(3000, 16))).tolist()
        ids, entries, dims = vs._entries(spark.createDataFrame(list(enumerate(points)), "vec_id long, embedding array<double>"))
        forest, table = vs.build(entries, dims)
        budget, reached = vs.measure(forest, table, table.where("rep % 20 = 0"), 20)
        shares.append(budget / forest.size.sum())
        assert reached >= vs.TARGET
    assert shares[0] < shares[1] / 3
