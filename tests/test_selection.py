"""Quota samples against plain loops."""

import random

from pyspark.sql import functions as F

from vialytics.operators import selection


def test_representatives(spark):
    rng = random.Random(2)
    items = [(t, f, rng.choice([*selection.ROLE_PRIORITY, "OTHER"]), f"p{rng.randrange(9)}", rng.randrange(5)) for t in range(30) for f in range(rng.randrange(1, 15))]
    df = spark.createDataFrame(items, "t int, frame_number int, role string, path string, q int").repartition(3)
    got = {}
    for r in selection.representatives(df, ["t"], [F.col("q")], 4).collect():
        got.setdefault(r.t, set()).add((r.frame_number, r.path))
    for t in range(30):
        ranked = sorted((i for i in items if i[0] == t), key=lambda i: (-i[4], i[1], i[3]))
        chosen = []
        for i in [next((i for i in ranked if i[2] == r), None) for r in selection.ROLE_PRIORITY] + ranked:
            if i and len(chosen) < 4 and i[3] not in {c[3] for c in chosen}:
                chosen.append(i)
        assert got[t] == {(c[1], c[3]) for c in chosen}


def test_one_of_each_stratum_then_the_rest(spark):
    rows = spark.createDataFrame([(i, i % 7, (i * 37) % 100) for i in range(70)], "id int, s int, x int").repartition(3)
    for most in (3, 7, 12, 200):
        got = [(r.id, r.s, r.x) for r in selection.stratified(rows, "s", [F.desc("x")], [F.desc("x")], most).orderBy("pick").collect()]
        every = sorted(((i, i % 7, (i * 37) % 100) for i in range(70)), key=lambda r: -r[2])
        firsts = [next(r for r in every if r[1] == s) for s in range(7)]
        assert got == (firsts + [r for r in every if r not in firsts])[:most]
    assert selection.stratified(rows.limit(0), "s", [F.desc("x")], [F.desc("x")], 5).count() == 0


def test_buckets_take_no_row_twice(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, k string")
    picks = selection.one_of_each(rows, ["id"], [], {"x": F.col("k") == "a", "y": F.lit(True), "z": F.col("k") == "c", "w": F.col("k") == "a", "v": F.lit(True)})
    assert sorted((r.bucket, r.id) for r in picks.collect()) == [("v", 3), ("x", 1), ("y", 2)]
