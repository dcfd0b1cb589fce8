"""Operators on small rows made by hand, against plain Python where SQL cannot ask the question."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vialytics.functions import plates as plate_text
from vialytics.functions.predicates import compare
from vialytics.operators import evidence, identity, imports, intervals, plates, reconcile, records, reid, tracks
from vialytics.plans.compiler import condition
from vialytics.plans.plan import from_payload, none_of, where
from vialytics.sources import runs
from vialytics.streaming import stateful


def test_null_semantics(spark):
    rows = spark.createDataFrame([("a", 1.0), (None, None), ("", 3.0)], "t string, x double")
    cases = {
        ("t", "neq", "a"): [False, True, True], ("t", "not_in", ("a",)): [False, True, True], ("t", "in", ("a", None)): [True, True, False], ("t", "exists", None): [True, False, False],
        ("t", "starts_with", "a"): [True, False, False], ("t", "contains", 5): [False] * 3, ("x", "gt", 0): [True, False, True], ("x", "between", (1, 2)): [True, False, False], ("x", "between", (1,)): [False] * 3,
    }
    got = rows.select(*(compare(F.col(c), op, v).alias(str(i)) for i, (c, op, v) in enumerate(cases))).collect()
    assert [[r[str(i)] for r in got] for i in range(len(cases))] == list(cases.values())


def test_not_is_nor(spark):
    rows = spark.createDataFrame([("CAR", "RED"), ("BUS", "RED"), ("BUS", "BLUE"), (None, None)], "vehicle_class string, colour string")
    tree = none_of(where("class", "eq", "CAR"), where("colour", "eq", "RED"))
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("camera_id", "run_id", "plate_text", "vehicle_id")} | {"plate_detected": F.lit(None).cast("boolean"), "first_seen_seconds": F.lit(0.0), "last_seen_seconds": F.lit(0.0)})
    assert [r.k for r in rows.select(condition(tree).alias("k")).collect()] == [False, False, True, True]


def test_payloads_are_checked():
    query = from_payload({"filters": {"kind": "or", "conditions": [{"field": "class", "operator": "in", "value": ["CAR"]}]}, "group_by": "run_camera", "limit": 4})
    assert query.group_by == "run_camera" and query.filters.parts[0].value == ("CAR",)
    with pytest.raises(ValueError, match="plate_text does not allow gt.*unknown group"):
        from_payload({"filters": {"field": "plate_text", "operator": "gt", "value": 1}, "group_by": "age"})


def test_plate_validation(spark):
    cases = {
        "hr 26-dk 8337": ("HR26DK8337", "standard_private", False), "22 BH 1234 AB": ("22BH1234AB", "bharat_series", False), "HR37DK833O": ("HR37DK8330", "standard_private", True), "HR26DK833O": (None, None, False),
        "ZZ26DK8337": (None, None, False), "": (None, None, False), None: (None, None, False), "H826DK8337": (None, None, False),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", plate_text.validated(F.col("t")).alias("c")).collect()
    assert {r.t: (r.c.canonical, r.c.format, r.c.corrected) for r in rows} == cases


def test_intervals_against_a_scan(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["CAR", "BUS", "TRUCK"]), rng.choice([None, float(rng.randrange(0, 60))]), None) for _ in range(60)]
    rows = [(c, a, None if rng.random() < 0.1 else (a or 0.0) + rng.randrange(0, 20)) for c, a, _ in rows]
    frame = spark.createDataFrame(rows, "vehicle_class string, first_seen_seconds double, last_seen_seconds double")
    top = max(x for _, a, b in rows for x in (a, b) if x is not None)
    want, k = {}, 0
    while k * 5.0 <= top:
        inside = [c for c, a, b in rows if (b is None or b >= k * 5) and (a is None or a <= k * 5 + 5)]
        want[k] = (inside.count("CAR"), inside.count("BUS"))
        k += 1
    assert {r.k: (r.left_n, r.right_n) for r in intervals.windows(frame, "CAR", "BUS").collect()} == want
    assert intervals.windows(frame.limit(0), "CAR", "BUS").count() == 0


def lifecycle(frames, seen, max_lost=30, least=3):
    """A frame-by-frame simulation of one camera."""
    open_, done = {}, []
    for f in frames:
        for i in list(open_):
            if i not in seen.get(f, ()):
                open_[i][2] += 1
                if open_[i][2] > max_lost:
                    done.append((i, *open_.pop(i)[:2], "LOST_TIMEOUT"))
        for i in seen.get(f, ()):
            t = open_.setdefault(i, [f, f, 0, 0])
            t[1], t[2], t[3] = f, 0, t[3] + 1
    return {(i, a, b) for i, a, b, _ in done} | {(i, t[0], t[1]) for i, t in open_.items()}


def test_lifecycles_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(8)
    frames = sorted(rng.sample(range(400), 220))
    seen = {f: {i for i in range(6) if rng.random() < (0.05 if (f // 60 + i) % 2 else 0.5)} for f in frames}
    rows = [("C", f, i, 0.5, "car") for f in frames for i in seen[f]]
    frame = spark.createDataFrame(rows, "camera_id string, frame_number long, native_id long, confidence double, raw_class_name string")
    every = spark.createDataFrame([("C", f) for f in frames], "camera_id string, frame_number long")
    want = lifecycle(frames, seen, 5)
    got = tracks.lifecycles(frame, every, 5)
    assert {(r.native_id, r.first_frame, r.last_frame) for r in got.collect()} == want
    beats = frame.select("camera_id", "frame_number", "native_id").unionByName(every.withColumn("native_id", F.lit(None).cast("long")))
    for k in range(2):
        beats.where(f"frame_number {'<' if k == 0 else '>='} 200").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(beats.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stateful.lifecycles(stream, 5).writeStream.format("memory").queryName("life").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    ended = {(r.native_id, r.first_frame, r.last_frame) for r in got.where("reason <> 'END_OF_STREAM'").collect()}
    streamed = {(r.native_id, r.first_frame, r.last_frame) for r in spark.table("life").collect()}
    # a stream learns of an end with the id's first absence too many, a batch from the camera's last frame
    assert streamed <= want and ended <= streamed | {t for t in want if t[2] >= frames[-8]}


def test_pool_and_spacing_against_a_scan(spark):
    rng = random.Random(5)
    rows = [(t, f, round(rng.random(), 3), float(rng.randrange(20)), 0.0, 30.0, 10.0) for t in range(40) for f in sorted(rng.sample(range(60), rng.randrange(1, 20)))]
    frame = spark.createDataFrame(rows, "track_no long, frame_number long, overall double, x1 double, y1 double, x2 double, y2 double").repartition(3)
    got = {}
    for r in evidence.spaced(frame, "track_no", 3, 4).collect():
        got.setdefault(r.track_no, set()).add(r.frame_number)
    for t in range(40):
        taken = []
        for r in sorted((r for r in rows if r[0] == t), key=lambda r: (-r[2], r[1])):
            if len(taken) < 3 and all(abs(r[1] - x) > 4 for x in taken):
                taken.append(r[1])
        assert got[t] == set(taken)


def test_pool_keeps_what_a_plain_online_pool_keeps(spark):
    rng = random.Random(6)
    rows = [(t, f, float(rng.randrange(6)), float(x := rng.randrange(8)), 0.0, x + 60.0, 10.0) for t in range(60) for f in sorted(rng.choices(range(50), k=rng.randrange(1, 25)))]
    rows = sorted(rows, key=lambda r: (r[0], r[1], -r[2]))
    frame = spark.createDataFrame(rows, "track_no long, frame_number long, instant double, cx1 double, cy1 double, cx2 double, cy2 double").repartition(3)
    got = {(r.track_no, r.frame_number, r.instant) for r in evidence.bounded_pool(frame, "track_no", 4).collect()}

    def overlap(a, b):
        both = max(0, min(a[5], b[5]) - max(a[3], b[3])) * 10
        return both / (1200 - both)

    want = set()
    for t in range(60):
        pool = []  # [score, row]
        for r in (r for r in rows if r[0] == t):
            if any(p[1][1] == r[1] for p in pool):
                continue
            twin = None
            for p in pool:
                if abs(p[1][1] - r[1]) <= 3 and overlap(p[1], r) >= 0.85 and (twin is None or overlap(p[1], r) > overlap(twin[1], r)):
                    twin = p
            if twin:
                lifted = max(r[2], overlap(twin[1], r))
                if lifted > twin[0]:
                    pool.remove(twin)
                    pool.append([lifted, r])
                continue
            pool.append([r[2], r])
            if len(pool) > 4:
                pool.remove(min(pool, key=lambda p: (p[0], p[1][1])))
        want |= {p[1][:3] for p in pool}
    assert got == want and len(want) < len(rows) / 2


def test_repeated_records_are_an_error(spark):
    rows = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("s", "a", 3)], "run_id string, vehicle_id string, x int")
    assert sorted(map(tuple, records.unique(rows, ["run_id", "vehicle_id"]).collect())) == [("r", "a", 1), ("r", "b", 2), ("s", "a", 3)]
    with pytest.raises(Exception, match="a record is repeated: vehicle_id=a"):
        records.unique(rows, ["vehicle_id"]).collect()


def test_the_first_valid_plate_counts_also_a_corrected_one(spark):
    rows = spark.createDataFrame([(1, "NO PLATE", "hr 26 dk 8337", None), (2, "HR26DK83E7", "22BH1234AA", "x"), (3, "", None, "  "), (4, "HR26DKA8B37", None, "DL1CA1234")], "id int, a string, b string, c string")
    assert {r.id: r.p for r in records.canonical_plate(rows, ["a", "b", "c"], "p").collect()} == {1: "HR26DK8337", 2: "22BH1234AA", 3: None, 4: "HR26DKA8837"}


def test_steps_upwards_and_repeated_media(spark):
    paths = spark.createDataFrame([(p,) for p in ("/f/a/../b", "/f/a..b", "../x", "x/..", "/g/x", "x")], "p string")
    assert {r.p: (r.kind, r.relative) for r in imports.relative_paths(paths, "p", "/f/").collect()} == {
        "/f/a/../b": ("invalid", None), "/f/a..b": ("inside", "a..b"), "../x": ("invalid", None), "x/..": ("invalid", None), "/g/x": ("outside", None), "x": ("relative", "x"),
    }
    media = lambda *rows: spark.createDataFrame(rows, "media_type string, relative_path string, original_path string, track_no long")
    got = imports.first_media(media(("crop", "a", "/a", 9), ("crop", None, "/b", 4)), media(("crop", "a", "/a", 1), ("plate", "a", "/a", 2), ("crop", None, "/b", 3), ("crop", None, "/b", 2)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("crop", "a", "/a", 9, 0, 2), ("crop", None, "/b", 4, 0, 3), ("plate", "a", "/a", 2, 1, 1)], key=str)


def test_chains_of_tracks_end_at_their_root(spark):
    rows = spark.createDataFrame([(i,) for i in range(40)], "track_no long")
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 30)] + [(35, 31), (36, 31)], "new_no long, old_no long")
    got = {r.track_no: r.root for r in reconcile.vehicles(rows, edges).collect()}
    assert got == {i: 0 if i < 30 else 31 if i in (35, 36) else i for i in range(40)}


def test_conflicts_chain_and_clear(spark):
    rows = [("C", "P", 1, 0.0, 0.9), ("C", "P", 2, 2.0, 0.5), ("C", "P", 3, 4.0, 0.1), ("C", "P", 4, 9.0, 0.5), ("C", "P", 5, 9.5, 0.49), ("C", "Q", 1, 0.0, 0.1), ("C", "Q", 1, 1.0, 0.1)]
    frame = spark.createDataFrame(rows, "camera_id string, plate_text string, track_no long, read_at double, score double")
    got = {(r.plate_text, r.track_no, r.read_at): r.verdict for r in plates.conflicts(frame).collect()}
    assert [got["P", i, a] for i, a in ((1, 0.0), (2, 2.0), (3, 4.0))] == ["kept", "duplicate_owner", "duplicate_owner"]
    assert got["P", 4, 9.0] == got["P", 5, 9.5] == "ambiguous_owner" and got["Q", 1, 0.0] == got["Q", 1, 1.0] == "kept"


def test_schema_contract():
    found = StructType([StructField("a", LongType()), StructField("b", StringType()), StructField("c", StringType())])
    wanted = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("d", LongType())])
    assert imports.schema_differences(found, wanted) == [("b", "type"), ("c", "extra"), ("d", "missing")]


def test_distribution_counts_far_pairs_too(spark, monkeypatch):
    monkeypatch.setattr(reid, "PART", 40)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice([1, 2, 3, None])) for i in range(300)] + [(300, [0.0] * 8, 1), (301, [float("nan")] + [1.0] * 7, 1), (None, [1.0] * 8, 1)]
    units = reid.normalized(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    known = {r.vec_id: (r.unit, r.label) for r in units.collect() if r.vec_id is not None and r.vec_id < 300}
    want = {"same": [], "different": []}
    for q in range(0, 300, 100):
        for g in known:
            if g != q:
                kind = "same" if known[q][1] is not None and known[q][1] == known[g][1] else "different"
                want[kind].append(round(sum(x * y for x, y in zip(known[q][0], known[g][0])), 9))
    got = {r.pairs: r for r in reid.all_pairs_distribution(units.where("vec_id % 100 = 0"), units).collect()}
    assert sum(r.n for r in got.values()) == 3 * 299
    for kind, values in want.items():
        r = got[kind]
        assert (r.n, r.least, r.most) == (len(values), min(values), max(values))
        assert (r.mean, r.median) == pytest.approx((statistics.fmean(values), statistics.median(values)), abs=1e-12)
    assert reid.all_pairs_distribution(units.limit(0), units).count() == 0


def test_plate_evidence_follows_the_rules(spark):
    rows = [
        ("HR12AB1234", "HIGH", "HR12AB1234", "HIGH", 0.5, None), ("HR12AB1234", "HIGH", "HR12AB1234", "HIGH", 0.9, "time_gap_too_large"), ("HR12AB1234", "HIGH", "HR12AB1234", "HIGH", 0.5, "different_camera"),
        ("HR12AB1234", "HIGH", "DL98XY7765", "HIGH", 0.9, None), ("HR12AB1234", "MEDIUM", "HR12AB1235", "HIGH", 0.9, None), ("HR12AB1O34", "HIGH", "HR12AB1034", "HIGH", 0.5, None),
        ("HR12AB1234", "HIGH", "HR12AB9834", "HIGH", 0.1, None), ("HR12AB1234", "LOW", "HR12AB1234", "HIGH", 0.4, None), (None, "HIGH", "HR12AB1234", "HIGH", 0.4, "time_gap_too_large"), ("", "HIGH", "X", "LOW", None, None),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, plate_a string, quality_a string, plate_b string, quality_b string, score double, rejection string")
    got = identity.plate_adjusted(identity.plate_relations(frame)).orderBy("i").collect()
    assert [(r.evidence, r.score, r.rejection) for r in got] == [
        ("STRONG_POSITIVE", 0.98, None), ("STRONG_POSITIVE", 1.24, None), ("GEOMETRY_BLOCKED_PLATE_MATCH", 0.5, "different_camera"),
        ("STRONG_NEGATIVE", 0.0, "REJECTED_BY_PLATE_CONTRADICTION"), ("PARTIAL_POSITIVE", 1.0, None), ("PARTIAL_POSITIVE", 0.68, None),
        ("WEAK_NEGATIVE", 0.0, None), ("NEUTRAL", 0.4, None), ("NEUTRAL", 0.4, "time_gap_too_large"), ("NEUTRAL", 0.0, None),
    ]


def test_completed_duplicates_keep_or_lose_their_key(spark):
    rows = [("a", "DISCARDED", 1), ("a", "COMPLETED", 2), ("b", "COMPLETED", 1), ("b", "COMPLETED", 2), ("c", None, 1), ("d", "DISCARDED", 1), ("d", "", 2)]
    got = imports.numbered_duplicates(spark.createDataFrame(rows, "k string, status string, no int"), "k", "no").orderBy("k", "no").collect()
    assert [r.unique_key for r in got] == ["a__DUPLICATE_1_DISCARDED", "a", "b__DUPLICATE_1_COMPLETED", "b__DUPLICATE_2_COMPLETED", "c", "d__DUPLICATE_1_DISCARDED", "d__DUPLICATE_2_UNKNOWN"]
    assert [(r.issue or "").split("_")[1:2] for r in got] == [["noncanonical"], [], ["completed"], ["completed"], [], ["noncanonical"], ["noncanonical"]]


def test_references_without_a_candidate_stay(spark):
    refs = spark.createDataFrame([(1, "x", 5), (2, "y", 5)], "ref_id int, owner string, frame_number int")
    tracks = spark.createDataFrame([("x", 7, 1, 9, "COMPLETED")], "owner string, track_no int, first_frame int, last_frame int, status string")
    assert sorted(map(tuple, imports.resolved(refs, tracks, ["owner"]).collect()), key=str) == [(1, 7, "containment"), (2, None, "unresolved")]


def test_run_folders_are_found_read_and_written(spark, tmp_path):
    import json

    for name, tracks in (("run_1", [{"camera_id": "c", "local_track_id": "t", "status": "COMPLETED", "extra": 1}]), ("run_2", [{"run_id": "named", "local_track_id": "u", "first_frame": 3}])):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "tracks.json").write_text(json.dumps(tracks))
    (tmp_path / "run_1" / "observations.csv").write_text("camera_id,frame_number,x1,other\nc,4,1.5,z\nc,bad,2,z\n")
    (tmp_path / "run_2" / "events.jsonl").write_text('{"frame_number": 1, "event": "start"}\n{"frame_number": 2, "event": "end"}\n')
    root = f"file://{tmp_path}"
    assert runs.run_folders(spark, root) == ["run_2", "run_1"] and runs.selected(spark, root, "latest") == ["run_2"]
    with pytest.raises(ValueError):
        runs.selected(spark, root, "run_9")
    assert sorted((r.run_id, r.local_track_id, r.first_frame) for r in runs.read_tracks(spark, root).collect()) == [("1", "t", None), ("named", "u", 3)]
    assert sorted((r.run_id, r.frame_number, r.x1) for r in runs.read_observations(spark, root).collect() if r.frame_number) == [("1", 4, 1.5)]
    assert runs.read_observations(spark, root).count() == 2 and runs.read_observations(spark, root, "run_2").count() == 0
    assert [r.event for r in runs.read_events(spark, root).orderBy("frame_number").collect()] == ["start", "end"]
    out = f"{root}/out"
    runs.write_run(runs.read_tracks(spark, root), out, "json")
    runs.write_run(runs.read_tracks(spark, root, "run_1"), out, "json")
    assert sorted(str(r.run_id) for r in spark.read.json(out).collect()) == ["1", "named"]


def test_neighbours_gather_few_rows_and_rank_all(spark, monkeypatch):
    monkeypatch.setattr(reid, "QUERIES", 7)
    monkeypatch.setattr(reid, "GALLERY", 40)
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(6)], i % 4) for i in range(200)]
    rows += [(1000 + i, rows[i % 3][1], None) for i in range(60)] + [(5000, [0.5, 0.5], 1), (5001, [0.0] * 6, 1)]
    units = reid.normalized(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    plain = {r.vec_id: r.unit for r in units.collect()}
    ranked = reid.neighbours(units.where("vec_id % 10 = 0"), units, 5)
    got = {}
    for r in ranked.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.similarity)
    for q in (i for i in plain if i % 10 == 0):
        want = sorted((-round(sum(x * y for x, y in zip(plain[q], v)), 9), i) for i, v in plain.items() if i != q)[:5]
        assert [got[q][k][0] for k in range(1, 6)] == [i for _, i in want]
        assert [got[q][k][1] for k in range(1, 6)] == pytest.approx([-s for s, _ in want], abs=1e-12)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # no row for each pair of a query with the gallery


def test_decimal_weights_are_summed_exactly(spark):
    from decimal import Decimal

    from vialytics.operators import votes

    rows = [(1, "CAR", w) for w in ("0.2", "0.6", "0.7")] + [(1, "BUS", w) for w in ("0.7", "0.3")] + [(2, "CAR", None)]
    df = spark.createDataFrame([(t, label, w and Decimal(w)) for t, label, w in rows], "track_no long, label string, weight decimal(20,6)")
    got = {r.track_no: (r.label, r.reason) for r in votes.weighted_vote(df, "track_no").collect()}
    assert got == {1: ("CAR", "weighted_majority"), 2: ("UNKNOWN", "single_weak_prediction")}


def test_owners_are_sought_near_their_plates(spark):
    rows = [("A", 1, i, 40.0 * i, 10.0 * (i % 7), 40.0 * i + 60, 10.0 * (i % 7) + 50) for i in range(-60, 400)] + [("B", 9, 1, 0.0, 0.0, 10.0, 10.0), ("A", 1, 900, -9000.0, -50.0, 9000.0, 80.0)]
    cars = spark.createDataFrame(rows, "camera_id string, frame_number long, track_no long, x1 double, y1 double, x2 double, y2 double")
    tags = [("A", 1, t, 0.5, x, y, x + 12, y + 6) for _, f, t, x, y, *_ in rows if f == 1] + [("B", 9, 5, 0.5, 500.0, 0.0, 505.0, 4.0), ("C", 1, 6, 0.5, 0.0, 0.0, 9.0, 9.0)]
    plate = "camera_id string, frame_number long, track_no long, confidence double, p_x1 double, p_y1 double, p_x2 double, p_y2 double"
    tagged = spark.createDataFrame(tags, plate)
    pairs = tagged.join(cars.withColumnRenamed("track_no", "owner"), ["camera_id", "frame_number"])
    score = plates.owner_score(tuple(F.col(f"p_{c}") for c in ("x1", "y1", "x2", "y2")), tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("confidence"))
    want = {}
    for r in pairs.withColumn("score", score).collect():
        best = want.setdefault((r.camera_id, r.track_no), [])
        best += [(-r.score, r.owner)] if r.score is not None else []
    for lost in (cars, cars.union(spark.createDataFrame([("B", 9, 2, None, 0.0, 1000.0, 3.0)], cars.schema))):
        got = {(r.camera_id, r.track_no): r for r in plates.owners(tagged, lost).collect()}
        assert set(got) == set(want)
        for k, found in want.items():
            if k[0] == "A":
                assert got[k].owner == min(found)[1] and got[k].best_score == -min(found)[0]
    assert got["B", 5].verdict == "target_not_in_owner_pool"  # a vehicle without a left edge reaches everything
    joined = plates.owners(tagged, cars)
    joined.collect()
    assert "cell_x" in joined._jdf.queryExecution().optimizedPlan().toString()  # not all vehicles of a frame


def test_continued_tracks_are_those_of_all_pairs(spark):
    draw = random.Random(11)
    seen, tracks = [], []
    for t in range(300):
        x, y, f, dx = draw.uniform(0, 2500), draw.uniform(0, 400), draw.randrange(60), draw.uniform(-3, 9)
        tracks.append(("r", "c", t, draw.choice(["CAR", "BUS", "UNKNOWN"]), draw.choice(["RED", "GREY", "UNKNOWN"])))
        seen += [(t, f + i, (f + i) / 2.0, x + dx * i, y, x + dx * i + 20, y + 10) for i in range(draw.randrange(1, 7))]
    observed = spark.createDataFrame(seen, "track_no long, frame_number long, timestamp_seconds double, x1 double, y1 double, x2 double, y2 double")
    found = reconcile.tracklets(observed, spark.createDataFrame(tracks, "run_id string, camera_id string, track_no long, vehicle_class string, colour string")).cache()
    every = reconcile.accepted(reconcile.pair_scores(found).withColumn("score", F.round("score", 9))).collect()
    assert len(every) > 5 and sorted(map(tuple, reconcile.continued(found).collect())) == sorted(map(tuple, every))
