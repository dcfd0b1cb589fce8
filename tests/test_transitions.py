"""Frames around a transition, by hand."""

from pyspark.sql import functions as F

from vialytics.operators import transitions as tr

OBS = "run_id string, camera_id string, track_no long, frame_number long, timestamp_seconds double, x1 double, y1 double, x2 double, y2 double"
DET = "run_id string, camera_id string, frame_number long, class_name string, confidence double, passed boolean, x1 double, y1 double, x2 double, y2 double"


def test_a_gap_with_a_missing_and_a_weak_frame(spark):
    obs = [("r", "c", 1, f, f / 10, 0.0, 0.0, 10.0, 10.0) for f in (3, 4, 5)] + [("r", "c", 2, f, f / 10, 2.0, 0.0, 12.0, 10.0) for f in (9, 10)]
    det = [("r", "c", 5, "truck", 0.9, True, 0.0, 0.0, 10.0, 10.0), ("r", "c", 6, "Truck", 0.3, True, 0.0, 0.0, 10.0, 20.0), ("r", "c", 6, "car", 0.9, False, 0.0, 0.0, 10.0, 10.0), ("r", "c", 8, "bus", 0.8, False, 5.0, 0.0, 15.0, 10.0), ("r", "c", 8, "person", 0.8, True, 0.0, 0.0, 10.0, 10.0), ("r", "c", 9, "car", 0.05, True, 900.0, 0.0, 910.0, 10.0)]
    o, d = spark.createDataFrame(obs, OBS), spark.createDataFrame(det, DET)
    bounds = tr.boundaries(spark.createDataFrame([("r", "c", 1, 2)], "run_id string, camera_id string, old_no long, new_no long"), o)
    b = bounds.first()
    assert (b.gap_frames, round(b.gap_seconds, 6), b.t_x1, b.t_x2) == (4, 0.4, 0.0, 10.0)
    windows = tr.frame_windows(bounds, d, o, 0.5)
    rows = {r.frame_number: r for r in windows.collect()}
    assert sorted(rows) == list(range(0, 20)) and [f for f in rows if rows[f].in_gap] in ([6, 7, 8], [8, 7, 6], [6, 8, 7], [7, 6, 8], [7, 8, 6], [8, 6, 7])
    assert (rows[5].band, rows[5].iou, rows[6].band, rows[6].primary_class, rows[6].iou, rows[6].height_ratio) == ("high_confidence_path", None, "low_confidence_path", "Truck", 0.5, 2.0)
    assert (rows[6].raw_count, rows[6].passed_count, rows[7].band, rows[8].band, rows[8].passed_count) == (2, 1, "missing", "high_confidence_path", 0)
    assert round(rows[8].iou, 6) == round(50 / 250, 6) and rows[8].others == 1 and rows[9].band == "missing"  # frame 8 compares with frame 6
    assert [rows[f].old_state for f in (2, 4, 6)] == ["NOT_CREATED", "ACTIVE", "LOST"] and [rows[f].new_state for f in (8, 9, 15)] == ["NOT_CREATED", "ACTIVE", "LOST"]
    s = tr.transition_summaries(windows, 0.5).first()
    assert (s.missing_frames, s.low_frames, s.dropout, s.box_jump, s.occlusion, s.root_cause) == ([7], [6], True, True, True, tr.DROPOUT)


def test_states_and_conclusions(spark):
    states = spark.createDataFrame([(1, None, None, False), (50, 1, 9, False), (49, 1, 9, False)], "f int, a int, b int, seen boolean").select(tr.manager_state(F.col("f"), F.col("a"), F.col("b"), F.col("seen")).alias("s"))
    assert [r.s for r in states.collect()] == ["UNKNOWN", "COMPLETED", "LOST"]
    causes = spark.createDataFrame([("a", tr.DROPOUT), ("a", tr.DROPOUT), ("b", tr.DROPOUT), ("b", tr.WEAK), ("c", tr.WEAK), ("c", tr.SEVERAL), ("d", tr.DROPOUT), ("d", tr.UNSTABLE)], "k string, root_cause string")
    assert {r.k: r.conclusion for r in tr.conclusions(causes, ["k"]).collect()} == {"a": tr.DROPOUT, "b": tr.DROPOUT_AND_WEAK, "c": tr.WEAK, "d": tr.SEVERAL}
