"""Boxes that meet by cells, against all pairs."""

import math
import random

from pyspark.sql import functions as F

from vialytics.functions.geometry import box, intersection
from vialytics.operators import places
from vialytics.operators import transitions as tr

from .test_transitions import DET, OBS


def test_boxes_that_share_space_meet_once(spark):
    draw = random.Random(3)
    rows = []
    for i in range(400):
        x, y, w = draw.uniform(-9000, 9000), draw.uniform(-500, 500), 4000 if i == 0 else draw.uniform(0, 300)
        rows.append((i, x, y, x + w, y + draw.uniform(0, 300)))
    a = spark.createDataFrame(rows, "a long, x1 double, y1 double, x2 double, y2 double")
    b = a.select(F.col("a").alias("b"), *(F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")))
    side = places.cell_side(*places.extent(a, box())[:2])
    met = places.in_cells(a, box(), side).join(places.in_cells(b, box("p_"), side), ["cell_x", "cell_y"])
    assert met.count() < 400 * 400 / 20
    got = sorted((r.a, r.b) for r in met.where(places.meet_here(box(), box("p_"), side) & (intersection(box(), box("p_")) > 0)).collect())
    assert got == sorted((r.a, r.b) for r in a.crossJoin(b).where(intersection(box(), box("p_")) > 0).collect())


def test_boxes_without_a_number_for_a_side_share_one_cell(spark):
    a = spark.createDataFrame([(0.0, 0.0, math.nan, 1.0), (5.0, 5.0, 6.0, None)], "x1 double, y1 double, x2 double, y2 double")
    wide, high, missing = places.extent(a, box())
    assert (wide, high, missing) == (math.inf, 1.0, 1) and places.cell_side(wide, high) == math.inf


def test_a_transition_does_not_meet_what_is_far_away(spark):
    obs = [("r", "c", 1, f, f / 10, 250.0, 250.0, 260.0, 262.0) for f in (3, 4, 5)] + [("r", "c", 2, f, f / 10, 252.0, 250.0, 262.0, 262.0) for f in (9, 10)]
    near = [("r", "c", f, "truck", 0.9, True, 170.0, 250.0, 180.0, 262.0) for f in (6, 8, 64)] + [("r", "c", 7, "van", 0.9, True, 255.0, 251.0, 261.0, 262.0)]
    o, bounds = spark.createDataFrame(obs, OBS), None
    bounds = tr.boundaries(spark.createDataFrame([("r", "c", 1, 2)], "run_id string, camera_id string, old_no long, new_no long"), o)
    far = [("r", "c", f, "truck", 0.9, True, float(x), 0.0, x + 9.0, 9.0) for f in range(20) for x in range(2000, 60000, 1000)]
    broken = [("r", "c", 5, "truck", 0.9, True, 20000.0, 0.0, None, 9.0)]
    for more in ([], far, far + broken):
        windows = tr.frame_windows(bounds, spark.createDataFrame(near + more, DET), o, 0.5)
        rows = {r.frame_number: (r.raw_count, r.others) for r in windows.collect()}
        assert {f: n for f, n in rows.items() if n != (0, 0)} == {6: (1, 0), 7: (0, 1), 8: (1, 0)}
        assert len(rows) == 20
