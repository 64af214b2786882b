import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import asof, filters, spatial


def test_nearest_ties_ends_and_tolerance(spark):
    a = spark.createDataFrame([(1, t) for t in (-5, 0, 5, 14, 15, 16, 99)] + [(2, 7)], "k int, t long")
    b = spark.createDataFrame([(1, 0, "a"), (1, 10, "b"), (1, 20, "c")], "k int, t long, v string")
    get = lambda df: {(r.k, r.t): r.r_v for r in df.collect()}
    early = get(asof.nearest(a, b, "t", ["k"]))
    assert early == {(1, -5): "a", (1, 0): "a", (1, 5): "a", (1, 14): "b", (1, 15): "b", (1, 16): "c", (1, 99): "c", (2, 7): None}
    assert get(asof.nearest(a, b, "t", ["k"], later_on_tie=True))[1, 5] == "b"
    assert set(get(asof.nearest(a, b, "t", ["k"], tolerance=4, how="inner"))) == {(1, 0), (1, 14), (1, 16)}
    assert get(asof.ceiling(a, b, "t", ["k"])) == {(1, -5): "a", (1, 0): "a", (1, 5): "b", (1, 14): "c", (1, 15): "c", (1, 16): "c", (1, 99): "c", (2, 7): None}
    assert get(asof.lower(a, b, "t", ["k"])) == {(1, -5): None, (1, 0): "a", (1, 5): "a", (1, 14): "b", (1, 15): "b", (1, 16): "b", (1, 99): "c", (2, 7): None}


def test_bounds_and_interpolation(spark):
    a = spark.createDataFrame([(1, t) for t in (-5, 0, 5, 20)], "k int, t long")
    b = spark.createDataFrame([(1, 0, 1.0), (1, 10, 3.0)], "k int, t long, v double")
    got = {r.t: (r.lower, r.upper, r.alpha, r.good) for r in asof.bounds(a, b, "t", ["k"]).collect()}
    assert got == {-5: (0, 0, 0.0, False), 0: (0, 0, 0.0, True), 5: (0, 10, 0.5, True), 20: (10, 10, 0.0, False)}
    assert {r.t: r.v for r in asof.interpolated(a, b, ["v"], "t", ["k"]).collect()} == {-5: 1.0, 0: 1.0, 5: 2.0, 20: 3.0}


def test_trailing_window_is_closed(spark):
    a = spark.createDataFrame([(100,)], "t long")
    b = spark.createDataFrame([(t,) for t in (79, 80, 90, 100, 101)], "t long")
    assert sorted(r.r_t for r in asof.trailing(a, b, 20, "t").collect()) == [80, 90, 100]


def boxes(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i % 2, i, *map(float, rng.uniform(-4, 4, 2)), float(rng.uniform(0, 1)), *map(float, rng.uniform(0.3, 3, 3)), float(rng.uniform(-3, 3))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "scene_id int, det_id int, tx double, ty double, tz double, sx double, sy double, sz double, yaw double")


@pytest.mark.parametrize("cell", [0.7, 4.0])
def test_bucketed_overlap_join_equals_brute_force(spark, cell):
    rows, df = boxes(spark)
    got = {(r.a, r.b): r.iou for r in spatial.overlap_edges(df, ["scene_id"], 0.0, cell).collect()}
    v = np.array([r[2:] for r in rows])
    want = {}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            near = np.hypot(*(v[i, :2] - v[j, :2])) <= (np.hypot(v[i, 3], v[i, 4]) + np.hypot(v[j, 3], v[j, 4])) / 2
            if rows[i][0] == rows[j][0] and near and min(v[i, 2] + v[i, 5] / 2, v[j, 2] + v[j, 5] / 2) > max(v[i, 2] - v[i, 5] / 2, v[j, 2] - v[j, 5] / 2):
                want[i, j] = spatial.sampled_iou(v[i : i + 1], v[j : j + 1])[0]
    assert got.keys() == want.keys() and got == pytest.approx(want)
    assert all(0 <= x <= 1 for x in got.values())


def test_iou_values():
    cube = np.array([[0, 0, 0, 1, 1, 1, 0.0]])
    half, far, turned = cube.copy(), cube.copy(), cube.copy()
    half[0, 3:6], far[0, 0], turned[0, 6] = 0.5, 10, 0.2
    assert spatial.exact_iou(cube, cube)[0] == pytest.approx(1) and spatial.sampled_iou(cube, cube)[0] == pytest.approx(1)
    assert spatial.exact_iou(cube, half)[0] == pytest.approx(0.125) and spatial.exact_iou(cube, far)[0] == 0
    turned[0, :3] = 0.2, 0.1, 0.05
    assert spatial.sampled_iou(cube, turned, 32)[0] == pytest.approx(spatial.exact_iou(cube, turned)[0], abs=0.05)


def test_points_and_distance(spark):
    rows, df = boxes(spark)
    rng = np.random.default_rng(3)
    pts = [(k % 2, k, *map(float, rng.uniform(-4, 4, 3))) for k in range(200)]
    p = spark.createDataFrame(pts, "scene_id int, pid int, x double, y double, z double")
    got = {(r.det_id, r.pid) for r in spatial.points_in_boxes(df, p, ["scene_id"], 1.3).collect()}
    want = set()
    for s, i, tx, ty, tz, sx, sy, sz, yaw in rows:
        for s2, k, x, y, z in pts:
            dx, dy, c, n = x - tx, y - ty, np.cos(yaw), np.sin(yaw)
            if s == s2 and abs(c * dx + n * dy) < sx / 2 and abs(c * dy - n * dx) < sy / 2 and abs(z - tz) < sz / 2:
                want.add((i, k))
    assert got == want
    near = {r.det_id for r in spatial.within_distance(df, df.where("det_id % 10 = 0"), ["scene_id"], 1.0).collect()}
    v = np.array([r[2:5] for r in rows])
    assert near == {i for i in range(len(rows)) if any(j % 10 == 0 and rows[i][0] == rows[j][0] and np.linalg.norm(v[i] - v[j]) <= 1 for j in range(len(rows)))}


def test_filters(spark):
    d = spark.createDataFrame([(1, 5, 5, 95, 95), (2, 2, 5, 95, 95), (3, 5, 5, 6, 6)], "det_id int, x1 int, y1 int, x2 int, y2 int")
    assert [r.det_id for r in filters.clipped_boxes(d, 100, 100, 0.01, 3).collect()] == [1]
    b = spark.createDataFrame([(1, 1, 0, 0, 1, 1), (1, 2, 5, 5, 6, 6), (1, 3, 8, 8, 8, 8)], "frame_id int, box_id int, px1 int, py1 int, px2 int, py2 int")
    p = spark.createDataFrame([(1, 0, 0, 0.1), (1, 1, 1, 0.2), (1, 5, 5, 9.0), (1, 6, 6, 0.0)], "frame_id int, px int, py int, depth double")
    assert sorted(r.box_id for r in filters.depth_filtered(b, p).collect()) == [2, 3]
    assert filters.depth_filtered(b, p, 0, 0).count() == 3
    t = spark.createDataFrame([(1, t) for t in (0, 4, 10, 12, 21)], "k int, time_ns long")
    assert sorted(r.time_ns for r in filters.thinned(t, 10, "k").collect()) == [0, 10, 21]
    assert sorted(r.time_ns for r in filters.subsampled(t, skip=2, start=1, most=3).collect()) == [4, 12]
    x = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, float("nan"), 0.0), (1.0, 2.0, 3.0)], "x double, y double, z double")
    assert filters.valid_points(x).count() == 1
    names = spark.createDataFrame([("Wall",), ("chair",), (None,)], "label string")
    assert sorted(str(r.label) for r in filters.without_structure(names).collect()) == ["None", "chair"]
    s = spark.range(1000).withColumn("k", F.col("id"))
    assert filters.hash_sample(s, 10, "k").collect() == filters.hash_sample(s.repartition(7), 10, "k").collect()
