import itertools
import math

import numpy as np
import pandas as pd
import pytest

from orbweave.operators import fuse, greedy, tracking

SCHEMA = "scene_id long, frame_id long, det_id long, label string, prob double, tx double, ty double, tz double, sx double, sy double, sz double, yaw double"


def det(i, x, frame=None, label="chair", prob=0.9, size=(1.0, 1.0, 1.0), yaw=0.0, scene=0):
    return (scene, i if frame is None else frame, i, label, prob, float(x), 0.0, 0.0, *size, yaw)


def fused(spark, rows, **options):
    options = {"min_detections": 1, "nms": None, "contained": 0.0} | options
    return fuse.fuse_detections(spark.createDataFrame(rows, SCHEMA), **options).collect()


@pytest.mark.parametrize("shape", [(3, 3), (5, 5), (3, 6), (6, 3), (1, 5), (5, 1)])
def test_assignment_is_least(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        c = rng.random(shape)
        got = greedy.assign(c)
        n, m = shape
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(c[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert len(got) == min(shape) and len({a for a, _ in got}) == len({b for _, b in got}) == min(shape)
        assert sum(c[i, j] for i, j in got) == pytest.approx(best)
    assert greedy.assign(np.zeros((0, 3))) == [] and len(greedy.assign(np.zeros((5, 5)))) == 5 and len(greedy.assign(np.full((10, 10), 1e6))) == 10


def test_scenes(spark):
    two = fused(spark, [det(0, 0), det(1, 0)])
    assert [(r.support_count, r.members) for r in two] == [(2, [0, 1])]
    assert len(fused(spark, [det(i, 10 * i) for i in range(3)])) == 3
    assert fused(spark, [det(i, 10 * i) for i in range(3)], min_detections=2) == []
    pairs = fused(spark, [det(2 * i + k, 5 * i + 0.05 * k) for i in range(5) for k in range(2)])
    assert [r.support_count for r in pairs] == [2] * 5
    assert fused(spark, [det(0, 0, prob=0.5)]) == []


def test_two_of_one_frame_never_merge(spark):
    rows = [det(0, 0, frame=1), det(1, 0.1, frame=2), det(2, 0.05, frame=1)]
    assert sorted(tuple(r.members) for r in fused(spark, rows)) in ([(0,), (1, 2)], [(0, 1), (2,)])


def test_labels_may_differ_unless_asked(spark):
    rows = [det(0, 0, label="chair"), det(1, 0, label="sofa", prob=0.8)]
    assert [r.label for r in fused(spark, rows)] == ["chair"]
    assert len(fused(spark, rows, same_label=True)) == 2


def test_yaw_of_opposite_boxes(spark):
    yaw = fused(spark, [det(0, 0, size=(2.0, 1.0, 1.0)), det(1, 0, size=(2.0, 1.0, 1.0), yaw=math.pi)])[0].yaw
    assert min(abs(yaw), abs(abs(yaw) - math.pi)) < 1e-6


def test_right_angles_are_aligned(spark):
    r = fused(spark, [det(0, 0, size=(2.0, 1.0, 1.0), prob=0.95), det(1, 0, size=(1.0, 2.0, 1.0), yaw=math.pi / 2, prob=0.6)])[0]
    assert (r.sx, r.sy) == pytest.approx((2, 1), abs=1e-6)


def test_far_members_weigh_less(spark):
    rows = [det(i, 0.01 * i) for i in range(6)] + [det(6, 0.35)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0 as cluster")
    w = {r.det_id: r.weight for r in fuse.weighted(df).collect()}
    score = 0.32 / (1.4826 * 0.02) / 3  # the position alone is off: 0.32 from the median, of a median deviation of 0.02
    assert w[6] == pytest.approx(w[2] * 2.5 / score) and sum(w.values()) == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        fuse.weighted(df, "median")


def item(k, x, support, label="a", size=1.0, prob=0.9):
    return {"cluster": k, "tx": x, "ty": 0.0, "tz": 0.0, "sx": size, "sy": size, "sz": size, "yaw": 0.0, "prob": prob, "support_count": support, "members": [100 * k + i for i in range(support)], "label": label}


def test_suppression_and_absorption():
    kept = greedy.suppress_instances([item(0, 0, 2), item(1, 0.05, 5, "b"), item(2, 9, 1)], 0.6)
    assert [(x["cluster"], x["support_count"]) for x in kept] == [(1, 7), (2, 1)]
    kept = greedy.absorb_contained([item(0, 0, 2, size=0.4), item(1, 0, 1, size=1.0), item(2, 0, 1, "b", 0.4)], 0.8)
    assert [(x["cluster"], x["support_count"]) for x in kept] == [(1, 3), (2, 1)]


def test_nms_per_frame(spark):
    rows = [(0, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.8, 1.0, 0.0, 11.0, 10.0), (2, 1, 0.7, 30.0, 0.0, 40.0, 10.0), (3, 2, 0.1, 1.0, 0.0, 11.0, 10.0)]
    df = spark.createDataFrame(rows, "det_id int, frame_id int, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.det_id for r in greedy.suppress_2d(df).collect()) == [0, 2, 3]


def test_clusters_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [det(i, float(rng.uniform(0, 6)), frame=i // 3) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    run = lambda d: sorted(map(tuple, (r.members for r in fuse.fuse_detections(d, min_detections=1).select("members").collect())))
    assert run(df) == run(df.repartition(9))


def frames(*xs):
    return [{"box": [float(x), 0, 0, 1, 1, 1, 0.0], "prob": 0.9, "label": "chair"} for x in xs]


def test_track_life():
    t = tracking.Tracker(tracking.TrackerConfig(min_hits=3, max_missed=4))
    assert t.update(0, frames(0)) == [] and t.state.tracks[0].state == tracking.TENTATIVE
    t.update(1, frames(0.05))
    assert [x.state for x in t.update(2, frames(0.05))] == [tracking.ACTIVE]
    assert [x.state for x in t.update(3, [])] == [tracking.INACTIVE]
    assert [x.state for x in t.update(4, frames(0.05))] == [tracking.ACTIVE]
    for f in range(5, 20):
        out = t.update(f, [])
    assert out == [] and t.state.tracks == []
    t = tracking.Tracker()
    t.update(0, frames(0, 10, 20))
    assert len(t.state.tracks) == 3


def test_state_survives_packing():
    a, b = tracking.Tracker(), tracking.Tracker()
    for f in range(6):
        a.update(f, frames(0, 5))
        b = tracking.Tracker(state=tracking.TrackerState.unpack(b.state.pack()))
        b.update(f, frames(0, 5))
    assert a.state == b.state


def test_batch_tracker(spark):
    rows = [det(2 * f + k, 5.0 * k, frame=f, scene=s) for s in range(2) for f in range(6) for k in range(2)]
    out = tracking.track(spark.createDataFrame(rows, SCHEMA)).toPandas()
    last = out[out.frame_id == 5]
    assert len(last) == 4 and (last.state == tracking.ACTIVE).all() and (last.support == 6).all()
    assert isinstance(out, pd.DataFrame)


def test_statistics_count_what_the_steps_give(spark):
    rows = [det(i, 9.0 * (i // 5) + 0.01 * i, prob=0.9 if i % 7 else 0.1) for i in range(40)]
    statistics = fuse.FusionStatistics()
    got = fuse.fuse_detections(spark.createDataFrame(rows, SCHEMA), min_detections=5, statistics=statistics)
    counts = statistics.rows()
    assert set(counts) == set(fuse.FusionStatistics.STEPS) == set(statistics.seconds)
    sure = [r for r in rows if r[4] > 0.5]
    groups = [sum(r[2] // 5 == g for r in sure) for g in range(8)]
    assert (counts["detections"], counts["confident"], counts["clusters"], counts["fused"]) == (40, len(sure), len(sure), 8)
    assert counts["links"] == sum(n * (n - 1) // 2 for n in groups) and counts["supported"] == counts["final"] == got.count() == sum(n >= 5 for n in groups)


def test_links_of_detections_that_are_alike(spark):
    df = spark.createDataFrame([det(i, 0.01 * i) for i in range(6)], SCHEMA)
    vectors = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 3.0]), (4, [0.0, 0.0]), (9, [1.0, 1.0])]
    emb = spark.createDataFrame(vectors, "det_id long, embedding array<double>")
    got = fuse.fuse_detections(df, min_detections=1, nms=None, contained=0.0, embeddings=emb, semantic=0.9).collect()
    assert sorted(sorted(r.members) for r in got) == [[0, 1], [2, 3], [4], [5]]  # neither a zero vector nor a missing one is like any
