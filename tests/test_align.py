"""Motions between point sets, boxes from corners, quarter turns, other forms of rotations, principal components."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import geometry
from orbweave.operators import align
from orbweave.plans.spaces import lits


def turn(draw):
    q, _ = np.linalg.qr(draw.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_motions_are_recovered(spark):
    draw = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(12):
        r, t = turn(draw), draw.normal(size=3) * 100
        q = draw.normal(size=(3 if g == 0 else 20, 3)) * [1, 2, 3] + (1e6 if g == 1 else 0)
        if g == 2:
            q[:, 2] = 0.0  # points in a plane: a reflection would do as well
        p = q @ r.T + t + (draw.normal(size=q.shape) * 0.05 if g > 5 else 0)
        want[g] = (r, t, p, q)
        rows += [(g, *map(float, a), *map(float, b)) for a, b in zip(p, q)]
    rows += [(0, None, 1.0, 1.0, 1.0, 1.0, 1.0), (0, math.nan, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, px double, py double, pz double, qx double, qy double, qz double").repartition(4)
    got = align.align_points(df, ["g"], ("px", "py", "pz"), ("qx", "qy", "qz")).collect()
    assert len(got) == 12
    for row in got:
        r, t, p, q = want[row["g"]]
        assert row["n"] == len(p)
        m = np.array(row["rotation"]).reshape(3, 3)
        assert np.linalg.det(m) == pytest.approx(1)
        left = q @ m.T + row["translation"] - p
        assert row["error"] == pytest.approx(np.linalg.norm(left, axis=0).mean(), abs=1e-4)
        if row["g"] <= 5:
            assert m == pytest.approx(r, abs=1e-6) and row["error"] < 1e-4
        else:
            for _ in range(30):  # no motion near it is better
                other = m @ (np.eye(3) + (lambda w: np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]))(draw.normal(size=3) * 1e-2))
                u, _, v = np.linalg.svd(other)
                moved = q @ (u @ v).T
                assert ((moved - moved.mean(0) - p + p.mean(0)) ** 2).sum() >= (left**2).sum() - 1e-9
    assert align.align_points(df.limit(0), ["g"], ("px", "py", "pz"), ("qx", "qy", "qz")).count() == 0


def test_trajectories_of_other_times(spark):
    r, t = turn(np.random.default_rng(2)), np.array([3.0, -2.0, 1.0])
    path = lambda s: np.array([s, 2 * s if s < 5 else 10.0, 0.0 if s < 7 else s - 7])  # noqa: E731  straight between whole times
    other = [("a", s * 1000, *map(float, path(s))) for s in range(0, 11)]
    own = [("a", int(s * 1000), *map(float, r @ path(s) + t)) for s in np.arange(-1, 12, 0.5)]
    schema = "device string, time_ns long, x double, y double, z double"
    (row,) = align.align_trajectories(spark.createDataFrame(own, schema), spark.createDataFrame(other, schema), ["device"]).collect()
    assert row["n"] == 21 and np.array(row["rotation"]).reshape(3, 3) == pytest.approx(r, abs=1e-9) and row["translation"] == pytest.approx(list(t), abs=1e-9)


def test_boxes_from_corners(spark):
    draw = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(20):
        r, t, s = turn(draw), draw.normal(size=3) * 9, draw.uniform(0.2, 3, 3)
        noise = draw.normal(size=(8, 3)) * (0.001 if i > 9 else 0)
        rows.append((i, ((align.CORNERS * s) @ r.T + t + noise).tolist()))
        want[i] = (r, t, s, 0.02 if i > 9 else 1e-9)
    rows += [(98, None), (99, [[1.0, 2.0, 3.0]] * 7), (97, [[1.0, None, 3.0]] * 8)]
    for row in align.with_box_of_corners(spark.createDataFrame(rows, "i int, corners array<array<double>>").repartition(3), "corners").collect():
        if row["i"] > 90:
            assert row["box"] is None
            continue
        r, t, s, near = want[row["i"]]
        assert row["box"]["center"] == pytest.approx(list(t), abs=near) and row["box"]["size"] == pytest.approx(list(s), abs=near)
        assert np.array(row["box"]["rotation"]).reshape(3, 3) == pytest.approx(r, abs=near)


def test_quarter_turns(spark):
    assert len(set(align.QUARTER_TURNS)) == 24 and align.QUARTER_TURNS[0] == (1, 0, 0, 0, 1, 0, 0, 0, 1)
    mats = np.array(align.QUARTER_TURNS).reshape(-1, 3, 3)
    assert all(np.linalg.det(m) == pytest.approx(1) and (m @ m.T == np.eye(3)).all() for m in mats)
    draw = np.random.default_rng(4)
    pairs = [(turn(draw), turn(draw)) for _ in range(40)] + [(np.eye(3), np.eye(3))]
    df = spark.createDataFrame([(i, a.ravel().tolist(), b.ravel().tolist()) for i, (a, b) in enumerate(pairs)], "i int, a array<double>, b array<double>")
    for row in df.withColumn("q", align.nearest_quarter_turn(F.col("a"), F.col("b"))).collect():
        a, b = pairs[row["i"]]
        angle = lambda m: math.acos(max(-1, min(1, (np.trace(m) - 1) / 2)))
        best = min(range(24), key=lambda k: (round(angle(a.T @ b @ mats[k]), 9), k))
        assert np.array(row["q"]["turn"]).reshape(3, 3) == pytest.approx(mats[best]) and np.array(row["q"]["rotation"]).reshape(3, 3) == pytest.approx(b @ mats[best])


def test_rotations_of_six_and_five_numbers(spark):
    draw = np.random.default_rng(5)
    for _ in range(5):
        a, b = draw.normal(size=3), draw.normal(size=3)
        x = a / np.linalg.norm(a)
        y = b - (b @ x) * x
        y /= np.linalg.norm(y)
        want = np.column_stack([x, y, np.cross(x, y)])
        assert np.array(one(spark, geometry.rotation_of_6d(lits(*a), lits(*b)))).reshape(3, 3) == pytest.approx(want)
    for _ in range(5):  # the numbers of a rotation lead back to it
        r = turn(draw)
        u = np.array([r[2, 0], *r[:, 1]])  # of length sqrt(1 + r20^2); the projection is from the unit sphere
        u = u / np.linalg.norm(u)
        flat = u[1:] / (1 - u[0])
        five = [*r[:2, 0], *(flat / [math.sqrt(2) + 1, math.sqrt(2) + 1, math.sqrt(2)])]
        assert np.array(one(spark, geometry.rotation_of_5d(lits(*five)))).reshape(3, 3) == pytest.approx(r, abs=1e-9)
    p = one(spark, geometry.stereographic_unprojected(lits(0.3, -2.0), 2, 1))
    assert np.linalg.norm(p) == pytest.approx(1) and [p[0] / (1 - p[1]), p[2] / (1 - p[1])] == pytest.approx([0.3, -2.0])


def test_average_pose(spark):
    none = F.lit(0.0)
    a = geometry.pose(geometry.rotation_of_euler(none, none, F.lit(3.0)), lits(1, 2, 3))
    b = geometry.pose(geometry.rotation_of_euler(none, none, F.lit(-3.0)), lits(3, 0, 3))
    got = one(spark, geometry.average_pose(a, b))
    assert got["t"] == [2, 1, 3] and got["r"][:2] == pytest.approx([-1, 0], abs=1e-9)  # over half a turn, not over none


def test_principal_components(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(300, 7)) * [5, 1, 3, 0.5, 0.1, 2, 0.2] + 1e5
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None] + [0.0] * 5), (902, [math.nan] * 7)]
    df = spark.createDataFrame(rows, "i int, v array<double>").repartition(5)
    mean, axes, n = align.principal_components(df, "v")
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert n == 300 and mean == pytest.approx(x.mean(0)) and np.abs((axes * vt[:3]).sum(1)) == pytest.approx(np.ones(3), abs=1e-9)
    assert (axes[np.arange(3), np.abs(axes).argmax(1)] > 0).all()
    along = (x - x.mean(0)) @ axes.T
    want = (along - along.min(0)) / (along.max(0) - along.min(0))
    got = {r["i"]: r["colour"] for r in align.component_colours(df, "v").collect()}
    assert all(got[i] == pytest.approx(list(w), abs=1e-7) for i, w in enumerate(want)) and got[900] is None and got[901] is None and got[902] is None
    flat = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], "i int, v array<double>")
    assert {tuple(r["colour"]) for r in align.component_colours(flat, "v", k=2).collect()} == {(0.0, 0.0)}
    for bad in (df.limit(0), spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "i int, v array<double>")):
        with pytest.raises(ValueError):
            align.principal_components(bad, "v")
