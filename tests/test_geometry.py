import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import boxes, camera, geometry, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lits(*xs):
    return [F.lit(float(x)) for x in xs]


def rotation(spark, *rpy):
    return np.array(one(spark, geometry.rotation_of_euler(*lits(*rpy)))).reshape(3, 3)


def test_euler_and_quaternion_round_trips(spark):
    r = geometry.rotation_of_euler(*lits(0.3, -0.5, 1.1))
    assert one(spark, geometry.euler_of_rotation(r)) == pytest.approx([0.3, -0.5, 1.1])
    q = geometry.quaternion_of_rotation(r)
    back = geometry.let(q, lambda q: geometry.rotation_of_quaternion(q[0], q[1], q[2], q[3]))
    assert one(spark, back) == pytest.approx(one(spark, r))
    assert one(spark, q)[0] >= 0


def test_zero_quaternion_is_identity(spark):
    assert one(spark, geometry.rotation_of_quaternion(*lits(0, 0, 0, 0))) == list(geometry.IDENTITY)


@pytest.mark.parametrize("v", [(0, 0, 0), (1e-6, 0, 0), (0.4, -0.2, 0.9), (0, 0, 3.0)])
def test_exp_and_log_are_inverse(spark, v):
    assert one(spark, geometry.so3_log(geometry.so3_exp(geometry.vec(*v)))) == pytest.approx(list(v), abs=1e-6)


def test_pose_laws(spark):
    a = geometry.pose(geometry.rotation_of_euler(*lits(0.1, 0.2, 0.3)), geometry.vec(1, 2, 3))
    b = geometry.pose(geometry.rotation_of_euler(*lits(-0.4, 0.1, 0.9)), geometry.vec(-1, 0, 2))
    p = geometry.vec(0.5, -0.5, 2)
    assert one(spark, geometry.pose_apply(geometry.pose_compose(a, b), p)) == pytest.approx(one(spark, geometry.pose_apply(a, geometry.pose_apply(b, p))))
    assert one(spark, geometry.pose_apply(geometry.pose_inverse(a), geometry.pose_apply(a, p))) == pytest.approx([0.5, -0.5, 2])
    assert one(spark, geometry.geodesic(a["r"], a["r"])) == pytest.approx(0, abs=1e-6)


def test_slerp_takes_the_shorter_arc(spark):
    a, b = geometry.vec(1, 0, 0, 0), geometry.vec(-math.cos(0.5), 0, 0, -math.sin(0.5))
    assert one(spark, geometry.slerp(a, b, F.lit(0.5))) == pytest.approx([math.cos(0.25), 0, 0, math.sin(0.25)])


@pytest.mark.parametrize("a, b, want", [(0, math.pi, 0), (0, math.pi / 2, math.pi / 2), (0.1, 0.1 + 3 * math.pi, 0)])
def test_half_turn_distance(spark, a, b, want):
    assert one(spark, geometry.half_turn_distance(*lits(a, b))) == pytest.approx(want, abs=1e-9)


def test_corners_voxels_and_inside(spark):
    c = one(spark, geometry.box_corners(geometry.vec(1, 2, 3), geometry.vec(2, 4, 6), geometry.vec(*geometry.IDENTITY)))
    assert sorted(map(tuple, c))[0] == (0, 0, 0) and sorted(map(tuple, c))[-1] == (2, 4, 6)
    assert one(spark, geometry.voxel_centres(*lits(2, 4), 2)) == [2.5, 3.5]
    box = lits(0, 0, 0, 2, 2, 2, 0)
    assert one(spark, geometry.inside_yaw_box(*lits(0.9, 0, 0), *box)) is True
    assert one(spark, geometry.inside_yaw_box(*lits(1, 0, 0), *box)) is False


def test_rect_iou(spark):
    a, b = tuple(lits(0, 0, 2, 2)), tuple(lits(1, 1, 3, 3))
    assert one(spark, geometry.iou_xyxy(a, b)) == pytest.approx(1 / 7)
    assert one(spark, geometry.iou_xyxy(tuple(lits(0, 0, 0, 0)), tuple(lits(0, 0, 0, 0)))) == 0


def test_cameras(spark):
    p = geometry.vec(0.2, -0.1, 2)
    uv = one(spark, camera.pinhole_project(p, *lits(500, 500, 320, 240)))
    assert uv == pytest.approx([370, 215])
    ray = one(spark, camera.pinhole_ray(*lits(370, 215, 500, 500, 320, 240)))
    assert np.array(ray) * 2 == pytest.approx([0.2, -0.1, 2])
    zeros = lambda n: F.array(*lits(*[0] * n))
    r = math.hypot(0.1, 0.05)
    assert one(spark, camera.fisheye_project(p, *lits(500, 500, 320, 240), zeros(6), zeros(2), zeros(4)))[0] == pytest.approx(500 * math.atan(r) / r * 0.1 + 320)
    assert one(spark, camera.scaled(*lits(500, 500, 320, 240, 0.5, 0.5))[2]) == pytest.approx(159.75)


def test_labels_and_colours(spark):
    assert one(spark, text.prompt_phrases(text.normalised_prompt(F.lit(" Chair. Round Table ")))) == ["chair", "round table"]
    assert one(spark, text.label_for_file(F.lit(" "), F.lit("Book,Shelf"), F.lit(3))) == "book shelf"
    assert one(spark, text.label_for_file(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(3))) == "3"
    assert one(spark, text.instance_colour(F.lit(10))) == [(73 * 10 + 97) % 256, (151 * 10 + 53) % 256, (199 * 10 + 211) % 256]
    assert one(spark, text.hex_colour(F.lit("#0a10ff"))) == [10, 16, 255] and one(spark, text.hex_colour(F.lit("red"))) is None
    assert one(spark, text.contains_chinese(F.lit("a椅"))) and not one(spark, text.contains_chinese(F.lit("chair")))


def test_nearest_rotation_of_a_matrix_that_is_nearly_one(spark):
    r = rotation(spark, 0.3, -0.5, 1.1)
    near = r + 0.01 * np.random.default_rng(1).standard_normal((3, 3))
    u, _, v = np.linalg.svd(near)
    got = np.array(one(spark, boxes.nearest_rotation(F.array(*lits(*near.ravel()))))).reshape(3, 3)
    assert got == pytest.approx(u @ v, abs=1e-5) and np.abs(near - u @ v).max() > 1e-3


def test_fitted_box_holds_its_points(spark):
    rng = np.random.default_rng(2)
    yaw = 5 * math.pi / 19
    local = rng.uniform(-0.5, 0.5, (400, 3)) * (4, 1, 2)
    turned = np.stack([math.cos(yaw) * local[:, 0] - math.sin(yaw) * local[:, 1], math.sin(yaw) * local[:, 0] + math.cos(yaw) * local[:, 1], local[:, 2]], 1) + (3, -2, 1)
    rows = [("a", *map(float, p)) for p in turned] + [("single", 0.0, 0.0, 0.0), ("twice", 1.0, 1.0, 1.0), ("twice", 1.0, 1.0, 1.0)]
    got = {x["k"]: x for x in boxes.fit_boxes(spark.createDataFrame(rows, "k string, x double, y double, z double"), ["k"]).collect()}
    assert set(got) == {"a", "twice"}
    assert (got["a"]["yaw"], got["a"]["sx"], got["a"]["sy"]) == pytest.approx((yaw, *np.ptp(local, 0)[:2])) and got["twice"]["yaw"] == 0


@pytest.mark.parametrize("size, want", [((1600, 900), (640, 360, 0, 0)), ((100, 300), (120, 360, 260, 0)), ((1000, 100), (640, 64, 0, 148)), ((0, 0), (1, 1, 319, 179))])
def test_fitted_panel(spark, size, want):
    assert tuple(one(spark, boxes.fitted_panel(F.lit(size[0]), F.lit(size[1]), 640))) == want


def test_nearest_position_takes_the_first_of_equals(spark):
    assert one(spark, boxes.nearest_position(F.array(*lits(5, 1, 3, 1)), F.lit(2.0))) == 1
    assert one(spark, boxes.nearest_position(F.array(*lits(5, 2, 2)), F.lit(2.0))) == 1
    assert one(spark, boxes.nearest_position(F.expr("array(cast(null as double), 4D)"), F.lit(2.0))) == 1
    assert one(spark, boxes.nearest_position(F.expr("cast(array() as array<double>)"), F.lit(2.0))) is None


def test_unseen_boxes_stay(spark):
    assert one(spark, boxes.scaled_bb2(F.array(*lits(-1, -1, -1, -1)), *lits(2, 2))) == [-1] * 4
    assert one(spark, boxes.turned_bb2(F.array(*lits(-1, 5, 2, 8)), F.lit(10.0))) == [-1, 7, -1, 5]
