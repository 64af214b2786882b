"""Cameras as a whole, boxes of any rotation, what is seen of boxes and points, depth images."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import camera, geometry
from orbweave.operators import oriented, spatial, views
from orbweave.plans.spaces import FISHEYE, lits

WIDE = (600.0, 590.0, 700.0, 710.0, 0.3, -0.2, 0.05, 0.01, -0.004, 0.0003, 0.001, -0.002, 0.0007, -0.0002, 0.0005, 0.0001)


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def fisheye(p, params):
    fx, fy, cx, cy, *rest = params
    k, t, s = rest[:6], rest[6:8], rest[8:]
    a, b = p[0] / p[2], p[1] / p[2]
    r = math.hypot(a, b)
    h = math.atan(r)
    m = 1.0 if r < 1e-12 else h * (1 + sum(k[i] * h ** (2 * i + 2) for i in range(6))) / r
    x, y = a * m, b * m
    q = x * x + y * y
    u = x + (2 * x * x + q) * t[0] + 2 * x * y * t[1] + s[0] * q + s[1] * q * q
    v = y + (2 * y * y + q) * t[1] + 2 * x * y * t[0] + s[2] * q + s[3] * q * q
    return fx * u + cx, fy * v + cy


@pytest.mark.parametrize("params", [FISHEYE, WIDE, WIDE[:1] + WIDE[2:]])
def test_rays_lead_back_to_their_points(spark, params):
    draw = np.random.default_rng(1)
    points = np.c_[draw.uniform(-1.4, 1.4, (300, 2)), np.ones(300)] * draw.uniform(0.5, 9, (300, 1))
    points[0] = (0, 0, 2)
    cam = camera.camera(lits(*params), F.lit(1400), F.lit(1400), F.lit(800.0))
    df = rows(spark, [(i, *map(float, p)) for i, p in enumerate(points)], "i int, x double, y double, z double").withColumn("cam", cam)
    df = camera.with_pixels(df.withColumn("q", camera.project(F.col("cam"), geometry.vec(F.col("x"), F.col("y"), F.col("z")))), "cam", ("x", "y", "z"), "n")
    full = params if len(params) == 16 else params[:1] * 2 + params[1:]
    for row in df.withColumn("ray", camera.unproject(F.col("cam"), F.col("q.u"), F.col("q.v"))).collect():
        p = points[row["i"]]
        assert (row["q"]["u"], row["q"]["v"]) == pytest.approx(fisheye(p, full), abs=1e-7)
        assert (row["n"]["u"], row["n"]["v"], row["n"]["valid"]) == (pytest.approx(row["q"]["u"], abs=1e-7), pytest.approx(row["q"]["v"], abs=1e-7), row["q"]["valid"])
        inside = math.hypot(row["q"]["u"] - full[2], row["q"]["v"] - full[3]) < 800
        angle = math.degrees(math.acos(p[2] / np.linalg.norm(p)))
        image = 0 <= row["q"]["u"] <= 1399 and 0 <= row["q"]["v"] <= 1399
        assert row["q"]["valid"] == (inside and image and angle < 70) and row["ray"]["valid"] == (inside and image)
        if inside:
            assert row["ray"]["ray"] == pytest.approx(list(p / p[2]), abs=1e-6)


def test_cameras_by_their_parameters(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    pin = one(camera.camera(lits(100, 110, 60, 40), F.lit(120), F.lit(80)))
    assert pin["pinhole"] and pin["rx"] == pytest.approx(math.hypot(60, 40) + 1) and (pin["fx"], pin["fy"], pin["cx"], pin["cy"]) == (100, 110, 60, 40)
    assert one(camera.camera(lits(100, 110, 60, 40), F.lit(120), F.lit(80), F.lit(70.0)))["rx"] == 70
    single = one(camera.camera(lits(*WIDE[:1], *WIDE[2:]), F.lit(1408), F.lit(1408)))
    assert (single["fx"], single["fy"], single["cx"], list(single["k"]), list(single["t"]), list(single["s"])) == (600, 600, 700, list(WIDE[4:10]), list(WIDE[10:12]), list(WIDE[12:])) and single["rx"] == pytest.approx(1415 * 1408 / 2880)
    assert one(camera.camera(lits(*WIDE), F.lit(640), F.lit(480)))["rx"] == pytest.approx(330)
    half = one(camera.resized_camera(camera.camera(lits(100, 110, 60, 40), F.lit(120), F.lit(80)), F.lit(0.5), F.lit(0.25)))
    assert (half["width"], half["height"], half["fx"], half["fy"], half["cx"], half["cy"], half["rx"], half["ry"]) == pytest.approx((60, 20, 50, 27.5, 29.75, 9.625, pin["rx"] / 2, pin["rx"] / 4))
    for params, size in ((lits(1, 2, 3), (4, 4)), (lits(*WIDE), (1000, 10))):
        with pytest.raises(Exception, match="parameters|aspect"):
            one(camera.camera(params, F.lit(size[0]), F.lit(size[1])))


def turn(draw):
    q, _ = np.linalg.qr(draw.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def oriented_boxes(draw, n, spread, scale):
    return [(i, i % 2, [float(x) for x in draw.uniform(-spread, spread, 3)], [float(x) for x in draw.uniform(0.2, 1, 3) * scale(i)], [float(x) for x in turn(draw).ravel()]) for i in range(n)]


OBB = "det_id long, scene_id int, center array<double>, size array<double>, rotation array<double>"


def cells_shared(a, b, n):
    line = (np.arange(n) + 0.5) / n - 0.5
    grid = np.array([(x, y, z) for x in line for y in line for z in line])
    count = 0
    ra, rb = np.array(a[4]).reshape(3, 3), np.array(b[4]).reshape(3, 3)
    for g in grid:
        world = ra @ (g * np.array(a[3])) + np.array(a[2])
        count += bool((np.abs(rb.T @ (world - np.array(b[2]))) < np.array(b[3]) / 2).all())
    return count


def voxel(a, b, n):
    va, vb = np.prod(a[3]), np.prod(b[3])
    shared = (va * cells_shared(a, b, n) + vb * cells_shared(b, a, n)) / 2
    return shared / ((va + vb) * n**3 - shared)


def test_overlap_of_boxes_of_any_rotation_and_size(spark):
    draw = np.random.default_rng(2)
    boxes = oriented_boxes(draw, 60, 4, lambda i: 60 if i == 7 else 0.05 if i % 9 == 0 else 2)
    boxes[20] = (20, boxes[3][1], *boxes[3][2:])
    got = {(r["a"], r["b"]): r["iou"] for r in oriented.overlap_pairs(rows(spark, boxes, OBB), ["scene_id"], 1e-12, n=3).collect()}
    want = {(a[0], b[0]): v for a in boxes for b in boxes if a[0] < b[0] and a[1] == b[1] and (v := voxel(a, b, 3)) > 0}
    assert got == pytest.approx(want) and any(7 in k for k in want)


def test_candidates_come_once_and_none_is_missed(spark):
    draw = np.random.default_rng(3)
    boxes = oriented_boxes(draw, 80, 3, lambda i: 10.0 ** (i % 4 - 2))
    df = rows(spark, boxes, OBB)
    got = [(r["a_det_id"], r["b_det_id"]) for r in oriented.sphere_pairs(df, df, ["scene_id"]).collect()]
    near = lambda a, b: np.linalg.norm(np.subtract(a[2], b[2])) <= (np.linalg.norm(a[3]) + np.linalg.norm(b[3])) / 2
    assert sorted(got) == sorted((a[0], b[0]) for a in boxes for b in boxes if a[1] == b[1] and near(a, b))
    assert oriented.sphere_pairs(df.limit(0), df.limit(0), ["scene_id"]).count() == 0


def test_kernel_works_in_blocks(monkeypatch):
    draw = np.random.default_rng(4)
    flat = lambda b: np.array([[*x[2], *x[3], *x[4]] for x in b])
    a, b = flat(oriented_boxes(draw, 50, 1, lambda i: 2)), flat(oriented_boxes(draw, 50, 1, lambda i: 2))
    whole = oriented.voxel_iou(a, b, 6)
    monkeypatch.setattr(oriented, "KERNEL_BYTES", 6**3 * 24 * 7)
    assert (oriented.voxel_iou(a, b, 6) == whole).all() and (oriented.voxel_iou(a, a, 6) == 1).all()


def test_boxes_one_to_one(spark):
    draw = np.random.default_rng(5)
    a, b = oriented_boxes(draw, 20, 1, lambda i: 2), oriented_boxes(draw, 20, 1, lambda i: 2)
    got = {r["det_id"]: r["iou"] for r in oriented.matched_overlap(rows(spark, a, OBB), rows(spark, b, OBB), ["det_id"], n=3).collect()}
    assert got == pytest.approx({x[0]: voxel(x, y, 3) for x, y in zip(a, b)})
    for other in (b[1:], [*b, b[0]]):
        with pytest.raises(Exception, match="pair up"):
            oriented.matched_overlap(rows(spark, a, OBB), rows(spark, other, OBB), ["det_id"], n=3).collect()


def polygon_area(a, b):
    """Common area of two footprints by cutting one with each side of the other."""
    def foot(x):
        c, s = math.cos(x[6]), math.sin(x[6])
        return [(x[0] + c * u * x[3] / 2 - s * v * x[4] / 2, x[1] + s * u * x[3] / 2 + c * v * x[4] / 2) for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1))]

    shape, window = foot(a), foot(b)
    for p, q in zip(window, window[1:] + window[:1]):
        side = lambda r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])  # noqa: B023, E731
        cut = []
        for r, t in zip(shape, shape[1:] + shape[:1]):
            if side(r) >= 0:
                cut.append(r)
            if side(r) * side(t) < 0:
                f = side(r) / (side(r) - side(t))
                cut.append((r[0] + f * (t[0] - r[0]), r[1] + f * (t[1] - r[1])))
        shape = cut
        if not shape:
            return 0.0
    return sum(r[0] * t[1] - r[1] * t[0] for r, t in zip(shape, shape[1:] + shape[:1])) / 2


def test_exact_overlap_of_footprints():
    draw = np.random.default_rng(6)
    make = lambda: np.c_[draw.uniform(-1, 1, (600, 3)), draw.uniform(0.3, 2, (600, 3)), draw.uniform(-4, 4, 600)]
    a, b = make(), make()
    b[:100, 6] = a[:100, 6]  # parallel
    b[100:150] = a[100:150]  # equal
    b[150:200] = a[150:200]
    b[150:200, 3] /= 2  # one side on the other's middle line, two on its sides
    b[200:250, 6] = a[200:250, 6] + math.pi / 2
    b[250:300, :2] = a[250:300, :2] + 9  # apart
    assert spatial.footprint_overlap(a, b) == pytest.approx([polygon_area(x, y) for x, y in zip(a, b)], abs=1e-9)
    assert spatial.exact_iou(a[100:150], a[100:150]) == pytest.approx(np.ones(50), abs=1e-6)


def test_enclosed_overlap_tells_boxes_that_do_not_meet_apart(spark):
    data = [(0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, float(d), 0.0, 0.0, 1.0, 1.0, 1.0, 0.0) for d in (0, 2, 4, 8)]
    df = rows(spark, data, ", ".join(f"{p}_{c} double" for p in "ab" for c in spatial.BOX))
    got = [r["g"] for r in spatial.with_iou(df, 8).select(spatial.enclosed(F.col("iou")).alias("g")).collect()]
    side = math.sqrt(2)
    assert got[0] == pytest.approx((1 - (side * side - 1) / (side * side) + 1) / 2, abs=1e-6)
    assert got[1:] == pytest.approx([(1 - (side * (d + side) - 2) / (side * (d + side))) / 2 for d in (2, 4, 8)], abs=1e-6) and got == sorted(got, reverse=True)


@pytest.mark.parametrize("params", [(200.0, 210.0, 160.3, 119.7), FISHEYE])
@pytest.mark.parametrize("steps", [1, 4])
def test_what_a_camera_sees_of_boxes(spark, params, steps):
    draw = np.random.default_rng(7)
    size = (320, 240) if len(params) == 4 else (1280, 720)
    boxes, pose = oriented_boxes(draw, 60, 4, lambda i: 2), (turn(draw), draw.normal(size=3))
    df = rows(spark, boxes, OBB).withColumn("cam", camera.camera(lits(*params), *map(F.lit, size), F.lit(230.0 if len(params) == 4 else 700.0)))
    df = df.withColumn("pose", geometry.pose(lits(*pose[0].ravel()), lits(*pose[1])))
    seen = 0
    for row in views.with_projected_boxes(df, oriented.BOX, "cam", "pose", steps=steps).collect():
        box = boxes[row["det_id"]]
        ends = [(a, b, c) for a in (-0.5, 0.5) for b in (-0.5, 0.5) for c in (-0.5, 0.5)]
        if steps > 2:
            ends = [tuple(np.insert((a, b), axis, at)) for axis in range(3) for a in (-0.5, 0.5) for b in (-0.5, 0.5) for at in np.linspace(-0.5, 0.5, steps)]
        found = []
        for e in ends:
            p = pose[0].T @ (np.array(box[4]).reshape(3, 3) @ (np.array(e) * box[3]) + box[2] - pose[1])
            if p[2] <= 0 or p[2] <= math.cos(math.radians(70)) * np.linalg.norm(p):
                continue
            u, v = fisheye(p, params) if len(params) == 16 else (params[0] * p[0] / p[2] + params[2], params[1] * p[1] / p[2] + params[3])
            radius = row["cam"]["rx"]
            if 0 <= u <= size[0] - 1 and 0 <= v <= size[1] - 1 and math.hypot(u - params[2], v - params[3]) < radius:
                found.append((u, v))
        got = row["bb2"]
        assert got["points"] == len(found)
        if found:
            us, vs = zip(*found)
            assert (got["x_min"], got["x_max"], got["y_min"], got["y_max"]) == pytest.approx((min(us), max(us), min(vs), max(vs)), abs=1e-6)
        else:
            assert got["x_min"] is None and not got["valid"]
        assert got["valid"] == (len(found) > 1 and len(found) >= 2 * steps * (1 if steps > 2 else 1))
        seen += got["valid"]
    assert 0 < seen < 60


def test_patches_hold_the_median_of_pixel_means(spark):
    frames = rows(spark, [(1,), (2,)], "frame int").withColumn("camera", camera.camera(lits(8, 8, 3.6, 3.6), F.lit(8), F.lit(8))).withColumn("pose", geometry.pose(lits(1, 0, 0, 0, 1, 0, 0, 0, 1), lits(1e6, 0, 0)))
    at = lambda u, v, z: (1, 1e6 + (u - 3.6) / 8 * z, (v - 3.6) / 8 * z, float(z))
    points = [at(0, 0, 1), at(0.2, 0, 3), at(1, 0, 4), at(2, 1, 6), at(3, 3, 8), at(5, 1, 5), (1, 1e6, 0.0, -2.0), (3, 0.0, 0.0, 1.0)]
    got = {(r["frame"], r["patch_row"], r["patch_column"]): r["depth"] for r in views.patch_depths(rows(spark, points, "frame int, x double, y double, z double"), frames, ["frame"], 8, 8, 4).collect()}
    # pixels of the first patch: 2 (mean of 1 and 3), 4, 6, 8
    assert got == {(f, i, j): {(1, 0, 0): 4.0, (1, 0, 1): 5.0}.get((f, i, j), -1.0) for f in (1, 2) for i in (0, 1) for j in (0, 1)}
    with pytest.raises(ValueError):
        views.patch_depths(frames, frames, ["frame"], 9, 8, 4)


def test_pixels_halfway_are_those_of_plain_sums(spark):
    """Boxes that are not turned, whose points fall halfway between pixels: the digits of plain sums decide, so all are taken in their order."""
    draw = np.random.default_rng(3)
    boxes = [(i, [3.0 * int(a) + int(b) / 100, 3.0 * int(c) + int(d) / 100, 0.5 + int(e) / 100], [1 + int(f) / 50, 0.8 + int(g) / 50, 1.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for i, (a, b, c, d, e, f, g) in enumerate(zip(*[draw.integers(lo, hi, 20_000) for lo, hi in ((0, 5), (-50, 51), (2, 5), (-48, 49), (-5, 6), (0, 9), (0, 7))]))]
    eye = rows(spark, boxes, "i int, c array<double>, s array<double>, r array<double>").withColumn("camera", camera.camera(lits(200, 200, 160.3, 119.7), F.lit(320), F.lit(240))).withColumn("pose", geometry.pose(lits(1, 0, 0, 0, 0, 1, 0, -1, 0), lits(6, 4, 1)))
    met = views._seen_from(views.box_edge_points(eye, ["i", "camera", "pose"], ("c", "s", "r"), 4, "pos"), "pose", ("x", "y", "z"))
    got = camera.with_pixels(met, "camera", ("_x", "_y", "_z"), "q").where("q.valid").select("i", "pos", F.rint("q.u").alias("u"), F.rint("q.v").alias("v")).collect()
    line, want, halves = [k * 2 / 3.0 - 1 for k in range(4)], {}, 0
    grid = [tuple((a, b)[:axis] + (at,) + (a, b)[axis:]) for axis in range(3) for a in (-1, 1) for b in (-1, 1) for at in line]
    for i, (tx, ty, tz), (sx, sy, sz), _ in boxes:
        for pos, (x, y, z) in enumerate(grid):
            px, py, pz = tx + x * sx / 2 - 6, -(tz + z * sz / 2 - 1), ty + y * sy / 2 - 4
            if pz > 0:
                u, v = 200 * px / pz + 160.3, 200 * py / pz + 119.7
                want[i, pos] = (round(u), round(v))
                halves += abs(u - math.floor(u) - 0.5) < 1e-9
    assert halves > 100 and len(got) > 10_000
    assert [x for x in got if (x["u"], x["v"]) != want[x["i"], x["pos"]]] == []


def png(pixels, kinds, depth=16, colour=0, cut=None):
    """A PNG file of 16-bit grey pixels whose rows use the filters in turn."""
    high, wide = pixels.shape
    plain = pixels.astype(">u2").view(np.uint8).reshape(high, 2 * wide).astype(int)
    out = b""
    for y in range(high):
        kind, line = kinds[y % len(kinds)], []
        for x in range(2 * wide):
            left, up = plain[y, x - 2] if x > 1 else 0, plain[y - 1, x] if y else 0
            corner = plain[y - 1, x - 2] if y and x > 1 else 0
            p = left + up - corner
            guess = (0, left, up, (left + up) // 2, min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2])[kind]
            line.append((plain[y, x] - guess) % 256)
        out += bytes([kind, *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    packed = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, depth, colour, 0, 0, 0)) + chunk(b"IDAT", packed[: len(packed) // 2]) + chunk(b"IDAT", packed[len(packed) // 2 : cut]) + chunk(b"IEND", b"")


def test_depth_images(spark, tmp_path):
    draw = np.random.default_rng(8)
    pixels = draw.integers(0, 1 << 16, (7, 9)).astype(np.uint16)
    files = {"good": png(pixels, [0, 1, 2, 3, 4]), "other": png(pixels[:3], [4]), "eight": png(pixels, [0], depth=8), "cut": png(pixels, [0], cut=-9), "text": b"hello"}
    for name, data in files.items():
        (tmp_path / f"{name}.png").write_bytes(data)
    df = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_extract("path", "([a-z]+).png$", 1).alias("name"), "content").unionByName(rows(spark, [("null", None), ("nothing", b"")], "name string, content binary"))
    got = {r["name"]: r for r in views.decoded_depth(df, width=9, height=7).collect()}
    assert set(got) == {*files, "null", "nothing"} and got["good"]["fault"] is None
    assert got["good"]["depth"] == pytest.approx((pixels.astype(np.float32) / 1000).ravel().tolist()) and (got["good"]["width"], got["good"]["height"]) == (9, 7)
    assert all(got[n]["fault"] and got[n]["depth"] is None for n in got if n != "good")


def test_points_from_depth(spark):
    draw = np.random.default_rng(9)
    depth = np.where(draw.random((40, 60)) < 0.7, draw.uniform(0.5, 4, (40, 60)), 0.0)
    df = rows(spark, [(1, depth.ravel().tolist()), (2, [0.0] * 2400)], "frame int, depth array<double>").selectExpr("*", "60 as width", "40 as height", "50D as fx", "55D as fy", "30D as cx", "20D as cy").withColumn("pose", geometry.pose(lits(0, -1, 0, 1, 0, 0, 0, 0, 1), lits(1, 2, 3)))
    known = {(round(1 - (v - 20) / 55 * z, 9), round(2 + (u - 30) / 50 * z, 9), round(3 + z, 9)) for v in range(40) for u in range(60) if (z := depth[v, u]) > 0}
    for wanted, count in ((5000, len(known)), (300, None), (50, 50)):
        got = [(round(r["x"], 9), round(r["y"], 9), round(r["z"], 9)) for r in views.depth_points(df, ["frame"], wanted).collect()]
        step = max(1, int(math.sqrt(2400 / (2 * wanted))))
        strided = sum(depth[v, u] > 0 for v in range(0, 40, step) for u in range(0, 60, step))
        assert len(got) == min(wanted, strided) and set(got) <= known and (count is None or len(got) == count)
        assert sorted(got) == sorted((round(r["x"], 9), round(r["y"], 9), round(r["z"], 9)) for r in views.depth_points(df.repartition(3), ["frame"], wanted).collect())


def test_usable_poses(spark):
    data = [(0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1e-9, 0.0, 0.0, 0.0), (math.nan, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (math.inf, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)]
    df = rows(spark, data, "a double, b double, c double, w double, x double, y double, z double")
    assert [r["ok"] for r in df.select(views.usable_pose(*map(F.col, df.columns)).alias("ok")).collect()] == [True, False, False, False, False]
