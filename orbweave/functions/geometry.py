"""Geometry as column expressions: rotations, rigid poses, oriented boxes.

Vectors are array<double> of 3, rotations array<double> of 9 (row by row), poses struct<r, t>. Everything here stays in
the JVM. Angles are radians.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """Evaluate each argument once, however often the function's expression names it: else nested calls multiply it."""

    @wraps(f)
    def call(*args: Column) -> Column:
        held = F.array(F.struct(*[a.alias(f"_{i}") for i, a in enumerate(args)]))
        return F.get(F.transform(held, lambda x: f(*[x[f"_{i}"] for i in range(len(args))])), F.lit(0))

    return call


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def vec(*xs) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in xs])


def _sum(xs) -> Column:
    return reduce(lambda a, b: a + b, xs)


def dot(a: Column, b: Column, n: int = 3) -> Column:
    return _sum(a[i] * b[i] for i in range(n))


@bound
def cross(a: Column, b: Column) -> Column:
    return vec(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Column, n: int = 3) -> Column:
    return F.sqrt(dot(a, a, n))


@bound
def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    return let(norm(a), lambda n: F.when(n > 0, vec(*[a[i] / n for i in range(3)])).otherwise(a))


@bound
def reject(a: Column, b: Column) -> Column:
    """The part of ``a`` that is at right angles to ``b``."""
    return let(dot(a, b) / dot(b, b), lambda s: vec(*[a[i] - s * b[i] for i in range(3)]))


# -- rotations -----------------------------------------------------------------------------------------------------------


@bound
def matmul(a: Column, b: Column) -> Column:
    return vec(*[_sum(a[3 * i + k] * b[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)])


@bound
def transpose(r: Column) -> Column:
    return vec(*[r[3 * j + i] for i in range(3) for j in range(3)])


@bound
def rotate(r: Column, v: Column) -> Column:
    return vec(*[_sum(r[3 * i + k] * v[k] for k in range(3)) for i in range(3)])


@bound
def rotation_of_quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Rotation of a quaternion of any length; the identity for a zero one."""
    n = w * w + x * x + y * y + z * z
    s = F.when(n > 0, 2.0 / n).otherwise(0.0)
    return vec(
        1 - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y),
        s * (x * y + w * z), 1 - s * (x * x + z * z), s * (y * z - w * x),
        s * (x * z - w * y), s * (y * z + w * x), 1 - s * (x * x + y * y),
    )


@bound
def quaternion_of_rotation(r: Column) -> Column:
    """Unit quaternion (w, x, y, z) with w >= 0, by the largest of its four parts."""
    m = lambda i, j: r[3 * i + j]
    trace = m(0, 0) + m(1, 1) + m(2, 2)
    squares = vec(1 + trace, 1 + m(0, 0) - m(1, 1) - m(2, 2), 1 - m(0, 0) + m(1, 1) - m(2, 2), 1 - m(0, 0) - m(1, 1) + m(2, 2))
    a, b, c = m(2, 1) - m(1, 2), m(0, 2) - m(2, 0), m(1, 0) - m(0, 1)
    ab, ac, bc = m(0, 1) + m(1, 0), m(0, 2) + m(2, 0), m(1, 2) + m(2, 1)

    def by_largest(h: Column) -> Column:
        w, x, y, z = (h[i] for i in range(4))
        most = F.array_max(h)
        return (
            F.when(w >= most, vec(w, a / (4 * w), b / (4 * w), c / (4 * w)))
            .when(x >= most, vec(a / (4 * x), x, ab / (4 * x), ac / (4 * x)))
            .when(y >= most, vec(b / (4 * y), ab / (4 * y), y, bc / (4 * y)))
            .otherwise(vec(c / (4 * z), ac / (4 * z), bc / (4 * z), z))
        )

    halves = F.transform(squares, lambda v: F.sqrt(F.greatest(v, F.lit(0.0))) / 2)
    return let(let(halves, by_largest), lambda q: F.when(q[0] < 0, F.transform(q, lambda v: -v)).otherwise(q))


@bound
def rotation_of_euler(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Yaw about z after pitch about y after roll about x."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return vec(cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr)


@bound
def euler_of_rotation(r: Column) -> Column:
    """(roll, pitch, yaw)."""
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -r[6])))
    return vec(F.atan2(r[7], r[8]), pitch, F.atan2(r[3], r[0]))


def yaw_of_rotation(r: Column) -> Column:
    return F.atan2(r[3], r[0])


@bound
def rotation_angle(r: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (r[0] + r[4] + r[8] - 1) / 2)))


def geodesic(a: Column, b: Column) -> Column:
    """Angle of the rotation that leads from one rotation to another."""
    return rotation_angle(matmul(transpose(a), b))


@bound
def so3_exp(v: Column) -> Column:
    """Rotation by the length of ``v`` about ``v``; a series near zero."""
    x, y, z = v[0], v[1], v[2]

    def rows(k: Column) -> Column:
        a, b = k[0], k[1]
        return vec(1 - b * (y * y + z * z), b * x * y - a * z, b * x * z + a * y, b * x * y + a * z, 1 - b * (x * x + z * z), b * y * z - a * x, b * x * z - a * y, b * y * z + a * x, 1 - b * (x * x + y * y))

    def factors(t2: Column) -> Column:
        t = F.sqrt(t2)
        return vec(F.when(t2 < 1e-8, 1 - t2 / 6).otherwise(F.sin(t) / t), F.when(t2 < 1e-8, 0.5 - t2 / 24).otherwise((1 - F.cos(t)) / t2))

    return let(let(dot(v, v), factors), rows)


@bound
def so3_log(r: Column) -> Column:
    """The vector whose ``so3_exp`` is the rotation."""

    def vector(q: Column) -> Column:
        s = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
        scale = let(s, lambda n: F.when(n < 1e-9, F.lit(2.0)).otherwise(2 * F.atan2(n, q[0]) / n))
        return let(scale, lambda k: vec(k * q[1], k * q[2], k * q[3]))

    return let(quaternion_of_rotation(r), vector)


@bound
def slerp(a: Column, b: Column, alpha: Column) -> Column:
    """Between unit quaternions along the shorter arc; linear where they nearly agree."""

    def shares(d: Column) -> Column:
        sign = F.when(d < 0, -1.0).otherwise(1.0)
        angle = F.acos(F.least(F.abs(d), F.lit(1.0)))
        near = F.abs(d) > 0.9995
        return vec(F.when(near, 1 - alpha).otherwise(F.sin((1 - alpha) * angle) / F.sin(angle)), F.when(near, alpha).otherwise(F.sin(alpha * angle) / F.sin(angle)) * sign)

    mixed = let(let(dot(a, b, 4), shares), lambda k: vec(*[k[0] * a[i] + k[1] * b[i] for i in range(4)]))
    return let(mixed, lambda q: let(norm(q, 4), lambda n: vec(*[q[i] / n for i in range(4)])))


def rotation_of_6d(a: Column, b: Column) -> Column:
    """Rotation whose first column is along ``a`` and whose second is along the part of ``b`` that is at right angles to it."""
    x = unit(a)
    z = unit(cross(x, unit(b)))
    return transpose(F.concat(x, cross(z, x), z))


def stereographic_unprojected(a: Column, n: int, axis: int) -> Column:
    """The point of the unit sphere in n + 1 dimensions that a point of n dimensions is the projection of, from the pole of an axis."""

    @bound
    def out(a: Column) -> Column:
        def placed(s2: Column) -> Column:
            parts = [2 * a[i] / (s2 + 1) for i in range(n)]
            return vec(*parts[:axis], (s2 - 1) / (s2 + 1), *parts[axis:])

        return let(dot(a, a, n), placed)

    return out(a)


@bound
def rotation_of_5d(v: Column) -> Column:
    """Rotation of five numbers: two, and three that stand for four by a stereographic projection, make the six of ``rotation_of_6d``.

    The scales, fixed values, bring the numbers near 1 where the rotation is near none.
    """
    scales = (math.sqrt(2) + 1, math.sqrt(2) + 1, math.sqrt(2))

    def filled(u: Column) -> Column:
        return let(norm(vec(u[1], u[2], u[3])), lambda n: rotation_of_6d(vec(v[0], v[1], u[0] / n), vec(u[1] / n, u[2] / n, u[3] / n)))

    return let(stereographic_unprojected(vec(*[v[2 + i] * s for i, s in enumerate(scales)]), 3, 0), filled)


def gravity_aligned(view: Column, gravity: Column) -> Column:
    """Columns of a frame whose z axis is opposed to gravity and whose x axis is the view's horizontal part."""
    z = unit(F.transform(gravity, lambda v: -v))
    x = unit(reject(view, z))
    y = cross(z, x)
    return transpose(F.concat(x, y, z))


# -- poses ---------------------------------------------------------------------------------------------------------------


def pose(r: Column, t: Column) -> Column:
    return F.struct(r.alias("r"), t.alias("t"))


@bound
def pose_inverse(p: Column) -> Column:
    return let(transpose(p["r"]), lambda back: pose(back, F.transform(rotate(back, p["t"]), lambda v: -v)))


@bound
def pose_compose(a: Column, b: Column) -> Column:
    """First ``b``, then ``a``."""
    return pose(matmul(a["r"], b["r"]), pose_apply(a, b["t"]))


@bound
def pose_apply(p: Column, v: Column) -> Column:
    return F.zip_with(rotate(p["r"], v), p["t"], lambda x, y: x + y)


def skew(v: Column) -> Column:
    """The matrix whose product with a vector is the cross product."""
    zero = F.lit(0.0)
    return vec(zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero)


@bound
def _turn_factors(w: Column) -> Column:
    """(1 - cos t) / t^2 and (t - sin t) / t^3 for a rotation by t; series near zero."""
    def parts(t2: Column) -> Column:
        t = F.sqrt(t2)
        return vec(F.when(t2 < 1e-8, 0.5 - t2 / 24).otherwise((1 - F.cos(t)) / t2), F.when(t2 < 1e-8, 1.0 / 6 - t2 / 120).otherwise((t - F.sin(t)) / (t2 * t)))

    return let(dot(w, w), parts)


@bound
def _screw(w: Column, u: Column) -> Column:
    """Where a steady turn by ``w`` takes a body that moves by ``u`` in its own frame."""
    def moved(k: Column) -> Column:
        once = cross(w, u)
        return let(once, lambda c: let(cross(w, c), lambda d: vec(*[u[i] + k[0] * c[i] + k[1] * d[i] for i in range(3)])))

    return let(_turn_factors(w), moved)


@bound
def _unscrewed(w: Column, t: Column) -> Column:
    """The ``u`` that ``_screw`` takes to ``t``."""
    def share(t2: Column) -> Column:
        half = F.sqrt(t2) / 2
        return F.when(t2 < 1e-8, 1.0 / 12 + t2 / 720).otherwise((1 - half * F.cos(half) / F.sin(half)) / t2)

    def moved(k: Column) -> Column:
        return let(cross(w, t), lambda c: let(cross(w, c), lambda d: vec(*[t[i] - 0.5 * c[i] + k * d[i] for i in range(3)])))

    return let(let(dot(w, w), share), moved)


@bound
def se3_exp(w: Column, u: Column) -> Column:
    """The pose that a turn ``w`` and a move ``u``, both steady and in the body's frame, lead to."""
    return pose(so3_exp(w), _screw(w, u))


@bound
def se3_log(p: Column) -> Column:
    """struct<w, u> whose ``se3_exp`` is the pose."""
    return let(so3_log(p["r"]), lambda w: F.struct(w.alias("w"), _unscrewed(w, p["t"]).alias("u")))


@bound
def pose_between(a: Column, b: Column, alpha: Column) -> Column:
    """On the steady screw motion from pose ``a`` (alpha 0) to ``b`` (alpha 1)."""
    scaled = lambda v: F.transform(v, lambda x: x * alpha)
    way = let(pose_compose(pose_inverse(a), b), se3_log)
    return let(let(way, lambda g: se3_exp(scaled(g["w"]), scaled(g["u"]))), lambda g: pose_compose(a, g))


@bound
def average_pose(a: Column, b: Column) -> Column:
    """Half way between two poses: rotations along the shorter arc, places along the line."""
    turn = let(slerp(quaternion_of_rotation(a["r"]), quaternion_of_rotation(b["r"]), F.lit(0.5)), lambda q: rotation_of_quaternion(q[0], q[1], q[2], q[3]))
    return pose(turn, F.zip_with(a["t"], b["t"], lambda x, y: (x + y) / 2))


# -- angles --------------------------------------------------------------------------------------------------------------


def wrap_angle(a: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def half_turn_distance(a: Column, b: Column) -> Column:
    """Distance of directions that are the same after half a turn: 0 to pi / 2."""
    d = F.abs(wrap_angle(a - b))
    return F.when(d > math.pi / 2, math.pi - d).otherwise(d)


# -- boxes ---------------------------------------------------------------------------------------------------------------


def box_volume(sx: Column, sy: Column, sz: Column) -> Column:
    return sx * sy * sz


def box_diagonal(sx: Column, sy: Column, sz: Column) -> Column:
    return F.sqrt(sx * sx + sy * sy + sz * sz)


@bound
def box_corners(center: Column, size: Column, r: Column) -> Column:
    """The eight corners, as an array of vectors: x varies slowest, z fastest."""
    def corner(i: int) -> Column:
        signs = [1 if i >> b & 1 else -1 for b in (2, 1, 0)]
        return F.zip_with(rotate(r, vec(*[size[k] * (s / 2) for k, s in enumerate(signs)])), center, lambda x, y: x + y)

    return F.array(*[corner(i) for i in range(8)])


def box_bounds(tx: Column, ty: Column, tz: Column, sx: Column, sy: Column, sz: Column, yaw: Column) -> dict[str, Column]:
    """Axis-aligned bounds of a box that is turned about z only."""
    c, s = F.abs(F.cos(yaw)), F.abs(F.sin(yaw))
    hx, hy, hz = (sx * c + sy * s) / 2, (sx * s + sy * c) / 2, sz / 2
    return {"min_x": tx - hx, "max_x": tx + hx, "min_y": ty - hy, "max_y": ty + hy, "min_z": tz - hz, "max_z": tz + hz}


def inside_yaw_box(px: Column, py: Column, pz: Column, tx: Column, ty: Column, tz: Column, sx: Column, sy: Column, sz: Column, yaw: Column) -> Column:
    """Strictly inside a box that is turned about z only."""
    c, s = F.cos(yaw), F.sin(yaw)
    dx, dy = px - tx, py - ty
    return (F.abs(c * dx + s * dy) < sx / 2) & (F.abs(c * dy - s * dx) < sy / 2) & (F.abs(pz - tz) < sz / 2)


def voxel_centres(low: Column, high: Column, n: int) -> Column:
    """Centres of n equal cells along an axis."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * (i + 0.5) / n)


def area_xyxy(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def iou_xyxy(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap of two axis-aligned rectangles over their union; 0 where the union is empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = area_xyxy(*a) + area_xyxy(*b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def xyxy_of_cxcywh(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Corners in pixels of a box given as shares of the image, clipped to it."""
    clip = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    return [clip((cx - w / 2) * width, width), clip((cy - h / 2) * height, height), clip((cx + w / 2) * width, width), clip((cy + h / 2) * height, height)]


def plucker(origin: Column, direction: Column) -> Column:
    """Ray coordinates: unit direction, then moment."""
    d = unit(direction)
    return F.concat(d, cross(origin, d))
