"""Camera models as column expressions: pinhole and the fisheye model with radial, tangential and thin-prism terms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import bound, let, vec

#: Depths nearer to zero than this are moved away from it, keeping the sign.
NEAR = 1e-9


@bound
def pinhole_project(p: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    z = F.when(F.abs(p[2]) < NEAR, F.when(p[2] < 0, -NEAR).otherwise(NEAR)).otherwise(p[2])
    return vec(fx * p[0] / z + cx, fy * p[1] / z + cy)


def pinhole_ray(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    return vec((u - cx) / fx, (v - cy) / fy, F.lit(1.0))


@bound
def fisheye_project(p: Column, fx: Column, fy: Column, cx: Column, cy: Column, k: Column, t: Column, s: Column) -> Column:
    """``k``: six radial coefficients of the angle, ``t``: two tangential, ``s``: four thin-prism."""
    z = F.when(F.abs(p[2]) < NEAR, F.when(p[2] < 0, -NEAR).otherwise(NEAR)).otherwise(p[2])

    def bent(ab: Column) -> Column:
        r = F.sqrt(ab[0] * ab[0] + ab[1] * ab[1])

        def scale(theta: Column) -> Column:
            t2 = theta * theta
            poly = 1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * (k[3] + t2 * (k[4] + t2 * k[5])))))
            return F.when(r < 1e-12, F.lit(1.0)).otherwise(theta * poly / r)

        return let(let(F.atan(r), scale), lambda m: vec(ab[0] * m, ab[1] * m))

    def shifted(xy: Column) -> Column:
        x, y = xy[0], xy[1]
        r2 = x * x + y * y
        u = x + 2 * x * (t[0] * x + t[1] * y) + t[0] * r2 + s[0] * r2 + s[1] * r2 * r2
        v = y + 2 * y * (t[0] * x + t[1] * y) + t[1] * r2 + s[2] * r2 + s[3] * r2 * r2
        return vec(fx * u + cx, fy * v + cy)

    return let(let(let(z, lambda z: vec(p[0] / z, p[1] / z)), bent), shifted)


#: Newton steps of each of the two iterations of ``fisheye_unproject``.
STEPS = 8
#: Slopes nearer to zero than this are not divided by.
FLAT = 1e-6


def fisheye_unproject(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column, k: Column, t: Column, s: Column, steps: int = STEPS) -> Column:
    """The ray (x, y, 1) that ``fisheye_project`` takes to a pixel.

    Two iterations of Newton's, a fixed number of steps each, folded over a sequence: one undoes the tangential and
    thin-prism terms (two unknowns), the other finds the angle whose polynomial is the length that is left. Inside the
    radius in which the model is monotonic, eight steps leave an error near that of the arithmetic.
    """
    rounds = F.sequence(F.lit(1), F.lit(steps))

    def nearer(at: Column, goal: Column, t: Column, s: Column) -> Column:
        """One step towards the point that the terms shift to ``goal``."""
        x, y = at[0], at[1]

        def step(h: Column) -> Column:
            r2, along, bend0, bend1 = h[0], h[1], h[2], h[3]
            missing0 = goal[0] - (x + 2 * x * along + t[0] * r2 + s[0] * r2 + s[1] * r2 * r2)
            missing1 = goal[1] - (y + 2 * y * along + t[1] * r2 + s[2] * r2 + s[3] * r2 * r2)
            a, b = 1 + 2 * along + 4 * x * t[0] + 2 * x * bend0, 2 * x * t[1] + 2 * y * t[0] + 2 * y * bend0
            c, d = 2 * y * t[0] + 2 * x * t[1] + 2 * x * bend1, 1 + 2 * along + 4 * y * t[1] + 2 * y * bend1
            return let(vec(missing0, missing1, a, b, c, d), lambda m: let(m[2] * m[5] - m[3] * m[4], lambda det: vec(x + (m[5] * m[0] - m[3] * m[1]) / det, y + (m[2] * m[1] - m[4] * m[0]) / det)))

        return let(let(x * x + y * y, lambda r2: vec(r2, t[0] * x + t[1] * y, s[0] + 2 * s[1] * r2, s[2] + 2 * s[3] * r2)), step)

    def wider(angle: Column, length: Column, k: Column) -> Column:
        def step(a2: Column) -> Column:
            value, slope = F.lit(0.0), F.lit(0.0)
            for i in reversed(range(6)):
                value, slope = a2 * (k[i] + value), a2 * ((2 * i + 3) * k[i] + slope)
            slope = 1 + slope
            return angle - F.when(F.abs(slope) > FLAT, (angle * (1 + value) - length) / slope).otherwise(F.lit(0.0))

        return let(angle * angle, step)

    @bound
    def ray(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column, k: Column, t: Column, s: Column) -> Column:
        def straight(xy: Column) -> Column:
            def scaled(length: Column) -> Column:
                angle = F.aggregate(rounds, length, lambda a, _: wider(a, length, k))
                return F.when(length < 1e-12, F.lit(1.0)).otherwise(F.tan(angle) / length)

            return let(let(F.sqrt(xy[0] * xy[0] + xy[1] * xy[1]), scaled), lambda m: vec(xy[0] * m, xy[1] * m, F.lit(1.0)))

        goal = vec((u - cx) / fx, (v - cy) / fy)
        return let(let(goal, lambda g: F.aggregate(rounds, g, lambda at, _: nearer(at, g, t, s))), straight)

    return ray(u, v, fx, fy, cx, cy, k, t, s)


def in_image(u: Column, v: Column, width: Column, height: Column) -> Column:
    return (u >= 0) & (u <= width - 1) & (v >= 0) & (v <= height - 1)


def in_radius(u: Column, v: Column, cx: Column, cy: Column, rx: Column, ry: Column) -> Column:
    return ((u - cx) / rx) ** 2 + ((v - cy) / ry) ** 2 < 1


def in_view(p: Column, degrees: float = 140.0) -> Column:
    """Whether a point lies within the cone of so many degrees about the optical axis."""
    n = F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])
    return F.when(n > 0, p[2] / n > F.cos(F.radians(F.lit(degrees / 2)))).otherwise(False)


def scaled(fx: Column, fy: Column, cx: Column, cy: Column, sx: Column, sy: Column) -> list[Column]:
    """Intrinsics of the image resized by two factors; pixel centres are at whole numbers."""
    return [fx * sx, fy * sy, (cx + 0.5) * sx - 0.5, (cy + 0.5) * sy - 0.5]


def cropped(fx: Column, fy: Column, cx: Column, cy: Column, left: Column, top: Column) -> list[Column]:
    return [fx, fy, cx - left, cy - top]


def turned_right(fx: Column, fy: Column, cx: Column, cy: Column, height: Column) -> list[Column]:
    """Intrinsics of the image turned by a right angle clockwise."""
    return [fy, fx, height - 1 - cy, cx]


# -- whole cameras -------------------------------------------------------------------------------------------------------

#: A radius that bounds nothing.
NO_RADIUS = 99999.0
#: Valid radius as a share of the height for fisheye images of an aspect (height to width): fixed values of the devices.
RADIUS_OF_ASPECT = ((1.0, 1415.0 / 2880), (480.0 / 640, 330.0 / 480), (240.0 / 640, 330.0 / 480))


def _valid_radius(pinhole: Column, width: Column, height: Column, radius: Column) -> Column:
    """The radius given, if it fits the image; else half the diagonal and a pixel, or for a fisheye what its aspect tells."""
    by_aspect = F.raise_error(F.lit("no valid radius is known for a fisheye image of this aspect")).cast("double")
    for aspect, share in RADIUS_OF_ASPECT:
        by_aspect = F.when(F.abs(height / width - aspect) < 1e-6, share * height).otherwise(by_aspect)
    half = F.sqrt((width / 2) ** 2 + (height / 2) ** 2) + 1
    return F.when((radius <= height) & (radius <= width), radius).when(pinhole, half).otherwise(by_aspect)


def camera(params: Column, width: Column, height: Column, radius: Column | None = None) -> Column:
    """A camera as a struct; the number of ``params`` tells the model.

    4: pinhole (fx, fy, cx, cy). 15 or 16: fisheye with one focal length or two, then the centre, six radial, two
    tangential and four thin-prism terms. Any other number is an error. Without ``radius`` see ``_valid_radius``.
    """

    @bound
    def built(p: Column, width: Column, height: Column, radius: Column) -> Column:
        n = F.size(p)
        known = F.when(n.isin(4, 15, 16), n).otherwise(F.raise_error(F.concat(F.lit("a camera has 4, 15 or 16 parameters, not "), n.cast("string"))).cast("int"))

        def fields(n: Column) -> Column:
            one = F.when(n == 15, 1).otherwise(0)  # places that a single focal length saves
            at = lambda i: F.get(p, F.lit(i) - one)
            part = lambda first, count: F.when(n > 4, F.slice(p, F.lit(first + 1) - one, F.lit(count))).otherwise(F.array_repeat(F.lit(0.0), count))
            rad = _valid_radius(n == 4, width, height, radius)
            named = {"pinhole": n == 4, "width": width, "height": height, "fx": F.get(p, F.lit(0)), "fy": at(1), "cx": at(2), "cy": at(3), "rx": rad, "ry": rad, "k": part(4, 6), "t": part(10, 2), "s": part(12, 4)}
            return F.struct(*[c.alias(name) for name, c in named.items()])

        return let(known, fields)

    wide = lambda c: c.cast("double")
    return built(params, wide(width), wide(height), wide(F.lit(NO_RADIUS) if radius is None else radius))


def resized_camera(cam: Column, sx: Column, sy: Column) -> Column:
    """The camera of the image resized by two factors."""

    @bound
    def out(c: Column, sx: Column, sy: Column) -> Column:
        fx, fy, cx, cy = scaled(c["fx"], c["fy"], c["cx"], c["cy"], sx, sy)
        new = {"width": c["width"] * sx, "height": c["height"] * sy, "fx": fx, "fy": fy, "cx": cx, "cy": cy, "rx": c["rx"] * sx, "ry": c["ry"] * sy}
        return F.struct(*[new.get(n, c[n]).alias(n) for n in ("pinhole", "width", "height", "fx", "fy", "cx", "cy", "rx", "ry", "k", "t", "s")])

    return out(cam, sx, sy)


def _seen(cam: Column, u: Column, v: Column) -> Column:
    return in_image(u, v, cam["width"], cam["height"]) & in_radius(u, v, cam["cx"], cam["cy"], cam["rx"], cam["ry"])


def project(cam: Column, p: Column, degrees: float | None = 140.0) -> Column:
    """struct<u, v, valid>: where a camera sees a point of its frame. Valid: in the image, within the radius, in front and,
    unless ``degrees`` is None, in the cone about the axis. For tables of points ``with_pixels`` is much faster."""

    @bound
    def out(c: Column, p: Column) -> Column:
        own = [c[n] for n in ("fx", "fy", "cx", "cy")]
        uv = F.when(c["pinhole"], pinhole_project(p, *own)).otherwise(fisheye_project(p, *own, c["k"], c["t"], c["s"]))

        def judged(q: Column) -> Column:
            valid = _seen(c, q[0], q[1]) & (p[2] > 0)
            return F.struct(q[0].alias("u"), q[1].alias("v"), F.coalesce(valid & in_view(p, degrees) if degrees else valid, F.lit(False)).alias("valid"))

        return let(uv, judged)

    return out(cam, p)


def unproject(cam: Column, u: Column, v: Column) -> Column:
    """struct<ray, valid>: the ray through a pixel, and whether the pixel is in the image and within the radius."""

    @bound
    def out(c: Column, u: Column, v: Column) -> Column:
        own = [c[n] for n in ("fx", "fy", "cx", "cy")]
        ray = F.when(c["pinhole"], pinhole_ray(u, v, *own)).otherwise(fisheye_unproject(u, v, *own, c["k"], c["t"], c["s"]))
        return F.struct(ray.alias("ray"), _seen(c, u, v).alias("valid"))

    return out(cam, u.cast("double"), v.cast("double"))


#: A camera as a row of numbers, for the kernel below.
_NUMBERS = ("pinhole", "width", "height", "fx", "fy", "cx", "cy", "rx", "ry")


def numbers(cam: Column) -> list[Column]:
    """The fields of a camera as columns of doubles."""
    lists = [F.get(cam[n], F.lit(i)) for n, k in (("k", 6), ("t", 2), ("s", 4)) for i in range(k)]
    return [*[cam[n].cast("double") for n in _NUMBERS], *lists]


def seen_pixels(points: np.ndarray, cams: np.ndarray, degrees: float | None = 140.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``project`` gives, for n points (rows, n, 3) of each of many cameras (rows of ``numbers``) at once."""
    flat, width, height, fx, fy, cx, cy, rx, ry = (cams[:, i : i + 1] for i in range(len(_NUMBERS)))
    k, t, s = cams[:, 9:15], cams[:, 15:17], cams[:, 17:21]
    x, y, depth = points[..., 0], points[..., 1], points[..., 2]
    z = np.where(np.abs(depth) < NEAR, np.where(depth < 0, -NEAR, NEAR), depth)
    a, b = x / z, y / z
    wide = flat[:, 0] == 0
    if wide.any():
        p, q = a[wide], b[wide]
        r = np.hypot(p, q)
        angle = np.arctan(r)
        h2, poly = angle * angle, 0.0
        for i in reversed(range(6)):
            poly = h2 * (k[wide, i : i + 1] + poly)
        m = np.where(r < 1e-12, 1.0, angle * (1 + poly) / np.where(r < 1e-12, 1.0, r))
        p, q = p * m, q * m
        r2, along = p * p + q * q, 2 * (t[wide, :1] * p + t[wide, 1:] * q)
        a[wide] = p * (1 + along) + t[wide, :1] * r2 + r2 * (s[wide, :1] + s[wide, 1:2] * r2)
        b[wide] = q * (1 + along) + t[wide, 1:] * r2 + r2 * (s[wide, 2:3] + s[wide, 3:] * r2)
    tall = flat != 0  # a pinhole's focal length is taken before the division, as ``pinhole_project`` has it: halves of pixels stay halves
    u, v = np.where(tall, fx * x / z, fx * a) + cx, np.where(tall, fy * y / z, fy * b) + cy
    valid = (u >= 0) & (u <= width - 1) & (v >= 0) & (v <= height - 1) & (((u - cx) / rx) ** 2 + ((v - cy) / ry) ** 2 < 1) & (depth > 0)
    if degrees:
        valid &= depth > math.cos(math.radians(degrees / 2)) * np.sqrt(x * x + y * y + depth * depth)
    return u, v, valid


def with_pixels(df: DataFrame, cam: str, point: tuple[str, str, str], name: str, degrees: float | None = 140.0) -> DataFrame:
    """Add struct<u, v, valid> as ``project`` has it for the points in three columns, in Arrow batches.

    As one expression for each row the same takes some 20 microseconds a point: the JVM does not compile methods that long.
    """

    @F.pandas_udf("u double, v double, valid boolean")
    def seen(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in parts:
            values = np.stack([c.to_numpy(float) for c in columns], 1)
            u, v, valid = seen_pixels(values[:, None, :3], values[:, 3:], degrees)
            yield pd.DataFrame({"u": u[:, 0], "v": v[:, 0], "valid": valid[:, 0]})

    return df.withColumn(name, seen(*[F.col(c) for c in point], *numbers(F.col(cam))))
