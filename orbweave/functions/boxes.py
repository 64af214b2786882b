"""Points, grids and image edits of boxes as column expressions; boxes fitted to groups of points.

Vectors, rotations and poses are as in ``geometry``. Boxes in an image are array<double> (x_min, x_max, y_min, y_max), as
the 2D tables store them. Null boxes give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import bound, let, matmul, rotate, transpose, vec

#: Yaws that ``fit_boxes`` tries between no turn and half a turn, both included.
FITTED_YAWS = 20
#: A box in an image that was never seen has this in all four places.
UNSEEN = -1.0


def linspace(start: Column, end: Column, steps: int) -> Column:
    """``steps`` vectors from one to another at equal distances, both included; a single one is the start."""
    share = lambda i: i / max(1, steps - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.zip_with(start, end, lambda a, b: a * (1 - share(i)) + b * share(i)))


def _placed(center: Column, r: Column, v: Column) -> Column:
    return F.zip_with(rotate(r, v), center, lambda a, b: a + b)


def edge_points(center: Column, size: Column, r: Column, steps: int) -> Column:
    """``steps`` points on each of the twelve edges, ends included: edges along x first, then y, then z."""

    @bound
    def points(center: Column, size: Column, r: Column) -> Column:
        edges = []
        for axis in range(3):
            for i in range(4):
                signs = [1.0 if i & 2 else -1.0, 1.0 if i & 1 else -1.0]
                ends = [signs[:axis] + [way] + signs[axis:] for way in (-1.0, 1.0)]
                edges.append(linspace(*[_placed(center, r, vec(*[size[k] * (s / 2) for k, s in enumerate(end)])) for end in ends], steps))
        return F.concat(*edges)

    return points(center, size, r)


def voxel_grid(center: Column, size: Column, r: Column, nx: int, ny: int, nz: int) -> Column:
    """Centres of the cells of a box cut along all three axes; x varies slowest, z fastest."""

    @bound
    def points(center: Column, size: Column, r: Column) -> Column:
        def cell(i: Column) -> Column:
            at = [F.floor(i / (ny * nz)), F.floor(i / nz) % ny, i % nz]
            return _placed(center, r, vec(*[size[k] * ((at[k] + 0.5) / n - 0.5) for k, n in enumerate((nx, ny, nz))]))

        return F.transform(F.sequence(F.lit(0), F.lit(nx * ny * nz - 1)), cell)

    return points(center, size, r)


@bound
def recentred(p: Column, low: Column, high: Column) -> Column:
    """struct<r, t, low, high>: the same box in a frame whose origin is the box's centre."""
    half = F.zip_with(low, high, lambda a, b: (b - a) / 2)
    middle = F.zip_with(low, high, lambda a, b: (a + b) / 2)
    return F.struct(p["r"].alias("r"), _placed(p["t"], p["r"], middle).alias("t"), F.transform(half, lambda x: -x).alias("low"), half.alias("high"))


#: Steps of ``nearest_rotation``; each squares the error.
ROTATION_STEPS = 5


@bound
def nearest_rotation(m: Column) -> Column:
    """The rotation nearest to a matrix that is nearly one, by Newton-Schulz steps: each takes x to x (3 - x'x) / 2, which
    brings all singular values nearer to 1 and leaves the singular vectors alone."""

    def step(x: Column) -> Column:
        three = [3.0 if i % 4 == 0 else 0.0 for i in range(9)]
        return matmul(x, let(matmul(transpose(x), x), lambda y: vec(*[(three[i] - y[i]) / 2 for i in range(9)])))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROTATION_STEPS)), m, lambda x, _: step(x))


# -- boxes in images -----------------------------------------------------------------------------------------------------


@bound
def scaled_bb2(b: Column, sx: Column, sy: Column) -> Column:
    """After the image was resized by two factors; an unseen box stays as it is."""
    seen = F.exists(b, lambda x: x != UNSEEN)
    return F.when(seen, vec(b[0] * sx, b[1] * sx, b[2] * sy, b[3] * sy)).otherwise(b)


@bound
def cropped_bb2(b: Column, left: Column, top: Column) -> Column:
    """After the image was cut off left and above."""
    return vec(b[0] - left, b[1] - left, b[2] - top, b[3] - top)


@bound
def turned_bb2(b: Column, height: Column) -> Column:
    """After an image of so many rows was turned by a right angle clockwise; places that were negative stay as they are."""
    return F.zip_with(b, vec(height - b[3] - 1, height - b[2] - 1, b[0], b[1]), lambda old, new: F.when(old < 0, old).otherwise(new))


def fitted_panel(width: Column, height: Column, panel_width: int, aspect: float = 16 / 9) -> Column:
    """struct<width, height, left, top>: where an image lies, as large as it fits, in the middle of a panel of an aspect."""
    panel_height = max(1, round(panel_width / aspect))

    @bound
    def placed(w: Column, h: Column) -> Column:
        def sized(scale: Column) -> Column:
            whole = lambda x: F.greatest(F.lit(1), F.bround(x).cast("int"))
            return F.struct(whole(w * scale).alias("w"), whole(h * scale).alias("h"))

        scale = F.least(F.lit(float(panel_width)) / F.greatest(w, F.lit(1)), F.lit(float(panel_height)) / F.greatest(h, F.lit(1)))
        left = lambda s: F.floor((panel_width - s["w"]) / 2).cast("int")
        top = lambda s: F.floor((panel_height - s["h"]) / 2).cast("int")
        return let(let(scale, sized), lambda s: F.struct(s["w"].alias("width"), s["h"].alias("height"), left(s).alias("left"), top(s).alias("top")))

    return placed(width, height)


# -- boxes from points ---------------------------------------------------------------------------------------------------


def fit_boxes(points: DataFrame, keys: list[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """(keys, tx, ty, tz, sx, sy, sz, yaw): the upright box of least volume around the points of each group.

    All yaws are tried in one aggregation, which Spark combines before it shuffles, so a group of any size is all right.
    Of equal volumes (to nine decimals) the least yaw counts. Groups of under two points have no row.
    """
    yaws = [math.pi * i / (FITTED_YAWS - 1) for i in range(FITTED_YAWS)]
    sides = []
    for i, a in enumerate(yaws):
        for name, side in (("u", math.cos(a) * F.col(x) + math.sin(a) * F.col(y)), ("v", math.cos(a) * F.col(y) - math.sin(a) * F.col(x))):
            sides += [F.min(side).alias(f"_{name}0_{i}"), F.max(side).alias(f"_{name}1_{i}")]
    found = points.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(z).alias("_z0"), F.max(z).alias("_z1"), *sides).where("_n >= 2")
    c = F.col

    def tried(i: int) -> Column:
        size = [c(f"_u1_{i}") - c(f"_u0_{i}"), c(f"_v1_{i}") - c(f"_v0_{i}"), c("_z1") - c("_z0")]
        u, v = (c(f"_u0_{i}") + c(f"_u1_{i}")) / 2, (c(f"_v0_{i}") + c(f"_v1_{i}")) / 2
        cos, sin = math.cos(yaws[i]), math.sin(yaws[i])
        return F.struct(
            F.round(size[0] * size[1] * size[2], 9).alias("volume"), F.lit(yaws[i]).alias("yaw"), (cos * u - sin * v).alias("tx"), (sin * u + cos * v).alias("ty"),
            ((c("_z0") + c("_z1")) / 2).alias("tz"), *[s.alias(n) for s, n in zip(size, ("sx", "sy", "sz"))],
        )

    best = found.select(*keys, F.array_min(F.array(*[tried(i) for i in range(FITTED_YAWS)])).alias("_b"))
    return best.select(*keys, *[c(f"_b.{n}").alias(n) for n in ("tx", "ty", "tz", "sx", "sy", "sz", "yaw")])


# -- arrays --------------------------------------------------------------------------------------------------------------


@bound
def nearest_position(values: Column, value: Column) -> Column:
    """Position (from 0) of the entry nearest to a value in an array in any order; of equally near ones the first."""
    away = F.transform(values, lambda x, i: F.struct(F.abs(x - value).alias("away"), i.alias("at")))
    return F.array_min(F.filter(away, lambda s: s["away"].isNotNull()))["at"]
