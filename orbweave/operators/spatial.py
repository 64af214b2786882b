"""Spatial joins over boxes that are turned about the vertical axis: candidates by grid cells, overlap by numpy kernels.

A box row has tx, ty, tz (centre), sx, sy, sz (extents), yaw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("tx", "ty", "tz", "sx", "sy", "sz", "yaw")
#: Comparison slack at the faces of a box.
SLACK = 1e-9


def _reach(df: DataFrame) -> DataFrame:
    """Half the horizontal diagonal: no part of the box lies farther from its centre."""
    return df.withColumn("_r", F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2) / 2)


def candidate_pairs(a: DataFrame, b: DataFrame, keys: list[str], cell: float, extra: Column | None = None) -> DataFrame:
    """Pairs (``a_*``, ``b_*``) of boxes whose horizontal circles touch and whose heights overlap, equal in ``keys``.

    Each box is put in every grid cell that its circle's square touches; a pair is kept in one cell only, the one that
    holds the lower corner of the squares' intersection, so nothing need be made distinct. ``extra`` is one more
    condition on the pair.
    """
    def spread(df: DataFrame, p: str) -> DataFrame:
        df = _reach(df)
        lo = lambda c: F.floor((F.col(c) - F.col("_r")) / cell)
        hi = lambda c: F.floor((F.col(c) + F.col("_r")) / cell)
        df = df.withColumn("_cx", F.explode(F.sequence(lo("tx"), hi("tx")))).withColumn("_cy", F.explode(F.sequence(lo("ty"), hi("ty"))))
        return df.select(*[F.col(c).alias(p + c) for c in df.columns])

    left, right = spread(a, "a_"), spread(b, "b_")
    A, B = (lambda c: F.col("a_" + c)), (lambda c: F.col("b_" + c))
    on = (A("_cx") == B("_cx")) & (A("_cy") == B("_cy"))
    for k in keys:
        on = on & (A(k) == B(k))
    own = lambda c: F.floor(F.greatest(A(c) - A("_r"), B(c) - B("_r")) / cell)
    near = (A("tx") - B("tx")) ** 2 + (A("ty") - B("ty")) ** 2 <= (A("_r") + B("_r")) ** 2
    tall = F.least(A("tz") + A("sz") / 2, B("tz") + B("sz") / 2) > F.greatest(A("tz") - A("sz") / 2, B("tz") - B("sz") / 2)
    met = left.join(right, on & near & tall & (own("tx") == A("_cx")) & (own("ty") == A("_cy")) & (extra if extra is not None else F.lit(True)))
    return met.drop(*[p + c for p in ("a_", "b_") for c in ("_r", "_cx", "_cy")])


def _z_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a[:, 2] + a[:, 5] / 2, b[:, 2] + b[:, 5] / 2) - np.maximum(a[:, 2] - a[:, 5] / 2, b[:, 2] - b[:, 5] / 2)


def _share_inside(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Share of an n x n grid over a's footprint, its edges included, that lies in b's."""
    line = np.linspace(-0.5, 0.5, n)
    gx, gy = (g.ravel() for g in np.meshgrid(line, line, indexing="ij"))
    c, s = np.cos(a[:, 6:7]), np.sin(a[:, 6:7])
    px, py = gx * a[:, 3:4], gy * a[:, 4:5]
    dx, dy = a[:, 0:1] + c * px - s * py - b[:, 0:1], a[:, 1:2] + s * px + c * py - b[:, 1:2]
    c, s = np.cos(b[:, 6:7]), np.sin(b[:, 6:7])
    return ((np.abs(c * dx + s * dy) <= b[:, 3:4] / 2 + SLACK) & (np.abs(c * dy - s * dx) <= b[:, 4:5] / 2 + SLACK)).mean(1)


#: Points that are sampled together: arrays of this many stay in a processor's cache and out of the way of its memory.
BLOCK_POINTS = 1 << 16


def sampled_iou(a: np.ndarray, b: np.ndarray, n: int = 8) -> np.ndarray:
    """Overlap over union of boxes (rows of BOX) by sampling the footprints on a fixed grid; exact in height. A block of pairs at a time."""
    block = max(1, BLOCK_POINTS // (n * n))
    if len(a) > block:
        return np.concatenate([sampled_iou(a[i : i + block], b[i : i + block], n) for i in range(0, len(a), block)])
    z = np.maximum(_z_overlap(a, b), 0)
    area_a, area_b = a[:, 3] * a[:, 4], b[:, 3] * b[:, 4]
    inter = 0.5 * (area_a * _share_inside(a, b, n) + area_b * _share_inside(b, a, n)) * z
    return inter / (area_a * a[:, 5] + area_b * b[:, 5] - inter + 1e-8)


#: Sides of footprints nearer to each other than this lie on each other.
TOUCH = 1e-12
#: Corners of a unit footprint, anticlockwise.
_CORNERS = np.array([(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)])


def _turned(x: np.ndarray, y: np.ndarray, yaw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c, s = np.cos(yaw)[:, None], np.sin(yaw)[:, None]
    return c * x - s * y, s * x + c * y


def _cut(x: np.ndarray, y: np.ndarray, half: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Where (shares of its length) each side of a footprint enters and leaves a rectangle about the origin, grown by ``slack``."""
    dx, dy = np.roll(x, -1, 1) - x, np.roll(y, -1, 1) - y
    enter, leave = np.zeros_like(x), np.ones_like(x)
    for at, way, most in ((x, dx, half[:, :1] + slack), (y, dy, half[:, 1:] + slack)):
        still = np.abs(way) < 1e-15
        safe = np.where(still, 1.0, way)
        first, second = (-most - at) / safe, (most - at) / safe
        enter = np.maximum(enter, np.where(still, np.where(np.abs(at) <= most, 0.0, 2.0), np.minimum(first, second)))
        leave = np.minimum(leave, np.where(still, 1.0, np.maximum(first, second)))
    return enter, leave


def footprint_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Area that the footprints of boxes (rows of BOX) share, for all pairs at once.

    The border of the common part is made of pieces of sides: of a's in b and of b's in a. Each piece adds the triangle that
    it spans with b's centre. Where sides lie on each other, a's count and b's do not.
    """
    dx, dy = _turned((a[:, 0] - b[:, 0])[:, None], (a[:, 1] - b[:, 1])[:, None], -b[:, 6])
    size_a, size_b = a[:, 3:5], b[:, 3:5]
    bx, by = _CORNERS[:, 0] * size_b[:, :1], _CORNERS[:, 1] * size_b[:, 1:]
    ax, ay = _turned(_CORNERS[:, 0] * size_a[:, :1], _CORNERS[:, 1] * size_a[:, 1:], a[:, 6] - b[:, 6])
    area = np.zeros(len(a))
    near_x, near_y = _turned(bx - dx, by - dy, b[:, 6] - a[:, 6])  # b's corners as a sees them
    for x, y, (enter, leave) in ((ax + dx, ay + dy, _cut(ax + dx, ay + dy, size_b / 2, TOUCH)), (bx, by, _cut(near_x, near_y, size_a / 2, -TOUCH))):
        wx, wy = np.roll(x, -1, 1) - x, np.roll(y, -1, 1) - y
        # both ends lie on the side, so the triangle depends on the piece's length alone
        area += np.where(leave > enter, (leave - enter) * (x * wy - y * wx), 0).sum(1) / 2
    return np.maximum(area, 0)


def exact_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap over union by the exact common part of the footprints."""
    inter = footprint_overlap(a, b) * np.maximum(_z_overlap(a, b), 0)
    return inter / (a[:, 3] * a[:, 4] * a[:, 5] + b[:, 3] * b[:, 4] * b[:, 5] - inter + 1e-8)


def enclosed(iou: Column) -> Column:
    """The overlap of ``a_*`` and ``b_*`` less the share of an upright box around both that neither fills, brought from [-1, 1]
    to [0, 1], so that boxes that do not meet still differ. The box around holds the circles about both footprints."""
    c = lambda p, n: F.col(f"{p}_{n}")
    radius = {p: F.sqrt(c(p, "sx") ** 2 + c(p, "sy") ** 2) / 2 for p in "ab"}
    reach = lambda p, n: c(p, "sz") / 2 if n == "tz" else radius[p]
    hull = F.lit(1.0)
    for n in ("tx", "ty", "tz"):
        hull = hull * (F.greatest(*[c(p, n) + reach(p, n) for p in "ab"]) - F.least(*[c(p, n) - reach(p, n) for p in "ab"]))
    union = (c("a", "sx") * c("a", "sy") * c("a", "sz") + c("b", "sx") * c("b", "sy") * c("b", "sz")) / (1 + iou)  # what they share is iou / (1 + iou) of both
    return (iou - (hull - union) / (hull + 1e-8) + 1) / 2


def with_iou(pairs: DataFrame, n: int | None = 8, name: str = "iou") -> DataFrame:
    """Add the overlap of ``a_*`` and ``b_*``: sampled on n x n points, or exact for None. Arrow batches of pairs."""
    names = [p + c for p in ("a_", "b_") for c in BOX]

    @F.pandas_udf("double")
    def overlap(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            v = np.stack([c.to_numpy(float) for c in columns], 1)
            yield pd.Series(sampled_iou(v[:, :7], v[:, 7:], n) if n else exact_iou(v[:, :7], v[:, 7:]))

    return pairs.withColumn(name, overlap(*[F.col(c) for c in names]))


def overlap_edges(boxes: DataFrame, keys: list[str], least: float, cell: float = 4.0, n: int | None = 8, id_col: str = "det_id", extra: Column | None = None) -> DataFrame:
    """(keys, a, b, iou) for pairs of ids a < b that overlap by at least ``least``."""
    small = boxes.select(*keys, id_col, *[c for c in ("frame_id",) if c in boxes.columns], *BOX)
    order = F.col(f"a_{id_col}") < F.col(f"b_{id_col}")
    pairs = with_iou(candidate_pairs(small, small, keys, cell, order if extra is None else order & extra), n)
    return pairs.where(F.col("iou") >= least).select(*[F.col(f"a_{k}").alias(k) for k in keys], F.col(f"a_{id_col}").alias("a"), F.col(f"b_{id_col}").alias("b"), "iou")


def points_in_boxes(boxes: DataFrame, points: DataFrame, keys: list[str], cell: float = 4.0, id_col: str = "det_id") -> DataFrame:
    """Pairs of a box and each point (x, y, z) strictly inside it, equal in ``keys``."""
    from ..functions.geometry import inside_yaw_box

    b = _reach(boxes)
    for c, t in (("_cx", "tx"), ("_cy", "ty")):
        b = b.withColumn(c, F.explode(F.sequence(F.floor((F.col(t) - F.col("_r")) / cell), F.floor((F.col(t) + F.col("_r")) / cell))))
    p = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    met = b.join(p, [*keys, "_cx", "_cy"])
    return met.where(inside_yaw_box(*[F.col(c) for c in ("x", "y", "z", *BOX)])).drop("_r", "_cx", "_cy")


def within_distance(a: DataFrame, b: DataFrame, keys: list[str], distance: float, id_col: str = "det_id") -> DataFrame:
    """Rows of ``a`` with a row of ``b`` whose centre is at most so far away."""
    cells = lambda df: df.withColumn("_cx", F.floor(F.col("tx") / distance)).withColumn("_cy", F.floor(F.col("ty") / distance))
    near = cells(a.select(*keys, id_col, "tx", "ty", "tz"))
    near = near.withColumn("_cx", F.explode(F.array(*[F.col("_cx") + d for d in (-1, 0, 1)]))).withColumn("_cy", F.explode(F.array(*[F.col("_cy") + d for d in (-1, 0, 1)])))
    other = cells(b.select(*keys, F.col("tx").alias("ox"), F.col("ty").alias("oy"), F.col("tz").alias("oz"), "tx", "ty")).drop("tx", "ty")
    met = near.join(other, [*keys, "_cx", "_cy"]).where((F.col("tx") - F.col("ox")) ** 2 + (F.col("ty") - F.col("oy")) ** 2 + (F.col("tz") - F.col("oz")) ** 2 <= distance**2)
    return a.join(met.select(*keys, id_col).distinct(), [*keys, id_col], "left_semi")
