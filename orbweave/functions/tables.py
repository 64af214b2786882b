"""Table functions for SQL: the points of a box as rows, by a lateral join.

``register(spark)`` makes them known; then ``SELECT d.id, p.* FROM d, LATERAL edge_points(center, size, rotation, 3) p``.
Rows come back as they are: an Arrow batch for each box costs several times what its few points do. A null argument, or fewer than one step, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

POINT = "pos int, x double, y double, z double"


def _placed(unit: np.ndarray, center, size, rotation) -> Iterator[tuple]:
    points = (unit * np.asarray(size, float)) @ np.asarray(rotation, float).reshape(3, 3).T + np.asarray(center, float)
    for pos, (x, y, z) in enumerate(points.tolist()):
        yield pos, x, y, z


class _Points:
    """Points of a unit cube are made once for each number of steps that a task sees."""

    def __init__(self):
        self.known = {}

    def unit(self, steps: tuple) -> np.ndarray:
        if steps not in self.known:
            self.known[steps] = self.made(*steps)
        return self.known[steps]


@udtf(returnType=POINT, useArrow=False)
class EdgePoints(_Points):
    """``steps`` points on each of the twelve edges, ends included: edges along x first, then y, then z."""

    def made(self, steps: int) -> np.ndarray:
        line = np.linspace(-0.5, 0.5, steps) if steps > 1 else np.array([-0.5])
        return np.array([np.insert(ends, axis, at) for axis in range(3) for ends in product((-0.5, 0.5), repeat=2) for at in line])

    def eval(self, center, size, rotation, steps):
        if center is not None and size is not None and rotation is not None and steps is not None and steps > 0:
            yield from _placed(self.unit((steps,)), center, size, rotation)


@udtf(returnType=POINT, useArrow=False)
class VoxelPoints(_Points):
    """Centres of the cells of a box cut into nx, ny and nz parts; x varies slowest, z fastest."""

    def made(self, nx: int, ny: int, nz: int) -> np.ndarray:
        return np.array(list(product(*[[(i + 0.5) / n - 0.5 for i in range(n)] for n in (nx, ny, nz)])))

    def eval(self, center, size, rotation, nx, ny, nz):
        if center is not None and size is not None and rotation is not None and None not in (nx, ny, nz) and min(nx, ny, nz) > 0:
            yield from _placed(self.unit((nx, ny, nz)), center, size, rotation)


def register(spark: SparkSession) -> None:
    spark.udtf.register("edge_points", EdgePoints)
    spark.udtf.register("voxel_points", VoxelPoints)
