"""Joins of boxes of any rotation: candidates by cells that grow with the boxes, overlap by cells of the boxes themselves.

A box row has center, size (array<double> of 3) and rotation (array<double> of 9, row by row, box to world).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("center", "size", "rotation")
#: Bytes of sample points that one Arrow batch holds at a time.
KERNEL_BYTES = 64 << 20
#: A cell's centre nearer to a face than this lies on it, and so not inside, however the sums that place it were rounded.
SLACK = 1e-9


def _reach() -> Column:
    """Half the diagonal: no part of the box lies farther from its centre."""
    return F.sqrt(sum(F.col("size")[i] ** 2 for i in range(3))) / 2


#: Cells are at least so many times as wide as the spheres in them: a box then lies in two cells on average, not in five.
CELL_SPHERES = 4


def _level() -> Column:
    """The power of four (as one of two) that is the least cell at least ``CELL_SPHERES`` times as wide as the box's sphere."""
    return (2 * F.ceil(F.log2(F.greatest(2 * CELL_SPHERES * F.col("_r"), F.lit(1e-6))) / 2)).cast("int")


def sphere_pairs(a: DataFrame, b: DataFrame, keys: list[str], extra: Column | None = None) -> DataFrame:
    """Pairs (``a_*``, ``b_*``) of boxes whose spheres meet, equal in ``keys``.

    Cells come in sizes of powers of four. A box is put into the cells, eight at most, that its sphere touches at its own
    size and at each larger one that some box has; two boxes are compared at the larger of their sizes, in the cell that
    holds the lower corner of what their spheres' cubes share. So one huge box costs eight cells, not one for each small
    box in it. Both sides are shuffled: Spark's estimate of a table's size knows nothing of the copies in cells, and would
    send them all through the driver. ``extra`` is one more condition on the pair.
    """
    a, b = (df.withColumn("_r", _reach()).withColumn("_l", _level()) for df in (a, b))
    sizes = a.select("_l").unionByName(b.select("_l")).distinct().where("_l is not null").orderBy("_l").collect()  # powers of four: some dozens
    levels = F.array(*[F.lit(r["_l"]) for r in sizes]) if sizes else F.array().cast("array<int>")

    def spread(df: DataFrame, p: str) -> DataFrame:
        df = df.withColumn("_at", F.explode(F.filter(levels, lambda x: x >= F.col("_l"))))
        for i in range(3):
            edge = lambda sign, i=i: F.floor((F.col("center")[i] + sign * F.col("_r")) / F.pow(F.lit(2.0), F.col("_at")))
            df = df.withColumn(f"_c{i}", F.explode(F.sequence(edge(-1), edge(1))))
        return df.select(*[F.col(c).alias(p + c) for c in df.columns])

    left, right = spread(a, "a_"), spread(b, "b_")
    A, B = (lambda c: F.col("a_" + c)), (lambda c: F.col("b_" + c))
    on = A("_at") == B("_at")
    for c in [*keys, "_c0", "_c1", "_c2"]:
        on = on & (A(c) == B(c))
    on = on & (A("_at") == F.greatest(A("_l"), B("_l")))
    for i in range(3):
        own = F.floor(F.greatest(A("center")[i] - A("_r"), B("center")[i] - B("_r")) / F.pow(F.lit(2.0), A("_at")))
        on = on & (own == A(f"_c{i}"))
    apart = sum((A("center")[i] - B("center")[i]) ** 2 for i in range(3))
    met = left.join(right.hint("merge"), on & (apart <= (A("_r") + B("_r")) ** 2) & (F.lit(True) if extra is None else extra))
    return met.drop(*[p + c for p in ("a_", "b_") for c in ("_r", "_l", "_at", "_c0", "_c1", "_c2")])


def _grid(n: int) -> np.ndarray:
    line = (np.arange(n) + 0.5) / n - 0.5
    return np.stack(np.meshgrid(line, line, line, indexing="ij"), -1).reshape(-1, 3)


def _cells_inside(a: np.ndarray, b: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """How many cell centres of each box of ``a`` lie strictly in the box of ``b`` at its place. Rows: centre, size, rotation."""
    ra, rb = a[:, 6:].reshape(-1, 3, 3), b[:, 6:].reshape(-1, 3, 3)
    turn = np.einsum("pki,pkj->pij", rb, ra) * a[:, None, 3:6]  # a's unit cube to b's frame
    move = np.einsum("pki,pk->pi", rb, a[:, :3] - b[:, :3])
    half, inside = b[:, 3:6] / 2, np.ones((len(a), len(grid)), bool)
    for axis in range(3):
        inside &= np.abs(turn[:, axis] @ grid.T + move[:, axis : axis + 1]) < half[:, axis : axis + 1] - SLACK
    return inside.sum(1)


def voxel_iou(a: np.ndarray, b: np.ndarray, n: int = 32) -> np.ndarray:
    """Overlap over union of boxes by the centres of n x n x n cells of each that lie in the other; a bounded block of pairs at a time."""
    grid, out = _grid(n), np.zeros(len(a))
    block = max(1, KERNEL_BYTES // (len(grid) * 24))
    for i in range(0, len(a), block):
        x, y = a[i : i + block], b[i : i + block]
        va, vb = x[:, 3:6].prod(1), y[:, 3:6].prod(1)
        both = (va * _cells_inside(x, y, grid) + vb * _cells_inside(y, x, grid)) / 2
        union = (va + vb) * len(grid) - both
        out[i : i + block] = np.divide(both, union, out=np.zeros(len(x)), where=union > 0)
    return out


def with_voxel_iou(pairs: DataFrame, n: int = 32, name: str = "iou") -> DataFrame:
    """Add the overlap of ``a_*`` and ``b_*``, row by row: whatever brought the pairs together. Null boxes give null."""

    @F.pandas_udf("double")
    def overlap(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            v = np.stack([c.to_numpy(float) for c in columns], 1)
            good, out = ~np.isnan(v).any(1), np.full(len(v), np.nan)
            out[good] = voxel_iou(v[good, :15], v[good, 15:], n)
            yield pd.Series(out).astype(object).where(good, None).astype("Float64") if not good.all() else pd.Series(out)

    flat = [F.get(F.col(p + c), F.lit(i)) for p in ("a_", "b_") for c, k in zip(BOX, (3, 3, 9)) for i in range(k)]
    return pairs.withColumn(name, overlap(*flat))


def overlap_pairs(boxes: DataFrame, keys: list[str], least: float, n: int = 32, id_col: str = "det_id") -> DataFrame:
    """(keys, a, b, iou) for pairs of ids a < b, equal in ``keys``, that overlap by at least ``least``."""
    small = boxes.select(*keys, id_col, *BOX)
    met = with_voxel_iou(sphere_pairs(small, small, keys, F.col(f"a_{id_col}") < F.col(f"b_{id_col}")), n).where(F.col("iou") >= least)
    return met.select(*[F.col(f"a_{k}").alias(k) for k in keys], F.col(f"a_{id_col}").alias("a"), F.col(f"b_{id_col}").alias("b"), "iou")


def matched_overlap(a: DataFrame, b: DataFrame, on: list[str], n: int = 32) -> DataFrame:
    """(on, iou): overlap of the boxes of two tables that agree in ``on``, one to one. An id that one table lacks, or has twice, is an error.

    The tables are grouped together, so a lone or doubled id is seen without counting either table first.
    """
    sides = [df.select(*on, F.lit(k).alias("_side"), F.struct(*BOX).alias("_box")) for k, df in (("a", a), ("b", b))]
    held = lambda k: F.first(F.when(F.col("_side") == k, F.col("_box")), ignorenulls=True)
    count = lambda k: F.count_if(F.col("_side") == k)
    met = sides[0].unionByName(sides[1]).groupBy(*on).agg(held("a").alias("_a"), held("b").alias("_b"), ((count("a") == 1) & (count("b") == 1)).alias("_ok"))
    met = met.withColumn("_a", F.when(F.col("_ok"), F.col("_a")).otherwise(F.raise_error(F.lit("boxes to be compared one to one do not pair up"))))
    flat = met.select(*on, *[F.col(f"_{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in BOX])
    return with_voxel_iou(flat, n).select(*on, "iou")
