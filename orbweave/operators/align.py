"""Small linear algebra over groups: rigid motions between point sets, boxes from corners, principal components.

Groups are summed to a few moments by Spark; only those reach a matrix decomposition, many groups to an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import asof

AXES = "xyz"


def rotations_between(cross: np.ndarray) -> np.ndarray:
    """For each matrix of sums q p' over centred pairs, the rotation that takes q nearest to p; never a reflection."""
    u, _, vt = np.linalg.svd(cross)
    flip = np.ones((len(cross), 3))
    flip[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    return np.einsum("nji,nj,nkj->nik", vt, flip, u)


def align_points(pairs: DataFrame, keys: list[str], own: tuple[str, str, str], other: tuple[str, str, str]) -> DataFrame:
    """(keys, n, rotation, translation, error): the rigid motion that takes the other points of each group nearest to its own.

    Horn's closed form: both sets are centred, the 3 x 3 sums of products decomposed, a reflection undone at the least
    singular value. ``error``: over the axes, the mean of the root of the summed squares of what is left. All of it comes from
    one aggregation of moments, combined before the shuffle, so a group of any size is all right; moments are taken about
    means, so groups far from the origin lose no digits. Rows with a null or NaN coordinate do not count.
    """
    columns = [*own, *other]
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    found = pairs.where(whole).groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(q, p).alias(f"_c{i}{j}") for i, q in enumerate(other) for j, p in enumerate(own)],
        *[F.covar_pop(a, b).alias(f"_q{i}{j}") for i, a in enumerate(other) for j, b in enumerate(other) if i <= j], *[F.var_pop(p).alias(f"_p{i}") for i, p in enumerate(own)],
    )

    @F.pandas_udf("rotation array<double>, translation array<double>, error double")
    def fitted(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in parts:
            v = np.stack([c.to_numpy(float) for c in columns], 1)
            n, own_mean, other_mean, cross = v[:, 0], v[:, 1:4], v[:, 4:7], v[:, 7:16].reshape(-1, 3, 3)
            spread = np.zeros((len(v), 3, 3))
            i, j = np.triu_indices(3)
            spread[:, i, j] = spread[:, j, i] = v[:, 16:22]
            turn = rotations_between(cross)
            left = np.einsum("nij,njk,nik->ni", turn, spread, turn) - 2 * np.einsum("nij,nji->ni", turn, cross) + v[:, 22:25]
            moved = own_mean - np.einsum("nij,nj->ni", turn, other_mean)
            yield pd.DataFrame({"rotation": list(turn.reshape(-1, 9)), "translation": list(moved), "error": np.sqrt(np.maximum(left, 0) * n[:, None]).mean(1)})

    moments = [F.col("n"), *[F.col(f"_m{i}") for i in range(6)], *[F.col(f"_c{i}{j}") for i in range(3) for j in range(3)], *[F.col(f"_q{i}{j}") for i in range(3) for j in range(3) if i <= j], *[F.col(f"_p{i}") for i in range(3)]]
    return found.withColumn("_f", fitted(*moments)).select(*keys, "n", "_f.*")


def align_trajectories(own: DataFrame, other: DataFrame, keys: list[str], time: str = "time_ns") -> DataFrame:
    """``align_points`` of two tables of positions (keys, time, x, y, z); the other's are interpolated at the own times that lie
    within its span, so the two need not have the same times or as many."""
    moved = other.select(*keys, time, *[F.col(c).alias(f"o_{c}") for c in AXES])
    met = asof.interpolated(own.select(*keys, time, *AXES), moved, [f"o_{c}" for c in AXES], time, keys).where("good")
    return align_points(met, keys, tuple(AXES), tuple(f"o_{c}" for c in AXES))


#: The corners of a unit box in the order in which corner lists have them: the bottom around, then the top.
CORNERS = np.array([(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]) / 2


def with_box_of_corners(df: DataFrame, corners: str, name: str = "box") -> DataFrame:
    """Add struct<center, size, rotation> of the box whose eight corners (array<array<double>>, in the order of CORNERS) a row has.

    Sizes are the lengths of the edges at the first corner; the box of that size is moved onto all eight as near as it
    goes, so corners with noise are all right. Corner lists that are null, or not eight of three, give null.
    """
    c = F.col(corners)
    good = (F.size(c) == 8) & ~F.exists(c, lambda p: p.isNull() | (F.size(p) != 3) | F.exists(p, lambda x: x.isNull() | F.isnan(x)))
    flat = F.when(good, F.flatten(c))

    @F.pandas_udf("center array<double>, size array<double>, rotation array<double>")
    def fitted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            known, out = np.flatnonzero(part.notna()), {n: [None] * len(part) for n in ("center", "size", "rotation")}
            if len(known):
                p = np.stack(part.iloc[known].to_list()).reshape(-1, 8, 3).astype(float)
                size = np.stack([np.linalg.norm(p[:, i] - p[:, 0], axis=1) for i in (1, 3, 4)], 1)
                middle = p.mean(1)
                turn = rotations_between(np.einsum("ki,ni,nkj->nij", CORNERS, size, p - middle[:, None]))
                for n, values in (("center", middle), ("size", size), ("rotation", turn.reshape(-1, 9))):
                    for i, v in zip(known, values):
                        out[n][i] = v
            yield pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in out.items()})

    return df.withColumn("_f", flat).withColumn(name, F.when(good, fitted(F.col("_f")))).drop("_f")


def _quarter_turns() -> list[tuple[int, ...]]:
    """The 24 rotations that take axes to axes, row by row: of the signed permutation matrices those that do not mirror."""
    out = []
    for x in range(3):
        for y in (k for k in range(3) if k != x):
            for sx in (1, -1):
                for sy in (1, -1):
                    a, b = np.eye(3, dtype=int)[x] * sx, np.eye(3, dtype=int)[y] * sy
                    out.append(tuple(int(v) for v in np.column_stack([a, b, np.cross(a, b)]).ravel()))
    return sorted(out, reverse=True)


QUARTER_TURNS = _quarter_turns()


def nearest_quarter_turn(a: Column, b: Column) -> Column:
    """struct<turn, rotation>: of the 24 rotations that take axes to axes the one after which ``b`` is nearest to ``a``, and ``b``
    after it. Of equally near ones the first of QUARTER_TURNS, the rotation that does nothing before others."""
    from ..functions.geometry import bound, let, matmul, transpose

    turns = F.array(*[F.array(*[F.lit(float(v)) for v in t]) for t in QUARTER_TURNS])

    @bound
    def out(a: Column, b: Column) -> Column:
        def best(m: Column) -> Column:
            # the angle falls as the trace rises; m is turned back, so the trace is a sum of products
            trace = lambda t: F.aggregate(F.zip_with(m, t, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            ranked = F.transform(turns, lambda t, i: F.struct(F.round(-trace(t), 12).alias("less"), i.alias("i")))
            return F.get(turns, F.array_min(ranked)["i"])

        return let(let(transpose(matmul(transpose(a), b)), best), lambda t: F.struct(t.alias("turn"), matmul(b, t).alias("rotation")))

    return out(a, b)


# -- principal components ------------------------------------------------------------------------------------------------


def principal_components(df: DataFrame, vector: str, k: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, the k axes of most variance (rows) and the number of vectors, from one pass of sums.

    Each partition adds up its vectors about the first it meets to 1 + d + d^2 numbers, and those sums are brought together; d, not
    the number of rows, bounds what the driver holds. The entry of an axis that is largest in size is positive. Null vectors, and
    those with a null or NaN entry, do not count; vectors of different lengths are an error.
    """
    from .. import staging

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for part in parts:
            for d, rows in part["v"].groupby(part["v"].map(len)):
                x = np.stack(rows.to_list()).astype(float)
                n, mean, spread = len(x), x.mean(0), (x - x.mean(0)).T @ (x - x.mean(0))
                held[d] = merged_moments(held[d], (n, mean, spread)) if d in held else (n, mean, spread)
        for d, (n, mean, spread) in held.items():
            yield pd.DataFrame({"d": [d], "n": [n], "mean": [mean], "spread": [spread.ravel()]})

    good = df.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    sums = staging.stage(good.mapInPandas(partial, "d int, n long, mean array<double>, spread array<double>"), "moments")
    wide = sums.agg(F.sum("n"), F.min("d"), F.max("d")).first()
    if wide[0] is None:
        raise ValueError("no vectors")
    if wide[1] != wide[2]:
        raise ValueError("vectors of different lengths")
    d = wide[1]
    # of the partitions' own means: the spread about the common mean is that about the own ones and of the own ones
    total = wide[0]
    mean_rows = sums.select("n", F.posexplode("mean")).groupBy("pos").agg((F.sum(F.col("n") * F.col("col")) / total).alias("m")).collect()
    mean = np.zeros(d)
    for r in mean_rows:
        mean[r["pos"]] = r["m"]
    at = F.array(*[F.lit(float(m)) for m in mean])
    off = F.zip_with("mean", at, lambda a, b: a - b)
    outer = F.flatten(F.transform(off, lambda a: F.transform(off, lambda b: a * b * F.col("n"))))
    spread = np.zeros(d * d)
    for r in sums.select(F.posexplode(F.zip_with("spread", outer, lambda a, b: a + b))).groupBy("pos").agg(F.sum("col").alias("s")).collect():
        spread[r["pos"]] = r["s"]
    values, axes = np.linalg.eigh(spread.reshape(d, d))
    axes = axes[:, np.argsort(-values)[:k]].T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return mean, axes * signs[:, None], total


def merged_moments(a: tuple, b: tuple) -> tuple:
    """Counts, means and spreads about them, of two sets together."""
    n, way = a[0] + b[0], b[1] - a[1]
    return n, a[1] + way * (b[0] / n), a[2] + b[2] + np.outer(way, way) * (a[0] * b[0] / n)


def component_colours(df: DataFrame, vector: str, name: str = "colour", k: int = 3) -> DataFrame:
    """Add an array of ``k`` numbers from 0 to 1: the vector's principal components, each from the least to the greatest of the table.

    A component that is the same everywhere is 0. Vectors that do not count have null.
    """
    mean, axes, _ = principal_components(df, vector, k)

    @F.pandas_udf("array<double>")
    def along(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            whole = [None if v is None or np.isnan(np.asarray(v, float)).any() else axes @ (np.asarray(v, float) - mean) for v in part]
            yield pd.Series(whole, dtype=object)

    placed = df.withColumn("_v", along(F.col(vector).cast("array<double>")))
    ends = placed.agg(*[f(F.get(F.col("_v"), F.lit(i))) for i in range(len(axes)) for f in (F.min, F.max)]).first()
    scaled = [F.when(F.lit(hi > lo), (F.get(F.col("_v"), F.lit(i)) - lo) / (hi - lo)).otherwise(0.0) for i, (lo, hi) in enumerate(zip(ends[::2], ends[1::2]))]
    return placed.withColumn(name, F.when(F.col("_v").isNotNull(), F.array(*scaled))).drop("_v")
