"""Global ranks, slices and quantiles of whole tables, without one task that sees all rows.

Ranks come from range partitions and their offsets; quantiles from counts by cells that are narrowed around the ranks asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: Cells into which an interval is cut in a round of ``order_statistics``.
CELLS = 4096
#: Values of a cell that are looked at one by one.
FEW = 10_000


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in an order, gapless from 0. Rows are sorted by range; each partition then adds what is before it."""
    found = stage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)  # the number of the partition; those are in order
    parts = found.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    shifts = F.broadcast(parts.select("_part", before.alias("_before")))
    return found.join(shifts, part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def sliced(df: DataFrame, time: str, *steps: tuple[str, int | None]) -> DataFrame:
    """Rows of some of the distinct values of ``time``: each step, in order, leaves out the first n (``start``), all but every n-th
    (``every``) or all after the first n (``most``; None for no bound) of what the steps before it left."""
    times = ranked(df.select(time).where(F.col(time).isNotNull()).distinct(), time, name="_n")
    for what, n in steps:
        at = F.col("_n")
        if what == "start":
            times = times.where(at >= n).withColumn("_n", at - n)
        elif what == "every":
            times = times.where(at % n == 0).withColumn("_n", F.floor(at / n))
        elif what != "most":
            raise ValueError(f"no step {what!r}")
        elif n is not None:
            times = times.where(at < n)
    return df.join(times.select(time), time, "left_semi")


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at some ranks (from 0) of a column in order, exact. Nulls and NaN do not count.

    A round cuts the interval that holds each rank into cells, counts its values by cell in one aggregation for all ranks and goes on
    in the cell that holds the rank, between its least and greatest value; it ends when those are equal or few values are
    left. The driver sees CELLS counts a rank.
    """
    x = F.col(column).cast("double")
    values = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not all(0 <= k < n for k in ranks):
        raise ValueError(f"ranks are from 0 to {n - 1}, not {ranks}")
    found: dict[int, float] = {}
    open_ = {k: (low, high, 0, n) for k in dict.fromkeys(ranks)}  # least and greatest value, values before, values inside
    while open_:
        for k, (lo, hi, before, inside) in list(open_.items()):
            if lo == hi:
                found[k] = lo
                del open_[k]
            elif inside <= FEW:
                own = [r["x"] for r in values.where(F.col("x").between(lo, hi)).orderBy("x").limit(inside).collect()]
                found[k] = own[k - before]
                del open_[k]
        if open_:
            spans = list(dict.fromkeys((lo, hi) for lo, hi, _, _ in open_.values()))
            cut = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(spans)])
            rows = values.withColumn("s", F.explode(F.filter(cut, lambda s: F.col("x").between(s["lo"], s["hi"]))))
            half = lambda v: v / 2  # noqa: E731  so that the span of very large values stays finite
            cell = F.floor((half(F.col("x")) - half(F.col("s.lo"))) / (half(F.col("s.hi")) - half(F.col("s.lo"))) * (CELLS - 1))
            counts: dict[int, list] = {}
            for r in rows.groupBy(F.col("s.i").alias("i"), cell.alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i", "c").collect():
                counts.setdefault(r["i"], []).append(r)
            for k, (lo, hi, before, _) in open_.items():
                for r in counts[spans.index((lo, hi))]:
                    if k < before + r["n"]:
                        open_[k] = (r["lo"], r["hi"], before, r["n"])
                        break
                    before += r["n"]
    return [found[k] for k in ranks]


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Values below which shares of a column lie, linear between the two values next to them; None where there is no value."""
    x = F.col(column).cast("double")
    n = df.where(x.isNotNull() & ~F.isnan(x)).count()
    if not n:
        return [None] * len(shares)  # type: ignore[list-item]
    at = [s * (n - 1) for s in shares]
    ranks = sorted({k for a in at for k in (int(a), min(int(a) + 1, n - 1))})
    value = dict(zip(ranks, order_statistics(df, column, ranks)))
    return [value[int(a)] + (a - int(a)) * (value[min(int(a) + 1, n - 1)] - value[int(a)]) for a in at]


def normalised(df: DataFrame, column: str, name: str, robust: tuple[float, float] | None = (0.02, 0.98), eps: float = 1e-8) -> DataFrame:
    """Add a column brought to [0, 1]: from its least to its greatest value, or between two quantiles with what lies beyond clipped."""
    if robust is None:
        lo, hi = df.where(~F.isnan(F.col(column).cast("double"))).agg(F.min(column), F.max(column)).first()
    else:
        lo, hi = quantiles(df, column, list(robust))
    if lo is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    return df.withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(column) - F.lit(float(lo))) / (float(hi) - float(lo) + eps))))
