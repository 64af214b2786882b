"""Joins by nearest time. Windows carry neighbours along the sorted times of a key, so both sides are shuffled once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _around(left: DataFrame, right: DataFrame, time: str, keys: list[str]) -> DataFrame:
    """Rows of ``left`` with ``_before`` and ``_after``: structs (t, v) of the neighbours in ``right``, equal times in both.

    A left row without keys still needs one: give a bucket of time as the key where there is no natural one.
    """
    r = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(time).alias("t"), F.struct(*[c for c in right.columns if c not in keys]).alias("v")).alias("_right"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    m = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct("*").alias("_left"))
    both = r.unionByName(m)
    back = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    forth = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_before", F.last("_right", ignorenulls=True).over(back)).withColumn("_after", F.last("_right", ignorenulls=True).over(forth))
    return both.where("_side = 1").select("_left.*", "_before", "_after")


def neighbours(left: DataFrame, right: DataFrame, time: str = "time_ns", keys: list[str] | None = None) -> DataFrame:
    return _around(left, right, time, keys or [])


def _chosen(df: DataFrame, time: str, pick_after: Column, right_columns: list[str], prefix: str) -> DataFrame:
    near = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull(), F.col("_before")).when(pick_after, F.col("_after")).otherwise(F.col("_before"))
    out = df.withColumn("_near", near)
    return out.select(*[c for c in df.columns if c not in ("_before", "_after")], *[F.col(f"_near.v.{c}").alias(prefix + c) for c in right_columns], (F.col("_near.t") - F.col(time)).alias("dt"))


def nearest(left: DataFrame, right: DataFrame, time: str = "time_ns", keys: list[str] | None = None, *, later_on_tie: bool = False, tolerance: int | None = None, how: str = "left", prefix: str = "r_") -> DataFrame:
    """The row of ``right`` nearest in time, the earlier one of two as near (or the later). ``dt`` is its time less the left's.

    With a tolerance, farther ones count as none; ``how="inner"`` drops rows that have none.
    """
    keys = keys or []
    columns = [c for c in right.columns if c not in keys]
    a, b = F.col(time) - F.col("_before.t"), F.col("_after.t") - F.col(time)
    out = _chosen(_around(left, right, time, keys), time, (b <= a) if later_on_tie else (b < a), columns, prefix)
    if tolerance is not None:
        ok = F.abs("dt") <= tolerance
        out = out.withColumns({c: F.when(ok, F.col(c)) for c in [prefix + c for c in columns] + ["dt"]})
    return out.where(F.col("dt").isNotNull()) if how == "inner" else out


def lower(left: DataFrame, right: DataFrame, time: str = "time_ns", keys: list[str] | None = None, prefix: str = "r_") -> DataFrame:
    """The last row of ``right`` not after the left's time."""
    columns = [c for c in right.columns if c not in (keys or [])]
    out = _around(left, right, time, keys or []).withColumn("_after", F.col("_before"))
    return _chosen(out, time, F.lit(False), columns, prefix)


def ceiling(left: DataFrame, right: DataFrame, time: str = "time_ns", keys: list[str] | None = None, prefix: str = "r_") -> DataFrame:
    """The first row of ``right`` not before the left's time, else its last one."""
    columns = [c for c in right.columns if c not in (keys or [])]
    return _chosen(_around(left, right, time, keys or []), time, F.lit(True), columns, prefix)


def bounds(left: DataFrame, right: DataFrame, time: str = "time_ns", keys: list[str] | None = None) -> DataFrame:
    """Neighbouring times ``lower``, ``upper``, how far between them ``alpha``, and whether the time lies inside (``good``)."""
    out = _around(left, right, time, keys or [])
    low, high, t = F.col("_before.t"), F.col("_after.t"), F.col(time)
    good = low.isNotNull() & high.isNotNull()
    low_, high_ = F.coalesce(low, high), F.coalesce(high, low)
    alpha = F.when(good & (high > low), (t - low) / (high - low)).otherwise(0.0)
    return out.select(*[c for c in out.columns if c not in ("_before", "_after")], low_.alias("lower"), high_.alias("upper"), alpha.alias("alpha"), good.alias("good"))


def interpolated(left: DataFrame, right: DataFrame, values: list[str], time: str = "time_ns", keys: list[str] | None = None) -> DataFrame:
    """``values`` of ``right`` at the left's times, linear between neighbours, held constant outside."""
    out = _around(left, right, time, keys or [])
    low, high, t = F.col("_before"), F.col("_after"), F.col(time)
    good = low.isNotNull() & high.isNotNull()
    alpha = F.when(good & (high["t"] > low["t"]), (t - low["t"]) / (high["t"] - low["t"])).otherwise(0.0)
    mixed = [(F.coalesce(low["v"][c], high["v"][c]) + F.when(good, alpha * (high["v"][c] - low["v"][c])).otherwise(0.0)).alias(c) for c in values]
    return out.select(*[c for c in out.columns if c not in ("_before", "_after")], *mixed, good.alias("good"))


def trailing(left: DataFrame, right: DataFrame, span: int, time: str = "time_ns", keys: list[str] | None = None) -> DataFrame:
    """Pairs of a left row and each right row at most ``span`` before it (both ends count), by buckets of that span."""
    keys = keys or []
    a = left.withColumn("_b", F.explode(F.array(F.floor(F.col(time) / span), F.floor(F.col(time) / span) - 1)))
    b = right.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys], F.floor(F.col(time) / span).alias("_rb"))
    on = F.col("_b") == F.col("_rb")
    for c in keys:
        on = on & (F.col(c) == F.col(f"_k_{c}"))
    met = a.join(b, on & (F.col(f"r_{time}") <= F.col(time)) & (F.col(f"r_{time}") >= F.col(time) - span))
    return met.drop("_b", "_rb", *[f"_k_{c}" for c in keys])


def segments(df: DataFrame, key: str, time: str = "time_ns", id_col: str = "event_id") -> DataFrame:
    """Each row with the time, position and id of the next one in its key; the last one of a key has none and is left out."""
    w = Window.partitionBy(key).orderBy(time)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in (time, "x", "y", "z", id_col) if c in df.columns}).where(F.col(f"next_{time}").isNotNull())
