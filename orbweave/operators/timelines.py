"""Time lines of frames and observations: rates, what was observed lately, the last stretch of a path, boxes for every frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof

#: Steps of a time line (ns) under this are numbers of frames, not times.
LEAST_STEP = 1000.0
#: Rates above this are mistakes of the clock.
MOST_RATE = 240.0
#: Observations this far from a time (ns) still count where there is none in the window before it.
NEAR = 1_000_000


def frame_rates(df: DataFrame, keys: list[str], time: str = "time_ns", fallback: Column | float = 10.0, unit: float = 1e9) -> DataFrame:
    """(keys, fps): frames a second from the median step between the times of each key, half-way between two middle ones.

    Repeated times make no step. ``fallback``, a number or an expression over the keys, counts where there is no step, where the
    median is under LEAST_STEP, and where the rate is above MOST_RATE. ``unit``: time units a second.
    """
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    steps = df.withColumn("_step", step).groupBy(*keys).agg(F.median(F.when(F.col("_step") > 0, F.col("_step"))).alias("_m"))
    rate = F.lit(unit) / F.col("_m")
    usual = (F.col("_m") >= LEAST_STEP) & (rate <= MOST_RATE)
    other = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    return steps.select(*keys, F.when(usual, rate).otherwise(other.cast("double")).alias("fps"))


def observed_lately(frames: DataFrame, observations: DataFrame, span: int, keys: list[str], id_col: str, time: str = "time_ns", value: str = "uid", near: int = NEAR) -> DataFrame:
    """(id, value): the distinct values observed at most ``span`` before each frame, ends included; for a frame with none of these,
    those of the one observation time nearest to it, if at most ``near`` away."""
    own = frames.select(*keys, id_col, time)
    seen = observations.select(*keys, time, value)
    trail = asof.trailing(own, seen, span, time, keys).select(id_col, F.col(f"r_{value}").alias(value))
    alone = own.join(trail.select(id_col).distinct(), id_col, "left_anti")
    times = seen.select(*keys, time).distinct().withColumn("at", F.col(time))
    single = asof.nearest(alone, times, time, keys, tolerance=near, how="inner").select(id_col, *keys, F.col("r_at").alias(time))
    return trail.distinct().unionByName(single.join(seen, [*keys, time]).select(id_col, value).distinct())


def path_tails(frames: DataFrame, path: DataFrame, span: int, key: str, id_col: str, time: str = "time_ns") -> DataFrame:
    """(id, start, end, from, to): for each frame the pieces of its key's path that begin at most ``span`` before it, ends included.

    A piece goes from one position (x, y, z) of the path to the next; a frame's own last piece may end after it.
    """
    pieces = asof.segments(path.select(key, time, "x", "y", "z"), key, time)
    met = asof.trailing(frames.select(key, id_col, time), pieces, span, time, [key])
    point = lambda p: F.array(*[F.col(f"r_{p}{c}") for c in "xyz"])
    return met.select(id_col, F.col(f"r_{time}").alias("start"), F.col(f"r_next_{time}").alias("end"), point("").alias("from"), point("next_").alias("to"))


def densified(boxes: DataFrame, frames: DataFrame, keys: list[str], time: str = "time_ns") -> DataFrame:
    """Each different box of a scene at every frame of it: ``boxes`` without their times, once each, by ``frames`` (keys, time)."""
    own = boxes.select(*[c for c in boxes.columns if c != time]).distinct()
    return own.join(frames.select(*keys, time).distinct(), keys)


def scene_bounds(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, z, distance): middle of the upright bounds of all boxes, and from how far away all of it is seen: one and a half
    times the longest side, three at least."""
    from ..functions.geometry import box_bounds
    from .spatial import BOX

    ends = boxes.withColumns(box_bounds(*[F.col(c) for c in BOX])).groupBy(*keys).agg(*[f(f"{n}_{a}").alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    side = F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"])
    return ends.select(*keys, *[((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2).alias(a) for a in "xyz"], F.greatest(1.5 * side, F.lit(3.0)).alias("distance"))


def overlay_depths(df: DataFrame, depth: str = "depth", valid: str | None = None, least: float = 0.1, most: float = 10.0) -> DataFrame:
    """Rows whose depth can be shown over an image: valid and strictly between two limits."""
    shown = (F.col(depth) > least) & (F.col(depth) < most)
    return df.where(shown if valid is None else shown & F.col(valid))
