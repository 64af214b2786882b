"""Filters and simple projections over detections and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import sliced

# Classes that are structure, not objects.
STRUCTURE = ("floor", "wall", "shelter")


def confident(df: DataFrame, least: float, score: str = "prob") -> DataFrame:
    return df.where(F.col(score) >= least)


def clipped_boxes(df: DataFrame, width: int, height: int, min_area_ratio: float, margin: float) -> DataFrame:
    """Drop rectangles that are small or touch the image's margin, and clip the others to the image."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    large = (x2 - x1) * (y2 - y1) >= min_area_ratio * width * height
    inner = (x1 > margin) & (y1 > margin) & (x2 < width - margin) & (y2 < height - margin)
    clip = lambda c, top: F.greatest(F.lit(0.0), F.least(c, F.lit(float(top))))
    return df.where(large & inner).withColumns({"x1": clip(x1, width - 1), "y1": clip(y1, height - 1), "x2": clip(x2, width - 1), "y2": clip(y2, height - 1)})


def depth_filtered(boxes: DataFrame, patches: DataFrame, least: float = 0.4, most: float = 8.0) -> DataFrame:
    """Drop a box (frame_id, box_id, px1, py1, px2, py2 in patches) whose patches (frame_id, px, py, depth) all have a
    depth and lie all nearer than ``least`` or all farther than ``most``. With both limits at most 0 nothing is dropped."""
    if least <= 0 and most <= 0:
        return boxes
    d = F.col("depth")
    known = d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < float("inf"))
    p = patches.withColumnRenamed("frame_id", "_frame")
    met = boxes.select("frame_id", "box_id", "px1", "py1", "px2", "py2").join(p, (F.col("frame_id") == F.col("_frame")) & F.col("px").between(F.col("px1"), F.col("px2")) & F.col("py").between(F.col("py1"), F.col("py2")))
    bad = met.groupBy("frame_id", "box_id").agg(F.every(known).alias("known"), F.every(d < least).alias("near"), F.every(d > most).alias("far"))
    return boxes.join(bad.where("known and (near or far)").select("frame_id", "box_id"), ["frame_id", "box_id"], "left_anti")


def validated(df: DataFrame, projected: tuple[str, ...], detected: tuple[str, ...], min_iou: float = 0.5) -> DataFrame:
    """Keep rows whose projected box is there and overlaps the detected one by more than ``min_iou``."""
    from ..functions.geometry import iou_xyxy

    there = F.col(projected[0]).isNotNull()
    return df.where(there & (iou_xyxy(tuple(map(F.col, projected)), tuple(map(F.col, detected))) > min_iou))


def scored_3d(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Keep rows by their 3D score; the probability becomes the mean of both scores."""
    return df.where(F.col("score3d") >= least).withColumn("prob", (F.col("score2d") + F.col("score3d")) / 2)


def without_structure(df: DataFrame, label: str = "label", names: tuple[str, ...] = STRUCTURE) -> DataFrame:
    return df.where(~F.coalesce(F.lower(F.col(label)).isin(*names), F.lit(False)))


def not_large(df: DataFrame, most: float = 3.0) -> DataFrame:
    return df.where(F.greatest("sx", "sy", "sz") <= most)


def at_least_sized(df: DataFrame, least: float = 0.05) -> DataFrame:
    """Grow boxes about their centres to a least extent on each axis."""
    return df.withColumns({c: F.greatest(F.col(c), F.lit(float(least))) for c in ("sx", "sy", "sz")})


def keep_classes(df: DataFrame, ids: list[int], column: str = "sem_id") -> DataFrame:
    return df.where(F.col(column).isin(*ids))


def centre_in_radius(df: DataFrame, cx: float, cy: float, radius: float) -> DataFrame:
    u, v = (F.col("x1") + F.col("x2")) / 2 - cx, (F.col("y1") + F.col("y2")) / 2 - cy
    return df.where(u * u + v * v <= radius * radius)


def in_volume(df: DataFrame, low: tuple[float, ...], high: tuple[float, ...], border: float = 0.1) -> DataFrame:
    """Centres strictly inside a volume that is shrunk by a border."""
    return df.where(" and ".join(f"{c} > {a + border!r} and {c} < {b - border!r}" for c, a, b in zip(("tx", "ty", "tz"), low, high)))


def seen_large_enough(df: DataFrame, views: DataFrame, ratio: float, width: int, height: int) -> DataFrame:
    """Instances of which some view has both sides of at least ``ratio`` of the mean image side."""
    enough = views.where(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= ratio * (width + height) / 2)
    return df.join(enough.select("inst_id").distinct(), "inst_id", "left_semi")


def within_depth(df: DataFrame, camera: tuple[str, str, str], most: float) -> DataFrame:
    return df.where(F.sqrt(sum((F.col(a) - F.col(b)) ** 2 for a, b in zip(("tx", "ty", "tz"), camera))) <= most)


def valid_points(df: DataFrame) -> DataFrame:
    """Finite points that are not the origin."""
    x = [F.col(c) for c in ("x", "y", "z")]
    finite = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in x]
    return df.where(finite[0] & finite[1] & finite[2] & (F.abs(x[0]) + F.abs(x[1]) + F.abs(x[2]) > 1e-6))


def subsampled(df: DataFrame, time: str = "time_ns", skip: int = 1, start: int = 0, most: int | None = None) -> DataFrame:
    """Rows of every ``skip``-th of the distinct times from number ``start`` on, of which at most ``most`` count."""
    return sliced(df, time, ("start", start), ("most", most), ("every", skip))


def thinned(df: DataFrame, least_gap: int, key: str, time: str = "time_ns") -> DataFrame:
    """Keep a row if it comes at least so long after the last one kept in its key: a fold over sorted times."""
    fold = F.aggregate(
        F.array_sort(F.collect_set(time)), F.array().cast("array<bigint>"),
        lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= least_gap), F.concat(kept, F.array(t))).otherwise(kept),
    )
    kept = df.groupBy(key).agg(fold.alias("_kept")).select(key, F.explode("_kept").alias(time))
    return df.join(kept, [key, time], "left_semi")


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows, the same ones on every run: those with the smallest hashes of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def top_k(df: DataFrame, k: int, group: str, score: str, tie: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return df.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
