"""What cameras see: depth of points by patches of an image, points from depth images, depth images from files.

Frames are rows with a camera (see ``functions.camera.camera``) and the camera's pose in the world; points are x, y, z.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.camera import numbers, seen_pixels, with_pixels
from ..functions.geometry import pose_apply, vec
from .fuse import lower_median

#: The depth of a patch that no point falls in.
NO_DEPTH = -1.0


def _seen_from(df: DataFrame, pose: str, point: tuple[str, str, str], names: tuple[str, str, str] = ("_x", "_y", "_z")) -> DataFrame:
    """Add the points of three columns as a camera with a pose in the world sees them. Their places are taken relative to the
    camera before they are turned, so no digits are lost far from the origin."""
    rel = {f"_d{i}": F.col(n) - F.col(f"{pose}.t")[i] for i, n in enumerate(point)}
    turn = lambda j: sum(F.col(f"{pose}.r")[3 * i + j] * F.col(f"_d{i}") for i in range(3))
    return df.withColumns(rel).withColumns({n: turn(j) for j, n in enumerate(names)}).drop(*rel)


#: Points of boxes that are projected together.
BLOCK_POINTS = 1 << 20


@lru_cache(maxsize=32)
def _edge_grid(steps: int) -> np.ndarray:
    """Points of a unit cube about the origin: ``steps`` on each edge, or the corners for up to two."""
    ends = (-0.5, 0.5)
    if steps <= 2:
        return np.array(list(product(ends, ends, ends)))
    line = np.linspace(-0.5, 0.5, steps)
    return np.array([np.insert((a, b), axis, at) for axis in range(3) for a in ends for b in ends for at in line])


def box_views(boxes: np.ndarray, poses: np.ndarray, cams: np.ndarray, steps: int, ratio: float, degrees: float | None) -> list[np.ndarray]:
    """Sides, number of points seen and validity of the image boxes of many boxes (rows of centre, size, rotation)."""
    world = np.einsum("pij,nj,pj->pni", boxes[:, 6:].reshape(-1, 3, 3), _edge_grid(steps), boxes[:, 3:6]) + (boxes[:, None, :3] - poses[:, None, 9:])
    u, v, valid = seen_pixels(np.einsum("pji,pnj->pni", poses[:, :9].reshape(-1, 3, 3), world), cams, degrees)
    points, sides = valid.sum(1), []
    for x, most in ((u, cams[:, 1] - 1), (v, cams[:, 2] - 1)):
        sides += [np.where(valid, x, np.inf).min(1), np.where(valid, x, -np.inf).max(1)]
    full = (sides[0] < sides[1]) & (sides[2] < sides[3]) & (points >= 12 * steps * ratio)
    for i, most in enumerate((cams[:, 1], cams[:, 1], cams[:, 2], cams[:, 2])):
        clamped = np.where(cams[:, 0] == 1, np.clip(sides[i], 0, most - 1), sides[i])
        sides[i] = np.where(points > 0, clamped, np.nan)
    return [*sides, points, full]


def box_edge_points(df: DataFrame, keys: list[str], box: tuple[str, str, str], steps: int, pos: str | None = None) -> DataFrame:
    """(keys, x, y, z), with ``pos`` also each point's place: the points of ``_edge_grid`` of each box as rows; for three points an edge or more as ``edge_points`` orders them.

    The points of a cube are one constant array, so a box's are plain sums of generated code, not nested array functions.
    """
    grid = F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("abc", p)]) for p in _edge_grid(steps)])
    center, size, turn = (F.col(c) for c in box)
    flat = {f"_s{i}": size[i] for i in range(3)} | {f"_c{i}": center[i] for i in range(3)} | {f"_r{i}": turn[i] for i in range(9)}
    rows = df.select(*keys, *[c.alias(n) for n, c in flat.items()]).select("*", *([F.posexplode(grid).alias(pos, "_e")] if pos else [F.explode(grid).alias("_e")]))
    keys = [*keys, *([pos] if pos else [])]
    part = lambda j, i: F.col(f"_r{3 * j + i}") * F.col(f"_e.{'abc'[i]}") * F.col(f"_s{i}")
    return rows.select(*keys, *[sum((part(j, i) for i in range(3)), F.col(f"_c{j}")).alias(n) for j, n in enumerate("xyz")])  # from the left, as SQL adds them


def with_projected_boxes(df: DataFrame, box: tuple[str, str, str], cam: str, pose: str, steps: int = 1, ratio: float = 1 / 6, degrees: float | None = 140.0, name: str = "bb2") -> DataFrame:
    """Add struct<x_min, x_max, y_min, y_max, points, valid>: the image box around the points of each box's edges that a camera sees.

    A row has a box (columns of centre, size and rotation), a camera and its pose in the world. ``steps`` points an edge, or
    the corners for up to two. A box is valid if it is not empty and at least a ``ratio`` of 12 x steps points are seen. A
    pinhole's box is clamped to the image. Where no point is seen the sides are null; a row with a null has null sides
    too. Rows stay where they are: Arrow batches, no shuffle.
    """

    @F.pandas_udf("x_min double, x_max double, y_min double, y_max double, points int, valid boolean")
    def seen(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        names, rows = ["x_min", "x_max", "y_min", "y_max", "points", "valid"], max(1, BLOCK_POINTS // len(_edge_grid(steps)))
        for columns in parts:
            values = np.stack([c.to_numpy(float) for c in columns], 1)
            blocks = [values[i : i + rows] for i in range(0, len(values), rows)]
            found = [box_views(x[:, :15], x[:, 15:27], x[:, 27:], steps, ratio, degrees) for x in blocks]
            out = pd.DataFrame({n: np.concatenate([f[i] for f in found]) if found else [] for i, n in enumerate(names)})
            yield out.assign(**{n: out[n].astype(object).where(out[n].notna(), None) for n in names[:4]}) if out["x_min"].isna().any() else out

    item = lambda c, n: [F.get(c, F.lit(i)) for i in range(n)]
    placed = [*item(F.col(box[0]), 3), *item(F.col(box[1]), 3), *item(F.col(box[2]), 9), *item(F.col(f"{pose}.r"), 9), *item(F.col(f"{pose}.t"), 3)]
    return df.withColumn(name, seen(*placed, *numbers(F.col(cam))))


def patch_depths(points: DataFrame, frames: DataFrame, keys: list[str], width: int, height: int, patch: int) -> DataFrame:
    """(keys, patch_row, patch_column, depth): median over a patch's pixels of the mean depth of the points seen in each.

    ``frames``: keys, ``camera``, ``pose``; ``points``: keys, x, y, z, and ``camera`` and ``pose`` if they have met their frames
    before. Pixels are rounded half to even; "median" is the lower one of two. Every patch of every frame has a row. Points
    are summed by pixel before they are shuffled, and pixels by patch after, so a frame with very many points is a row for
    each of its pixels at most. Points that were made in partitions by keys stay there. No side is broadcast: Spark's estimate
    of a table's size knows nothing of rows that were exploded.
    """
    if width % patch or height % patch:
        raise ValueError(f"a {width} x {height} image has no whole patches of {patch}")
    if "camera" not in points.columns:
        points = points.select(*keys, "x", "y", "z").join(frames.select(*keys, "camera", "pose").hint("merge"), keys)
    met = _seen_from(points.select(*keys, "x", "y", "z", "camera", "pose"), "pose", ("x", "y", "z"))
    met = with_pixels(met, "camera", ("_x", "_y", "_z"), "_q").where("_q.valid")
    pixel = lambda c, most: F.greatest(F.lit(0), F.least(F.rint(F.col(f"_q.{c}")).cast("int"), F.lit(most - 1))).alias(f"_{c}")
    pixels = met.groupBy(*keys, pixel("u", width), pixel("v", height)).agg(F.avg("_z").alias("_z"))
    at = lambda c: F.floor(F.col(f"_{c}") / patch).cast("int")
    found = pixels.groupBy(*keys, at("v").alias("patch_row"), at("u").alias("patch_column")).agg(lower_median("_z").alias("depth"))
    grid = frames.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(height // patch - 1))).alias("patch_row")).withColumn("patch_column", F.explode(F.sequence(F.lit(0), F.lit(width // patch - 1))))
    return grid.join(found.hint("merge"), [*keys, "patch_row", "patch_column"], "left").withColumn("depth", F.coalesce("depth", F.lit(NO_DEPTH)))


def stride(pixels: Column, wanted: int) -> Column:
    """The step over rows and columns that leaves about twice as many pixels as wanted."""
    return F.greatest(F.lit(1), F.floor(F.sqrt(pixels / (2.0 * wanted))).cast("int"))


def depth_points(images: DataFrame, keys: list[str], wanted: int = 10_000, seed: int = 0) -> DataFrame:
    """(keys, x, y, z) in the world: at most ``wanted`` points of each depth image.

    ``images``: keys, ``depth`` (array<double>, row by row, 0 where unknown), ``width``, ``height``, fx, fy, cx, cy, ``pose``. Pixels
    are taken at a stride and those without depth dropped; where too many are left, those of the least hash of their place
    and the frame's keys stay, so runs agree. One image is one row, so its points are sorted where they are.
    """
    step = stride(F.col("width") * F.col("height"), wanted)
    line = lambda n: F.sequence(F.lit(0), F.col(n) - 1, F.col("_step"))
    at = F.flatten(F.transform(line("height"), lambda v: F.transform(line("width"), lambda u: F.struct(u.alias("u"), v.alias("v"), F.get(F.col("depth"), v * F.col("width") + u).alias("z")))))
    held = images.withColumn("_step", step).withColumn("_at", F.filter(at, lambda p: p["z"] > 0))
    drawn = F.array_sort(F.transform("_at", lambda p: F.struct(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], p["u"], p["v"]).alias("h"), p.alias("p"))))
    few = F.when(F.size("_at") <= wanted, F.col("_at")).otherwise(F.transform(F.slice(drawn, 1, wanted), lambda d: d["p"]))
    rows = held.select(*keys, "fx", "fy", "cx", "cy", "pose", F.explode(few).alias("_p"))
    z = F.col("_p.z")
    world = pose_apply(F.col("pose"), vec((F.col("_p.u") - F.col("cx")) / F.col("fx") * z, (F.col("_p.v") - F.col("cy")) / F.col("fy") * z, z))
    return rows.withColumn("_w", world).select(*keys, *[F.col("_w")[i].alias(n) for i, n in enumerate("xyz")])


# -- depth images from files ---------------------------------------------------------------------------------------------

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def grey16(data: bytes) -> np.ndarray:
    """The pixels of a PNG image of one channel of 16 bits, not interlaced; ValueError for any other."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        elif kind == b"IEND":
            break
    if head is None or head[2:] != (16, 0, 0, 0, 0):
        raise ValueError("not one channel of 16 bits")
    width, height = head[:2]
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    except zlib.error as broken:
        raise ValueError("broken image data") from broken
    if len(raw) != height * (1 + 2 * width):
        raise ValueError("image data of another size")
    raw = raw.reshape(height, 1 + 2 * width)
    above, rows = np.zeros((width, 2), np.uint8), np.empty((height, width, 2), np.uint8)
    for y in range(height):
        rows[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:].reshape(width, 2), above)
    return rows.reshape(height, 2 * width).view(">u2").astype(np.uint16)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A row of pixels (two bytes each) before the image format's filter was applied."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, 0, dtype=np.uint8)
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise ValueError("unknown row filter")
    out = np.empty_like(row)
    left, corner = [0, 0], [0, 0]
    for x, (own, up) in enumerate(zip(row.tolist(), above.tolist())):
        for i in (0, 1):
            if kind == 3:
                guess = (left[i] + up[i]) >> 1
            else:
                whole = left[i] + up[i] - corner[i]
                guess = min((abs(whole - left[i]), 0, left[i]), (abs(whole - up[i]), 1, up[i]), (abs(whole - corner[i]), 2, corner[i]))[2]
            left[i] = own[i] + guess & 255
        corner = up
        out[x] = left
    return out


def decoded_depth(files: DataFrame, content: str = "content", width: int | None = None, height: int | None = None) -> DataFrame:
    """``files`` with ``width``, ``height``, ``depth`` (metres, row by row) and ``fault`` in place of the image's bytes.

    Bytes that are no 16-bit grey PNG, or of another size than asked for, have a fault and no depth; nothing is dropped. Images
    are decoded one by one from Arrow batches of few rows.
    """
    kept = [c for c in files.columns if c != content]
    schema = ", ".join([*[f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept], "width int, height int, depth array<float>, fault string"])

    def one(data: bytes | None) -> tuple:
        try:
            pixels = grey16(bytes(data or b""))
        except ValueError as fault:
            return None, None, None, str(fault)
        high, wide = pixels.shape
        if (width or wide, height or high) != (wide, high):
            return None, None, None, "image of another size"
        return wide, high, (pixels.astype(np.float32) / 1000).ravel(), None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(len(part)):
                row = part.iloc[i : i + 1]
                found = one(row[content].iloc[0])
                yield row[kept].assign(**{n: pd.Series([v], index=row.index, dtype=k) for n, v, k in zip(("width", "height", "depth", "fault"), found, ("Int32", "Int32", object, object))})

    return files.mapInPandas(run, schema)


def usable_pose(px: Column, py: Column, pz: Column, qw: Column, qx: Column, qy: Column, qz: Column) -> Column:
    """Whether a pose is finite and its quaternion long enough to be scaled to 1."""
    finite = F.lit(True)
    for c in (px, py, pz, qw, qx, qy, qz):
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
    return finite & (F.sqrt(qw * qw + qx * qx + qy * qy + qz * qz) > 1e-8)
