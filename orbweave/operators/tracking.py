"""Tracking objects over ordered frames: a keyed state machine that runs the same in a batch and on a stream.

A track is tentative until it has enough support, then active; it is inactive while it is not matched. A frame may come with a
camera and with points that were observed: then a track that was not matched is missed only if the camera sees its box and
enough points lie in it, and only tracks that were visible when last looked at are matched. A track that was missed too
often goes, the sooner the less sure its detections were; a tentative one goes two frames after it was last matched.

Frames of one scene are taken in order, one after the other: that order is what tracking is, so a scene is one task's work. Its
rows pass by in sorted batches and one frame is held at a time. Scenes are independent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.camera import numbers
from .greedy import assign
from .spatial import BOX, sampled_iou
from .views import box_views

TENTATIVE, ACTIVE, INACTIVE = 0, 1, 2
#: Kinds of rows in the order in which a frame's are taken: its camera, its points, its detections.
CAMERA, POINT, DETECTION = 0, 1, 2


@dataclass
class TrackerConfig:
    iou: float = 0.25
    min_hits: int = 3
    conf: float = 0.55
    ema: float = 0.0
    samples: int = 8
    max_missed: int = 30
    merge_iou: float = 0.5
    merge_iou_2d: float = 0.7
    merge_every: int = 5
    mass: float = 4.0
    merge_distance: float = 4.0
    min_points: int = 2
    edge_steps: int = 4
    seen_ratio: float = 1 / 6


@dataclass
class Track:
    track_id: int
    box: list[float]
    prob: float
    label: str
    weight: float
    state: int = TENTATIVE
    support: int = 1
    missed: int = 0
    first_frame: int = 0
    last_frame: int = 0
    visible: bool = True


@dataclass
class TrackerState:
    tracks: list[Track] = field(default_factory=list)
    next_id: int = 0

    def pack(self) -> dict:
        return asdict(self)

    @classmethod
    def unpack(cls, kept: dict) -> TrackerState:
        return cls([Track(**t) for t in kept["tracks"]], kept["next_id"])


@dataclass
class View:
    """What is known of a frame besides its detections: camera (``camera.numbers``) with pose (12 numbers), points (rows of x, y, z)."""

    camera: np.ndarray | None = None
    points: np.ndarray | None = None


def _half_turn(a: float, b: float) -> float:
    d = abs((a - b + math.pi) % (2 * math.pi) - math.pi)
    return math.pi - d if d > math.pi / 2 else d


def _turned_like(box: list[float], yaw: float) -> list[float]:
    """The box by the right angle, if any, that brings its yaw strictly nearer to another."""
    best = list(box)
    for turn in (math.pi / 2, -math.pi / 2):
        if _half_turn(box[6] + turn, yaw) < _half_turn(best[6], yaw) - 1e-12:
            best = [*box[:3], box[4], box[3], box[5], box[6] + turn]
    return best


def _mean_yaw(a: float, b: float, wa: float, wb: float) -> float:
    s, c = wa * math.sin(2 * a) + wb * math.sin(2 * b), wa * math.cos(2 * a) + wb * math.cos(2 * b)
    return 0.0 if math.hypot(s, c) < 1e-8 else math.atan2(s, c) / 2


def blend(old: list[float], new: list[float], wa: float, wb: float) -> list[float]:
    """Two boxes in one, by weight, after each took the right angle that brings it nearer to their mean direction."""
    wa, wb = wa / (wa + wb), wb / (wa + wb)
    mean = _mean_yaw(old[6], new[6], wa, wb)
    a, b = _turned_like(old, mean), _turned_like(new, mean)
    return [wa * x + wb * y for x, y in zip(a[:6], b[:6])] + [_mean_yaw(a[6], b[6], wa, wb)]


def _overlap(a: np.ndarray, b: np.ndarray, samples: int) -> np.ndarray:
    """Overlap of each box of one list with each of another; only those whose circles meet are sampled."""
    out = np.zeros((len(a), len(b)))
    i, j = np.nonzero(np.hypot(a[:, None, 0] - b[:, 0], a[:, None, 1] - b[:, 1]) <= (np.hypot(a[:, 3], a[:, 4])[:, None] + np.hypot(b[:, 3], b[:, 4])) / 2)
    if len(i):
        out[i, j] = sampled_iou(a[i], b[j], samples)
    return out


def _oriented(boxes: np.ndarray) -> np.ndarray:
    """Rows of BOX as rows of centre, size and rotation."""
    c, s, zero = np.cos(boxes[:, 6]), np.sin(boxes[:, 6]), np.zeros(len(boxes))
    return np.column_stack([boxes[:, :6], c, -s, zero, s, c, zero, zero, zero, zero + 1])


def image_boxes(boxes: np.ndarray, camera: np.ndarray, steps: int, ratio: float, degrees: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Sides (x_min, x_max, y_min, y_max) and validity of the image boxes of many boxes for one camera."""
    rows = np.repeat(camera[None], len(boxes), 0)
    *sides, _, valid = box_views(_oriented(boxes), rows[:, 21:], rows[:, :21], steps, ratio, degrees)
    return np.stack(sides, 1), valid


def points_inside(boxes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many points lie strictly in each box."""
    c, s = np.cos(boxes[:, 6])[:, None], np.sin(boxes[:, 6])[:, None]
    dx, dy, dz = (points[:, i] - boxes[:, i : i + 1] for i in range(3))
    return ((np.abs(c * dx + s * dy) < boxes[:, 3:4] / 2) & (np.abs(c * dy - s * dx) < boxes[:, 4:5] / 2) & (np.abs(dz) < boxes[:, 5:6] / 2)).sum(1)


class Tracker:
    def __init__(self, config: TrackerConfig | None = None, state: TrackerState | None = None):
        self.config, self.state = config or TrackerConfig(), state or TrackerState()

    def update(self, frame: int, detections: list[dict], view: View | None = None) -> list[Track]:
        """Take one frame's detections (box, prob, label); gives the tracks that are active or inactive."""
        cfg, st, view = self.config, self.state, view or View()
        found = [d for d in detections if d["prob"] >= cfg.conf]
        known, matched = list(st.tracks), self._match(found, frame)
        taken = set(matched.values())
        for y, d in enumerate(found):
            if y not in taken:
                st.tracks.append(Track(st.next_id, list(d["box"]), d["prob"], d["label"], d["prob"], first_frame=frame, last_frame=frame))
                st.next_id += 1
        if known:
            self._age([t for t in known if t.track_id not in matched], frame, view)
            st.tracks = [t for t in st.tracks if not self._gone(t, frame)]
            if found and (cfg.merge_every <= 1 or frame % cfg.merge_every == 0):
                self._merge(view)
        return [t for t in st.tracks if t.state != TENTATIVE]

    def _match(self, found: list[dict], frame: int) -> dict[int, int]:
        """Place of the detection that each matched track took. Tracks out of view take none."""
        looked = [t for t in self.state.tracks if t.visible]
        if not found or not looked:
            return {}
        iou = _overlap(np.array([t.box for t in looked]), np.array([d["box"] for d in found]), self.config.samples)
        cost = np.where(iou >= self.config.iou, 1 - iou, 1e6)
        pairs = {looked[x].track_id: y for x, y in assign(cost) if cost[x, y] < 1}
        for t in looked:
            if t.track_id in pairs:
                self._see(t, found[pairs[t.track_id]], frame)
        return pairs

    def _see(self, t: Track, d: dict, frame: int) -> None:
        cfg, w = self.config, d["prob"]
        heavy = t.weight >= cfg.mass  # the weight before this frame decides
        t.support, t.last_frame, t.missed, t.visible = t.support + 1, frame, 0, True
        if t.state == INACTIVE or t.state == TENTATIVE and (t.support >= cfg.min_hits or heavy):
            t.state = ACTIVE
        old, new = (1 - cfg.ema, cfg.ema) if cfg.ema > 0 else (t.weight, w)
        t.box = blend(t.box, d["box"], old, new)
        t.prob = (old * t.prob + new * w) / (old + new)
        t.label = d["label"] if w >= t.weight else t.label
        t.weight += w

    def _age(self, tracks: list[Track], frame: int, view: View) -> None:
        """Tracks that were not matched: missed if they should have been seen. Without a camera or points, all should."""
        if not tracks:
            return
        cfg, boxes = self.config, np.array([t.box for t in tracks])
        seen = np.ones(len(tracks), bool)
        if view.camera is not None:
            seen &= image_boxes(boxes, view.camera, cfg.edge_steps, cfg.seen_ratio, None)[1]
        if view.points is not None:
            seen &= points_inside(boxes, view.points) >= cfg.min_points
        for t, visible in zip(tracks, seen.tolist()):
            if t.state == ACTIVE and frame > t.last_frame:
                t.state = INACTIVE
            t.visible = visible
            t.missed += visible

    def _gone(self, t: Track, frame: int) -> bool:
        if t.missed >= int(self.config.max_missed * (0.5 + t.weight / max(t.support, 1))):
            return True
        return t.state == TENTATIVE and frame - t.last_frame >= 2

    def _merge(self, view: View) -> None:
        """Of two settled tracks that overlap, in space or in the image, one of them visible, the lighter is absorbed.

        Overlaps are those from before the first merge. Pairs are taken in order: visible tracks, for each all that are
        near a visible one.
        """
        cfg = self.config
        settled = [t for t in self.state.tracks if t.state != TENTATIVE]
        looked = [t for t in settled if t.visible]
        if cfg.merge_iou <= 0 or not looked:
            return
        a, b = np.array([t.box for t in looked]), np.array([t.box for t in settled])
        near = np.linalg.norm(a[:, None, :3] - b[:, :3], axis=2).min(0) <= cfg.merge_distance
        settled = [t for t, n in zip(settled, near) if n or t.visible]
        b = np.array([t.box for t in settled])
        overlap = _overlap(a, b, cfg.samples) >= cfg.merge_iou
        if view.camera is not None and cfg.merge_iou_2d > 0:
            overlap |= self._image_overlap([settled.index(t) for t in looked], b, view) >= cfg.merge_iou_2d
        gone: set[int] = set()
        for i, one in enumerate(looked):
            for j in np.flatnonzero(overlap[i]):
                other = settled[j]
                if one.track_id in gone:
                    break
                if other is one or other.track_id in gone:
                    continue
                keep, drop = (one, other) if one.weight >= other.weight else (other, one)
                keep.box = blend(keep.box, drop.box, keep.weight, drop.weight)
                keep.prob = (keep.weight * keep.prob + drop.weight * drop.prob) / (keep.weight + drop.weight)
                keep.weight += drop.weight
                keep.support += drop.support
                keep.first_frame, keep.last_frame = min(keep.first_frame, drop.first_frame), max(keep.last_frame, drop.last_frame)
                gone.add(drop.track_id)
        self.state.tracks = [t for t in self.state.tracks if t.track_id not in gone]

    def _image_overlap(self, looked: list[int], boxes: np.ndarray, view: View) -> np.ndarray:
        """Overlap of the image boxes around corners; 0 where one is not valid."""
        sides, valid = image_boxes(boxes, view.camera, 1, self.config.seen_ratio, 140.0)
        a, b = sides[looked][:, None], sides[None]
        w = np.clip(np.minimum(a[..., 1], b[..., 1]) - np.maximum(a[..., 0], b[..., 0]), 0, None)
        h = np.clip(np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 2], b[..., 2]), 0, None)
        area = lambda x: (x[..., 1] - x[..., 0]) * (x[..., 3] - x[..., 2])
        iou = w * h / (area(a) + area(b) - w * h + 1e-8)
        return np.where(valid[looked][:, None] & valid[None], iou, 0)


FIELDS = "frame_id long, track_id long, state int, label string, prob double, support long, missed long, tx double, ty double, tz double, sx double, sy double, sz double, yaw double"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def events(detections: DataFrame, frames: DataFrame | None = None, points: DataFrame | None = None, scene: str = "scene_id") -> DataFrame:
    """Rows (scene, frame_id, kind, det_id, label, prob, v) of all that is known of frames, for tracking.

    ``frames``: scene, frame_id, ``camera``, ``pose`` (of the camera in the world); a frame without detections is a row here.
    ``points``: scene, frame_id, x, y, z. The frames of a scene are those of detections and ``frames``; points of others are
    left out only when tracked, as they come to no frame.
    """
    none = [F.lit(None).cast(t).alias(n) for n, t in (("det_id", "long"), ("label", "string"), ("prob", "double"))]
    own = [F.col("det_id").cast("long").alias("det_id"), F.col("label").cast("string").alias("label"), F.col("prob").cast("double").alias("prob")]
    row = lambda df, kind, named, v: df.select(F.col(scene), F.col("frame_id").cast("long").alias("frame_id"), F.lit(kind).alias("kind"), *named, F.array(*[x.cast("double") for x in v]).alias("v"))
    out = row(detections, DETECTION, own, [F.col(c) for c in BOX])
    if frames is not None:
        item = lambda c, n: [F.get(F.col(c), F.lit(i)) for i in range(n)]
        out = out.unionByName(row(frames, CAMERA, none, [*numbers(F.col("camera")), *item("pose.r", 9), *item("pose.t", 3)]))
    if points is not None:
        out = out.unionByName(row(points, POINT, none, [F.col(c) for c in "xyz"]))
    return out


ORDER = ("frame_id", "kind", "det_id")


class Feed:
    """Rows of one scene in order, gathered into frames and handed to its tracker; ``with_points`` tells a frame without points from one of which none are known."""

    def __init__(self, tracker: Tracker, with_points: bool):
        self.tracker, self.with_points, self.frame, self.rows = tracker, with_points, None, []

    def add(self, frame: int, part: pd.DataFrame) -> Iterator[tuple]:
        if frame != self.frame:
            yield from self.close()
            self.frame = frame
        self.rows.append(part)

    def close(self) -> Iterator[tuple]:
        if not self.rows:
            return
        rows, self.rows = self.rows, []
        kind, v, prob, label = (np.concatenate([r[c].to_numpy() for r in rows]) for c in ("kind", "v", "prob", "label"))
        cameras, points, found = (np.flatnonzero(kind == k) for k in (CAMERA, POINT, DETECTION))
        if len(cameras) or len(found):
            seen = np.array(v[points].tolist(), float).reshape(-1, 3) if self.with_points else None
            view = View(np.array(v[cameras[0]], float) if len(cameras) else None, seen)
            boxes = [{"box": list(map(float, v[i])), "prob": float(prob[i]), "label": label[i]} for i in found]
            yield from track_rows(self.frame, self.tracker.update(self.frame, boxes, view))


def track_rows(frame: int, tracks: list[Track]) -> list[tuple]:
    return [(frame, t.track_id, t.state, t.label, t.prob, t.support, t.missed, *t.box) for t in tracks]


def fed(feed: Feed, rows: pd.DataFrame) -> list[tuple]:
    """What comes of sorted rows of one scene."""
    out = []
    starts = np.flatnonzero(np.diff(rows.frame_id.to_numpy(), prepend=rows.frame_id.iloc[0] - 1)) if len(rows) else []
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        out += feed.add(int(rows.frame_id.iloc[a]), rows.iloc[a:b])
    return out


def track(detections: DataFrame, config: TrackerConfig | None = None, scene: str = "scene_id", frames: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """Tracks after each frame of each scene; see ``events`` for ``frames`` and ``points``."""
    kind, with_points = detections.schema[scene].dataType.simpleString(), points is not None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feed, now, out = None, None, []

        def done() -> Iterator[pd.DataFrame]:
            if out:
                yield pd.DataFrame(out, columns=[scene, *_NAMES])
                out.clear()

        for part in parts:
            starts = np.flatnonzero((part[scene] != part[scene].shift()).to_numpy())
            for a, b in zip(starts, [*starts[1:], len(part)]):
                key = part[scene].iloc[a]
                if feed is None or key != now:
                    if feed is not None:
                        out += [(now, *t) for t in feed.close()]
                    feed, now = Feed(Tracker(config), with_points), key
                out += [(now, *t) for t in fed(feed, part.iloc[a:b])]
            yield from done()
        if feed is not None:
            out += [(now, *t) for t in feed.close()]
        yield from done()

    rows = events(detections, frames, points, scene).where(F.col(scene).isNotNull())
    return rows.repartition(scene).sortWithinPartitions(scene, *ORDER).mapInPandas(run, f"`{scene}` {kind}, {FIELDS}")
