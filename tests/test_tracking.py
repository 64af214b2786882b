"""Tracking with cameras and points: what is out of view or hidden is not missed, and the stream tells the same as the batch."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import camera, geometry
from orbweave.operators import tracking
from orbweave.operators.tracking import ACTIVE, INACTIVE, TENTATIVE, Tracker, TrackerConfig, View
from orbweave.plans.spaces import lits
from orbweave.streaming.tracker import track_stream
from tests.test_fusion import SCHEMA, det

AHEAD, BEHIND = (1, 0, 0, 0, 0, 1, 0, -1, 0), (-1, 0, 0, 0, 0, -1, 0, -1, 0)  # rotations whose third column looks along y, or against it


def view(turn=AHEAD, at=(0, 0, 0), points=None):
    pinhole = [1, 320, 240, 200, 200, 160, 120, 400, 400] + [0] * 12
    return View(np.array([*pinhole, *turn, *at], float), None if points is None else np.array(points, float).reshape(-1, 3))


def found(y=5.0, x=0.0, prob=0.8, size=(1, 1, 1), label="chair", yaw=0.0):
    return {"box": [x, y, 0.0, *map(float, size), yaw], "prob": prob, "label": label}


def settled(*boxes, config=None):
    """A tracker after three frames of the same detections."""
    t = Tracker(config or TrackerConfig(max_missed=4))
    for frame in (1, 2, 3):
        t.update(frame, list(boxes))
    assert [x.state for x in t.state.tracks] == [ACTIVE] * len(boxes)
    return t


OTHER = found(y=40.0, x=9.0, prob=0.9)  # so that frames are not empty


def test_tracks_out_of_view_do_not_age():
    seen, unseen = settled(found()), settled(found())
    for frame in range(4, 40):
        seen.update(frame, [OTHER], view(points=[(0, 5, 0), (0.1, 5, 0)]))
        unseen.update(frame, [OTHER], view(BEHIND, points=[(0, 5, 0), (0.1, 5, 0)]))
    assert 0 not in {t.track_id for t in seen.state.tracks}
    first = unseen.state.tracks[0]
    assert (first.track_id, first.state, first.missed, first.visible) == (0, INACTIVE, 0, False)


def test_hidden_tracks_do_not_age():
    t = settled(found())
    for frame in range(4, 40):
        t.update(frame, [], view(points=[(0, 5, 0), (0, 5.5, 0), (0, 3, 0)]))  # one strictly inside
    assert (t.state.tracks[0].missed, t.state.tracks[0].visible) == (0, False)
    t.update(40, [found()], view())  # a track that was not visible takes no detection
    assert [x.track_id for x in t.state.tracks] == [0, 1]


@pytest.mark.parametrize("prob", [0.6, 0.9])
def test_patience_follows_the_mean_probability(prob):
    t = settled(found(prob=prob), config=TrackerConfig(max_missed=10))
    frame = 3
    while t.state.tracks:
        frame += 1
        t.update(frame, [], view())
    assert frame - 3 == int(10 * (0.5 + prob))


def test_tentative_tracks_go_two_frames_after_their_last_match():
    t = Tracker()
    t.update(1, [found()])
    t.update(2, [OTHER])
    assert [(x.state, x.last_frame) for x in t.state.tracks] == [(TENTATIVE, 1), (TENTATIVE, 2)]
    t.update(3, [OTHER])
    assert [x.track_id for x in t.state.tracks] == [1]
    heavy = Tracker(TrackerConfig(mass=0.7))
    heavy.update(1, [found()])
    assert [x.state for x in heavy.update(2, [found()])] == [ACTIVE]


def test_labels_follow_the_heavier_side():
    t = Tracker()
    t.update(1, [found(prob=0.6, label="a")])
    t.update(2, [found(prob=0.7, label="b")])
    assert t.state.tracks[0].label == "b"
    t.update(3, [found(prob=0.9, label="c")])
    assert t.state.tracks[0].label == "b" and t.state.tracks[0].weight == pytest.approx(2.2)


def test_boxes_that_cover_each_other_in_the_image_are_one():
    config = TrackerConfig(max_missed=30, merge_every=5)
    near, far = found(y=5.0, size=(1, 0.2, 1)), found(y=5.5, size=(1.1, 0.2, 1.1), prob=0.7)
    apart, together = settled(near, far, config=config), settled(near, far, config=config)
    apart.update(5, [near, far])
    together.update(5, [near, far], view())
    assert len(apart.state.tracks) == 2
    (one,) = together.state.tracks
    assert (one.track_id, one.support, one.first_frame, one.last_frame) == (0, 8, 1, 5) and one.weight == pytest.approx(4 * 0.8 + 4 * 0.7)
    assert one.box[1] == pytest.approx((3.2 * 5 + 2.8 * 5.5) / 6)
    away = settled(near, far, config=config)
    away.update(5, [near, far], view(BEHIND))  # not valid in the image
    assert len(away.state.tracks) == 2


def test_a_heavier_track_out_of_view_absorbs_a_visible_one():
    t = settled(found(x=0.0), found(x=30.0), config=TrackerConfig(merge_every=5))
    first, second = t.state.tracks
    first.visible, second.box[0] = False, 0.05
    first.weight = 9.0
    t.update(5, [found(x=0.05)])
    assert [x.track_id for x in t.state.tracks] == [0]


def test_blend_turns_both_boxes_to_their_mean():
    box = tracking.blend([0, 0, 0, 2, 1, 1, 0.0], [0, 0, 0, 1, 2, 1, math.pi / 2 - 0.1], 3, 1)
    assert box[3:6] == pytest.approx([2, 1, 1]) and box[6] == pytest.approx(-0.025, abs=1e-3)


def walk():
    """A scene whose camera turns away and back, with frames that have no detection."""
    rows, frames, points, n = [], [], [], 0
    for scene in (0, 1):
        for f in range(1, 21):
            turn = BEHIND if 8 <= f <= 14 else AHEAD
            frames.append((scene, f, list(map(float, turn))))
            for k in range(3):
                if turn is AHEAD and (f + k + scene) % 5 and f != 16:
                    rows.append((n, scene, f, "chair", 0.8, 2.0 * k - 2, 6.0, 0.0, 1.0, 1.0, 1.0, 0.1 * k))
                    n += 1
                points += [(scene, f, 2.0 * k - 2 + d, 6.0, 0.0) for d in (0.0, 0.1, 0.2)][: 3 if k else 1]
    return rows, frames, points


ROW = "det_id long, scene_id long, frame_id long, label string, prob double, tx double, ty double, tz double, sx double, sy double, sz double, yaw double"
FRAME, POINTS = "scene_id long, frame_id long, turn array<double>", "scene_id long, frame_id long, x double, y double, z double"


def framed(df):
    return df.select("scene_id", "frame_id", camera.camera(lits(200, 200, 160, 120), F.lit(320), F.lit(240)).alias("camera"), geometry.pose(F.col("turn"), lits(0, 0, 0)).alias("pose"))


def key(rows):
    return sorted((r.scene_id, r.frame_id, r.track_id, r.state, r.support, r.missed, round(r.tx, 6)) for r in rows)


def test_stream_of_three_kinds_equals_batch_and_plain_calls(spark, tmp_path):
    rows, frames, points = walk()
    tables = {"rows": (rows, ROW, 2), "frames": (frames, FRAME, 1), "points": (points, POINTS, 1)}
    whole = {n: spark.createDataFrame(d, s) for n, (d, s, _) in tables.items()}
    batch = key(tracking.track(whole["rows"], frames=framed(whole["frames"]), points=whole["points"]).collect())
    plain = []
    for scene in (0, 1):
        t = Tracker()
        for _, f, turn in [x for x in frames if x[0] == scene]:
            boxes = [{"box": list(r[5:]), "prob": r[4], "label": r[3]} for r in rows if r[1:3] == (scene, f)]
            out = t.update(f, boxes, view(turn, points=[p[2:] for p in points if p[:2] == (scene, f)]))
            plain += [(scene, f, x.track_id, x.state, x.support, x.missed, round(x.box[0], 6)) for x in out]
    assert batch == sorted(plain) and any(x[3] == INACTIVE for x in batch)
    pieces = {}
    for n, (data, schema, at) in tables.items():
        for part, last in enumerate((9, 20)):
            own = [d for d in data if (0 if part == 0 else 9) < d[at] <= last]
            spark.createDataFrame(own, schema).coalesce(1).write.json(str(tmp_path / n / str(part)))
        pieces[n] = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / n / "*"))
    q = track_stream(pieces["rows"], frames=framed(pieces["frames"]), points=pieces["points"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert key(spark.read.parquet(str(tmp_path / "out")).collect()) == batch


def test_rows_that_are_no_use(spark):
    none = spark.createDataFrame([], ROW)
    assert tracking.track(none).count() == 0
    rows = spark.createDataFrame([det(1, 0.0, frame=1)], SCHEMA)
    assert tracking.track(rows, points=spark.createDataFrame([], POINTS)).count() == 0  # tentative
