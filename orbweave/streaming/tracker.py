"""The tracker on a stream: state is kept per scene and survives restarts from the checkpoint."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import _NAMES, FIELDS, ORDER, Feed, Tracker, TrackerConfig, TrackerState, events, fed


def track_stream(detections: DataFrame, config: TrackerConfig | None = None, scene: str = "scene_id", frames: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """Tracks after each frame, as frames arrive. Frames of a scene must arrive in order, whole frames in one batch.

    Detections, frames (cameras and poses) and points are three streams, or tables of which a batch has its part; they are
    one keyed stream of events here, so a scene's tracks see all three.
    """
    kind, with_points = detections.schema[scene].dataType.simpleString(), points is not None

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        feed = Feed(Tracker(config, TrackerState.unpack(json.loads(state.get[0])) if state.exists else None), with_points)
        rows = pd.concat(list(parts), ignore_index=True).sort_values(list(ORDER), kind="stable")
        out = [*fed(feed, rows), *feed.close()]
        state.update((json.dumps(feed.tracker.state.pack()),))
        done = pd.DataFrame(out, columns=_NAMES)
        done.insert(0, scene, key[0])
        yield done

    return events(detections, frames, points, scene).groupBy(scene).applyInPandasWithState(run, f"`{scene}` {kind}, {FIELDS}", "state string", "append", GroupStateTimeout.NoTimeout)
