"""Incremental fusion as keyed state: a scene's components are entries of a map, and a batch reads and writes those it touches.

New boxes touch the components whose members' bounds meet theirs. Members of those and the new boxes are clustered and fused
anew, those of enough members are cleaned (suppression, absorption) together with what lies near them, and names pass on:
each old component votes for the cluster that holds most of its members, a cluster takes the least of its voters' ids and
the others become aliases. All other entries stay as they are, so a batch's share of the state store's log, and of the
change rows that come out, is in proportion to what it touched. Old versions of the state go as Spark's own checkpoints do.

State needs the RocksDB store (``STORE``). Rows of a scene's batch are held together: a batch is a few frames of a scene.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.greedy import absorb_contained, merge_constrained, suppress_instances
from ..operators.spatial import BOX, sampled_iou

#: To be set before a stream starts.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: A member of a component, as a list.
MEMBER = ("det_id", "frame_id", "label", "prob", *BOX)


@dataclass
class FusionConfig:
    conf: float = 0.55
    iou: float = 0.2
    min_detections: int = 4
    nms: float | None = 0.4
    contained: float = 0.8
    samples: int = 8


def _half_turn(a: np.ndarray, b: float) -> np.ndarray:
    d = np.abs((a - b + math.pi) % (2 * math.pi) - math.pi)
    return np.where(d > math.pi / 2, math.pi - d, d)


def _mean_yaw(yaw: np.ndarray, weight: np.ndarray) -> float:
    s, c = (weight * np.sin(2 * yaw)).sum(), (weight * np.cos(2 * yaw)).sum()
    return 0.0 if math.hypot(s, c) < 1e-8 else math.atan2(s, c) / 2


def _lower_median(v: np.ndarray) -> np.ndarray:
    return np.sort(v, 0)[(len(v) - 1) // 2]


def fused_box(members: list[list]) -> dict:
    """One box for the members of a cluster, as ``operators.fuse.fuse_members`` makes it with robust weights."""
    members = sorted(members)
    prob, v = np.array([m[3] for m in members], float), np.array([m[4:] for m in members], float)
    ref = _mean_yaw(v[:, 6], prob)
    up, down = v[:, 6] + math.pi / 2, v[:, 6] - math.pi / 2
    best = np.where(_half_turn(up, ref) < _half_turn(down, ref), up, down)
    turn = _half_turn(best, ref) < _half_turn(v[:, 6], ref)
    v[turn, 3], v[turn, 4] = v[turn, 4], v[turn, 3].copy()
    v[turn, 6] = best[turn]
    off = v[:, :6] - _lower_median(v[:, :6])
    away = np.stack([np.linalg.norm(off[:, :3], axis=1), np.linalg.norm(off[:, 3:], axis=1), _half_turn(v[:, 6], _mean_yaw(v[:, 6], np.ones(len(v))))], 1)
    score = (away / (1.4826 * np.maximum(_lower_median(away), 1e-6))).mean(1)
    weight = prob * np.where((len(v) <= 2) | (score <= 2.5), 1.0, 2.5 / np.maximum(score, 1e-12))
    weight = weight / (weight.sum() + 1e-8)
    votes: dict[Any, list] = {}
    for m, w in zip(members, weight):
        kept = votes.setdefault(m[2], [0.0, m[0]])
        kept[0] += w
    label = min(votes, key=lambda x: (-round(votes[x][0], 9), votes[x][1]))
    box = dict(zip(BOX, [*(weight[:, None] * v[:, :6]).sum(0).tolist(), _mean_yaw(v[:, 6], weight)]))
    return {**box, "prob": float((weight * prob).sum()), "label": label, "support_count": len(members), "members": [m[0] for m in members]}


def each_bounds(boxes: list[list[float]]) -> np.ndarray:
    """Least x, y and z, then the greatest, of every box."""
    v = np.array(boxes, float).reshape(-1, 7)
    c, s = np.abs(np.cos(v[:, 6])), np.abs(np.sin(v[:, 6]))
    half = np.stack([v[:, 3] * c + v[:, 4] * s, v[:, 3] * s + v[:, 4] * c, v[:, 5]], 1) / 2
    return np.concatenate([v[:, :3] - half, v[:, :3] + half], 1)


def _around(bounds: np.ndarray) -> list[float]:
    return [*bounds[:, :3].min(0).tolist(), *bounds[:, 3:].max(0).tolist()]


def bounds_of(members: list[list]) -> list[float]:
    """Least and greatest x, y and z of boxes."""
    return _around(each_bounds([m[4:] for m in members]))


def _met(known: dict[int, list[float]], boxes: np.ndarray) -> list[int]:
    """Ids, in order, whose bounds meet those of any of some boxes."""
    ids = sorted(known)
    if not ids or not len(boxes):
        return []
    own, hit = np.array([known[i] for i in ids]), np.zeros(len(ids), bool)
    for at in range(0, len(boxes), 1024):
        b = boxes[None, at : at + 1024]
        hit |= ((own[:, None, :3] <= b[..., 3:]) & (b[..., :3] <= own[:, None, 3:])).all(2).any(1)
    return [i for i, h in zip(ids, hit) if h]


class SceneFusion:
    """One scene's components in mappings that the caller keeps: bounds, contents and aliases by stable id, and the next id.

    ``bounds`` is read whole in each batch (six numbers a component); contents of touched components only.
    """

    def __init__(self, config: FusionConfig, bounds: MutableMapping, contents: MutableMapping, aliases: MutableMapping, next_id: int = 0):
        self.config, self.bounds, self.contents, self.aliases, self.next_id = config, bounds, contents, aliases, next_id

    def update(self, new: list[list]) -> list[tuple[int, dict | None]]:
        """Take new members; gives the components that changed, None for those that are gone."""
        cfg = self.config
        new = [m for m in new if m[3] is not None and m[3] >= cfg.conf]
        if not new:
            return []
        known = dict(self.bounds.items())
        hit = _met(known, each_bounds([m[4:] for m in new]))
        old = {i: self.contents[i] for i in hit}
        held = {m[0]: m for m in [*new, *(m for x in old.values() for m in x["all"])]}
        found = [fused_box([held[i] for i in ids]) for ids in self._clusters(list(held.values()))]
        near = self._cleaned_with(found, held, {i: b for i, b in known.items() if i not in old}, old)
        return self._named(near, held, old)

    def _clusters(self, members: list[list]) -> list[list]:
        """Ids by cluster: members of different frames that overlap, never two of one frame."""
        v = np.array([m[4:] for m in members], float)
        i, j = np.triu_indices(len(members), 1)
        frame = np.array([m[1] for m in members])
        ok = (frame[i] != frame[j]) & (np.hypot(v[i, 0] - v[j, 0], v[i, 1] - v[j, 1]) <= (np.hypot(v[i, 3], v[i, 4]) + np.hypot(v[j, 3], v[j, 4])) / 2)
        i, j = i[ok], j[ok]
        iou = sampled_iou(v[i], v[j], self.config.samples) if len(i) else np.zeros(0)
        ids = [m[0] for m in members]
        edges = [(ids[a], ids[b], o) for a, b, o in zip(i, j, iou.tolist()) if o >= self.config.iou]
        groups: dict = {}
        for node, root in merge_constrained(ids, {m[0]: m[1] for m in members}, edges).items():
            groups.setdefault(root, []).append(node)
        return [sorted(groups[k]) for k in sorted(groups)]

    def _cleaned_with(self, found: list[dict], held: dict, others: dict[int, list[float]], old: dict) -> list[dict]:
        """Fused clusters after suppression and absorption among those of enough members, untouched neighbours included.

        Untouched components were cleaned against each other before, so only those near a new confirmed one take part; they
        come first, by id. One that changes, or goes, joins ``old`` and its members ``held``.
        """
        cfg = self.config
        confirmed = [x for x in found if x["support_count"] >= cfg.min_detections]
        beside = _met(others, each_bounds([[x[c] for c in BOX] for x in confirmed]))
        contents = {i: self.contents[i] for i in beside}
        contents = {i: x for i, x in contents.items() if x["support_count"] >= cfg.min_detections}
        items = [{**x, "members": list(x["members"]), "was": i} for i, x in contents.items()] + confirmed
        items = suppress_instances(items, cfg.nms) if cfg.nms is not None else items
        items = absorb_contained(items, cfg.contained)
        same = {x["was"] for x in items if "was" in x and x["members"] == contents[x["was"]]["members"]}
        for i, x in contents.items():
            if i not in same:
                old[i] = x
                held.update({m[0]: m for m in x["all"]})
        return [x for x in found if x["support_count"] < cfg.min_detections and x not in confirmed] + [x for x in items if x.get("was") not in same]

    def _named(self, found: list[dict], held: dict, old: dict) -> list[tuple[int, dict | None]]:
        claims: list[list[int]] = [[] for _ in found]
        sets = [set(x["members"]) for x in found]
        for i in sorted(old):
            shared = [len(s & set(old[i]["members"])) for s in sets]
            if shared and max(shared):
                claims[shared.index(max(shared))].append(i)
        changes: dict[int, dict | None] = dict.fromkeys(old)
        for x, own in zip(found, claims):
            if own:
                name = own[0]
                for other in own[1:]:
                    self.aliases[other] = name
            else:
                name, self.next_id = self.next_id, self.next_id + 1
            x = {k: v for k, v in x.items() if k != "was"} | {"all": [held[m] for m in x["members"]]}
            changes[name] = x
        every, at = each_bounds([m[4:] for x in changes.values() if x is not None for m in x["all"]]), 0
        for name, x in changes.items():
            if x is None:
                del self.bounds[name], self.contents[name]
            else:
                self.bounds[name], self.contents[name] = _around(every[at : at + len(x["all"])]), x
                at += len(x["all"])
        return list(changes.items())


class _Stored(MutableMapping):
    """A map of the state store as a mapping; values are JSON."""

    def __init__(self, state: Any):
        self.state = state

    def __getitem__(self, key: int) -> Any:
        return json.loads(self.state.getValue((key,))[0])

    def __setitem__(self, key: int, value: Any) -> None:
        self.state.updateValue((key,), (json.dumps(value),))

    def __delitem__(self, key: int) -> None:
        self.state.removeKey((key,))

    def __iter__(self) -> Iterator[int]:
        return iter([k[0] for k in self.state.keys()])

    def items(self):
        return [(k[0], json.loads(v[0])) for k, v in self.state.iterator()]

    def __len__(self) -> int:
        return sum(1 for _ in self)


CHANGES = "version long, stable_id long, gone boolean, label string, prob double, support_count long, tx double, ty double, tz double, sx double, sy double, sz double, yaw double, members array<long>"


def _taken(scene: SceneFusion, rows: pd.DataFrame, version: int) -> Iterator[tuple]:
    """Change rows of the parts of a batch, one after the other."""
    for n, (_, part) in enumerate(rows.groupby("batch", sort=True), version + 1):
        members = [[int(a), int(b), c, float(p), *map(float, box)] for a, b, c, p, *box in part.sort_values("det_id")[list(MEMBER)].itertuples(index=False)]
        for name, x in scene.update(members):
            yield n, name, x is None, *([x[c] for c in ("label", "prob", "support_count", *BOX, "members")] if x else [None] * 11)


def _change_table(scene: str, key: Any, changes: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(changes, columns=[c.split()[0] for c in CHANGES.split(", ")])
    out.insert(0, scene, key)
    return out


class _Processor(StatefulProcessor):
    def __init__(self, config: FusionConfig, scene: str):
        self.config, self.scene = config, scene

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.maps = [_Stored(handle.getMapState(n, "id long", "value string")) for n in ("bounds", "contents", "aliases")]
        self.counters = handle.getValueState("counters", "next_id long, version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        next_id, version = self.counters.get() if self.counters.exists() else (0, 0)
        scene, whole = SceneFusion(self.config, *self.maps, next_id), pd.concat(list(rows), ignore_index=True)
        changes = list(_taken(scene, whole, version))
        self.counters.update((scene.next_id, version + whole["batch"].nunique()))
        yield _change_table(self.scene, key[0], changes)

    def close(self) -> None:
        pass


def component_changes(detections: DataFrame, config: FusionConfig | None = None, scene: str = "scene_id", batch: str | None = None) -> DataFrame:
    """Changes of components as detections arrive (a stream), or as if they did (a table, without a store): see CHANGES.

    ``batch``: a column that orders parts of a table, or of a stream's batch, that are taken one after the other. A change
    row replaces all that came before it for its scene and stable id; ``gone`` ones leave nothing.
    """
    config, kind = config or FusionConfig(), detections.schema[scene].dataType.simpleString()
    rows = detections.select(scene, (F.lit(0) if batch is None else F.col(batch)).cast("long").alias("batch"), *MEMBER)
    schema = f"`{scene}` {kind}, {CHANGES}"
    if detections.isStreaming:
        return rows.groupBy(scene).transformWithStateInPandas(_Processor(config, scene), schema, "Append", "None")
    return rows.groupBy(scene).applyInPandas(lambda key, part: _change_table(scene, key[0], list(_taken(SceneFusion(config, {}, {}, {}), part, 0))), schema)


def published(changes: DataFrame, min_detections: int = 4, scene: str = "scene_id") -> DataFrame:
    """Components of enough members after the last of their changes."""
    last = F.row_number().over(Window.partitionBy(scene, "stable_id").orderBy(F.desc("version")))
    now = changes.withColumn("_n", last).where((F.col("_n") == 1) & ~F.col("gone") & (F.col("support_count") >= min_detections))
    return now.drop("_n", "gone", "version").withColumn("prob", F.bround("prob", 2))
