"""Order-dependent operators: suppression, constrained merging, assignment. Each kernel sees one group, in a fixed order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import stage
from .graph import components, roots
from .groups import by_group
from .spatial import BOX, sampled_iou


def _rect_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.clip(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
    h = np.clip(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0, None)
    area = lambda r: np.clip(r[:, 2] - r[:, 0], 0, None) * np.clip(r[:, 3] - r[:, 1], 0, None)
    union = area(a)[:, None] + area(b)[None, :] - w * h
    return np.where(union > 0, w * h / np.where(union > 0, union, 1), 0)


def suppress_2d(df: DataFrame, threshold: float = 0.5, frame: str = "frame_id", id_col: str = "det_id") -> DataFrame:
    """In each frame keep rectangles by falling score unless one kept overlaps by more; of equal scores the later id first."""

    def kernel(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        box = np.stack([rows[c].astype(float) for c in ("x1", "y1", "x2", "y2")], 1)
        over, kept = _rect_iou(box, box) > threshold, np.ones(len(box), bool)
        for i in range(len(box)):
            if kept[i]:
                kept[i + 1 :] &= ~over[i, i + 1 :]
        return {n: v[kept] for n, v in rows.items()}

    return by_group(df, frame, [F.desc("score"), F.desc(id_col)], kernel, df.schema)


#: Matrices of up to so many entries are assigned in lists: numpy's calls cost more than what they do there.
SMALL = 400


def _assign_small(c: list[list[float]]) -> list[tuple[int, int]]:
    """``assign`` step by step for no more rows than columns."""
    n, m = len(c), len(c[0])
    u, v, match = [0.0] * n, [0.0] * m, [-1] * m
    for row in range(n):
        dist, back, done = [math.inf] * m, [-1] * m, [False] * m
        now, at, base = row, -1, 0.0
        while True:
            mine, off, best, least = c[now], u[now], -1, math.inf
            for j in range(m):
                if not done[j]:
                    new = base + mine[j] - off - v[j]
                    if new < dist[j] - 1e-15:
                        dist[j], back[j] = new, at
                    if dist[j] < least:
                        best, least = j, dist[j]
            at, base = best, least
            done[at] = True
            if match[at] < 0:
                break
            now = match[at]
        u[row] += base
        for j in range(m):
            if done[j] and j != at:
                u[match[j]] += base - dist[j]
                v[j] -= base - dist[j]
        while at >= 0:
            prev = back[at]
            match[at] = match[prev] if prev >= 0 else row
            at = prev
    return [(match[j], j) for j in range(m) if match[j] >= 0]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one assignment of least total cost, by shortest augmenting paths; rectangular matrices are all right."""
    if cost.size == 0:
        return []
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    if c.size <= SMALL:
        pairs = _assign_small(c.tolist())
        return sorted((b, a) for a, b in pairs) if turned else sorted(pairs)
    n, m = c.shape
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        now, at, base = row, -1, 0.0
        while True:
            new = base + c[now] - u[now] - v
            better = ~done & (new < dist - 1e-15)
            dist[better], back[better] = new[better], at
            open_ = np.where(done, np.inf, dist)
            at = int(open_.argmin())
            base = open_[at]
            done[at] = True
            if match[at] < 0:
                break
            now = match[at]
        end = at
        seen = done.copy()
        seen[end] = False
        u[row] += base
        for j in np.flatnonzero(seen):
            u[match[j]] += base - dist[j]
            v[j] -= base - dist[j]
        while end >= 0:
            prev = back[end]
            match[end] = match[prev] if prev >= 0 else row
            end = prev
    pairs = [(int(match[j]), j) for j in range(m) if match[j] >= 0]
    return sorted((b, a) for a, b in pairs) if turned else sorted(pairs)


def assign_listed(row: np.ndarray, column: np.ndarray, cost: np.ndarray, most: float = 1e6) -> list[tuple[int, int]]:
    """``assign`` where only listed (row, column, cost) are allowed, costs under ``most``, as many as can be; places in sorted order.

    Rows and columns that no list of pairs leads from one to the other are assigned apart, so a matrix is as large as the
    largest such piece, not as all together.
    """
    r, c = np.unique(row, return_inverse=True)[1], np.unique(column, return_inverse=True)[1]
    wide = r.max() + 1 if len(r) else 0
    nodes, root = roots(r, c + wide)
    piece = root[np.searchsorted(nodes, r)]
    order, out = np.argsort(piece, kind="stable"), []
    cuts = np.flatnonzero(np.diff(piece[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        at = order[a:b]
        if len(at) == 1:
            out += [(int(r[at[0]]), int(c[at[0]]))] if cost[at[0]] < most else []
            continue
        rows, x = np.unique(r[at], return_inverse=True)
        columns, y = np.unique(c[at], return_inverse=True)
        full = np.full((len(rows), len(columns)), most)
        full[x, y] = cost[at]
        out += [(int(rows[i]), int(columns[j])) for i, j in assign(full) if full[i, j] < most]
    return sorted(out)


def merge_constrained(ids: list, frames: dict, edges: list[tuple]) -> dict:
    """Component of each id: edges (a, b, score) by falling score join two components unless both hold some frame."""
    parent, held = {i: i for i in ids}, {i: {frames[i]} if frames else set() for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, _ in sorted(edges, key=lambda e: (-e[2], min(e[0], e[1]), max(e[0], e[1]))):
        a, b = sorted((root(a), root(b)))
        if a != b and not held[a] & held[b]:
            parent[b] = a
            held[a] |= held[b]
    least: dict = {}
    for i in sorted(ids):
        least.setdefault(root(i), i)
    return {i: least[root(i)] for i in ids}


def cluster(detections: DataFrame, edges: DataFrame, id_col: str = "det_id", frame: str | None = "frame_id", written: bool = False) -> DataFrame:
    """(id, cluster): detections joined by edges (a, b, iou), never two of one frame; the least id names a cluster.

    Components without the constraint never touch, so they are found first and the greedy merge runs inside each. Edges are
    needed twice and so written out, unless they were ``written`` before.
    """
    nodes = detections.select(F.col(id_col).alias("node"))
    if frame is None:
        return components(nodes, edges).select(F.col("node").alias(id_col), F.col("component").alias("cluster"))
    joined = edges.select("a", "b", "iou")
    joined = joined if written else stage(joined, "links")
    weak = stage(components(nodes, joined), "components")
    members = weak.join(detections.select(F.col(id_col).alias("node"), F.col(frame).alias("frame")), "node").select("component", F.lit(0).alias("kind"), F.col("node").alias("a"), F.col("frame").alias("b"), F.lit(0.0).alias("iou"))
    links = joined.join(weak.hint("merge"), joined["a"] == weak["node"]).select("component", F.lit(1).alias("kind"), "a", "b", "iou")
    kinds = dict(members.dtypes)

    def kernel(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        own = rows["kind"] == 0
        a, b, link = rows["a"].tolist(), rows["b"].tolist(), np.flatnonzero(~own)
        nodes = np.flatnonzero(own)
        found = merge_constrained([a[i] for i in nodes], {a[i]: b[i] for i in nodes}, [(a[i], b[i], rows["iou"][i]) for i in link])
        return {id_col: np.array(list(found)), "cluster": np.array(list(found.values()))}

    return by_group(members.unionByName(links), "component", [F.col("kind")], kernel, f"`{id_col}` {kinds['a']}, cluster {kinds['a']}")


# -- suppression of fused instances ----------------------------------------------------------------------------------------


def better_kept(a: dict, b: dict) -> bool:
    """Whether the first of two instances is kept when one absorbs the other: volume, support, probability, order."""
    va, vb = (max(x["sx"] * x["sy"] * x["sz"], 1e-8) for x in (a, b))
    if abs(va - vb) > 1e-6 * max(va, vb):
        return va > vb
    if a["support_count"] != b["support_count"]:
        return a["support_count"] > b["support_count"]
    return a["prob"] >= b["prob"] - 1e-6 if abs(a["prob"] - b["prob"]) > 1e-6 else True


def keep_order(volume: Column, support: Column, prob: Column, order: Column) -> Column:
    """A struct that is least for the instance that ``better_kept`` keeps of many: to within its tolerances, as steps."""
    return F.struct(-F.round(volume, 6), -support, -F.round(prob, 6), order)


def _boxes(items: list[dict]) -> np.ndarray:
    return np.array([[x[c] for c in BOX] for x in items], float).reshape(-1, 7)


def _all_iou(items: list[dict], n: int) -> np.ndarray:
    v = _boxes(items)
    i, j = np.triu_indices(len(v), 1)
    out = np.zeros((len(v), len(v)))
    if len(i):
        near = np.hypot(v[i, 0] - v[j, 0], v[i, 1] - v[j, 1]) <= (np.hypot(v[i, 3], v[i, 4]) + np.hypot(v[j, 3], v[j, 4])) / 2
        i, j = i[near], j[near]
        out[i, j] = out[j, i] = sampled_iou(v[i], v[j], n)
    return out


def _absorb(into: dict, other: dict) -> None:
    into["members"] = into["members"] + [m for m in other["members"] if m not in set(into["members"])]
    into["support_count"] = len(into["members"])


def suppress_instances(items: list[dict], threshold: float = 0.6) -> list[dict]:
    """Of two instances that overlap by more, the one of less support goes (the later of equals) and the other takes its members."""
    iou, gone = _all_iou(items, 32), set()
    for i in range(len(items)):
        if i in gone:
            continue
        for j in range(i + 1, len(items)):
            if j in gone or iou[i, j] <= threshold:
                continue
            if items[j]["support_count"] > items[i]["support_count"]:
                _absorb(items[j], items[i])
                gone.add(i)
                break
            _absorb(items[i], items[j])
            gone.add(j)
    return [x for k, x in enumerate(items) if k not in gone]


def absorb_contained(items: list[dict], threshold: float = 0.8) -> list[dict]:
    """Of two instances of one label whose intersection is more than a share of the smaller, one absorbs the other."""
    if threshold <= 0 or len(items) < 2:
        return items
    iou, found, gone = _all_iou(items, 32), [], set()
    volume = [max(x["sx"] * x["sy"] * x["sz"], 1e-8) for x in items]
    for i in range(len(items)):
        for j in range(i + 1, len(items)):
            if items[i]["label"] == items[j]["label"] and iou[i, j] > 0:
                share = iou[i, j] * (volume[i] + volume[j]) / (1 + iou[i, j]) / min(volume[i], volume[j])
                if share > threshold:
                    found.append((share, i, j))
    for _, i, j in sorted(found, key=lambda x: -x[0]):
        if i in gone or j in gone:
            continue
        keep, drop = (i, j) if better_kept(items[i], items[j]) else (j, i)
        _absorb(items[keep], items[drop])
        gone.add(drop)
    return [x for k, x in enumerate(items) if k not in gone]


def clean_instances(fused: DataFrame, nms: float | None = 0.4, contained: float = 0.8, scene: str = "scene_id", id_col: str = "cluster") -> DataFrame:
    """Suppression, then absorption, over each scene's fused instances in order of their ids."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        items = rows.sort_values(id_col).to_dict("records")
        for x in items:
            x["members"] = list(x["members"])
        if nms is not None:
            items = suppress_instances(items, nms)
        items = absorb_contained(items, contained)
        return pd.DataFrame(items, columns=rows.columns)

    return fused.groupBy(scene).applyInPandas(run, fused.schema)


def assign_grouped(pairs: DataFrame, group: str, row: str, column: str, cost: str) -> DataFrame:
    """Least-cost one-to-one assignment inside each group of (row, column, cost); pairs that are not listed are not allowed."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates([row, column], keep="last").sort_values([row, column])
        r, c = (np.unique(rows[n], return_inverse=True) for n in (row, column))
        value = rows[cost].to_numpy(float)
        listed = dict(zip(zip(r[1].tolist(), c[1].tolist()), value.tolist()))
        out = [(rows[group].iloc[0], r[0][i], c[0][j], listed[i, j]) for i, j in assign_listed(r[1], c[1], value)]
        return pd.DataFrame(out, columns=[group, row, column, cost])

    schema = T.StructType([pairs.schema[c] for c in (group, row, column, cost)])
    return pairs.select(group, row, column, cost).groupBy(group).applyInPandas(run, schema)
