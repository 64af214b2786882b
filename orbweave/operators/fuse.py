"""Fusing clusters of detections into single boxes: circular means, alignment by right angles, robust weights.

All in DataFrame aggregates that join back to the members; "median" is the lower one of two.
"""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.geometry import half_turn_distance
from ..staging import stage
from .greedy import clean_instances, cluster
from .spatial import overlap_edges

WEIGHTINGS = ("uniform", "linear", "quadratic", "robust")


def yaw_mean(yaw: Column, weight: Column) -> Column:
    """Weighted mean of directions that are the same after half a turn; 0 where they cancel."""
    s, c = F.sum(weight * F.sin(2 * yaw)), F.sum(weight * F.cos(2 * yaw))
    return F.when(F.sqrt(s * s + c * c) < 1e-8, F.lit(0.0)).otherwise(F.atan2(s, c) / 2)


def lower_median(column: str) -> Column:
    return F.expr(f"percentile_disc(0.5) within group (order by {column})")


def aligned(members: DataFrame, key: str = "cluster") -> DataFrame:
    """Turn each box by a right angle, swapping its sides, where that brings it strictly nearer to its cluster's mean yaw."""
    w = Window.partitionBy(key)
    share = F.col("prob") / F.sum("prob").over(w)
    s, c = F.sum(F.col("_w") * F.sin(2 * F.col("yaw"))).over(w), F.sum(F.col("_w") * F.cos(2 * F.col("yaw"))).over(w)
    out = members.withColumn("_w", share).withColumn("_ref", F.when(F.sqrt(s * s + c * c) < 1e-8, F.lit(0.0)).otherwise(F.atan2(s, c) / 2))
    yaw, ref = F.col("yaw"), F.col("_ref")
    up, down = yaw + math.pi / 2, yaw - math.pi / 2
    turned = F.when(half_turn_distance(up, ref) < half_turn_distance(down, ref), up).otherwise(down)
    out = out.withColumn("_turn", half_turn_distance(turned, ref) < half_turn_distance(yaw, ref)).withColumn("_yaw", F.when(F.col("_turn"), turned).otherwise(yaw))
    return out.withColumns({"_sx": F.when(F.col("_turn"), F.col("sy")).otherwise(F.col("sx")), "_sy": F.when(F.col("_turn"), F.col("sx")).otherwise(F.col("sy"))}).withColumns({"sx": F.col("_sx"), "sy": F.col("_sy"), "yaw": F.col("_yaw")}).drop("_w", "_ref", "_turn", "_yaw", "_sx", "_sy")


def weighted(members: DataFrame, weighting: str = "robust", key: str = "cluster") -> DataFrame:
    """Add ``weight``, which sums to one in each cluster. Robust: confidence, less for members far from the medians."""
    if weighting not in WEIGHTINGS:
        raise ValueError(f"weighting is one of {', '.join(WEIGHTINGS)}")
    total = F.sum("weight").over(Window.partitionBy(key))
    if weighting != "robust":
        raw = {"uniform": F.lit(1.0), "linear": F.col("prob"), "quadratic": F.col("prob") ** 2}[weighting]
        return members.withColumn("weight", raw).withColumn("weight", F.col("weight") / (total + 1e-8))
    axes = ("tx", "ty", "tz", "sx", "sy", "sz")
    medians = members.groupBy(key).agg(F.count("*").alias("_n"), *[lower_median(c).alias(f"_m_{c}") for c in axes], yaw_mean(F.col("yaw"), F.lit(1.0)).alias("_m_yaw"))
    off = lambda cs: F.sqrt(sum((F.col(c) - F.col(f"_m_{c}")) ** 2 for c in cs))
    far = members.join(medians, key).withColumns({"_p": off(axes[:3]), "_s": off(axes[3:]), "_y": half_turn_distance(F.col("yaw"), F.col("_m_yaw"))})
    spread = far.groupBy(key).agg(*[F.greatest(lower_median(c), F.lit(1e-6)).alias(f"{c}_mad") for c in ("_p", "_s", "_y")])
    score = sum(F.col(c) / (1.4826 * F.col(f"{c}_mad")) for c in ("_p", "_s", "_y")) / 3
    less = F.when((F.col("_n") <= 2) | (score <= 2.5), F.lit(1.0)).otherwise(2.5 / score)
    out = far.join(spread, key).withColumn("weight", F.col("prob") * less)
    return out.select(*members.columns, (F.col("weight") / (total + 1e-8)).alias("weight"))


def fuse_members(members: DataFrame, weighting: str = "robust", key: str = "cluster", id_col: str = "det_id", keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """One box for each cluster: weighted means, the label of most weight (the first seen of equals), its members."""
    rows = weighted(aligned(members, key), weighting, key)
    w = F.col("weight")
    boxes = rows.groupBy(key).agg(
        *[F.first(k).alias(k) for k in keys], F.count("*").alias("support_count"), *[F.sum(w * F.col(c)).alias(c) for c in ("tx", "ty", "tz", "sx", "sy", "sz")],
        yaw_mean(F.col("yaw"), w).alias("yaw"), F.sum(w * F.col("prob")).alias("prob"), F.array_sort(F.collect_list(id_col)).alias("members"),
    )
    votes = rows.groupBy(key, "label").agg(F.sum("weight").alias("_v"), F.min(id_col).alias("_first"))
    best = votes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("_v", 9)), "_first"))).where("_r = 1").select(key, "label")
    return boxes.join(best, key)


class FusionStatistics:
    """How many rows each step of a fusion gave and how long it took, gathered while the steps are written out.

    Counts come from the run itself (``observe``), so nothing is counted twice. One object serves one fusion.
    """

    STEPS = ("detections", "confident", "links", "clusters", "fused", "supported", "final")

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}
        self.seconds: dict[str, float] = {}

    def step(self, name: str, df: DataFrame) -> DataFrame:
        began, self._seen[name] = time.time(), Observation(name)
        out = stage(df.observe(self._seen[name], F.count(F.lit(1)).alias("rows")), name)
        self.seconds[name] = time.time() - began
        return out

    def rows(self) -> dict[str, int]:
        return {name: seen.get["rows"] for name, seen in self._seen.items()}


#: Vectors of a key that are compared with as many others in one task, and rows of the products it holds at a time.
VECTORS, STRIP = 4096, 256


def alike_pairs(vectors: DataFrame, key: str, least: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b) for all pairs of ids a < b, equal in ``key``, whose vectors have a cosine of at least ``least``, in double precision.

    All pairs are compared: vectors of a key are dealt into blocks and each pair of blocks is one group, so work is spread and
    memory bounded, but time grows with the square of a key's vectors. Null or zero vectors, or null components, are like none.
    """
    known = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    blocks = known.groupBy(key).agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("_blocks"))
    own = known.select(F.col(key).alias("_key"), F.col(id_col).alias("id"), F.col(vector).alias("v")).join(blocks, F.col("_key") == F.col(key)).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    copies = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    copies = copies.select("_key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "id", "v")
    kind = vectors.schema[id_col].dataType.simpleString()

    def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.cumsum(x * y, 1)[:, -1]  # one after the other, as a row's expression sums

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = (rows["_own"] == rows["_i"]).to_numpy()
        same = rows["_i"].iloc[0] == rows["_j"].iloc[0]
        ids, v = rows["id"].to_numpy(), np.stack([np.asarray(x, float) for x in rows["v"]])
        norm = np.sqrt(inner(v, v))
        good = norm > 0
        left = np.flatnonzero(good & first)
        right = left if same else np.flatnonzero(good & ~first)
        unit, out = v[right] / norm[right, None], []
        for at in range(0, len(left), STRIP):
            part = left[at : at + STRIP]
            x, y = np.nonzero((v[part] / norm[part, None]) @ unit.T >= least - 1e-9)
            x, y = part[x], right[y]
            keep = ids[x] < ids[y] if same else np.ones(len(x), bool)
            x, y = x[keep], y[keep]
            keep = inner(v[x], v[y]) / (norm[x] * norm[y]) >= least
            x, y = ids[x[keep]], ids[y[keep]]
            out.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": ids[:0], "b": ids[:0]})

    return copies.groupBy("_key", "_i", "_j").applyInPandas(run, f"a {kind}, b {kind}")


def alike(edges: DataFrame, embeddings: DataFrame, least: float, id_col: str = "det_id", vector: str = "embedding") -> DataFrame:
    """Edges (a, b, ...) whose ends have embeddings with a cosine of at least ``least``.

    Only pairs that are edges already are compared, never all. An end without an embedding, or with a zero one, is like none.
    """
    inner = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    known = embeddings.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    known = known.withColumn("_n", F.sqrt(inner("_v", "_v"))).where(F.col("_n") > 0)
    side = lambda c: known.select(F.col("_id").alias(c), F.col("_v").alias(f"_v{c}"), F.col("_n").alias(f"_n{c}"))
    met = edges.join(side("a"), "a").join(side("b"), "b")  # a vector goes with each link, so it stays as narrow as it came
    return met.where(inner("_va", "_vb") / (F.col("_na") * F.col("_nb")) >= least).select(*edges.columns)


def fuse_detections(detections: DataFrame, *, conf: float = 0.55, iou: float = 0.2, same_label: bool = False, min_detections: int = 4, weighting: str = "robust", nms: float | None = 0.4, contained: float = 0.8, cell: float = 4.0, embeddings: DataFrame | None = None, semantic: float = 0.0, statistics: FusionStatistics | None = None) -> DataFrame:
    """Detections (scene_id, frame_id, det_id, label, prob, box) to fused objects with their members.

    Confident detections of different frames that overlap are linked, clustered without two of one frame, and fused. With
    ``embeddings`` (det_id, embedding) only those at least ``semantic`` alike are linked. With ``statistics`` each step is
    written out and counted.
    """
    step = statistics.step if statistics else lambda name, df: df
    kept = step("confident", (step("detections", detections) if statistics else detections).where(F.col("prob") >= conf))
    apart = F.col("a_frame_id") != F.col("b_frame_id")
    edges = overlap_edges(kept, ["scene_id"], iou, cell, extra=apart)
    if same_label:
        name = lambda c: kept.select(F.col("det_id").alias(c), F.col("label").alias(f"_{c}"))
        edges = edges.join(name("a"), "a").join(name("b"), "b").where("_a = _b").drop("_a", "_b")
    if embeddings is not None:
        edges = alike(edges, embeddings, semantic)
    found = step("clusters", cluster(kept, step("links", edges), written=statistics is not None))
    fused = step("fused", fuse_members(kept.join(found, "det_id"), weighting))
    supported = step("supported", fused.where(F.col("support_count") >= min_detections))
    return step("final", clean_instances(supported, nms, contained))


def precision_recall(pred: DataFrame, target: DataFrame, keys: list[str], iou: float = 0.2, cell: float = 4.0) -> DataFrame:
    """Precision and recall of predicted boxes (det_id, label, prob) against targets.

    A prediction takes the target of its label that it overlaps most, above the threshold; a target counts the prediction
    of the highest score among those. Without predictions (-1, 0), without targets (0, -1).
    """
    from .spatial import candidate_pairs, with_iou

    same = F.col("a_label") == F.col("b_label")
    pairs = with_iou(candidate_pairs(pred, target, keys, cell, same), 8).where(F.col("iou") > iou)
    first = F.row_number().over(Window.partitionBy("a_det_id").orderBy(F.desc("iou"), "b_det_id"))
    second = F.row_number().over(Window.partitionBy("b_det_id").orderBy(F.desc("a_prob"), F.desc("iou"), "a_det_id"))
    hits = pairs.withColumn("_f", first).where("_f = 1").withColumn("_s", second).where("_s = 1")
    kinds = [df.select(F.lit(k).alias("kind")) for k, df in (("hit", hits), ("pred", pred), ("target", target))]
    count = lambda k, n: F.count_if(F.col("kind") == k).alias(n)
    counts = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).agg(count("hit", "hits"), count("pred", "n_pred"), count("target", "n_target"))
    p, t = F.col("n_pred"), F.col("n_target")
    return counts.select("hits", F.when(p == 0, -1.0).when(t == 0, 0.0).otherwise(F.col("hits") / p).alias("precision"), F.when(p == 0, 0.0).when(t == 0, -1.0).otherwise(F.col("hits") / t).alias("recall"))
