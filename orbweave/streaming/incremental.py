"""Incremental fusion: batches of frames update a table of components; only components that new boxes touch are fused anew.

State is a folder of versions, one per batch, each with members, components and aliases; a batch that is replayed writes
the same version again. Snapshots of confirmed components are published beside it, empty ones too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_bounds
from ..operators.fuse import fuse_members
from ..operators.greedy import cluster
from ..operators.spatial import BOX, overlap_edges
from ..sources.writers import publish_snapshot
from ..staging import stage

MEMBERS = "scene_id long, frame_id long, det_id long, label string, prob double, tx double, ty double, tz double, sx double, sy double, sz double, yaw double, stable_id long"
ALIASES = "scene_id long, alias long, stable_id long"


def latest_frames(frames: DataFrame, order: str = "stream_seq", scene: str = "scene_id") -> DataFrame:
    """Conflation: of the frames that wait, only the newest of each scene goes on."""
    newest = frames.groupBy(scene).agg(F.max(order).alias(order))
    return frames.join(newest, [scene, order], "left_semi")


def touched(members: DataFrame, new: DataFrame) -> DataFrame:
    """(scene_id, stable_id) of components whose members' bounds meet the bounds of a new box; edges count."""
    bounds = box_bounds(*[F.col(c) for c in BOX])
    per = members.withColumns(bounds).groupBy("scene_id", "stable_id").agg(*[(F.min if n.startswith("min") else F.max)(n).alias(n) for n in bounds])
    boxes = new.select("scene_id", *[e.alias(f"n_{n}") for n, e in bounds.items()])
    meet = F.col("scene_id") == F.col("_scene")
    for axis in "xyz":
        meet = meet & (F.col(f"min_{axis}") <= F.col(f"n_max_{axis}")) & (F.col(f"n_min_{axis}") <= F.col(f"max_{axis}"))
    return per.join(boxes.withColumnRenamed("scene_id", "_scene"), meet, "left_semi").select("scene_id", "stable_id")


def stable_ids(old: DataFrame, new: DataFrame, next_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names for new clusters, and aliases. ``old``: (scene_id, det_id, stable_id), ``new``: (scene_id, det_id, cluster).

    Each old component votes for the cluster that holds most of its members (the least cluster of equals). A cluster
    takes the least id that votes for it, the others become its aliases; without votes it takes the scene's next id.
    """
    shared = old.join(new, ["scene_id", "det_id"]).groupBy("scene_id", "stable_id", "cluster").agg(F.count("*").alias("n"))
    pick = Window.partitionBy("scene_id", "stable_id").orderBy(F.desc("n"), "cluster")
    votes = shared.withColumn("_r", F.row_number().over(pick)).where("_r = 1").select("scene_id", "stable_id", "cluster")
    claimed = votes.groupBy("scene_id", "cluster").agg(F.min("stable_id").alias("name"))
    every = new.select("scene_id", "cluster").distinct().join(claimed, ["scene_id", "cluster"], "left").join(next_ids, "scene_id", "left")
    fresh = F.row_number().over(Window.partitionBy("scene_id", F.col("name").isNull()).orderBy("cluster")) - 1
    named = every.withColumn("name", F.coalesce("name", F.coalesce("next_id", F.lit(0)) + fresh)).select("scene_id", "cluster", "name")
    aliases = votes.join(claimed, ["scene_id", "cluster"]).where("stable_id <> name").select("scene_id", F.col("stable_id").alias("alias"), F.col("name").alias("stable_id"))
    return named, aliases


@dataclass
class IncrementalFusion:
    """Use ``update`` as the function of ``foreachBatch``, or call it with batches of detections."""

    folder: str
    conf: float = 0.55
    iou: float = 0.2
    min_detections: int = 4
    cell: float = 4.0
    snapshots: str | None = None

    def read(self, spark: SparkSession, table: str, version: int, schema: str) -> DataFrame:
        """A table's last version before ``version``."""
        from ..sources.files import list_names

        names = [int(n) for n in list_names(spark, f"{self.folder}/{table}") if n.isdigit() and int(n) < version]
        return spark.read.schema(schema).parquet(f"{self.folder}/{table}/{max(names)}") if names else spark.createDataFrame([], schema)

    def update(self, batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        members = self.read(spark, "members", batch_id, MEMBERS)
        new = stage(batch.where(F.col("prob") >= self.conf).select(*[c.split()[0] for c in MEMBERS.split(", ")[:-1]]), "new")
        hit = stage(touched(members, new), "touched")
        moved = members.join(hit, ["scene_id", "stable_id"], "left_semi")
        kept = members.join(hit, ["scene_id", "stable_id"], "left_anti")
        local = stage(moved.drop("stable_id").unionByName(new), "local")
        edges = overlap_edges(local, ["scene_id"], self.iou, self.cell, extra=F.col("a_frame_id") != F.col("b_frame_id"))
        found = stage(local.select("scene_id", "det_id").join(cluster(local, edges), "det_id"), "clusters")
        taken = members.select("scene_id", "stable_id").unionByName(self.read(spark, "aliases", batch_id, ALIASES).select("scene_id", F.col("alias").alias("stable_id")))
        next_ids = taken.groupBy("scene_id").agg((F.max("stable_id") + 1).alias("next_id"))
        named, aliases = stable_ids(moved.select("scene_id", "det_id", "stable_id"), found, next_ids)
        now = local.join(found, ["scene_id", "det_id"]).join(named, ["scene_id", "cluster"]).withColumn("stable_id", F.col("name")).drop("cluster", "name")
        kept.unionByName(now).write.mode("overwrite").parquet(f"{self.folder}/members/{batch_id}")
        self.read(spark, "aliases", batch_id, ALIASES).unionByName(aliases).write.mode("overwrite").parquet(f"{self.folder}/aliases/{batch_id}")
        out = self.published(spark, batch_id)
        if self.snapshots:
            publish_snapshot(out.drop("members"), self.snapshots, str(batch_id))
        return out

    def published(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Confirmed components after a batch, by id."""
        members = spark.read.schema(MEMBERS).parquet(f"{self.folder}/members/{batch_id}")
        key = F.concat_ws("/", "scene_id", "stable_id")
        fused = fuse_members(members.withColumn("cluster", key), keys=("scene_id", "stable_id"))
        return fused.where(F.col("support_count") >= self.min_detections).drop("cluster").withColumn("prob", F.bround("prob", 2)).orderBy("scene_id", "stable_id")
