"""Scenes of annotated objects put together from their tables: poses, extents, names and what three cameras saw.

``keys`` name the columns that tell sequences apart; without them there is one sequence, and its times and names are then
ranked in one task, which is right for a scene's few thousand objects and times but not for many scenes at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import UNSEEN
from ..operators import asof
from .files import still_objects

#: In this order cameras' times are merged.
CAMERAS = ("rgb", "slaml", "slamr")
#: Times of two cameras nearer than this (ns) are one moment.
MOMENT = 1_000_000
#: Instances above this are numbered anew from here.
LAST_ID = 10_000
SIDES = ("x_min", "x_max", "y_min", "y_max")


def classified(instances: DataFrame, classes: DataFrame, keys: list[str] | None = None, order: str = "inst_id") -> DataFrame:
    """``instances`` (keys, inst_id, category) with ``sem_id``, ``matched`` (the class's own name, null if there is none) and ``new_id``.

    Names are looked up in ``classes`` (name, sem_id) as they are, then without regard to case. Unknown ones are numbered after the
    greatest known id, by the first of their instances in ``order``; instances beyond LAST_ID are numbered on from there.
    """
    keys = keys or []
    exact = classes.select(F.col("name").alias("_e"), F.struct(F.col("name").alias("n"), "sem_id").alias("_es"))
    loose = classes.groupBy(F.lower("name").alias("_l")).agg(F.min(F.struct("sem_id", F.col("name").alias("n"))).alias("_ls"))
    found = instances.join(F.broadcast(exact), F.col("category") == F.col("_e"), "left").join(F.broadcast(loose), F.lower("category") == F.col("_l"), "left")
    found = found.withColumns({"matched": F.coalesce("_es.n", "_ls.n"), "sem_id": F.coalesce("_es.sem_id", "_ls.sem_id")}).drop("_e", "_es", "_l", "_ls")
    unknown = found.where("sem_id is null").groupBy(*keys, "category").agg(F.min(order).alias("_first"))
    greatest = F.broadcast(classes.agg(F.coalesce(F.max("sem_id"), F.lit(-1)).alias("_most")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_first", "category"))
    numbered = unknown.join(greatest).withColumn("_new", F.col("_most") + rank).select(*keys, F.col("category").alias("_c"), "_new")
    same: Column = F.col("category").eqNullSafe(F.col("_c"))
    for k in keys:
        numbered = numbered.withColumnRenamed(k, f"_k_{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = found.join(numbered, same, "left").withColumn("sem_id", F.coalesce("sem_id", "_new")).drop("_c", "_new", *[f"_k_{k}" for k in keys])
    far = F.row_number().over(Window.partitionBy(*keys, F.col("inst_id") > LAST_ID).orderBy(order))
    return out.withColumn("new_id", F.when(F.col("inst_id") > LAST_ID, LAST_ID + far).otherwise(F.col("inst_id")))


def placed_objects(poses: DataFrame, extents: DataFrame, named: DataFrame) -> DataFrame:
    """Objects with a static pose, or whose poses never move, with extents and classes.

    An object with a static pose (time -1) keeps it even if other poses of it move.
    """
    static = poses.where("time_ns = -1")
    still = still_objects(poses.join(static.select("inst_id"), "inst_id", "left_anti"))
    where = static.dropDuplicates(["inst_id"]).unionByName(still).drop("time_ns")
    return named.join(where, "inst_id").join(extents, "inst_id")


def merged_moments(views: DataFrame, keys: list[str] | None = None, within: int = MOMENT, cameras: tuple[str, ...] = CAMERAS) -> DataFrame:
    """``views`` (keys, camera, time_ns, ...) with ``moment``: the time under which a row counts.

    The first camera's times are moments. Each other camera's, in turn, count under the nearest moment so far if it is less than
    ``within`` away, the earlier of two as near, else they are moments of their own.
    """
    keys = keys or []
    out, moments = None, None
    for name in cameras:
        own = views.where(F.col("camera") == name)
        if moments is None:
            placed = own.withColumn("moment", F.col("time_ns"))
        else:
            times = own.select(*keys, "time_ns").distinct()
            near = asof.nearest(times, moments.withColumn("time_ns", F.col("moment")), "time_ns", keys)
            near = near.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("time_ns").alias("_t"), F.when(F.abs("dt") < within, F.col("r_moment")).otherwise(F.col("time_ns")).alias("moment"))
            on = F.col("time_ns") == F.col("_t")
            for k in keys:
                on = on & (F.col(k) == F.col(f"_k_{k}"))
            placed = own.join(near, on).select(*own.columns, "moment")
        added = placed.select(*keys, "moment")
        moments = (added if moments is None else moments.unionByName(added)).distinct()
        out = placed if out is None else out.unionByName(placed)
    return out


def seen_objects(views: DataFrame, keys: list[str] | None = None, within: int = MOMENT, cameras: tuple[str, ...] = CAMERAS) -> DataFrame:
    """(keys, moment, inst_id, bb2_<camera>...): an object's image boxes at each moment, UNSEEN in all places where a camera has none.

    Of several rows of a camera that fall on one moment the latest counts.
    """
    box = F.array(*[F.col(s) for s in SIDES])
    last = lambda c: F.max_by(F.when(F.col("camera") == c, box), F.when(F.col("camera") == c, F.col("time_ns")))
    none = F.array(*[F.lit(UNSEEN)] * 4)
    return merged_moments(views, keys, within, cameras).groupBy(*(keys or []), "moment", "inst_id").agg(*[F.coalesce(last(c), none).alias(f"bb2_{c}") for c in cameras])


def scene_objects(poses: DataFrame, extents: DataFrame, instances: DataFrame, classes: DataFrame, views: DataFrame | None = None, within: int = MOMENT, described: bool = False) -> DataFrame:
    """A scene's objects by time: with ``views`` as they were seen, without all of them under time -1.

    ``described``: the text of an object is its description, else its class's name, or its own if no class has it. No object at all
    is an error only where rows are needed; the table is empty then.
    """
    named = classified(instances, classes)
    text = F.col("description") if described else F.coalesce("matched", "category")
    objects = placed_objects(poses, extents, named).withColumn("text", text)
    if views is None:
        return objects.withColumn("time_ns", F.lit(-1).cast("long"))
    return seen_objects(views, None, within).join(objects, "inst_id").withColumnRenamed("moment", "time_ns")
