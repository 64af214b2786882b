"""Writers of perception files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import matmul, quaternion_of_rotation, rotate, rotation_of_euler, rotation_of_quaternion, transpose, vec
from ..functions.text import instance_colour, label_for_file

# The service's world frame against the sensor's.
WORLD = (0.0, 0.0, -1.0, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0)


def boxes_3d_rows(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The fifteen columns of a box file; the name is the text, else the class's name, else its number."""
    q = quaternion_of_rotation(rotation_of_euler(F.lit(0.0), F.lit(0.0), F.col("yaw")))
    name = F.lit(None).cast("string")
    if names is not None:
        df = df.join(F.broadcast(names.select(F.col("sem_id"), F.col("name").alias("_name"))), "sem_id", "left")
        name = F.col("_name")
    return df.select(
        "time_ns", *[F.col(c).alias(f"{c}_world_object") for c in ("tx", "ty", "tz")], *[q[i].alias(f"q{c}_world_object") for i, c in enumerate("wxyz")],
        *[F.col(f"s{c}").alias(f"scale_{c}") for c in "xyz"], label_for_file(F.col("label"), name, F.col("sem_id")).alias("name"), F.col("inst_id").alias("instance"), "sem_id", "prob",
    )


def write_boxes_3d(df: DataFrame, path: str, names: DataFrame | None = None, mode: str = "overwrite") -> None:
    boxes_3d_rows(df, names).write.mode(mode).option("header", True).csv(path)


def boxes_2d_rows(df: DataFrame) -> DataFrame:
    two, six = (lambda c: F.format_string("%.2f", F.col(c)).alias(c)), (lambda c: F.format_string("%.6f", F.col(c)).alias(c))
    return df.select("time_ns", "frame_id", "sensor", "device", "img_width", "img_height", *[two(c) for c in ("x1", "y1", "x2", "y2")], F.coalesce("name", F.lit("unknown")).alias("name"), "instance", F.coalesce("sem_id", F.lit(-1)).alias("sem_id"), six("prob"))


def write_boxes_2d(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    boxes_2d_rows(df).write.mode(mode).option("header", True).csv(path)


def exported(df: DataFrame, vocabulary: DataFrame, semantic_colours: bool = False) -> DataFrame:
    """Boxes back in the sensor's world frame, with translated names and colours. Unknown names stay, in instance colours."""
    back = transpose(vec(*WORLD))
    t = rotate(back, F.array(*[F.col(f"t{c}") for c in "xyz"]))
    q = quaternion_of_rotation(matmul(back, rotation_of_quaternion(*[F.col(f"q{c}") for c in "wxyz"])))
    own = instance_colour(F.col("inst_id"))
    v = F.broadcast(vocabulary.select(F.col("en").alias("_en"), "cn", *[F.col(c).alias(f"_{c}") for c in "rgb"]))
    met = df.join(v, F.col("label") == F.col("_en"), "left")
    colour = lambda i, c: (F.coalesce(F.col(f"_{c}"), own[i]) if semantic_colours else own[i]).alias(c)
    return met.select("time_ns", *[t[i].alias(f"t{c}") for i, c in enumerate("xyz")], *[q[i].alias(f"q{c}") for i, c in enumerate("wxyz")], "sx", "sy", "sz", F.coalesce("cn", "label").alias("name"), F.col("inst_id").alias("fused_instance"), "sem_id", "prob", *[colour(i, c) for i, c in enumerate("rgb")])


def publish_snapshot(df: DataFrame, folder: str, name: str) -> None:
    """Write one CSV folder so that readers see all of it or nothing: beside the target first, then renamed onto it.

    An empty snapshot has its header. Publishing the same name again replaces it.
    """
    context = df.sparkSession.sparkContext
    path = lambda p: context._jvm.org.apache.hadoop.fs.Path(p)
    side, goal = path(f"{folder}/.{name}-{uuid.uuid4().hex}"), path(f"{folder}/{name}.csv")
    df.coalesce(1).write.option("header", True).csv(side.toString())
    fs = goal.getFileSystem(context._jsc.hadoopConfiguration())
    fs.delete(goal, True)
    if not fs.rename(side, goal):
        raise OSError(f"cannot publish {name}")


def newest_snapshot(df_names: list[str]) -> int | None:
    """The newest time among names like <time>.csv."""
    times = [int(n[:-4]) for n in df_names if n.endswith(".csv") and n[:-4].isdigit()]
    return max(times, default=None)


def dump_objects(boxes: DataFrame, folder: str) -> None:
    """Poses, extents and instances as three tables; of repeated instances the first by time counts, -1 is left out."""
    first = boxes.where("inst_id <> -1").groupBy("inst_id").agg(F.min_by(F.struct("*"), "time_ns").alias("b")).select("b.*")
    q = quaternion_of_rotation(rotation_of_euler(F.lit(0.0), F.lit(0.0), F.col("yaw")))
    stamp = F.lit(-1).cast("long").alias("timestamp[ns]")
    first.select(F.col("inst_id").alias("object_uid"), stamp, *[F.col(f"t{c}").alias(f"t_wo_{c}[m]") for c in "xyz"], *[q[i].alias(f"q_wo_{c}") for i, c in enumerate("wxyz")]).write.mode("overwrite").option("header", True).csv(f"{folder}/scene_objects.csv")
    half = lambda c, s: (F.col(f"s{c}") * (0.5 * s))
    first.select(F.col("inst_id").alias("object_uid"), stamp, *[half(c, s).alias(f"p_local_obj_{c}{m}[m]") for c in "xyz" for m, s in (("min", -1), ("max", 1))]).write.mode("overwrite").option("header", True).csv(f"{folder}/3d_bounding_box.csv")
    first.select(F.to_json(F.create_map(F.col("inst_id").cast("string"), F.struct(F.col("label").alias("category"), F.col("label").alias("instance_name"), F.col("prob")))).alias("value")).write.mode("overwrite").text(f"{folder}/instances.json")


# The stream that a camera's boxes are written under.
VIEW_STREAMS = {"rgb": "214-1", "slaml": "1201-1", "slamr": "1201-2"}


def dump_views_2d(boxes: DataFrame, folder: str) -> None:
    """Image boxes (inst_id, time_ns, camera, x_min, x_max, y_min, y_max) as the 2D table of a scene, in the layout that ``read_views_2d`` reads.

    Instance -1 is left out, and so are boxes of other cameras; what share of a box is visible is not known and written
    as 0, so read the table back with ``least_visible`` = 0. Corners have six decimals; without boxes there is a header.
    """
    stream = F.element_at(F.create_map(*[F.lit(x) for kv in VIEW_STREAMS.items() for x in kv]), F.col("camera"))
    corner = lambda c: F.format_string("%.6f", F.col(c).cast("double")).alias(f"{c}[pixel]")
    rows = boxes.where("inst_id <> -1").withColumn("stream_id", stream).where("stream_id is not null")
    columns = ["stream_id", F.col("inst_id").alias("object_uid"), F.col("time_ns").alias("timestamp[ns]"), *[corner(c) for c in ("x_min", "x_max", "y_min", "y_max")], F.lit("0.000000").alias("visibility_ratio[%]")]
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(f"{folder}/2d_bounding_box.csv")


def renamed_instance(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("instance", "fused_instance") if "fused_instance" not in df.columns else df


def sensor_position(t: Column) -> Column:
    """A point from the sensor's world frame into the service's."""
    return rotate(vec(*WORLD), t)
