"""Readers of perception files as DataFrames. Schemas are explicit; malformed rows are dropped, not guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Column order of the files.
BOXES_3D = "time_ns long, tx_world_object double, ty_world_object double, tz_world_object double, qw_world_object double, qx_world_object double, qy_world_object double, qz_world_object double, scale_x double, scale_y double, scale_z double, name string, instance long, sem_id int, prob double"
BOXES_2D = "time_ns long, frame_id long, sensor string, device string, img_width int, img_height int, x1 double, y1 double, x2 double, y2 double, name string, instance long, sem_id int, prob double"
#: The trajectory layouts by number of columns, where they are told apart by width alone.
TRAJECTORY_WIDTHS = (8, 20, 28, 29)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any store that Spark reads; none if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []


def read_boxes_3d(spark: SparkSession, path: str, any_class: int | None = None) -> DataFrame:
    """Oriented boxes by time, with the rotation's yaw; ``any_class`` puts all boxes into one class."""
    from ..functions.geometry import rotation_of_quaternion, yaw_of_rotation

    raw = spark.read.schema(BOXES_3D).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    q = [F.col(f"q{c}_world_object") for c in "wxyz"]
    r = rotation_of_quaternion(*q)
    sem = F.lit(any_class).cast("int") if any_class is not None else F.col("sem_id")
    return raw.select("time_ns", *[F.col(f"{c}_world_object").alias(c) for c in ("tx", "ty", "tz")], *[x.alias(f"q{c}") for x, c in zip(q, "wxyz")], *[F.col(f"scale_{c}").alias(f"s{c}") for c in "xyz"], yaw_of_rotation(r).alias("yaw"), F.col("name").alias("label"), F.col("instance").alias("inst_id"), sem.alias("sem_id"), "prob")


def read_boxes_2d(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOXES_2D).option("header", True).option("mode", "DROPMALFORMED").csv(path)


def boxes_by_time(boxes: DataFrame) -> DataFrame:
    """One row per time with its image size (of the first row) and boxes."""
    w = Window.partitionBy("time_ns").orderBy("instance")
    first = boxes.withColumn("_n", F.row_number().over(w))
    return first.groupBy("time_ns").agg(F.max(F.when(F.col("_n") == 1, F.col("img_width"))).alias("img_width"), F.max(F.when(F.col("_n") == 1, F.col("img_height"))).alias("img_height"), F.sort_array(F.collect_list(F.struct("instance", "x1", "y1", "x2", "y2", "name", "prob"))).alias("boxes"))


def read_trajectory(spark: SparkSession, path: str, every: int = 1, *, y_up: bool = False) -> DataFrame:
    """Poses by time. Columns are found by name; microseconds become nanoseconds. Gravity, where given, must point along z
    (or y with ``y_up``), else the read fails."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.strip(): c for c in raw.columns}
    if len(names) not in TRAJECTORY_WIDTHS:
        raise ValueError(f"a trajectory has {TRAJECTORY_WIDTHS} columns, not {len(names)}")
    by = lambda *ends: next(names[n] for n in names if any(n == e or n.startswith(e) for e in ends))
    stamp = next(n for n in names if "timestamp" in n or n in ("ts", "time_ns"))
    scale = 1000 if stamp.endswith("_us") else 1
    out = raw.select((F.col(names[stamp]).cast("long") * scale).alias("time_ns"), *[F.col(by(f"{c}_world", c)).cast("double").alias(c) for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")], *[F.col(names[f"gravity_{c}_world"]).cast("double").alias(f"g{c}") for c in "xyz" if f"gravity_{c}_world" in names])
    if "gx" in out.columns:
        g = out.agg(*[F.abs(F.avg(f"g{c}")).alias(c) for c in "xyz"]).first()
        main = max("zyx", key=lambda c: g[c] or 0.0)
        if main == "y" and not y_up or main == "x":
            raise ValueError(f"gravity points along {main}")
    if every > 1:
        out = out.withColumn("_n", F.row_number().over(Window.orderBy("time_ns")) - 1).where(F.col("_n") % every == 0).drop("_n")
    return out


def gravity_axis(poses: DataFrame, samples: int = 100) -> DataFrame:
    """The axis of the mean gravity of a systematic sample: z before y before x where equal, else unknown."""
    n = poses.count()
    step = max(1, n // samples)
    s = poses.withColumn("_n", F.row_number().over(Window.orderBy("time_ns")) - 1).where(F.col("_n") % step == 0).agg(*[F.abs(F.avg(f"g{c}")).alias(c) for c in "xyz"])
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return s.select(F.when((z >= y) & (z >= x) & (z > 0), "z").when((y >= x) & (y > 0), "y").when(x > 0, "x").otherwise("unknown").alias("axis"))


CALIBRATION = "tracking_timestamp_us long, CameraCalibrations array<struct<Label:string, SerialNumber:string, Projection:struct<Name:string, Params:array<double>>, T_Device_Camera:struct<Translation:array<double>, UnitQuaternion:struct<w:double, xyz:array<double>>>>>"


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """One row per time and camera: focal length, principal point and image size guessed from them."""
    raw = spark.read.schema(CALIBRATION.replace("UnitQuaternion:struct<w:double, xyz:array<double>>", "UnitQuaternion:string")).json(path)
    c = raw.select((F.col("tracking_timestamp_us") * 1000).alias("time_ns"), F.explode("CameraCalibrations").alias("c"))
    p = F.col("c.Projection.Params")
    near = lambda v: (F.col("c2") > v / 2 * 0.9) & (F.col("c2") < v / 2 * 1.1)
    out = c.select("time_ns", F.col("c.Label").alias("label"), F.col("c.SerialNumber").alias("serial"), p[0].alias("f"), p[1].alias("cx"), p[2].alias("cy"), p[1].alias("c2"), F.col("c.T_Device_Camera.Translation").alias("translation"), F.col("c.Projection.Name").alias("model"), F.slice(p, 4, 100).alias("distortion"))
    return out.withColumn("size", F.when(near(704), 704).when(near(1408), 1408).when(near(2880), 2880)).drop("c2")


def read_points(spark: SparkSession, points: str, observations: str, max_std: float = 0.05, max_inv_std: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Points that are known well enough, and the observations of those."""
    p = spark.read.option("header", True).csv(points).select(F.col("uid").cast("long").alias("uid"), *[F.col(f"p{c}_world").cast("double").alias(c) for c in "xyz"], F.col("inv_dist_std").cast("double").alias("inv_std"), F.col("dist_std").cast("double").alias("std"))
    p = p.where((F.col("inv_std") <= max_inv_std) & (F.col("std") <= max_std))
    o = spark.read.option("header", True).csv(observations).select((F.col("frame_tracking_timestamp_us").cast("long") * 1000).alias("time_ns"), F.col("camera_serial").alias("serial"), F.col("uid").cast("long").alias("uid"))
    return p, o.join(p.select("uid"), "uid", "left_semi")


# Cameras of serial numbers where there is no calibration, and the labels of the two that see points.
SERIALS = {"16": "camera-slam-left", "17": "camera-slam-right", "18": "camera-rgb"}
POINT_CAMERAS = {"camera-slam-left": "slaml", "0": "slaml", "slam-front-left": "slaml", "camera-slam-right": "slamr", "1": "slamr", "slam-front-right": "slamr"}


def points_by_camera(observations: DataFrame, calibrations: DataFrame | None = None) -> DataFrame:
    """(time_ns, camera, uids): the points that the left and the right camera see at each time, each list sorted.

    The camera of a serial number is that of the calibrations' labels (the least one, if a serial number has several);
    without calibrations that of the numbers in SERIALS. Observations of other cameras and of unknown ones are left out.
    A point seen twice at a time is listed twice; without observations the result is empty.
    """
    spark = observations.sparkSession
    if calibrations is None:
        known = spark.createDataFrame(list(SERIALS.items()), "serial string, label string")
    else:
        known = calibrations.groupBy("serial").agg(F.min("label").alias("label"))
    camera = F.element_at(F.create_map(*[F.lit(x) for kv in POINT_CAMERAS.items() for x in kv]), F.col("label"))
    cameras = known.select("serial", camera.alias("camera")).where("serial is not null and camera is not null")
    met = observations.select("time_ns", "serial", "uid").join(cameras, "serial")
    return met.groupBy("time_ns", "camera").agg(F.sort_array(F.collect_list("uid")).alias("uids"))


# Which camera a stream id belongs to.
STREAMS = {"214-1": "rgb", "340-5": "rgb", "1201-1": "slaml", "340-1": "slaml", "1201-2": "slamr", "340-2": "slamr"}


def read_views_2d(spark: SparkSession, path: str, least_visible: float = 0.0) -> DataFrame:
    """2D boxes by camera: coordinates at least 0, without NaN; rows of unknown streams count for every camera."""
    raw = spark.read.option("header", True).csv(path)
    at = {c.split("[")[0]: c for c in raw.columns}
    num = lambda n: F.expr(f"try_cast(`{at[n]}` as double)")
    box = [F.greatest(num(n), F.lit(0.0)).alias(n) for n in ("x_min", "x_max", "y_min", "y_max")]
    stream = F.element_at(F.create_map(*[F.lit(x) for kv in STREAMS.items() for x in kv]), F.col(at["stream_id"]))
    out = raw.select(F.explode(F.when(stream.isNull(), F.array(*[F.lit(c) for c in ("rgb", "slaml", "slamr")])).otherwise(F.array(stream))).alias("camera"), F.col(at["object_uid"]).cast("long").alias("inst_id"), F.col(at["timestamp"]).cast("long").alias("time_ns"), *box, F.coalesce(num("visibility_ratio"), F.lit(1.0)).alias("visibility"))
    whole = " and ".join(f"{n} is not null and not isnan({n})" for n in ("x_min", "x_max", "y_min", "y_max"))
    return out.where(whole).where(F.col("visibility") >= least_visible)


def read_object_poses(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    at = {c.split("[")[0]: c for c in raw.columns}
    names = ["t_wo_x", "t_wo_y", "t_wo_z", "q_wo_w", "q_wo_x", "q_wo_y", "q_wo_z"]
    out = raw.select(F.col(at["object_uid"]).cast("long").alias("inst_id"), F.col(at["timestamp"]).cast("long").alias("time_ns"), *[F.col(at[n]).cast("double").alias(n) for n in names])
    return out.where(" and ".join(f"{n} is not null and not isnan({n})" for n in names))


def read_object_extents(spark: SparkSession, path: str) -> DataFrame:
    """Local extents by instance; of several rows the last one counts."""
    raw = spark.read.option("header", True).csv(path)
    at = {c.split("[")[0]: c for c in raw.columns}
    names = [f"p_local_obj_{c}{m}" for c in "xyz" for m in ("min", "max")]
    out = raw.select(F.col(at["object_uid"]).cast("long").alias("inst_id"), F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(at[n]).cast("double").alias(n[12:]) for n in names]).alias("e"))
    whole = " and ".join(f"e.{n[12:]} is not null and not isnan(e.{n[12:]})" for n in names)
    return out.where(whole).groupBy("inst_id").agg(F.max_by("e", "_row").alias("e")).select("inst_id", "e.*")


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """(inst_id, category, description): the instance's name, else its prototype's, else its category."""
    kind = "map<string, struct<category:string, instance_name:string, prototype_name:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("inst_id", "v"))
    return raw.select(F.col("inst_id").cast("long"), "v.category", F.coalesce("v.instance_name", "v.prototype_name", "v.category").alias("description"))


def still_objects(poses: DataFrame, move: float = 0.01, turn: float = 0.01) -> DataFrame:
    """The first pose of objects that are static (time -1) or never move or turn by more than a little."""
    w = Window.partitionBy("inst_id").orderBy("time_ns")
    first = lambda c: F.first(c).over(w)
    t = F.sqrt(sum((F.col(f"t_wo_{c}") - first(f"t_wo_{c}")) ** 2 for c in "xyz"))
    # |R - R0| in Frobenius norm is 2 sqrt(2) |sin(angle / 2)| = 2 sqrt(2 - 2 (q . q0)^2) for unit quaternions
    d = sum(F.col(f"q_wo_{c}") * first(f"q_wo_{c}") for c in "wxyz")
    r = F.sqrt(8 * F.greatest(1 - d * d, F.lit(0.0)))
    rows = poses.withColumn("_t", t).withColumn("_r", r).withColumn("_n", F.row_number().over(w))
    still = rows.groupBy("inst_id").agg(F.max("_t").alias("_mt"), F.max("_r").alias("_mr")).where((F.col("_mt") <= move) & (F.col("_mr") <= turn))
    return rows.where("_n = 1").join(still, "inst_id", "left_semi").drop("_t", "_r", "_n")


def read_poses_txt(spark: SparkSession, path: str) -> DataFrame:
    """Lines of eight tokens: ts tx ty tz qx qy qz qw; of repeated times the last line counts."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"), F.monotonically_increasing_id().alias("_row")).where(F.size("t") == 8)
    names = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    rows = lines.select(F.expr("try_cast(t[0] as bigint)").alias("time_ns"), "_row", F.struct(*[F.col("t")[i + 1].cast("double").alias(n) for i, n in enumerate(names)]).alias("p"))
    return rows.where("time_ns is not null").groupBy("time_ns").agg(F.max_by("p", "_row").alias("p")).select("time_ns", "p.*")


def replay_frames(poses: DataFrame, rgb: DataFrame, depth: DataFrame) -> DataFrame:
    """Poses that have both images, numbered by time."""
    both = poses.join(rgb.select("time_ns"), "time_ns", "left_semi").join(depth.select("time_ns"), "time_ns", "left_semi")
    return both.withColumn("stream_seq", F.row_number().over(Window.orderBy("time_ns")) - 1)


def read_images_json(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    """Annotated boxes of one image-set file: joined with image and category, only those that are valid in 3D."""
    kind = "categories array<struct<id:long,name:string>>, images array<struct<id:long,file_path:string,width:int,height:int,K:array<array<double>>>>, annotations array<struct<image_id:long,category_id:long,valid3D:boolean,bbox3D_cam:array<array<double>>,center_cam:array<double>,bbox2D_tight:array<double>>>"
    raw = spark.read.schema(kind).json(path, multiLine=True)
    part = lambda c: raw.select(F.explode(c).alias("x")).select("x.*")
    corners = F.col("bbox3D_cam")
    valid = F.coalesce("valid3D", F.lit(True)) & (F.size(corners) == 8) & F.forall(corners, lambda c: (F.size(c) == 3) & (c[2] > 0)) & ~F.forall("center_cam", lambda c: c == -1)
    out = part("annotations").where(valid).join(part("images").withColumnRenamed("id", "image_id"), "image_id").join(F.broadcast(part("categories").withColumnRenamed("id", "category_id")), "category_id")
    return out.where(F.col("name").isin(*categories)) if categories else out


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, m): all numbers of each text file in order; files that hold anything else, or no finite number, give null."""
    words = F.regexp_extract_all("value", F.lit(r"(\S+)"), F.lit(1))
    m = F.transform(words, lambda x: x.try_cast("double"))
    bad = (F.size(m) == 0) | F.exists(m, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.when(~bad, m).alias("m"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Class names, one per line; an empty file is an error."""
    out = spark.read.text(path).select(F.trim("value").alias("label")).where("label <> ''")
    if out.limit(1).count() == 0:
        raise ValueError("no labels")
    return out


def read_label_set(spark: SparkSession, folder: str, names: str | list[str] | None = None) -> DataFrame:
    """The classes of the set that is named first, of the file <name>_classes.csv in ``folder``; without such a file the names themselves.

    ``None`` means the set "default". Labels are in a column ``label``; a file without labels is an error.
    """
    names = ["default"] if names is None else [names] if isinstance(names, str) else list(names)
    file = f"{names[0]}_classes.csv" if names else ""
    if file in list_names(spark, folder):
        return read_labels(spark, f"{folder}/{file}")
    return spark.createDataFrame([(n,) for n in names], "label string")


def vocabulary(spark: SparkSession, en: list[str], cn: list[str], colours: dict[str, str]) -> tuple[DataFrame, str]:
    """The table (en, cn, r, g, b) and the prompt of all names; both lists and the colours must agree."""
    import re

    if len(en) != len(cn) or set(colours) != set(en):
        raise ValueError("names, translations and colours do not agree")
    if bad := [c for c in colours.values() if not re.fullmatch("#[0-9a-fA-F]{6}", c)]:
        raise ValueError(f"not a colour: {bad[0]}")
    rows = [(e, c, *(int(colours[e][i : i + 2], 16) for i in (1, 3, 5))) for e, c in zip(en, cn)]
    return spark.createDataFrame(rows, "en string, cn string, r int, g int, b int"), " . ".join(en) + " ."


def usable_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stream messages (ts, content, depth, camera_pose as JSON) that are whole, and those that are not."""
    kind = "struct<position:struct<x:double,y:double,z:double>, orientation:struct<x:double,y:double,z:double,w:double>>"
    out = raw.withColumn("time_ns", F.expr("try_cast(ts as bigint)")).withColumn("pose", F.from_json("camera_pose", kind))
    o = F.col("pose.orientation")
    length = F.sqrt(o["x"] ** 2 + o["y"] ** 2 + o["z"] ** 2 + o["w"] ** 2)
    good = F.coalesce((F.col("time_ns") >= 0) & F.col("content").isNotNull() & F.col("depth").isNotNull() & (length > 1e-8), F.lit(False))
    return out.where(good), out.where(~good)
