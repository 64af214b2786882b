import json

import pytest
from pyspark.sql import functions as F

from orbweave.operators import tracking
from orbweave.sources import files, writers
from orbweave.streaming import incremental
from orbweave.streaming.tracker import track_stream
from tests.test_fusion import SCHEMA, det


def test_stream_tracker_equals_batch(spark, tmp_path):
    rows = [det(2 * f + k, 5.0 * k, frame=f) for f in range(6) for k in range(2)]
    for n, part in enumerate((rows[:6], rows[6:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(n)))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    q = track_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = tracking.track(spark.createDataFrame(rows, SCHEMA))
    key = lambda df: sorted((r.frame_id, r.track_id, r.state, r.support, round(r.tx, 6)) for r in df.collect())
    assert key(got) == key(want)


def test_incremental_fusion_keeps_ids(spark, tmp_path):
    fusion = incremental.IncrementalFusion(str(tmp_path / "state"), min_detections=2, snapshots=str(tmp_path / "snapshots"))
    run = lambda rows, n: {r.stable_id: (r.support_count, round(r.tx, 3)) for r in fusion.update(spark.createDataFrame(rows, SCHEMA), n).collect()}
    assert run([det(0, 0), det(1, 0), det(2, 20)], 0) == {0: (2, 0.0)}
    second = run([det(3, 20), det(4, 0), det(5, 40), det(6, 40)], 1)
    assert second == {0: (3, 0.0), 1: (2, 20.0), 2: (2, 40.0)}
    assert run([det(3, 20), det(4, 0), det(5, 40), det(6, 40)], 1) == second  # a replayed batch changes nothing
    assert files.list_names(spark, str(tmp_path / "snapshots"))
    assert writers.newest_snapshot(["1.csv", "20.csv", "x.csv", "3.txt"]) == 20


def test_merged_components_become_aliases(spark):
    old = spark.createDataFrame([(0, 1, 5), (0, 2, 7)], "scene_id long, det_id long, stable_id long")
    new = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 3)], "scene_id long, det_id long, cluster long")
    named, aliases = incremental.stable_ids(old, new, spark.createDataFrame([(0, 8)], "scene_id long, next_id long"))
    assert {r.cluster: r.name for r in named.collect()} == {1: 5, 3: 8}
    assert [(r.alias, r.stable_id) for r in aliases.collect()] == [(7, 5)]


def test_conflation(spark):
    f = spark.createDataFrame([(0, 1), (0, 3), (1, 2)], "scene_id long, stream_seq long")
    assert sorted(map(tuple, incremental.latest_frames(f).collect())) == [(0, 3), (1, 2)]


def test_boxes_round_trip(spark, tmp_path):
    rows = [(1000, 1.0, 2.0, 3.0, 1.0, 2.0, 0.5, 0.7, "Chair, red", 4, 8, 0.9), (1000, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, None, 5, 9, 0.8)]
    df = spark.createDataFrame(rows, "time_ns long, tx double, ty double, tz double, sx double, sy double, sz double, yaw double, label string, inst_id long, sem_id int, prob double")
    names = spark.createDataFrame([(9, "Bookshelf")], "sem_id int, name string")
    writers.write_boxes_3d(df, str(tmp_path / "b.csv"), names)
    got = {r.inst_id: r for r in files.read_boxes_3d(spark, str(tmp_path / "b.csv")).collect()}
    assert (got[4].tx, got[4].yaw, got[4].label, got[5].label) == (1.0, pytest.approx(0.7), "chair  red", "bookshelf")
    assert {r.sem_id for r in files.read_boxes_3d(spark, str(tmp_path / "b.csv"), any_class=32).collect()} == {32}


def test_export_undoes_the_world_frame(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, "chair", 3, 1, 0.5)], "time_ns long, tx double, ty double, tz double, qw double, qx double, qy double, qz double, sx double, sy double, sz double, label string, inst_id long, sem_id int, prob double")
    v, prompt = files.vocabulary(spark, ["chair", "table"], ["椅", "桌"], {"chair": "#010203", "table": "#ffffff"})
    r = writers.exported(df, v, semantic_colours=True).first()
    assert (r.tx, r.ty, r.tz, r.name, r.r, r.g, r.b) == (2.0, -3.0, -1.0, "椅", 1, 2, 3) and prompt == "chair . table ."
    back = spark.range(1).select(writers.sensor_position(F.array(F.lit(2.0), F.lit(-3.0), F.lit(-1.0))).alias("t")).first().t
    assert back == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        files.vocabulary(spark, ["a"], ["b", "c"], {"a": "#000000"})


def test_readers(spark, tmp_path):
    (tmp_path / "poses.txt").write_text("1 0 0 0 0 0 0 1\nbad line\n1 5 0 0 0 0 0 1\n2 1 1 1 0 0 0 1\n")
    assert {r.time_ns: r.tx for r in files.read_poses_txt(spark, str(tmp_path / "poses.txt")).collect()} == {1: 5.0, 2: 1.0}
    (tmp_path / "i.json").write_text(json.dumps({"7": {"category": "c", "prototype_name": "p"}, "8": {"category": "d"}}))
    assert {r.inst_id: r.description for r in files.read_instances(spark, str(tmp_path / "i.json")).collect()} == {7: "p", 8: "d"}
    (tmp_path / "v.csv").write_text("stream_id,object_uid,timestamp[ns],x_min[pixel],x_max[pixel],y_min[pixel],y_max[pixel],visibility_ratio[%]\n214-1,1,5,-3,4,0,9,0.9\n77-7,2,5,0,4,0,9,0.9\n214-1,3,5,nan,4,0,9,0.9\n214-1,4,5,0,4,0,9,0.1\n")
    v = files.read_views_2d(spark, str(tmp_path / "v.csv"), 0.5).collect()
    assert sorted((r.inst_id, r.camera, r.x_min) for r in v) == [(1, "rgb", 0.0), (2, "rgb", 0.0), (2, "slaml", 0.0), (2, "slamr", 0.0)]
    (tmp_path / "m.txt").write_text("1 2\n3 4\n")
    assert files.read_matrix(spark, str(tmp_path / "m.txt")).first().m == [1, 2, 3, 4]
    (tmp_path / "t.csv").write_text("tracking_timestamp_us,tx_world_device,ty_world_device,tz_world_device,qx_world_device,qy_world_device,qz_world_device,qw_world_device\n1,0,0,0,0,0,0,1\n2,1,0,0,0,0,0,1\n")
    assert [(r.time_ns, r.tx) for r in files.read_trajectory(spark, str(tmp_path / "t.csv")).orderBy("time_ns").collect()] == [(1000, 0.0), (2000, 1.0)]
    g, b = files.usable_messages(spark.createDataFrame([("5", b"x", b"y", '{"position":{"x":0,"y":0,"z":0},"orientation":{"x":0,"y":0,"z":0,"w":1}}'), ("x", b"x", b"y", "{}"), ("-1", b"x", b"y", "{}")], "ts string, content binary, depth binary, camera_pose string"))
    assert g.count() == 1 and b.count() == 2
    p = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 9, 0.005, 1.0), (2, 0, 0.0, 1.0), (2, 9, 5.0, 1.0)], "inst_id long, time_ns long, t_wo_x double, q_wo_w double").selectExpr("*", "0.0D t_wo_y", "0.0D t_wo_z", "0.0D q_wo_x", "0.0D q_wo_y", "0.0D q_wo_z")
    assert [r.inst_id for r in files.still_objects(p).collect()] == [1]
