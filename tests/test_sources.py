"""The message stream and its quarantine, table functions, scenes from their tables."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from orbweave.functions import boxes, tables
from orbweave.plans.spaces import lits
from orbweave.sources import files, messages, scenes, writers

POSE = {"position": {"x": 1.0, "y": 2.0, "z": 3.0}, "orientation": {"x": 0.0, "y": 0.0, "z": 0.0, "w": 1.0}}


def message(ts, **changes):
    out = {"ts": ts, "content": base64.b64encode(b"rgb%d" % int(ts) if str(ts).isdigit() else b"rgb").decode(), "depth": base64.b64encode(b"depth").decode(), "camera_pose": json.dumps(POSE)} | changes
    return {k: v for k, v in out.items() if v is not ...}


def run(spark, tmp_path, max_bytes=messages.MAX_BYTES):
    stream = messages.read_messages(spark, str(tmp_path / "log"), max_bytes)
    q = messages.store_messages(stream, str(tmp_path / "good"), str(tmp_path / "bad")).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    read = lambda n: spark.read.parquet(str(tmp_path / n)).collect() if os.path.isdir(tmp_path / n) else []
    return sorted(r["time_ns"] for r in read("good")), read("bad"), read("good")


@pytest.mark.parametrize("max_bytes", [messages.MAX_BYTES, 97])
def test_messages_come_once_across_restarts(spark, tmp_path, max_bytes):
    os.makedirs(tmp_path / "log")
    a, b = str(tmp_path / "log" / "a.jsonl"), str(tmp_path / "log" / "b.jsonl")
    messages.append_messages(a, [message(str(i)) for i in range(20)])
    messages.append_messages(b, [message(100), message("x"), message(-1), message(101, depth=...), message(102, content="no base64!"), message(103, camera_pose="{}"), message(104, camera_pose=POSE)])
    with open(a, "a") as f:
        f.write('{"ts": "20", "content"')  # still being written
    good, bad, rows = run(spark, tmp_path, max_bytes)
    assert good == [*range(20), 100, 104]
    assert sorted(json.loads(r["message"])["ts"] if isinstance(json.loads(r["message"])["ts"], int) else 0 for r in bad) == [-1, 0, 101, 102, 103]
    assert {bytes(r["content"]) for r in rows if r["time_ns"] == 7} == {b"rgb7"} and {r["pose"]["position"]["z"] for r in rows} == {3.0}
    with open(a, "a") as f:
        f.write(': "' + base64.b64encode(b"late").decode() + '", "depth": "", "camera_pose": ' + json.dumps(POSE) + '}\nno json\n\n[1]\n')
    messages.append_messages(str(tmp_path / "log" / "c.jsonl"), [message(300)])
    good, bad, rows = run(spark, tmp_path, max_bytes)
    assert good == [*range(21), 100, 104, 300] and len(bad) == 7
    assert run(spark, tmp_path, max_bytes)[0] == good  # nothing new
    whole = {(r["shard"], r["position"]) for r in [*rows, *bad]}
    assert len(whole) == len(rows) + len(bad)


def test_whole_lines_of_long_files(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"a\n" + b"b" * 200_000)
    assert messages.whole_lines(str(path)) == 2 and messages.whole_lines(str(path), 2) == 2
    path.write_bytes(b"a\n" + b"b" * 200_000 + b"\nc")
    assert messages.whole_lines(str(path), 2) == 200_003


def test_table_functions_equal_the_column_functions(spark):
    tables.register(spark)
    turn = (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    d = spark.range(3).select("id", lits(1, 2, 3).alias("c"), F.when(F.col("id") != 2, lits(2, 4, 6)).alias("s"), lits(*turn).alias("r"))
    d.createOrReplaceTempView("some_boxes")
    for call, column in (("edge_points(c, s, r, 3)", boxes.edge_points(F.col("c"), F.col("s"), F.col("r"), 3)), ("voxel_points(c, s, r, 2, 3, 1)", boxes.voxel_grid(F.col("c"), F.col("s"), F.col("r"), 2, 3, 1))):
        got = [tuple(r) for r in spark.sql(f"SELECT b.id, p.* FROM some_boxes b, LATERAL {call} p").collect()]
        want = [(r["id"], r["pos"], *r["p"]) for r in d.where("id < 2").select("id", F.posexplode(column).alias("pos", "p")).collect()]
        assert [g[:2] for g in sorted(got)] == [w[:2] for w in sorted(want)]
        assert [x for g in sorted(got) for x in g[2:]] == pytest.approx([x for w in sorted(want) for x in w[2:]])
    assert spark.sql("SELECT count(*) AS n FROM some_boxes b, LATERAL voxel_points(c, s, r, 0, 1, 1) p").first()["n"] == 0


CLASSES = [("Chair", 3), ("Table", 7), ("chair", 9)]


def test_classes_of_instances(spark):
    rows = [(1, "Chair"), (2, "CHAIR"), (3, "Lamp"), (4, "table"), (5, "Vase"), (6, "Lamp"), (20_000, "lamp"), (15_000, "Table"), (7, None)]
    df = spark.createDataFrame(rows, "inst_id long, category string").repartition(3)
    got = {r["inst_id"]: (r["sem_id"], r["matched"], r["new_id"]) for r in scenes.classified(df, spark.createDataFrame(CLASSES, "name string, sem_id int")).collect()}
    assert got == {1: (3, "Chair", 1), 2: (3, "Chair", 2), 3: (10, None, 3), 4: (7, "Table", 4), 5: (11, None, 5), 6: (10, None, 6), 20_000: (13, None, 10_002), 15_000: (7, "Table", 10_001), 7: (12, None, 7)}


def test_moments_of_three_cameras(spark):
    ms = 1_000_000
    rows = [("rgb", 10 * ms, 1), ("rgb", 20 * ms, 1), ("slaml", 11 * ms - 1, 1), ("slaml", 11 * ms, 2), ("slaml", 15 * ms, 1), ("slamr", 15 * ms + 5, 1), ("slamr", 30 * ms, 3), ("slamr", 10 * ms + ms // 2, 1), ("slamr", 10 * ms + 2, 1)]
    df = spark.createDataFrame([(c, t, i, float(n), float(n) + 1, 0.0, 1.0) for n, (c, t, i) in enumerate(rows)], "camera string, time_ns long, inst_id long, x_min double, x_max double, y_min double, y_max double").repartition(3)
    got = {(r["moment"], r["inst_id"]): (r["bb2_rgb"][0], r["bb2_slaml"][0], r["bb2_slamr"][0]) for r in scenes.seen_objects(df).collect()}
    # 11 ms is a moment of its own: not less than a millisecond from 10 ms; 10.5 ms is as near to it as to 10 ms
    assert got == {(10 * ms, 1): (0, 2, 7), (20 * ms, 1): (1, -1, -1), (11 * ms, 2): (-1, 3, -1), (15 * ms, 1): (-1, 4, 5), (30 * ms, 3): (-1, -1, 6)}


def test_scene(spark):
    poses = [(i, t, float(x), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0) for i, t, x in ((1, -1, 0), (2, 5, 1), (2, 9, 1.005), (3, 5, 1), (3, 9, 2), (4, -1, 4), (4, 9, 5), (5, -1, 0))]
    frames = spark.createDataFrame(poses, "inst_id long, time_ns long, t_wo_x double, t_wo_y double, t_wo_z double, q_wo_w double, q_wo_x double, q_wo_y double, q_wo_z double")
    extents = spark.createDataFrame([(i, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0) for i in (1, 2, 3, 4)], "inst_id long, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double")
    named = spark.createDataFrame([(i, "Chair" if i < 3 else "Odd", f"thing {i}") for i in (1, 2, 3, 4, 5)], "inst_id long, category string, description string")
    classes = spark.createDataFrame(CLASSES, "name string, sem_id int")
    flat = {r["inst_id"]: r for r in scenes.scene_objects(frames, extents, named, classes).collect()}
    assert set(flat) == {1, 2, 4} and flat[4]["t_wo_x"] == 4.0 and flat[2]["t_wo_x"] == 1.0 and {r["time_ns"] for r in flat.values()} == {-1}
    assert (flat[1]["text"], flat[4]["text"], flat[4]["sem_id"]) == ("Chair", "Odd", 10)
    views = spark.createDataFrame([("rgb", 100, 1, 1.0, 2.0, 3.0, 4.0), ("slamr", 200, 3, 1.0, 2.0, 3.0, 4.0)], "camera string, time_ns long, inst_id long, x_min double, x_max double, y_min double, y_max double")
    (row,) = scenes.scene_objects(frames, extents, named, classes, views, described=True).collect()
    assert (row["time_ns"], row["inst_id"], row["bb2_rgb"], row["bb2_slamr"][0], row["text"]) == (100, 1, [1, 2, 3, 4], -1, "thing 1")


def test_points_by_camera(spark):
    seen = spark.createDataFrame([(1, "a", 7), (1, "a", 3), (1, "b", 7), (2, "c", 9), (2, "x", 9), (2, None, 1), (3, "b", 4), (3, "b", 4)], "time_ns long, serial string, uid long")
    calibrations = spark.createDataFrame([(0, "camera-slam-left", "a"), (5, "camera-slam-left", "a"), (0, "slam-front-right", "b"), (0, "camera-rgb", "c"), (0, "0", None)], "time_ns long, label string, serial string")
    got = {(r["time_ns"], r["camera"]): r["uids"] for r in files.points_by_camera(seen, calibrations).collect()}
    assert got == {(1, "slaml"): [3, 7], (1, "slamr"): [7], (3, "slamr"): [4, 4]}
    plain = spark.createDataFrame([(1, "16", 2), (1, "17", 5), (1, "18", 6), (1, "a", 8)], "time_ns long, serial string, uid long")
    assert {(r["camera"], *r["uids"]) for r in files.points_by_camera(plain).collect()} == {("slaml", 2), ("slamr", 5)}
    assert files.points_by_camera(seen.limit(0), calibrations).count() == 0


def test_label_sets(spark, tmp_path):
    (tmp_path / "rooms_classes.csv").write_text("chair\n\n  table \n")
    (tmp_path / "none_classes.csv").write_text("\n \n")
    read = lambda names: [r["label"] for r in files.read_label_set(spark, str(tmp_path), names).collect()]
    assert read("rooms") == read(["rooms", "ignored"]) == ["chair", "table"]
    assert read(["lamp", "rooms"]) == ["lamp", "rooms"] and read("lamp") == ["lamp"] and read(None) == ["default"] and read([]) == []
    with pytest.raises(ValueError):
        read("none")


def test_views_come_back_from_their_table(spark, tmp_path):
    rows = [(4, 10, "rgb", 1.5, 20.25, 3.0, 4.0), (4, 10, "slaml", 0.0, 2.0, 0.125, 9.0), (5, 11, "slamr", 7.0, 8.0, 1.0, 2.0), (-1, 11, "rgb", 1.0, 2.0, 3.0, 4.0), (6, 12, "depth", 1.0, 2.0, 3.0, 4.0), (6, 12, None, 1.0, 2.0, 3.0, 4.0)]
    boxes_2d = spark.createDataFrame(rows, "inst_id long, time_ns long, camera string, x_min double, x_max double, y_min double, y_max double")
    writers.dump_views_2d(boxes_2d, str(tmp_path))
    got = files.read_views_2d(spark, f"{tmp_path}/2d_bounding_box.csv").select("inst_id", "time_ns", "camera", "x_min", "x_max", "y_min", "y_max", "visibility")
    assert sorted(map(tuple, got.collect())) == sorted((*r, 0.0) for r in rows[:3])
