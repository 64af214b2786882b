"""What grows with the tables: no side of a join through the driver, ties, links once, bounded kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import camera, geometry
from orbweave.operators import oriented, views


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture()
def placed(spark):
    turn = geometry.rotation_of_euler(F.lit(0.1), F.lit(0.2), F.col("id") * 0.1)
    return spark.range(300).select(F.col("id").alias("det_id"), (F.col("id") % 3).alias("scene_id"), F.array(F.col("id") % 7 * 0.9, F.col("id") % 5 * 1.1, F.lit(0.5)).alias("center"), F.array(1 + F.col("id") % 4 * 1.5, F.lit(1.0), F.lit(1.2)).alias("size"), turn.alias("rotation"))


def test_points_that_were_exploded_are_not_broadcast(spark, placed):
    frames = placed.select("scene_id").distinct().withColumn("camera", camera.camera(F.array(*map(F.lit, (200.0, 200.0, 160.3, 119.7))), F.lit(320), F.lit(240))).withColumn("pose", geometry.pose(F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1, 0, -1, 0)]), F.array(*map(F.lit, (3.0, -4.0, 1.0)))))
    points = views.box_edge_points(placed, ["scene_id"], ("center", "size", "rotation"), 4)
    apart = views.patch_depths(points, frames, ["scene_id"], 320, 240, 16)
    met = views.box_edge_points(placed.join(frames, "scene_id"), ["scene_id", "camera", "pose"], ("center", "size", "rotation"), 4)
    met = views.patch_depths(met, frames, ["scene_id"], 320, 240, 16)
    assert "Broadcast" not in plan(apart)
    rows = lambda df: {tuple(r)[:3]: round(r["depth"], 9) for r in df.collect()}
    assert rows(apart) == rows(met) and len(rows(apart)) == 3 * 300 and max(rows(apart).values()) > 0


def test_boxes_in_cells_are_not_broadcast_and_all_pairs_found(placed):
    met = oriented.sphere_pairs(placed, placed, ["scene_id"], F.col("a_det_id") < F.col("b_det_id"))
    assert "Broadcast" not in plan(met)
    r = placed.withColumn("r", F.sqrt(sum(F.col("size")[i] ** 2 for i in range(3))) / 2).collect()
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a["center"], b["center"]))
    want = sorted((a["det_id"], b["det_id"]) for a in r for b in r if a["det_id"] < b["det_id"] and a["scene_id"] == b["scene_id"] and far(a, b) <= (a["r"] + b["r"]) ** 2)
    assert sorted(map(tuple, met.select("a_det_id", "b_det_id").collect())) == want


def test_cells_on_a_face_are_not_inside():
    rng = np.random.default_rng(3)
    at = rng.uniform(-20, 20, (2000, 3))
    box = lambda c: np.concatenate([c, np.tile([1.0, 0.8, 1.0], (len(c), 1)), np.tile(np.eye(3).ravel(), (len(c), 1))], 1)
    # moved by an eighth of the side: the outer cells' centres come to lie on the face
    assert set(oriented._cells_inside(box(at), box(at + [0.0, 0.1, 0.0]), oriented._grid(4))) == {48}


def edge_reads(spark, edges):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    return edges.mapInPandas(count, edges.schema), seen


@pytest.mark.parametrize("few", (0, 1 << 17))
def test_components_read_edges_once_and_join_in_tasks(spark, monkeypatch, few):
    from orbweave.operators import graph

    monkeypatch.setattr(graph, "FEW", few)
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(a) + 1) for a in rng.permutation(400) if a % 50 != 49] + [(500, int(b)) for b in range(600, 640)] + [(7, 7)]
    edges, seen = edge_reads(spark, spark.createDataFrame(pairs, "a long, b long").repartition(5))
    found = dict(map(tuple, graph.components(spark.range(700).withColumnRenamed("id", "node"), edges).collect()))
    assert found == {n: n // 50 * 50 if n < 400 else 500 if n == 500 or 600 <= n < 640 else n for n in range(700)}
    assert seen.value == len(pairs)


def test_clusters_read_edges_once(spark):
    from orbweave.operators import greedy

    nodes = spark.range(60).selectExpr("id as det_id", "id % 2 as frame_id")
    edges, seen = edge_reads(spark, spark.range(59).selectExpr("id as a", "id + 1 as b", "0.5D as iou"))
    assert greedy.cluster(nodes, edges).count() == 60 and seen.value == 59


def test_assignment_of_pieces_costs_what_the_whole_matrix_does():
    from orbweave.operators import greedy

    rng = np.random.default_rng(2)
    for trial in range(40):
        full = np.where(rng.random((30, 25)) < 0.06, rng.random((30, 25)), 1e6)
        x, y = np.nonzero(full < 1e6)
        want = [(i, j) for i, j in greedy.assign(full) if full[i, j] < 1e6]
        assert [(i, j) for i, j in ((np.unique(x)[a], np.unique(y)[b]) for a, b in greedy.assign_listed(x, y, full[x, y]))] == want


def test_sampling_holds_one_block_of_pairs():
    import tracemalloc

    from orbweave.operators import spatial

    rng = np.random.default_rng(1)
    a, b = (np.column_stack([rng.uniform(0, 2, (20_000, 3)), rng.uniform(0.5, 2, (20_000, 3)), rng.uniform(-3, 3, 20_000)]) for _ in range(2))
    tracemalloc.start()
    whole = spatial.sampled_iou(a, b)
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
    assert (whole[:50] == spatial.sampled_iou(a[:50], b[:50])).all()


def test_pairs_of_vectors_by_blocks_are_those_by_row(spark, monkeypatch):
    from orbweave.operators import fuse

    monkeypatch.setattr(fuse, "VECTORS", 40)
    monkeypatch.setattr(fuse, "STRIP", 7)
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(150, 4)), 2)
    v[7] = 0
    rows = [(i, i % 2 if i < 148 else None, x.tolist()) for i, x in enumerate(v)] + [(900, 0, None), (901, 0, [1.0, None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    f = v.astype(np.float32).astype(float)
    cos = lambda i, j: f[i] @ f[j] / np.sqrt((f[i] @ f[i]) * (f[j] @ f[j]))
    want = [(i, j) for i in range(148) for j in range(i + 1, 148) if i % 2 == j % 2 and 7 not in (i, j) and cos(i, j) >= 0.7]
    assert sorted(map(tuple, fuse.alike_pairs(df, "label", 0.7).collect())) == want


def test_vectors_go_with_links_as_narrow_as_they_came(spark):
    from orbweave.operators import fuse

    known = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "det_id long, embedding array<float>")
    out = fuse.alike(spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long"), known, 0.5)
    assert [tuple(r) for r in out.collect()] == [(1, 2)]
    assert "cast(embedding" not in out._jdf.queryExecution().analyzed().toString()


def test_places_of_edge_points_and_their_table_function(spark, placed):
    from orbweave.functions import boxes, tables

    rows = lambda df: sorted((r["det_id"], r["pos"], *(round(r[c], 9) for c in "xyz")) for r in df.collect())
    got = views.box_edge_points(placed, ["det_id"], ("center", "size", "rotation"), 3, "pos")
    want = placed.select("det_id", F.posexplode(boxes.edge_points(F.col("center"), F.col("size"), F.col("rotation"), 3)).alias("pos", "p")).select("det_id", "pos", *[F.col("p")[i].alias(n) for i, n in enumerate("xyz")])
    assert rows(got) == rows(want) and len(rows(got)) == 300 * 36
    assert tables.EdgePoints.evalType == 300  # rows of few points, no Arrow batch for each box


def test_bounds_that_meet_are_found_together():
    from orbweave.streaming import keyed_fusion as k

    rng = np.random.default_rng(6)
    boxes = np.column_stack([rng.uniform(0, 9, (60, 3)), rng.uniform(0.2, 2, (60, 3)), rng.uniform(-3, 3, 60)]).tolist()
    known = {i: k.bounds_of([[0, 0, "", 0, *b]]) for i, b in enumerate(boxes[:40])}
    new = k.each_bounds(boxes[40:])
    meet = lambda a, b: all(a[i] <= b[i + 3] and b[i] <= a[i + 3] for i in range(3))
    assert k._met(known, new) == [i for i in known if any(meet(known[i], b) for b in new.tolist())]
    assert k._met({}, new) == [] and k._met(known, new[:0]) == []


def test_grids_of_boxes_are_made_once():
    assert views._edge_grid(4) is views._edge_grid(4) and views._edge_grid(4).shape == (48, 3)
