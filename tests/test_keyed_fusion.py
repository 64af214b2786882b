"""Incremental fusion as keyed state: against taking everything anew, against itself on a stream, and what it writes."""

import copy
import os
import random

import pytest
from pyspark.sql import functions as F

from orbweave.operators import fuse
from orbweave.operators.spatial import BOX
from orbweave.streaming import keyed_fusion
from orbweave.streaming.keyed_fusion import FusionConfig, SceneFusion, component_changes, fused_box, published
from tests.test_fusion import SCHEMA, det


def member(row):
    _, frame, i, label, prob, *box = row
    return [i, frame, label, prob, *box]


def made(n, seed, spread=12, frames=6):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        size = (draw.uniform(0.8, 1.5), draw.uniform(0.8, 1.5), 1.0)
        rows.append(det(i, draw.randrange(spread) * 1.3 + draw.uniform(-0.2, 0.2), frame=draw.randrange(frames), label=draw.choice("ab"), prob=draw.uniform(0.5, 1), size=size, yaw=draw.uniform(-0.3, 0.3)))
    return rows


def test_one_box_as_the_table_operators_make_it(spark):
    rows = [(*r, f"{i % 7}") for i, r in enumerate(made(80, 1, spread=2))]
    got = {r.cluster: r for r in fuse.fuse_members(spark.createDataFrame(rows, SCHEMA + ", cluster string")).collect()}
    for key, want in got.items():
        one = fused_box([member(r[:-1]) for r in rows if r[-1] == key])
        assert [one[c] for c in (*BOX, "prob")] == pytest.approx([want[c] for c in (*BOX, "prob")], abs=1e-9)
        assert (one["label"], one["support_count"], one["members"]) == (want.label, want.support_count, want.members)


class Everything(SceneFusion):
    """Cleans against all components of the scene, near or not."""

    def _cleaned_with(self, found, held, others, old):
        return super()._cleaned_with(found, held, {i: [-1e9] * 3 + [1e9] * 3 for i in others}, old)


class Counted(dict):
    def __init__(self, *args):
        super().__init__(*args)
        self.read, self.written = [], []

    def __getitem__(self, key):
        self.read.append(key)
        return super().__getitem__(key)

    def __setitem__(self, key, value):
        self.written.append(key)
        super().__setitem__(key, value)


@pytest.mark.parametrize("seed", range(6))
def test_near_components_are_all_that_matter(seed):
    rows = made(120, seed)
    one, all_ = (kind(FusionConfig(min_detections=2, nms=0.3, contained=0.6), {}, {}, {}) for kind in (SceneFusion, Everything))
    for at in range(0, 120, 15):
        part = [member(r) for r in rows[at : at + 15]]
        one.update(copy.deepcopy(part))
        all_.update(copy.deepcopy(part))
        assert one.contents == all_.contents and one.bounds == all_.bounds and one.aliases == all_.aliases
    held = sorted(m for x in one.contents.values() for m in x["members"])
    assert held == sorted(r[2] for r in rows if r[4] >= 0.55)  # each in one component
    assert all(len({m[1] for m in x["all"]}) == len(x["all"]) for x in one.contents.values() if x["support_count"] < 2)


def test_a_batch_reads_and_writes_what_it_touches():
    contents = Counted()
    scene = SceneFusion(FusionConfig(min_detections=1), {}, contents, {})
    scene.update([member(det(i, 5.0 * i, frame=0)) for i in range(200)])
    assert len(contents) == 200
    contents.read, contents.written = [], []
    (change,) = scene.update([member(det(1000, 5.0 * 7, frame=1))])
    assert set(contents.read) == set(contents.written) == {7} and change[0] == 7 and change[1]["members"] == [7, 1000]


def test_merged_components_leave_an_alias_and_ids_stay():
    scene = SceneFusion(FusionConfig(min_detections=1, nms=None, contained=0), {}, {}, {})
    scene.update([member(det(0, 0.0, frame=0, size=(2, 1, 1))), member(det(1, 1.6, frame=1, size=(2, 1, 1)))])
    assert sorted(scene.contents) == [0, 1]
    changes = dict(scene.update([member(det(2, 0.8, frame=2, size=(2, 1, 1)))]))
    assert changes[1] is None and changes[0]["members"] == [0, 1, 2] and scene.aliases == {1: 0}
    scene.update([member(det(3, 50.0, frame=3))])
    assert sorted(scene.contents) == [0, 2]  # the id of an alias is not given again


def test_weak_and_empty_batches_change_nothing():
    scene = SceneFusion(FusionConfig(), {}, {}, {})
    assert scene.update([]) == [] and scene.update([member(det(0, 0, prob=0.1)), [1, 0, "a", None, *[1.0] * 7]]) == [] and not scene.contents


def test_components_are_those_of_the_table_version(spark, tmp_path):
    """The two ways to fuse batch by batch agree where neither cleans; new names go to small clusters first here."""
    from orbweave.plans import catalog
    from orbweave.streaming.incremental import IncrementalFusion

    d = catalog.det3(spark, "/root/testdata/sf0.001").where("scene_id < 3").cache()
    fusion = IncrementalFusion(str(tmp_path / "state"))
    for n in (0, 1):
        out = fusion.update(d.where((F.col("frame_id") % 50 >= 25) == bool(n)), n)
    key = lambda rows: sorted((r.scene_id, r.support_count, tuple(r.members), round(r.tx, 5), r.label) for r in rows)
    config = FusionConfig(nms=None, contained=0.0)
    got = published(component_changes(d.withColumn("part", (F.col("frame_id") % 50 >= 25).cast("int")), config, batch="part"))
    assert key(got.collect()) == key(out.collect())


def plain(rows, config, parts):
    """Published components of one scene, with plain mappings."""
    scene = SceneFusion(config, {}, {}, {})
    for part in parts:
        scene.update(sorted(member(r) for r in rows if r[2] in part))
    return {i: (x["support_count"], x["members"], round(x["tx"], 6)) for i, x in scene.contents.items() if x["support_count"] >= config.min_detections}


def test_table_equals_plain_mappings(spark):
    config = FusionConfig(min_detections=2)
    rows = [(s, *r[1:]) for s in (0, 1) for r in made(60, s)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "cast(det_id / 20 as int) as part")
    got = published(component_changes(df, config, batch="part"), 2).collect()
    for s in (0, 1):
        want = plain([r for r in rows if r[0] == s], config, [range(k, k + 20) for k in (0, 20, 40)])
        assert {r.stable_id: (r.support_count, r.members, round(r.tx, 6)) for r in got if r.scene_id == s} == want


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    for k, v in keyed_fusion.STORE.items():
        spark.conf.set(k, v)
    config = FusionConfig(min_detections=2)
    rows = made(90, 9)
    parts = [range(0, 60), range(60, 75), range(75, 90)]
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    for n, part in enumerate(parts):
        spark.createDataFrame([r for r in rows if r[2] in part], SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / str(n)))
        if n == 1:
            continue  # this one and the next come after a restart, in one go
        q = component_changes(source, config).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
    for k in keyed_fusion.STORE:
        spark.conf.unset(k)
    changes = spark.read.parquet(str(tmp_path / "out"))
    got = {r.stable_id: (r.support_count, r.members, round(r.tx, 6)) for r in published(changes, 2).collect()}
    assert got == plain(rows, config, parts) and got
    assert os.path.isdir(tmp_path / "check" / "state")
