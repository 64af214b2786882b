"""Global ranks, slices, quantiles and time lines."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import ranks, timelines


def numbers(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double").repartition(5)


def test_ranks_are_gapless_and_in_order(spark):
    draw = random.Random(1)
    values = [(i, draw.randrange(40)) for i in range(500)]
    got = ranks.ranked(spark.createDataFrame(values, "i long, v long").repartition(6), "v", F.desc("i")).collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["rank"])] == [i for i, v in sorted(values, key=lambda x: (x[1], -x[0]))]
    assert sorted(r["rank"] for r in got) == list(range(500))
    assert ranks.ranked(spark.createDataFrame([], "v long"), "v").count() == 0


@pytest.mark.parametrize("steps", [(("start", 3), ("most", 20), ("every", 4)), (("most", 20), ("start", 3), ("every", 4)), (("every", 4), ("start", 3), ("most", 5)), (("start", 2), ("most", None))])
def test_slices_follow_the_order_of_their_steps(spark, steps):
    df = spark.createDataFrame([(t, k) for t in range(0, 300, 3) for k in range(3)] + [(None, 9)], "t long, k long").repartition(4)
    want = list(range(0, 300, 3))
    for what, n in steps:
        want = want[n:] if what == "start" else want[::n] if what == "every" else want[:n]
    assert sorted((r["t"], r["k"]) for r in ranks.sliced(df, "t", *steps).collect()) == [(t, k) for t in want for k in range(3)]
    with pytest.raises(ValueError):
        ranks.sliced(df, "t", ("stop", 1))


@pytest.mark.parametrize("few", [10_000, 3])
@pytest.mark.parametrize("kind", ["even", "ties", "tails", "one"])
def test_order_statistics_are_exact(spark, kind, few, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "CELLS", 16)
    draw = np.random.default_rng(2)
    values = {"even": draw.uniform(-5, 5, 700), "ties": draw.integers(0, 4, 700).astype(float), "tails": np.exp(draw.normal(size=700) * 40) * draw.choice([-1, 1], 700), "one": np.full(50, 2.5)}[kind].tolist()
    df = numbers(spark, [*values, None, math.nan])
    at = sorted({0, 1, len(values) // 3, len(values) // 2, len(values) - 1})
    assert ranks.order_statistics(df, "x", at) == [sorted(values)[k] for k in at]
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    assert ranks.quantiles(df, "x", shares) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)


def test_normalised(spark):
    got = lambda robust, values: [r["v"] for r in ranks.normalised(numbers(spark, values), "x", "v", robust).orderBy("i").collect()]
    assert got(None, [1.0, 3.0, 2.0]) == pytest.approx([0, 1, 0.5]) and got((0.25, 0.75), [0.0, 1.0, 2.0, 3.0, 4.0]) == pytest.approx([0, 0, 0.5, 1, 1])
    assert got((0.1, 0.9), [None]) == [None] and ranks.quantiles(numbers(spark, []), "x", [0.5]) == [None]
    with pytest.raises(ValueError):
        ranks.order_statistics(numbers(spark, [1.0]), "x", [1])


def test_frame_rates_and_their_guards(spark):
    lines = {"camera": [0, 33_000_000, 66_000_000, 66_000_000, 166_000_000], "index": [0, 1, 2, 3], "fast": [0, 2_000, 4_000], "single": [5], "same": [7, 7, 7]}
    df = spark.createDataFrame([(k, t) for k, ts in lines.items() for t in ts], "line string, time_ns long").repartition(3)
    got = {r["line"]: r["fps"] for r in timelines.frame_rates(df, ["line"], fallback=F.when(F.col("line") == "index", 30).otherwise(10)).collect()}
    assert got == pytest.approx({"camera": 1e9 / 33e6, "index": 30, "fast": 10, "single": 10, "same": 10})


def test_observed_lately_falls_back_to_the_nearest(spark):
    frames = spark.createDataFrame([("a", 1, 1000), ("a", 2, 5000), ("a", 3, 9000), ("b", 4, 1000)], "k string, id long, time_ns long")
    seen = spark.createDataFrame([("a", 800, 7), ("a", 900, 7), ("a", 1000, 8), ("a", 5040, 9), ("a", 5040, 10), ("a", 4930, 11), ("a", 9200, 12)], "k string, time_ns long, uid long")
    got = sorted((r["id"], r["uid"]) for r in timelines.observed_lately(frames, seen, 50, ["k"], "id", near=100).collect())
    assert got == [(1, 8), (2, 9), (2, 10)]
    assert sorted((r["id"], r["uid"]) for r in timelines.observed_lately(frames, seen, 200, ["k"], "id", near=100).collect()) == [(1, 7), (1, 8), (2, 11)]


def test_path_tails(spark):
    path = spark.createDataFrame([("a", t, float(t), 0.0, 1.0) for t in (0, 10, 20, 30)], "k string, time_ns long, x double, y double, z double")
    frames = spark.createDataFrame([("a", 1, 20), ("a", 2, 35)], "k string, id long, time_ns long")
    got = sorted((r["id"], r["start"], r["end"], r["from"][0], r["to"][0]) for r in timelines.path_tails(frames, path, 15, "k", "id").collect())
    assert got == [(1, 10, 20, 10, 20), (1, 20, 30, 20, 30), (2, 20, 30, 20, 30)]
