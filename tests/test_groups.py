"""Kernels over many groups at once."""

import numpy as np
from pyspark.sql import functions as F

from orbweave.operators.groups import by_group


def test_each_group_is_seen_once_in_order_however_batches_fall(spark):
    sizes = {0: 1, 1: 700, 2: 3, 5: 25, None: 4, -7: 2}
    rows = [(k, i * 7 % n, float(i)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k long, v long, x double").repartition(7)

    def kernel(columns):
        assert sorted(columns) == ["k", "v", "x"] and (np.diff(columns["v"]) >= 0).all()
        return {"k": columns["k"][:1], "n": np.array([len(columns["v"])]), "total": columns["x"].sum(keepdims=True)}

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("5", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            out = by_group(df, "k", [F.col("v")], kernel, "k long, n long, total double").collect()
            assert sorted((r["n"], r["total"]) for r in out) == sorted((n, float(n * (n - 1) / 2)) for n in sizes.values())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert by_group(df.limit(0), "k", [F.col("v")], kernel, "k long, n long, total double").count() == 0
