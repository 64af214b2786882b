"""Every query with SQL against DuckDB on the smallest dataset."""

import math
import os

import pytest

from orbweave.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(columns, values):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(clean(v[i]) for i in order) for v in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "orders", "lineitem", "events", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, df.collect()), rows(columns, want.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-6) if all(isinstance(x, float) for x in a) else all(x == (pytest.approx(y, abs=1e-6) if isinstance(y, float) else y) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"t3_incremental"}))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_flagship_clusters_hold_no_frame_twice(spark):
    d = catalog.det3(spark, SF)
    from orbweave.operators import greedy, spatial

    kept = d.where("prob >= 0.55")
    found = greedy.cluster(kept, spatial.overlap_edges(kept, ["scene_id"], 0.2)).join(d.select("det_id", "frame_id"), "det_id")
    assert found.groupBy("cluster", "frame_id").count().where("count > 1").count() == 0
