"""Named queries of the engine over the dataset folders, and DuckDB SQL that gives the same rows where SQL can say it.

Detections are derived from the `events` and `orders` tables by rules that both engines evaluate alike (no division, no
negative remainders). Floats are rounded, because the order of a distributed sum is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes, camera, geometry, text
from ..operators import asof, filters, fuse, greedy, ranks, spatial, tracking, views
from ..operators.graph import components
from ..sources import writers
from ..staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "fuse_flagship"

# -- derived tables ------------------------------------------------------------------------------------------------------

DET3 = """SELECT det_id, scene_id, frame_id, obj, label,
 (obj % 5)*3.0E0 + ((det_id*det_id*13 + det_id*5) % 101 - 50)/100.0E0 AS tx,
 CAST((obj - obj % 5)/5 AS BIGINT)*3.0E0 + ((det_id*det_id*17 + det_id*3) % 97 - 48)/100.0E0 AS ty,
 0.5E0 + ((det_id*19) % 11 - 5)/100.0E0 AS tz,
 1.0E0 + (obj % 3)*0.25E0 + ((det_id*7) % 9)/50.0E0 AS sx,
 0.8E0 + (obj % 2)*0.3E0 + ((det_id*11) % 7)/50.0E0 AS sy,
 1.0E0 AS sz,
 (obj % 4)*0.3E0 + ((det_id*23) % 31 - 15)/100.0E0 AS yaw,
 0.5E0 + ((det_id*29) % 50)/100.0E0 AS prob
FROM (SELECT CAST(event_id AS BIGINT) AS det_id, CAST((event_id - event_id % 200)/200 AS BIGINT) AS scene_id,
 CAST((event_id - event_id % 4)/4 AS BIGINT) AS frame_id, CAST((event_id*event_id*3 + event_id*7) % 23 AS BIGINT) AS obj, event_type AS label FROM {events}) e"""
DET2 = """SELECT det_id, frame_id, x1, y1, x1 + bw AS x2, y1 + bh AS y2, label, score
FROM (SELECT CAST(o_orderkey AS BIGINT) AS det_id, CAST((o_orderkey - o_orderkey % 20)/20 AS BIGINT) AS frame_id,
 CAST((o_custkey*37) % 900 AS DOUBLE) AS x1, CAST((o_orderkey*53) % 500 AS DOUBLE) AS y1,
 CAST(40 + (o_custkey*13) % 300 AS DOUBLE) AS bw, CAST(40 + (o_orderkey*17) % 200 AS DOUBLE) AS bh,
 o_orderpriority AS label, 0.02E0 + ((o_orderkey*31) % 97)/100.0E0 AS score FROM {orders}) o"""
D3, D2 = f"WITH d AS ({DET3.format(events='events')}) ", f"WITH d AS ({DET2.format(orders='orders')}) "
T = "WITH t AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events) "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def det3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DET3, events=table(spark, sf_dir, "events"))


def det2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DET2, orders=table(spark, sf_dir, "orders"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds, whatever the session's time zone."""
    us = "unix_date(cast(ts as date)) * 86400000000 + hour(ts) * 3600000000L + minute(ts) * 60000000L + cast(extract(second from ts) * 1000000 as bigint)"
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "value", f"{us} as us")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c: Column | str, n: int = 6) -> Column:
    return (F.round(c, n) + 0.0).alias(c) if isinstance(c, str) else F.round(c, n) + 0.0


def of(kind: str, df: DataFrame) -> DataFrame:
    return df.where(F.col("event_type") == kind)


# -- filters and projections ---------------------------------------------------------------------------------------------


@query(D3 + "SELECT det_id, scene_id, label, round(prob, 6) AS prob FROM d WHERE prob >= 0.55")
def f1_confidence(spark, sf):
    return filters.confident(det3(spark, sf), 0.55).select("det_id", "scene_id", "label", r("prob"))


@query(D2 + """SELECT det_id, greatest(0, least(x1, 1279)) AS x1, greatest(0, least(y1, 719)) AS y1, greatest(0, least(x2, 1279)) AS x2, greatest(0, least(y2, 719)) AS y2
FROM d WHERE (x2 - x1) * (y2 - y1) >= 0.01 * 1280 * 720 AND NOT (x1 <= 3 OR y1 <= 3 OR x2 >= 1277 OR y2 >= 717)""")
def f2_box_filter(spark, sf):
    return filters.clipped_boxes(det2(spark, sf), 1280, 720, 0.01, 3).select("det_id", "x1", "y1", "x2", "y2")


@query(D2 + """, p AS (SELECT l_orderkey - l_orderkey % 20 AS k, l_partkey % 60 AS px, l_suppkey % 45 AS py, CASE WHEN l_quantity > 45 THEN 0 ELSE l_quantity / 5 END AS depth FROM lineitem),
b AS (SELECT det_id, frame_id, floor(x1 / 20) AS px1, floor(y1 / 20) AS py1, floor(x2 / 20) AS px2, floor(y2 / 20) AS py2 FROM d),
m AS (SELECT b.det_id, bool_and(depth > 0) AS known, bool_and(depth < 0.4) AS near, bool_and(depth > 8) AS far FROM b JOIN p ON p.k = b.frame_id * 20 AND px BETWEEN px1 AND px2 AND py BETWEEN py1 AND py2 GROUP BY 1)
SELECT det_id, frame_id FROM b WHERE det_id NOT IN (SELECT det_id FROM m WHERE known AND (near OR far))""")
def f3_depth_filter(spark, sf):
    d = det2(spark, sf)
    boxes = d.select("frame_id", F.col("det_id").alias("box_id"), *[F.floor(F.col(c) / 20).alias("p" + c) for c in ("x1", "y1", "x2", "y2")])
    boxes = boxes.select("frame_id", "box_id", F.col("px1"), F.col("py1"), F.col("px2"), F.col("py2"))
    p = table(spark, sf, "lineitem").selectExpr("cast((l_orderkey - l_orderkey % 20) / 20 as bigint) as frame_id", "l_partkey % 60 as px", "l_suppkey % 45 as py", "case when l_quantity > 45 then 0 else l_quantity / 5 end as depth")
    return filters.depth_filtered(boxes, p).select(F.col("box_id").alias("det_id"), "frame_id")


IOU2 = "greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"
IOU2 = "(" + IOU2 + ") / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - (" + IOU2 + "))"


@query(D2 + ", m AS (SELECT *, x1 + 10 AS q1, y1 + 5 AS q2, x2 + 10 AS q3, y2 + 5 AS q4 FROM d) SELECT a.det_id FROM d a JOIN (SELECT det_id, q1 AS x1, q2 AS y1, q3 AS x2, q4 AS y2 FROM m) b USING (det_id) WHERE " + IOU2.format(a="a", b="b") + " > 0.7")
def f4_projection_check(spark, sf):
    d = det2(spark, sf).selectExpr("*", "x1 + 10 as q1", "y1 + 5 as q2", "x2 + 10 as q3", "y2 + 5 as q4")
    return filters.validated(d, ("q1", "q2", "q3", "q4"), ("x1", "y1", "x2", "y2"), 0.7).select("det_id")


@query(D3 + "SELECT det_id, round((prob + 0.2 + sx / 4) / 2, 6) AS prob FROM d WHERE 0.2 + sx / 4 >= 0.5")
def f5_score_3d(spark, sf):
    return filters.scored_3d(det3(spark, sf).selectExpr("*", "prob as score2d", "0.2E0 + sx / 4 as score3d"), 0.5).select("det_id", r("prob"))


@query(D3 + "SELECT det_id, label FROM d WHERE lower(label) NOT IN ('click', 'error')")
def f6_structure_anti(spark, sf):
    return filters.without_structure(det3(spark, sf), names=("click", "error")).select("det_id", "label")


@query(D3 + "SELECT det_id FROM d WHERE greatest(sx, sy, sz) <= 1.3")
def f7_large(spark, sf):
    return filters.not_large(det3(spark, sf), 1.3).select("det_id")


@query(D3 + "SELECT det_id, round(greatest(sx, 1.1), 6) AS sx, round(greatest(sy, 1.1), 6) AS sy, round(greatest(sz, 1.1), 6) AS sz FROM d")
def f8_expand(spark, sf):
    return filters.at_least_sized(det3(spark, sf), 1.1).select("det_id", r("sx"), r("sy"), r("sz"))


@query(D2 + "SELECT det_id FROM d WHERE pow((x1 + x2) / 2 - 640, 2) + pow((y1 + y2) / 2 - 360, 2) <= 90000")
def f10_centre_radius(spark, sf):
    return filters.centre_in_radius(det2(spark, sf), 640, 360, 300).select("det_id")


@query(D3 + "SELECT det_id FROM d WHERE tx > 0.1 AND tx < 8.9 AND ty > 0.1 AND ty < 8.9 AND tz > -0.9 AND tz < 1.9")
def f11_volume(spark, sf):
    return filters.in_volume(det3(spark, sf), (0, 0, -1), (9, 9, 2)).select("det_id")


@query(D2 + ", v AS (SELECT det_id % 97 AS inst_id, * FROM d) SELECT det_id FROM v WHERE inst_id IN (SELECT inst_id FROM v WHERE least(x2 - x1, y2 - y1) >= 0.22 * 1000)")
def f12_large_view(spark, sf):
    v = det2(spark, sf).withColumn("inst_id", F.col("det_id") % 97)
    return filters.seen_large_enough(v, v, 0.22, 1280, 720).select("det_id")


@query(D3 + "SELECT det_id FROM d WHERE sqrt(pow(tx - 6, 2) + pow(ty - 6, 2) + pow(tz - 1, 2)) <= 5")
def f13_depth(spark, sf):
    d = det3(spark, sf).selectExpr("*", "6.0E0 as cx", "6.0E0 as cy", "1.0E0 as cz")
    return filters.within_depth(d, ("cx", "cy", "cz"), 5).select("det_id")


@query(D3 + "SELECT scene_id, obj, count(*) AS support_count FROM d GROUP BY 1, 2 HAVING count(*) >= 9")
def f17_support(spark, sf):
    return det3(spark, sf).groupBy("scene_id", "obj").agg(F.count("*").alias("support_count")).where("support_count >= 9")


BOUNDS = "tx - (sx * abs(cos(yaw)) + sy * abs(sin(yaw))) / 2 AS min_x, tx + (sx * abs(cos(yaw)) + sy * abs(sin(yaw))) / 2 AS max_x, ty - (sx * abs(sin(yaw)) + sy * abs(cos(yaw))) / 2 AS min_y, ty + (sx * abs(sin(yaw)) + sy * abs(cos(yaw))) / 2 AS max_y, tz - sz / 2 AS min_z, tz + sz / 2 AS max_z"


@query(D3 + f", b AS (SELECT scene_id, obj, det_id, {BOUNDS} FROM d), c AS (SELECT scene_id, obj, min(min_x) AS lx, max(max_x) AS hx, min(min_y) AS ly, max(max_y) AS hy, min(min_z) AS lz, max(max_z) AS hz FROM b GROUP BY 1, 2) "
       "SELECT DISTINCT c.scene_id, c.obj FROM c JOIN b ON b.scene_id = c.scene_id AND lx <= max_x + 11 AND min_x + 11 <= hx AND ly <= max_y + 2 AND min_y + 2 <= hy AND lz <= max_z AND min_z <= hz")
def f18_aabb(spark, sf):
    from ..streaming.incremental import touched

    d = det3(spark, sf)
    moved = d.withColumns({"tx": F.col("tx") + 11, "ty": F.col("ty") + 2})
    return touched(d.withColumn("stable_id", F.col("obj")), moved).select("scene_id", F.col("stable_id").alias("obj"))


@query(D3 + ", f AS (SELECT DISTINCT frame_id FROM d), n AS (SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS n FROM f) SELECT det_id, d.frame_id FROM d JOIN n USING (frame_id) WHERE n >= 5 AND n < 205 AND (n - 5) % 3 = 0")
def f19_subsample(spark, sf):
    return filters.subsampled(det3(spark, sf), "frame_id", 3, 5, 200).select("det_id", "frame_id")


# -- joins by time -------------------------------------------------------------------------------------------------------

AROUND = T + """, f AS (SELECT * FROM t WHERE event_type = 'view'), p AS (SELECT * FROM t WHERE event_type = 'click'),
lo AS (SELECT f.event_id, arg_max(p.event_id, p.us) AS lid, max(p.us) AS lt FROM f JOIN p ON p.user_id = f.user_id AND p.us <= f.us GROUP BY 1),
hi AS (SELECT f.event_id, arg_min(p.event_id, p.us) AS hid, min(p.us) AS ht FROM f JOIN p ON p.user_id = f.user_id AND p.us >= f.us GROUP BY 1),
n AS (SELECT f.event_id, f.user_id, f.us, lid, lt, hid, ht FROM f LEFT JOIN lo USING (event_id) LEFT JOIN hi USING (event_id)) """


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    t = timed(spark, sf)
    return of("view", t).select("event_id", "user_id", "us"), of("click", t).select("user_id", "us", F.col("event_id").alias("click_id"), "value")


@query(AROUND + "SELECT event_id, CASE WHEN lt IS NULL THEN hid WHEN ht IS NULL THEN lid WHEN ht - us < us - lt THEN hid ELSE lid END AS click_id FROM n")
def j1_nearest_asof(spark, sf):
    a, b = _sides(spark, sf)
    return asof.nearest(a, b, "us", ["user_id"]).select("event_id", F.col("r_click_id").alias("click_id"))


@query(AROUND + ", x AS (SELECT event_id, CASE WHEN lt IS NULL THEN ht - us WHEN ht IS NULL THEN lt - us WHEN ht - us < us - lt THEN ht - us ELSE lt - us END AS dt FROM n) SELECT event_id, dt FROM x WHERE abs(dt) <= 600000000")
def j3_tolerance(spark, sf):
    a, b = _sides(spark, sf)
    return asof.nearest(a, b, "us", ["user_id"], tolerance=600_000_000, how="inner").select("event_id", "dt")


@query(AROUND + "SELECT event_id, coalesce(lt, ht) AS lower, coalesce(ht, lt) AS upper, round(CASE WHEN lt IS NOT NULL AND ht > lt THEN (us - lt) / (ht - lt)::DOUBLE ELSE 0 END, 6) AS alpha, lt IS NOT NULL AND ht IS NOT NULL AS good FROM n")
def j4_bounds(spark, sf):
    a, b = _sides(spark, sf)
    return asof.bounds(a, b, "us", ["user_id"]).select("event_id", "lower", "upper", r("alpha"), "good")


@query(AROUND + ", v AS (SELECT event_id, value FROM events) SELECT n.event_id, round(CASE WHEN lt IS NULL THEN h.value WHEN ht IS NULL OR ht = lt THEN l.value ELSE l.value + (us - lt) / (ht - lt)::DOUBLE * (h.value - l.value) END, 6) AS value FROM n LEFT JOIN v l ON l.event_id = lid LEFT JOIN v h ON h.event_id = hid")
def j5_interpolated(spark, sf):
    a, b = _sides(spark, sf)
    return asof.interpolated(a, b, ["value"], "us", ["user_id"]).select("event_id", r("value"))


@query(AROUND + "SELECT event_id, CASE WHEN lt IS NULL THEN hid WHEN ht IS NULL THEN lid WHEN ht - us <= us - lt THEN hid ELSE lid END AS click_id FROM n")
def j5_closest(spark, sf):
    a, b = _sides(spark, sf)
    return asof.nearest(a, b, "us", ["user_id"], later_on_tie=True).select("event_id", F.col("r_click_id").alias("click_id"))


@query(AROUND + "SELECT event_id, coalesce(hid, lid) AS click_id FROM n")
def j20_ceiling_asof(spark, sf):
    a, b = _sides(spark, sf)
    return asof.ceiling(a, b, "us", ["user_id"]).select("event_id", F.col("r_click_id").alias("click_id"))


@query(T + "SELECT greatest((SELECT min(us) FROM t WHERE event_type = 'view'), (SELECT min(us) FROM t WHERE event_type = 'click')) AS start, least((SELECT max(us) FROM t WHERE event_type = 'view'), (SELECT max(us) FROM t WHERE event_type = 'click')) AS stop")
def j19_modality_range(spark, sf):
    per = timed(spark, sf).where("event_type in ('view', 'click')").groupBy("event_type").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    return per.agg(F.max("a").alias("start"), F.min("b").alias("stop"))


@query(T + "SELECT a.event_id, count(DISTINCT b.event_id) AS n FROM t a JOIN t b ON a.user_id = b.user_id AND b.us BETWEEN a.us - 7200000000 AND a.us WHERE a.event_type = 'view' AND b.event_type = 'click' GROUP BY 1")
def w1_trail(spark, sf):
    a, b = _sides(spark, sf)
    return asof.trailing(a, b, 7_200_000_000, "us", ["user_id"]).groupBy("event_id").agg(F.count_distinct("r_click_id").alias("n"))


@query(T + ", s AS (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY us) AS next_id FROM t) SELECT * FROM s WHERE next_id IS NOT NULL")
def w3_segments(spark, sf):
    return asof.segments(timed(spark, sf), "user_id", "us").select("event_id", F.col("next_event_id").alias("next_id"))


@query(T + ", o AS (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us) AS n FROM t), q AS (SELECT * FROM (WITH RECURSIVE k AS (SELECT user_id, us, n FROM o WHERE n = 1 UNION ALL SELECT o.user_id, CASE WHEN o.us - k.us >= 3600000000 THEN o.us ELSE k.us END, o.n FROM k JOIN o ON o.user_id = k.user_id AND o.n = k.n + 1) SELECT DISTINCT user_id, us FROM k)) SELECT user_id, count(*) AS kept FROM q GROUP BY 1")
def w4_thinned(spark, sf):
    return filters.thinned(timed(spark, sf), 3_600_000_000, "user_id", "us").groupBy("user_id").agg(F.count_distinct("us").alias("kept"))


@query(D3 + ", s AS (SELECT scene_id, label, sum(prob) AS v, min(det_id) AS f FROM d GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY round(v, 9) DESC, f) AS n FROM s) SELECT scene_id, label FROM q WHERE n = 1")
def w5_top_label(spark, sf):
    s = det3(spark, sf).groupBy("scene_id", "label").agg(F.sum("prob").alias("v"), F.min("det_id").alias("f"))
    n = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc(F.round("v", 9)), "f"))
    return s.withColumn("n", n).where("n = 1").select("scene_id", "label")


@query(D2 + ", q AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, det_id) AS n FROM d) SELECT det_id, frame_id FROM q WHERE n <= 5")
def w6_topk(spark, sf):
    return filters.top_k(det2(spark, sf), 5, "frame_id", "score", "det_id").select("det_id", "frame_id")


@query()
def w9_sample(spark, sf):
    return filters.hash_sample(det3(spark, sf), 200, "det_id").select("det_id")


# -- spatial joins -------------------------------------------------------------------------------------------------------

GRID = """, g AS (SELECT i / 7.0E0 - 0.5 AS u FROM (SELECT unnest(range(8)) AS i)), gg AS (SELECT a.u AS gx, b.u AS gy FROM g a, g b),
k AS (SELECT * FROM d WHERE prob >= 0.55),
c AS (SELECT a.scene_id, a.det_id AS a, b.det_id AS b, a.frame_id AS fa, b.frame_id AS fb, a.tx AS ax, a.ty AS ay, a.sx AS aw, a.sy AS ah, a.yaw AS ar, b.tx AS bx, b.ty AS by_, b.sx AS bw, b.sy AS bh, b.yaw AS br,
 least(a.tz + a.sz / 2, b.tz + b.sz / 2) - greatest(a.tz - a.sz / 2, b.tz - b.sz / 2) AS z, a.sx * a.sy * a.sz AS va, b.sx * b.sy * b.sz AS vb
 FROM k a JOIN k b ON a.scene_id = b.scene_id AND a.det_id < b.det_id AND pow(a.tx - b.tx, 2) + pow(a.ty - b.ty, 2) <= pow(sqrt(a.sx * a.sx + a.sy * a.sy) / 2 + sqrt(b.sx * b.sx + b.sy * b.sy) / 2, 2)),
cz AS (SELECT * FROM c WHERE z > 0),
s AS (SELECT cz.*, ax + cos(ar) * gx * aw - sin(ar) * gy * ah - bx AS dx, ay + sin(ar) * gx * aw + cos(ar) * gy * ah - by_ AS dy, bx + cos(br) * gx * bw - sin(br) * gy * bh - ax AS ex, by_ + sin(br) * gx * bw + cos(br) * gy * bh - ay AS ey FROM cz, gg),
h AS (SELECT scene_id, a, b, fa, fb, any_value(z) AS z, any_value(va) AS va, any_value(vb) AS vb, any_value(aw * ah) AS aa, any_value(bw * bh) AS ab,
 avg(CASE WHEN abs(cos(br) * dx + sin(br) * dy) <= bw / 2 + 1e-9 AND abs(cos(br) * dy - sin(br) * dx) <= bh / 2 + 1e-9 THEN 1.0E0 ELSE 0 END) AS p,
 avg(CASE WHEN abs(cos(ar) * ex + sin(ar) * ey) <= aw / 2 + 1e-9 AND abs(cos(ar) * ey - sin(ar) * ex) <= ah / 2 + 1e-9 THEN 1.0E0 ELSE 0 END) AS q FROM s GROUP BY 1, 2, 3, 4, 5),
e AS (SELECT scene_id, a, b, fa, fb, 0.5 * (aa * p + ab * q) * z / (va + vb - 0.5 * (aa * p + ab * q) * z + 1e-8) AS iou FROM h) """


@query(D3 + GRID + "SELECT scene_id, a, b, round(iou, 6) AS iou FROM e WHERE iou >= 0.2")
def j6_grid_iou(spark, sf):
    return spatial.overlap_edges(det3(spark, sf).where("prob >= 0.55"), ["scene_id"], 0.2).select("scene_id", "a", "b", r("iou"))


@query(D3 + GRID + "SELECT a, b FROM e WHERE iou >= 0.2 AND fa <> fb")
def j18_cannot_link_edges(spark, sf):
    return spatial.overlap_edges(det3(spark, sf).where("prob >= 0.55"), ["scene_id"], 0.2, extra=F.col("a_frame_id") != F.col("b_frame_id")).select("a", "b")


#: Areas that footprints share, from the pieces of each one's sides that lie in the other.
CUT = """, p AS (SELECT a.scene_id, a.det_id AS a, b.det_id AS b, a AS m, b AS n FROM d a JOIN d b ON a.scene_id = b.scene_id AND a.det_id < b.det_id AND pow(a.tx - b.tx, 2) + pow(a.ty - b.ty, 2) <= pow(sqrt(a.sx * a.sx + a.sy * a.sy) / 2 + sqrt(b.sx * b.sx + b.sy * b.sy) / 2, 2)),
v AS (SELECT scene_id, a, b, m, n, f.k, f.x * q.sx / 2 AS x, f.y * q.sy / 2 AS y, g.x * q.sx / 2 AS x2, g.y * q.sy / 2 AS y2, q, o, own FROM (SELECT *, m AS q, n AS o, 1 AS own FROM p UNION ALL SELECT *, n, m, 0 FROM p),
 (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) f(k, x, y), (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) g(k, x, y) WHERE g.k = (f.k + 1) % 4),
w AS (SELECT scene_id, a, b, m, n, o, own, q.tx + cos(q.yaw) * x - sin(q.yaw) * y AS x, q.ty + sin(q.yaw) * x + cos(q.yaw) * y AS y, q.tx + cos(q.yaw) * x2 - sin(q.yaw) * y2 AS x2, q.ty + sin(q.yaw) * x2 + cos(q.yaw) * y2 AS y2 FROM v),
l AS (SELECT *, cos(o.yaw) * (x - o.tx) + sin(o.yaw) * (y - o.ty) AS lx, cos(o.yaw) * (y - o.ty) - sin(o.yaw) * (x - o.tx) AS ly, cos(o.yaw) * (x2 - x) + sin(o.yaw) * (y2 - y) AS dx, cos(o.yaw) * (y2 - y) - sin(o.yaw) * (x2 - x) AS dy, CASE own WHEN 1 THEN 1e-12 ELSE -1e-12 END AS e FROM w),
t AS (SELECT *, CASE WHEN abs(dx) < 1e-15 THEN CASE WHEN abs(lx) <= o.sx / 2 + e THEN 0 ELSE 2 END ELSE least((-o.sx / 2 - e - lx) / dx, (o.sx / 2 + e - lx) / dx) END AS t1, CASE WHEN abs(dx) < 1e-15 THEN 1 ELSE greatest((-o.sx / 2 - e - lx) / dx, (o.sx / 2 + e - lx) / dx) END AS t2,
 CASE WHEN abs(dy) < 1e-15 THEN CASE WHEN abs(ly) <= o.sy / 2 + e THEN 0 ELSE 2 END ELSE least((-o.sy / 2 - e - ly) / dy, (o.sy / 2 + e - ly) / dy) END AS t3, CASE WHEN abs(dy) < 1e-15 THEN 1 ELSE greatest((-o.sy / 2 - e - ly) / dy, (o.sy / 2 + e - ly) / dy) END AS t4 FROM l),
s AS (SELECT scene_id, a, b, any_value(m) AS m, any_value(n) AS n, greatest(0, sum(greatest(0, least(1, t2, t4) - greatest(0, t1, t3)) * ((x - n.tx) * (y2 - y) - (y - n.ty) * (x2 - x)) / 2)) AS area FROM t GROUP BY 1, 2, 3),
h AS (SELECT scene_id, a, b, m, n, area * greatest(0, least(m.tz + m.sz / 2, n.tz + n.sz / 2) - greatest(m.tz - m.sz / 2, n.tz - n.sz / 2)) AS inter FROM s),
i AS (SELECT scene_id, a, b, inter / (m.sx * m.sy * m.sz + n.sx * n.sy * n.sz - inter + 1e-8) AS iou FROM h) """


@query(D3 + CUT + "SELECT scene_id, a, b, round(iou, 6) AS iou FROM i WHERE iou >= 0.2")
def j10_exact_iou(spark, sf):
    return spatial.overlap_edges(det3(spark, sf), ["scene_id"], 0.2, n=None).select("scene_id", "a", "b", r("iou"))


@query(D2 + f"SELECT a.det_id AS a, b.det_id AS b, round({IOU2.format(a='a', b='b')}, 6) AS iou FROM d a JOIN d b ON a.frame_id = b.frame_id AND a.det_id < b.det_id WHERE {IOU2.format(a='a', b='b')} > 0.3")
def j11_iou2d(spark, sf):
    d = det2(spark, sf).select("frame_id", "det_id", "x1", "y1", "x2", "y2")
    a, b = (d.select("frame_id", *[F.col(c).alias(f"{p}_{c}") for c in d.columns[1:]]) for p in "ab")
    iou = geometry.iou_xyxy(*[tuple(F.col(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")) for p in "ab"])
    return a.join(b, "frame_id").where("a_det_id < b_det_id").withColumn("v", iou).where("v > 0.3").select(F.col("a_det_id").alias("a"), F.col("b_det_id").alias("b"), r(F.col("v")).alias("iou"))


@query(D3 + f", b AS (SELECT det_id, {BOUNDS} FROM d), p AS (SELECT det_id AS pid, scene_id, tx + 0.1 AS x, ty - 0.1 AS y, tz AS z FROM d) SELECT o.det_id, count(*) AS n FROM d o JOIN p ON p.scene_id = o.scene_id WHERE abs(cos(yaw) * (x - tx) + sin(yaw) * (y - ty)) < sx / 2 AND abs(cos(yaw) * (y - ty) - sin(yaw) * (x - tx)) < sy / 2 AND abs(z - tz) < sz / 2 GROUP BY 1")
def j13_points_in_box(spark, sf):
    d = det3(spark, sf)
    p = d.selectExpr("scene_id", "det_id as pid", "tx + 0.1E0 as x", "ty - 0.1E0 as y", "tz as z")
    return spatial.points_in_boxes(d, p, ["scene_id"]).groupBy("det_id").agg(F.count("*").alias("n"))


@query(D3 + "SELECT det_id FROM d a WHERE EXISTS (SELECT 1 FROM d b WHERE b.scene_id = a.scene_id AND pow(a.tx - b.tx - 7.5, 2) + pow(a.ty - b.ty - 7.5, 2) + pow(a.tz - b.tz, 2) <= 2.25)")
def j14_radius(spark, sf):
    d = det3(spark, sf)
    moved = d.withColumns({"tx": F.col("tx") + 7.5, "ty": F.col("ty") + 7.5})
    return spatial.within_distance(d, moved, ["scene_id"], 1.5).select("det_id")


@query("WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.4")
def j15_cosine(spark, sf):
    return fuse.alike_pairs(table(spark, sf, "embeddings"), "label", 0.4).select("a", "b")


@query()
def j16_assignment(spark, sf):
    e = spatial.overlap_edges(det3(spark, sf), ["scene_id"], 0.2)
    return greedy.assign_grouped(e.select("scene_id", "a", "b", (1 - F.col("iou")).alias("cost")), "scene_id", "a", "b", "cost").select("scene_id", "a", "b", r("cost"))


@query("SELECT n_nationkey, n_name, coalesce(r_name, n_name) AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def j17_lookup(spark, sf):
    n, g = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(F.broadcast(g), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", F.coalesce("r_name", "n_name").alias("region"))


# -- dedup and greedy operators ------------------------------------------------------------------------------------------


@query(D2 + f""", o AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, det_id DESC) AS n FROM d),
e AS (SELECT a.frame_id, a.n AS i, b.n AS j FROM o a JOIN o b ON a.frame_id = b.frame_id AND a.n < b.n WHERE {IOU2.format(a='a', b='b')} > 0.5),
q AS (SELECT * FROM (WITH RECURSIVE k AS (SELECT frame_id, 1::BIGINT AS n, [1::BIGINT] AS kept FROM (SELECT DISTINCT frame_id FROM o)
 UNION ALL SELECT k.frame_id, k.n + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.frame_id = k.frame_id AND e.j = k.n + 1 AND list_contains(k.kept, e.i)) THEN k.kept ELSE list_append(k.kept, k.n + 1) END FROM k WHERE EXISTS (SELECT 1 FROM o WHERE o.frame_id = k.frame_id AND o.n = k.n + 1))
 SELECT frame_id, arg_max(kept, n) AS kept FROM k GROUP BY 1))
SELECT o.det_id, o.frame_id FROM o JOIN q USING (frame_id) WHERE list_contains(q.kept, o.n)""")
def d1_nms2d(spark, sf):
    return greedy.suppress_2d(det2(spark, sf)).select("det_id", "frame_id")


@query(D3 + ", v AS (SELECT scene_id, obj, det_id, sx * sy * sz AS vol, prob, row_number() OVER (PARTITION BY scene_id, obj ORDER BY round(sx * sy * sz, 6) DESC, det_id % 3 DESC, round(prob, 6) DESC, det_id) AS n FROM d) SELECT scene_id, obj, det_id FROM v WHERE n = 1")
def d5_keep_rule(spark, sf):
    best = F.min_by("det_id", greedy.keep_order(F.col("sx") * F.col("sy") * F.col("sz"), F.col("det_id") % 3, F.col("prob"), F.col("det_id")))
    return det3(spark, sf).groupBy("scene_id", "obj").agg(best.alias("det_id"))


@query(D3 + GRID + """, ed AS (SELECT a, b FROM e WHERE iou >= 0.35 UNION SELECT b, a FROM e WHERE iou >= 0.35), q AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT det_id AS node, det_id AS seen FROM k UNION SELECT w.node, ed.b FROM w JOIN ed ON ed.a = w.seen) SELECT node AS det_id, min(seen) AS component FROM w GROUP BY 1)) SELECT * FROM q""")
def d6_components(spark, sf):
    d = det3(spark, sf).where("prob >= 0.55")
    edges = spatial.overlap_edges(d, ["scene_id"], 0.35)
    return components(d.select(F.col("det_id").alias("node")), edges).select(F.col("node").alias("det_id"), "component")


@query()
def d6_cannot_link(spark, sf):
    d = det3(spark, sf).where("prob >= 0.55")
    return greedy.cluster(d, spatial.overlap_edges(d, ["scene_id"], 0.2, extra=F.col("a_frame_id") != F.col("b_frame_id")))


@query(D3 + "SELECT DISTINCT CAST(round_even(tx * 10, 0) AS BIGINT) AS x, CAST(round_even(ty * 10, 0) AS BIGINT) AS y, CAST(round_even(tz * 10, 0) AS BIGINT) AS z FROM d")
def d7_point_dedup(spark, sf):
    return det3(spark, sf).select(*[F.rint(F.col(f"t{c}") * 10).cast("long").alias(c) for c in "xyz"]).dropDuplicates()


@query(D3 + ", o AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY frame_id, det_id) AS n FROM d) SELECT obj, det_id, frame_id FROM o WHERE n = 1")
def d8_time_union(spark, sf):
    return det3(spark, sf).groupBy("obj").agg(F.min_by(F.struct("det_id", "frame_id"), F.struct("frame_id", "det_id")).alias("b")).select("obj", "b.*")


@query(D3 + "SELECT frame_id, count(*) AS n FROM (SELECT frame_id, obj FROM d WHERE det_id % 2 = 0 UNION SELECT frame_id, obj FROM d WHERE det_id % 3 = 0) GROUP BY 1")
def d10_uid_union(spark, sf):
    d = det3(spark, sf).select("frame_id", "obj", "det_id")
    return d.where("det_id % 2 = 0").unionByName(d.where("det_id % 3 = 0")).select("frame_id", "obj").distinct().groupBy("frame_id").agg(F.count("*").alias("n"))


# -- aggregates ----------------------------------------------------------------------------------------------------------


@query(D3 + "SELECT scene_id, obj, round(CASE WHEN sqrt(pow(sum(prob * sin(2 * yaw)), 2) + pow(sum(prob * cos(2 * yaw)), 2)) < 1e-8 THEN 0 ELSE atan2(sum(prob * sin(2 * yaw)), sum(prob * cos(2 * yaw))) / 2 END, 6) + 0.0 AS yaw FROM d GROUP BY 1, 2")
def a1_yaw_mean(spark, sf):
    return det3(spark, sf).groupBy("scene_id", "obj").agg(r(fuse.yaw_mean(F.col("yaw"), F.col("prob"))).alias("yaw"))


HT = "least(abs((({0}) - ref) - round((({0}) - ref) / pi()) * pi()), pi() - abs((({0}) - ref) - round((({0}) - ref) / pi()) * pi()))"
ALIGN = ", w AS (SELECT *, atan2(sum(prob * sin(2 * yaw0)) OVER c, sum(prob * cos(2 * yaw0)) OVER c) / 2 AS ref FROM (SELECT *, yaw + CASE WHEN det_id % 5 = 0 THEN 1.6 ELSE 0 END AS yaw0 FROM d) WINDOW c AS (PARTITION BY scene_id, obj)), al AS (SELECT *, " + HT.format("yaw0") + " AS d0, " + HT.format("yaw0 + pi() / 2") + " AS d1 FROM w) "


@query(D3 + ALIGN + "SELECT det_id, round(CASE WHEN d1 < d0 THEN sy ELSE sx END, 6) AS sx, round(CASE WHEN d1 < d0 THEN sx ELSE sy END, 6) AS sy FROM al")
def a2_align_r90(spark, sf):
    d = det3(spark, sf).withColumn("yaw", F.col("yaw") + F.when(F.col("det_id") % 5 == 0, 1.6).otherwise(0.0)).withColumn("cluster", F.concat_ws("/", "scene_id", "obj"))
    return fuse.aligned(d).select("det_id", r("sx"), r("sy"))


ROBUST = ", m AS (SELECT scene_id, obj, count(*) AS n, " + ", ".join(f"quantile_disc({c}, 0.5) AS m_{c}" for c in ("tx", "ty", "tz", "sx", "sy", "sz")) + ", atan2(sum(sin(2 * yaw)), sum(cos(2 * yaw))) / 2 AS ref FROM d GROUP BY 1, 2), v AS (SELECT d.*, n, sqrt(pow(tx - m_tx, 2) + pow(ty - m_ty, 2) + pow(tz - m_tz, 2)) AS p, sqrt(pow(sx - m_sx, 2) + pow(sy - m_sy, 2) + pow(sz - m_sz, 2)) AS s, " + HT.format("yaw") + " AS y FROM d JOIN m USING (scene_id, obj)), u AS (SELECT scene_id, obj, greatest(quantile_disc(p, 0.5), 1e-6) AS mp, greatest(quantile_disc(s, 0.5), 1e-6) AS ms, greatest(quantile_disc(y, 0.5), 1e-6) AS my FROM v GROUP BY 1, 2), x AS (SELECT v.*, (p / (1.4826 * mp) + s / (1.4826 * ms) + y / (1.4826 * my)) / 3 AS z FROM v JOIN u USING (scene_id, obj)), ww AS (SELECT *, prob * CASE WHEN n <= 2 OR z <= 2.5 THEN 1 ELSE 2.5 / z END AS w0 FROM x), wt AS (SELECT *, w0 / (sum(w0) OVER (PARTITION BY scene_id, obj) + 1e-8) AS weight FROM ww) "


@query(D3 + ROBUST + "SELECT det_id, round(weight, 6) AS weight FROM wt")
def a4_robust(spark, sf):
    return fuse.weighted(det3(spark, sf).withColumn("cluster", F.concat_ws("/", "scene_id", "obj"))).select("det_id", r("weight"))


@query(D3 + "SELECT det_id, round(prob * prob / (sum(prob * prob) OVER (PARTITION BY scene_id, obj) + 1e-8), 6) AS weight FROM d")
def a5_quadratic(spark, sf):
    return fuse.weighted(det3(spark, sf).withColumn("cluster", F.concat_ws("/", "scene_id", "obj")), "quadratic").select("det_id", r("weight"))


@query(D3 + ROBUST + ", vt AS (SELECT scene_id, obj, label, sum(weight) AS v, min(det_id) AS f FROM wt GROUP BY 1, 2, 3), lb AS (SELECT scene_id, obj, label FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, obj ORDER BY round(v, 9) DESC, f) AS n FROM vt) WHERE n = 1) SELECT scene_id, obj, any_value(lb.label) AS label, count(*) AS support_count, " + ", ".join(f"round(sum(weight * {c}), 6) AS {c}" for c in ("tx", "ty", "tz", "sx", "sy", "sz", "prob")) + ", round(atan2(sum(weight * sin(2 * yaw)), sum(weight * cos(2 * yaw))) / 2, 6) + 0.0 AS yaw FROM wt JOIN lb USING (scene_id, obj) GROUP BY 1, 2")
def a6_fuse_box(spark, sf):
    d = det3(spark, sf).withColumn("cluster", F.concat_ws("/", "scene_id", "obj"))
    return fuse.fuse_members(d, keys=("scene_id", "obj")).select("scene_id", "obj", "label", "support_count", *[r(c) for c in ("tx", "ty", "tz", "sx", "sy", "sz", "prob", "yaw")])


@query()
def fuse_flagship(spark, sf):
    out = fuse.fuse_detections(det3(spark, sf))
    return out.select("scene_id", F.col("cluster").alias("cluster_id"), "support_count", *[r(c) for c in ("tx", "ty", "tz", "sx", "sy", "sz", "yaw", "prob")], "label")


@query(D3 + f", b AS (SELECT scene_id, {BOUNDS} FROM d) SELECT scene_id, round(min(min_x), 6) + 0.0 AS min_x, round(max(max_x), 6) + 0.0 AS max_x, round(min(min_y), 6) + 0.0 AS min_y, round(max(max_y), 6) + 0.0 AS max_y, round(min(min_z), 6) + 0.0 AS min_z, round(max(max_z), 6) + 0.0 AS max_z FROM b GROUP BY 1")
def a8_bounds(spark, sf):
    b = geometry.box_bounds(*[F.col(c) for c in spatial.BOX])
    return det3(spark, sf).withColumns(b).groupBy("scene_id").agg(*[r((F.min if n.startswith("min") else F.max)(n)).alias(n) for n in b])


@query(D3 + "SELECT frame_id, CAST(round_even(tx * 4, 0) AS BIGINT) AS u, CAST(round_even(ty * 4, 0) AS BIGINT) AS v, round(avg(tz), 6) AS depth FROM d GROUP BY 1, 2, 3")
def a9_pixel_mean(spark, sf):
    return det3(spark, sf).groupBy("frame_id", F.rint(F.col("tx") * 4).cast("long").alias("u"), F.rint(F.col("ty") * 4).cast("long").alias("v")).agg(r(F.avg("tz")).alias("depth"))


@query(D3 + "SELECT frame_id, coalesce(round(quantile_disc(CASE WHEN prob >= 0.7 THEN tz END, 0.5), 6), -1) AS depth FROM d GROUP BY 1")
def a10_masked_median(spark, sf):
    return det3(spark, sf).withColumn("z", F.when(F.col("prob") >= 0.7, F.col("tz"))).groupBy("frame_id").agg(F.coalesce(r(fuse.lower_median("z")), F.lit(-1.0)).alias("depth"))


@query(D3 + GRID.replace("k AS (SELECT * FROM d WHERE prob >= 0.55)", "k AS (SELECT * FROM d), k2 AS (SELECT det_id, scene_id, frame_id, label, tx + 0.15 AS tx, ty - 0.1 AS ty, tz, sx, sy, sz, yaw, prob FROM d)").replace("FROM k a JOIN k b ON a.scene_id = b.scene_id AND a.det_id < b.det_id", "FROM k a JOIN k2 b ON a.scene_id = b.scene_id AND a.label = b.label") +
       ", f AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY iou DESC, b) AS n FROM e WHERE iou > 0.2), s2 AS (SELECT f.*, row_number() OVER (PARTITION BY b ORDER BY k.prob DESC, iou DESC, a) AS m FROM f JOIN k ON k.det_id = f.a WHERE n = 1), t AS (SELECT count(*) AS hits FROM s2 WHERE m = 1) SELECT hits, round(hits / (SELECT count(*) FROM k)::DOUBLE, 6) AS precision, round(hits / (SELECT count(*) FROM k2)::DOUBLE, 6) AS recall FROM t")
def a11_prec_recall(spark, sf):
    d = det3(spark, sf)
    return fuse.precision_recall(d, d.withColumns({"tx": F.col("tx") + 0.15, "ty": F.col("ty") - 0.1}), ["scene_id"]).select("hits", r("precision"), r("recall"))


@query(T + ", g AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM t) SELECT user_id, round(1e6 / median(gap), 6) AS fps FROM g WHERE gap > 0 GROUP BY 1")
def a13_fps(spark, sf):
    w = Window.partitionBy("user_id").orderBy("us")
    return timed(spark, sf).withColumn("gap", F.col("us") - F.lag("us").over(w)).where("gap > 0").groupBy("user_id").agg(r(1e6 / F.median("gap")).alias("fps"))


@query("SELECT event_type, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM events GROUP BY 1")
def a14_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n"))


@query(D3 + "SELECT frame_id, string_agg(CAST(obj AS VARCHAR), ',' ORDER BY det_id) AS objects FROM d GROUP BY 1")
def a15_collect(spark, sf):
    return det3(spark, sf).groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("det_id", "obj"))), lambda x: x["obj"].cast("string")), ",").alias("objects"))


@query("SELECT event_id, round(least(1, greatest(0, (value - lo) / (hi - lo + 1e-8))), 6) AS v FROM events, (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events)")
def a17_normalise(spark, sf):
    return ranks.normalised(table(spark, sf, "events"), "value", "v").select("event_id", r("v"))


@query(D3 + "SELECT scene_id, round(avg(tx), 6) AS cx, round(avg(ty), 6) AS cy, round(covar_pop(tx, ty), 6) AS cxy, round(var_pop(tx), 6) AS vxx FROM d GROUP BY 1")
def a19_covariance(spark, sf):
    return det3(spark, sf).groupBy("scene_id").agg(r(F.avg("tx")).alias("cx"), r(F.avg("ty")).alias("cy"), r(F.covar_pop("tx", "ty")).alias("cxy"), r(F.var_pop("tx")).alias("vxx"))


# -- geometry, cameras, text ---------------------------------------------------------------------------------------------

QUAT = "(SELECT *, cos(yaw / 2) AS w, sin(yaw / 2) AS z FROM d)"


@query(D3 + f"SELECT det_id, round(1 - 2 * z * z, 6) AS r00, round(2 * w * z, 6) AS r10, round(abs(w), 6) AS qw FROM {QUAT}")
def g1_quat(spark, sf):
    d = det3(spark, sf).selectExpr("det_id", "2 * cos(yaw / 2) as w", "2 * sin(yaw / 2) as z")
    m = geometry.rotation_of_quaternion(F.col("w"), F.lit(0.0), F.lit(0.0), F.col("z"))
    return d.withColumn("m", m).select("det_id", r(F.col("m")[0]).alias("r00"), r(F.col("m")[3]).alias("r10"), r(geometry.quaternion_of_rotation(F.col("m"))[0]).alias("qw"))


@query(D3 + "SELECT det_id, 0.1::DOUBLE AS roll, (-0.2)::DOUBLE AS pitch, round(yaw, 6) + 0.0 AS yaw FROM d")
def g4_euler(spark, sf):
    d = det3(spark, sf).withColumn("e", geometry.euler_of_rotation(geometry.rotation_of_euler(F.lit(0.1), F.lit(-0.2), F.col("yaw"))))
    return d.select("det_id", *[r(F.col("e")[i]).alias(n) for i, n in enumerate(("roll", "pitch", "yaw"))])


@query(D3 + "SELECT det_id, round(tx + cos(yaw) * 1.5 - sin(yaw) * 0.5, 6) + 0.0 AS x, round(ty + sin(yaw) * 1.5 + cos(yaw) * 0.5, 6) + 0.0 AS y, round(tz + 2, 6) AS z, 1.5::DOUBLE AS bx FROM d")
def g6_transform(spark, sf):
    d = det3(spark, sf).withColumn("p", geometry.pose(geometry.rotation_of_euler(F.lit(0.0), F.lit(0.0), F.col("yaw")), F.array("tx", "ty", "tz")))
    d = d.withColumn("m", geometry.pose_apply(F.col("p"), geometry.vec(1.5, 0.5, 2))).withColumn("b", geometry.pose_apply(geometry.pose_inverse(F.col("p")), F.col("m")))
    return d.select("det_id", *[r(F.col("m")[i]).alias(n) for i, n in enumerate("xyz")], r(F.col("b")[0]).alias("bx"))


@query(D3 + "SELECT det_id, round(abs(yaw), 6) AS angle, round(yaw, 6) + 0.0 AS z FROM d")
def g7_exp_log(spark, sf):
    d = det3(spark, sf).withColumn("m", geometry.so3_exp(F.array(F.lit(0.0), F.lit(0.0), "yaw")))
    return d.select("det_id", r(F.sqrt(geometry.dot(geometry.so3_log(F.col("m")), geometry.so3_log(F.col("m"))))).alias("angle"), r(geometry.so3_log(F.col("m"))[2]).alias("z"))


@query(D3 + """, w AS (SELECT det_id, yaw + 0.7 AS w, tx, ty, tz FROM d), f AS (SELECT *, sin(w) / w AS a, (1 - cos(w)) / w AS b, 0.3 * w AS h FROM w),
u AS (SELECT *, 0.3 * (a * tx + b * ty) / (a * a + b * b) AS ux, 0.3 * (a * ty - b * tx) / (a * a + b * b) AS uy FROM f)
SELECT det_id, round(h, 6) + 0.0 AS yaw, round((sin(h) * ux - (1 - cos(h)) * uy) / h + 1, 6) + 0.0 AS x, round(((1 - cos(h)) * ux + sin(h) * uy) / h + 2, 6) + 0.0 AS y, round(0.3 * tz + 3, 6) + 0.0 AS z FROM u""")
def g9_pose_between(spark, sf):
    none = F.lit(0.0)
    a = geometry.pose(geometry.rotation_of_euler(none, none, none), geometry.vec(1, 2, 3))
    b = geometry.pose(geometry.rotation_of_euler(none, none, F.col("yaw") + 0.7), geometry.vec(F.col("tx") + 1, F.col("ty") + 2, F.col("tz") + 3))
    d = det3(spark, sf).withColumn("p", geometry.pose_between(a, b, F.lit(0.3)))
    return d.select("det_id", r(geometry.yaw_of_rotation(F.col("p.r"))).alias("yaw"), *[r(F.col("p.t")[i]).alias(n) for i, n in enumerate("xyz")])


@query(D3 + ", s AS (SELECT * FROM (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) v(i, j)) SELECT det_id, round(max(tx + cos(yaw) * i * sx / 2 - sin(yaw) * j * sy / 2), 6) + 0.0 AS max_x, round(min(ty + sin(yaw) * i * sx / 2 + cos(yaw) * j * sy / 2), 6) + 0.0 AS min_y, round(any_value(sx * sy * sz), 6) AS volume FROM d, s GROUP BY 1")
def g17_corners(spark, sf):
    d = det3(spark, sf).withColumn("c", geometry.box_corners(F.array("tx", "ty", "tz"), F.array("sx", "sy", "sz"), geometry.rotation_of_euler(F.lit(0.0), F.lit(0.0), F.col("yaw"))))
    return d.select("det_id", r(F.array_max(F.transform("c", lambda p: p[0]))).alias("max_x"), r(F.array_min(F.transform("c", lambda p: p[1]))).alias("min_y"), r(geometry.box_volume(F.col("sx"), F.col("sy"), F.col("sz"))).alias("volume"))


@query(D3 + "SELECT det_id, abs(cos(yaw) * 0.4 + sin(yaw) * 0.3) < sx / 2 AND abs(cos(yaw) * 0.3 - sin(yaw) * 0.4) < sy / 2 AS inside FROM d")
def g21_inside(spark, sf):
    c = [F.col(x) for x in spatial.BOX]
    return det3(spark, sf).select("det_id", geometry.inside_yaw_box(c[0] + 0.4, c[1] + 0.3, c[2], *c).alias("inside"))


@query(D3 + "SELECT det_id, i, round(tx - sx / 2 + sx * (i + 0.5) / 4, 6) + 0.0 AS x FROM d, (SELECT unnest(range(4)) AS i)")
def g22_voxels(spark, sf):
    return det3(spark, sf).select("det_id", F.posexplode(geometry.voxel_centres(F.col("tx") - F.col("sx") / 2, F.col("tx") + F.col("sx") / 2, 4)).alias("i", "x")).select("det_id", F.col("i").cast("long").alias("i"), r("x"))


def _placed(spark, sf):
    """Boxes with centre, size and rotation as arrays."""
    turn = geometry.rotation_of_euler(F.lit(0.0), F.lit(0.0), F.col("yaw"))
    return det3(spark, sf).select("det_id", "scene_id", "frame_id", F.array("tx", "ty", "tz").alias("c"), F.array("sx", "sy", "sz").alias("s"), turn.alias("r"))


@query(D3 + """, q AS (SELECT a.axis, s.i, s.j, k.k FROM (SELECT unnest(range(3)) AS axis) a, (SELECT * FROM (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) v(i, j)) s, (SELECT unnest(range(3)) AS k) k),
p AS (SELECT axis * 12 + ((i + 1) + (j + 1) // 2) * 3 + k AS pos, CASE axis WHEN 0 THEN k - 1 ELSE i END AS x, CASE axis WHEN 0 THEN i WHEN 1 THEN k - 1 ELSE j END AS y, CASE axis WHEN 2 THEN k - 1 ELSE j END AS z FROM q)
SELECT det_id, pos, round(tx + cos(yaw) * x * sx / 2 - sin(yaw) * y * sy / 2, 6) + 0.0 AS x, round(ty + sin(yaw) * x * sx / 2 + cos(yaw) * y * sy / 2, 6) + 0.0 AS y, round(tz + z * sz / 2, 6) + 0.0 AS z FROM d, p""")
def g18_edges(spark, sf):
    d = views.box_edge_points(_placed(spark, sf), ["det_id"], ("c", "s", "r"), 3, "pos")
    return d.select("det_id", F.col("pos").cast("long").alias("pos"), *[r(n) for n in "xyz"])


@query(D3 + ", q AS (SELECT i * 6 + j * 2 + k AS pos, (i + 0.5E0) / 2 - 0.5 AS x, (j + 0.5E0) / 3 - 0.5 AS y, (k + 0.5E0) / 2 - 0.5 AS z FROM (SELECT unnest(range(2)) AS i), (SELECT unnest(range(3)) AS j), (SELECT unnest(range(2)) AS k)) SELECT det_id, pos, round(tx + cos(yaw) * x * sx - sin(yaw) * y * sy, 6) + 0.0 AS x, round(ty + sin(yaw) * x * sx + cos(yaw) * y * sy, 6) + 0.0 AS y, round(tz + z * sz, 6) + 0.0 AS z FROM d, q")
def g22_voxel_grid(spark, sf):
    d = _placed(spark, sf).select("det_id", F.posexplode(boxes.voxel_grid(F.col("c"), F.col("s"), F.col("r"), 2, 3, 2)).alias("pos", "p"))
    return d.select("det_id", F.col("pos").cast("long").alias("pos"), *[r(F.col("p")[i]).alias(n) for i, n in enumerate("xyz")])


@query(D3 + """, p AS (SELECT scene_id, i, pi() * i / 19 AS a, cos(pi() * i / 19) * tx + sin(pi() * i / 19) * ty AS u, cos(pi() * i / 19) * ty - sin(pi() * i / 19) * tx AS v, tz FROM d, (SELECT unnest(range(20)) AS i)),
b AS (SELECT scene_id, i, a, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1, min(tz) AS z0, max(tz) AS z1 FROM p GROUP BY ALL HAVING count(*) > 1)
SELECT scene_id, round(a, 6) AS yaw, round(u1 - u0, 6) AS sx, round(v1 - v0, 6) AS sy, round(z1 - z0, 6) AS sz, round(cos(a) * (u0 + u1) / 2 - sin(a) * (v0 + v1) / 2, 6) + 0.0 AS tx, round(sin(a) * (u0 + u1) / 2 + cos(a) * (v0 + v1) / 2, 6) + 0.0 AS ty, round((z0 + z1) / 2, 6) + 0.0 AS tz
FROM b QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY round((u1 - u0) * (v1 - v0) * (z1 - z0), 9), i) = 1""")
def g23_fit_points(spark, sf):
    out = boxes.fit_boxes(det3(spark, sf), ["scene_id"], "tx", "ty", "tz")
    return out.select("scene_id", *[r(n).alias(n) for n in ("yaw", "sx", "sy", "sz", "tx", "ty", "tz")])


@query(D3 + "SELECT det_id, i AS pos, round(tx + (sx - tx) * i / 4.0E0, 6) + 0.0 AS x, round(tz + (sz - tz) * i / 4.0E0, 6) + 0.0 AS z FROM d, (SELECT unnest(range(5)) AS i)")
def g24_linspace(spark, sf):
    d = _placed(spark, sf).select("det_id", F.posexplode(boxes.linspace(F.col("c"), F.col("s"), 5)).alias("pos", "p"))
    return d.select("det_id", F.col("pos").cast("long").alias("pos"), r(F.col("p")[0]).alias("x"), r(F.col("p")[2]).alias("z"))


@query(D3 + "SELECT det_id, round(tx + cos(yaw) * 0.25 - sin(yaw) * 0.5, 6) + 0.0 AS tx, round(ty + sin(yaw) * 0.25 + cos(yaw) * 0.5, 6) + 0.0 AS ty, round(tz - 0.5, 6) + 0.0 AS tz, round(-(sx + 0.5) / 2, 6) AS low_x, round((sx + 0.5) / 2, 6) AS high_x FROM d")
def g19_recentred(spark, sf):
    low = F.transform("s", lambda x: -x / 2)
    high = F.zip_with(F.transform("s", lambda x: x / 2), geometry.vec(0.5, 1.0, -1.0), lambda a, b: a + b)
    d = _placed(spark, sf).select("det_id", boxes.recentred(geometry.pose(F.col("r"), F.col("c")), low, high).alias("b"))
    return d.select("det_id", *[r(F.col("b.t")[i]).alias(f"t{n}") for i, n in enumerate("xyz")], r(F.col("b.low")[0]).alias("low_x"), r(F.col("b.high")[0]).alias("high_x"))


@query(D2 + """, b AS (SELECT det_id, CASE WHEN det_id % 3 = 0 THEN [-1.0E0, -1.0E0, -1.0E0, -1.0E0] ELSE [x1, x2, y1, y2] END AS b FROM d)
SELECT det_id, CASE WHEN b[1] = -1 THEN -1 ELSE b[1] * 0.5 END AS x1_scaled, CASE WHEN b[4] = -1 THEN -1 ELSE b[4] * 0.25 END AS y2_scaled, b[2] - 40 AS x2_cropped, b[3] - 30 AS y1_cropped,
 CASE WHEN b[1] < 0 THEN b[1] ELSE 1000 - b[4] - 1 END AS x1_turned, CASE WHEN b[3] < 0 THEN b[3] ELSE b[1] END AS y1_turned FROM b""")
def g26_image_edits(spark, sf):
    b = F.when(F.col("det_id") % 3 == 0, geometry.vec(-1, -1, -1, -1)).otherwise(F.array("x1", "x2", "y1", "y2"))
    d = det2(spark, sf).select("det_id", b.alias("b"))
    scaled, cropped, turned = boxes.scaled_bb2(F.col("b"), F.lit(0.5), F.lit(0.25)), boxes.cropped_bb2(F.col("b"), F.lit(40.0), F.lit(30.0)), boxes.turned_bb2(F.col("b"), F.lit(1000.0))
    return d.select("det_id", scaled[0].alias("x1_scaled"), scaled[3].alias("y2_scaled"), cropped[1].alias("x2_cropped"), cropped[2].alias("y1_cropped"), turned[0].alias("x1_turned"), turned[2].alias("y1_turned"))


@query(D3 + "SELECT det_id, CASE WHEN least(abs(sx - 1.5), abs(sy - 1.5), abs(sz - 1.5)) = abs(sx - 1.5) THEN 0 WHEN least(abs(sy - 1.5), abs(sz - 1.5)) = abs(sy - 1.5) THEN 1 ELSE 2 END AS pos FROM d")
def j2_nearest_entry(spark, sf):
    return _placed(spark, sf).select("det_id", boxes.nearest_position(F.col("s"), F.lit(1.5)).cast("int").alias("pos"))


@query(D3 + "SELECT det_id, round(500 * (tx - 6) / (ty + 5) + 640, 4) AS u, round(500 * (tz - 1) / (ty + 5) + 360, 4) AS v, 500 * (tx - 6) / (ty + 5) + 640 BETWEEN 0 AND 1279 AND 500 * (tz - 1) / (ty + 5) + 360 BETWEEN 0 AND 719 AS seen FROM d")
def c1_project(spark, sf):
    p = geometry.vec(F.col("tx") - 6, F.col("tz") - 1, F.col("ty") + 5)
    uv = camera.pinhole_project(p, F.lit(500.0), F.lit(500.0), F.lit(640.0), F.lit(360.0))
    return det3(spark, sf).withColumn("uv", uv).select("det_id", r(F.col("uv")[0], 4).alias("u"), r(F.col("uv")[1], 4).alias("v"), camera.in_image(F.col("uv")[0], F.col("uv")[1], F.lit(1280), F.lit(720)).alias("seen"))


@query(D3 + """, n AS (SELECT det_id, (tx - 6) / (ty + 5) AS x, (tz - 1) / (ty + 5) AS y FROM d), q AS (SELECT *, sqrt(x * x + y * y) AS q, atan(sqrt(x * x + y * y)) AS h FROM n),
m AS (SELECT *, CASE WHEN q < 1e-12 THEN 1 ELSE h * (1 + 0.1 * pow(h, 2) - 0.02 * pow(h, 4) + 0.003 * pow(h, 6) + 0.004 * pow(h, 8) - 0.005 * pow(h, 10) + 0.0006 * pow(h, 12)) / q END AS k FROM q),
e AS (SELECT det_id, x * k AS x, y * k AS y, x * k * x * k + y * k * y * k AS r2 FROM m)
SELECT det_id, round(500 * (x + (2 * x * x + r2) * 0.01 - 2 * x * y * 0.02 + 0.003 * r2 - 0.001 * r2 * r2) + 640, 4) AS u, round(400 * (y + 2 * x * y * 0.01 - (2 * y * y + r2) * 0.02 + 0.002 * r2 + 0.0005 * r2 * r2) + 360, 4) AS v FROM e""")
def c2_fisheye(spark, sf):
    of_ = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    uv = camera.fisheye_project(
        geometry.vec(F.col("tx") - 6, F.col("tz") - 1, F.col("ty") + 5), F.lit(500.0), F.lit(400.0), F.lit(640.0), F.lit(360.0),
        of_(0.1, -0.02, 0.003, 0.004, -0.005, 0.0006), of_(0.01, -0.02), of_(0.003, -0.001, 0.002, 0.0005),
    )
    return det3(spark, sf).select("det_id", r(uv[0], 4).alias("u"), r(uv[1], 4).alias("v"))


@query(D2 + "SELECT det_id, 250.0::DOUBLE AS fx, (x1 + 0.5) * 0.5 - 0.5 AS cx FROM d")
def c6_camera_scale(spark, sf):
    s = camera.scaled(F.lit(500.0), F.lit(500.0), F.col("x1"), F.col("y1"), F.lit(0.5), F.lit(0.5))
    return det2(spark, sf).select("det_id", s[0].alias("fx"), s[2].alias("cx"))


@query(D3 + ", s AS (SELECT * FROM (VALUES (-1, -1, -1), (-1, -1, 1), (-1, 1, -1), (-1, 1, 1), (1, -1, -1), (1, -1, 1), (1, 1, -1), (1, 1, 1)) v(i, j, l)), q AS (SELECT det_id, tx + cos(yaw) * i * sx / 2 - sin(yaw) * j * sy / 2 - 6 AS x, ty + sin(yaw) * i * sx / 2 + cos(yaw) * j * sy / 2 + 5 AS y, tz + l * sz / 2 - 1 AS z FROM d, s) SELECT det_id, round(greatest(0, least(1279, min(500 * x / y + 640))), 4) AS x1, round(greatest(0, least(1279, max(500 * x / y + 640))), 4) AS x2 FROM q GROUP BY 1")
def c9_bb3_to_bb2(spark, sf):
    d = det3(spark, sf).withColumn("c", geometry.box_corners(F.array("tx", "ty", "tz"), F.array("sx", "sy", "sz"), geometry.rotation_of_euler(F.lit(0.0), F.lit(0.0), F.col("yaw"))))
    one = lambda p: camera.pinhole_project(geometry.vec(p[0] - 6, p[2] - 1, p[1] + 5), F.lit(500.0), F.lit(500.0), F.lit(640.0), F.lit(360.0))[0]
    d = d.withColumn("u", F.transform("c", one))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1279.0), c))
    return d.select("det_id", r(clip(F.array_min("u")), 4).alias("x1"), r(clip(F.array_max("u")), 4).alias("x2"))


@query(D3 + "SELECT det_id, round(ty, 6) + 0.0 AS tx, round(-tz, 6) + 0.0 AS ty, round(-tx, 6) + 0.0 AS tz, CASE label WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE label END AS name FROM d")
def k4_sfm_export(spark, sf):
    d = det3(spark, sf).selectExpr("*", "cos(yaw / 2) as qw", "0.0E0 as qx", "0.0E0 as qy", "sin(yaw / 2) as qz", "obj as inst_id", "0 as sem_id", "0L as time_ns")
    v = spark.createDataFrame([("click", "c", 1, 2, 3), ("view", "v", 4, 5, 6)], "en string, cn string, r int, g int, b int")
    return writers.exported(d.withColumn("fid", F.col("det_id")).withColumn("inst_id", F.col("det_id")), v).select(F.col("fused_instance").alias("det_id"), r("tx"), r("ty"), r("tz"), "name")


TEN = {"r": (230, 60, 255, 0, 245, 145, 70, 240, 210, 250), "g": (25, 180, 225, 130, 130, 30, 240, 50, 245, 190), "b": (75, 75, 25, 200, 48, 180, 240, 230, 60, 190)}
THEN = {"r": (73, 97), "g": (151, 53), "b": (199, 211)}


@query(D3 + "SELECT det_id, " + ", ".join(f"CASE WHEN det_id < 10 THEN {list(TEN[c])}[det_id + 1] ELSE ({THEN[c][0]} * det_id + {THEN[c][1]}) % 256 END AS {c}" for c in "rgb") + " FROM d")
def k5_instance_color(spark, sf):
    return det3(spark, sf).select("det_id", *[text.instance_colour(F.col("det_id"))[i].cast("long").alias(c) for i, c in enumerate("rgb")])


@query("SELECT conv_id, turn, rpad(left(role, 8), 8, ' ') AS padded FROM conversations")
def x1_pad(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.padded_text(F.col("role"), 8).alias("padded"))


@query("WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(lower(trim(role || '. ' || turn)), '.'), lambda x: trim(x)), lambda x: x <> '') AS q FROM conversations) SELECT conv_id, turn, len(q) AS n, q[1] AS first FROM p")
def x2_prompt(spark, sf):
    c = table(spark, sf, "conversations").withColumn("q", text.prompt_phrases(text.normalised_prompt(F.concat("role", F.lit(". "), F.col("turn").cast("string")))))
    return c.select("conv_id", "turn", F.size("q").cast("long").alias("n"), F.col("q")[0].alias("first"))


# -- tracking and incremental fusion -------------------------------------------------------------------------------------


@query(D3 + ", o AS (SELECT scene_id, det_id, obj AS stable_id FROM d WHERE det_id % 2 = 0), n AS (SELECT scene_id, det_id, obj - obj % 2 AS cluster FROM d), s AS (SELECT o.scene_id, stable_id, cluster, count(*) AS c FROM o JOIN n USING (scene_id, det_id) GROUP BY 1, 2, 3), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, stable_id ORDER BY c DESC, cluster) AS k FROM s) WHERE k = 1), cl AS (SELECT scene_id, cluster, min(stable_id) AS name FROM v GROUP BY 1, 2), ev AS (SELECT DISTINCT scene_id, cluster FROM n), fr AS (SELECT scene_id, cluster, name, row_number() OVER (PARTITION BY scene_id, name IS NULL ORDER BY cluster) - 1 AS k FROM ev LEFT JOIN cl USING (scene_id, cluster)) SELECT scene_id, cluster, coalesce(name, 100 + k) AS name FROM fr")
def t4_stable_ids(spark, sf):
    from ..streaming.incremental import stable_ids

    d = det3(spark, sf)
    old = d.where("det_id % 2 = 0").select("scene_id", "det_id", F.col("obj").alias("stable_id"))
    new = d.selectExpr("scene_id", "det_id", "obj - obj % 2 as cluster")
    return stable_ids(old, new, d.select("scene_id").distinct().withColumn("next_id", F.lit(100).cast("long")))[0]


@query(D3 + ", m AS (SELECT scene_id, max(frame_id) AS frame_id FROM d GROUP BY 1) SELECT d.det_id FROM d JOIN m USING (scene_id, frame_id)")
def t1_conflation(spark, sf):
    from ..streaming.incremental import latest_frames

    return latest_frames(det3(spark, sf), "frame_id").select("det_id")


@query()
def t3_incremental(spark, sf):
    import uuid

    from ..staging import shared_dir
    from ..streaming.incremental import IncrementalFusion

    d = stage(det3(spark, sf), "detections")
    fusion = IncrementalFusion(f"{shared_dir(spark)}/fusion-{uuid.uuid4().hex}")
    for batch in range(2):
        out = fusion.update(d.where(F.col("frame_id") % 50 < 25 if batch == 0 else F.col("frame_id") % 50 >= 25), batch)
    return out.select("scene_id", "stable_id", "support_count", r("tx", 4), r("ty", 4), "label")


@query()
def t6_tracker(spark, sf):
    d = det3(spark, sf).withColumn("frame_id", F.floor(F.col("frame_id") / 8))  # so that most objects are in every frame
    out = tracking.track(d, tracking.TrackerConfig(max_missed=8))
    return out.select("scene_id", "frame_id", "track_id", "state", "label", r("tx"), r("ty"), "support")


from . import spaces  # noqa: E402, F401  adds its queries to those above
