"""Queries over the object table: grids, clusters, range and nearest joins, shot plans, graph rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import graph as G, ranking as R, spatial as S
from tidegauge.plans.bindings import bind, table
from tidegauge.plans.registry import query
from tidegauge.runtime import cut_lineage
from tidegauge.sources.readers import scan_objects

CELL, Y_CELL = 16.0, 16.0

# Connected cells in the checking engine: transitive closure of the neighbour relation, least member per cell.
CC = """
    WITH RECURSIVE cells AS (
      SELECT CAST(FLOOR(x / 16) AS BIGINT) AS cx, CAST(FLOOR(y / 16) AS BIGINT) AS cy, CAST(FLOOR(z / 16) AS BIGINT) AS cz,
             COUNT(*) AS pieces
      FROM b_points WHERE category = 'BUILDING' GROUP BY 1, 2, 3 HAVING COUNT(*) >= 4),
    edges AS (SELECT a.cx || '/' || a.cy || '/' || a.cz AS src, b.cx || '/' || b.cy || '/' || b.cz AS dst
      FROM cells a JOIN cells b ON b.cx BETWEEN a.cx - 1 AND a.cx + 1 AND b.cy BETWEEN a.cy - 1 AND a.cy + 1
        AND b.cz BETWEEN a.cz - 1 AND a.cz + 1),
    reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON r.b = e.src),
    named AS (SELECT cx || '/' || cy || '/' || cz AS n, * FROM cells),
    lead_cell AS (SELECT r.a AS n, MIN((m.cx + 10000) * 10000000000 + (m.cy + 10000) * 100000 + m.cz + 10000) AS lead
      FROM reach r JOIN named m ON m.n = r.b GROUP BY r.a),
    sizes AS (SELECT lead, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, lead) AS cluster_id FROM lead_cell GROUP BY lead),
    cc AS (SELECT c.cx, c.cy, c.cz, c.pieces, s.cluster_id FROM named c JOIN lead_cell l USING (n) JOIN sizes s USING (lead))
"""


def _building(spark, sf):
    return bind(spark, sf, "b_points").filter(F.col("category") == "BUILDING")


def _pieces(spark, sf):
    return _building(spark, sf).withColumn("cluster_id", F.expr("l_suppkey % 10"))


PIECES = "(SELECT *, l_suppkey % 10 AS cluster_id FROM b_points WHERE category = 'BUILDING')"


def _clusters(spark, sf):
    return G.connected_cells(S.grid_count(_building(spark, sf), CELL, Y_CELL))


def cluster_report(spark, sf, min_pieces: int = 400):
    """Object table to ranked cluster report: grid, components, statistics, attribution, landmarks, score."""
    points = bind(spark, sf, "b_points")
    cells = cut_lineage(_clusters(spark, sf))  # read by five joins below
    pieces = S.cell_join(points.filter(F.col("category") == "BUILDING"), cells.drop("pieces"), CELL, Y_CELL)
    stats = S.cluster_stats(pieces, min_pieces)
    landmarks = S.category_pivot(S.footprint_join(points.filter(F.col("category").isin("PORTAL", "BED")), cells, CELL),
                                 "cluster_id", "category", ["PORTAL", "BED"])
    report = (S.cluster_features(stats)
              .join(S.top_value(pieces, "cluster_id", "prefab_name"), "cluster_id", "left")
              .join(S.top_value(pieces, "cluster_id", "creator_id", ignore=0), "cluster_id", "left")
              .join(landmarks, "cluster_id", "left").na.fill(0, ["portal", "bed"])
              .withColumn("top_prefab_share", F.round(F.col("top_prefab_name_n") / F.col("pieces"), 3)))
    return R.score_rank(report, "score", "cluster_id").select(
        "rank", "cluster_id", "region", "pieces", "score", "center_x", "center_y", "center_z", "size_x", "size_y", "size_z",
        "distinct_prefabs", "distinct_creators", "top_prefab_name", "top_prefab_share", "top_creator_id", "portal", "bed")


@query("cluster_report", CC + """,
    pc AS (SELECT p.*, c.cluster_id FROM b_points p JOIN cc c ON c.cx = CAST(FLOOR(p.x / 16) AS BIGINT)
        AND c.cy = CAST(FLOOR(p.y / 16) AS BIGINT) AND c.cz = CAST(FLOOR(p.z / 16) AS BIGINT) WHERE p.category = 'BUILDING'),
    st AS (SELECT cluster_id, COUNT(*) AS pieces, MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1, MIN(z) AS z0, MAX(z) AS z1,
        AVG(x) AS mx, AVG(z) AS mz, MEDIAN(y) AS med, COUNT(DISTINCT prefab_name) AS dp, COUNT(DISTINCT creator_id) AS dc
      FROM pc GROUP BY cluster_id HAVING COUNT(*) >= 400),
    tp AS (SELECT cluster_id, prefab_name, n FROM (SELECT cluster_id, prefab_name, COUNT(*) AS n,
        ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY COUNT(*) DESC, prefab_name) AS k FROM pc GROUP BY 1, 2) t WHERE k = 1),
    tc AS (SELECT cluster_id, creator_id FROM (SELECT cluster_id, creator_id,
        ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY COUNT(*) DESC, creator_id) AS k FROM pc WHERE creator_id <> 0 GROUP BY 1, 2) t WHERE k = 1),
    fp AS (SELECT DISTINCT cx, cz, cluster_id FROM cc),
    lm AS (SELECT f.cluster_id, SUM(CASE WHEN category = 'PORTAL' THEN 1 ELSE 0 END) AS portal, SUM(CASE WHEN category = 'BED' THEN 1 ELSE 0 END) AS bed
      FROM b_points p JOIN fp f ON f.cx = CAST(FLOOR(p.x / 16) AS BIGINT) AND f.cz = CAST(FLOOR(p.z / 16) AS BIGINT)
      WHERE category <> 'BUILDING' GROUP BY 1),
    sc AS (SELECT st.*, ROUND(LOG10(pieces) * 2 + LEAST(y1 - y0, 60) / 20 + LEAST(dp, 60) / 30.0
        + LEAST(pieces / (GREATEST(x1 - x0, 1) * GREATEST(z1 - z0, 1)) * 4, 2), 3) AS score FROM st)
    SELECT ROW_NUMBER() OVER (ORDER BY score DESC, sc.cluster_id) AS rank, sc.cluster_id,
           CASE WHEN SQRT(mx * mx + mz * mz) <= 10500 THEN 'in-world' ELSE 'outland' END AS region, pieces, score,
           ROUND(mx, 1) AS center_x, ROUND(med, 1) AS center_y, ROUND(mz, 1) AS center_z, x1 - x0 AS size_x, y1 - y0 AS size_y,
           z1 - z0 AS size_z, dp AS distinct_prefabs, dc AS distinct_creators, prefab_name AS top_prefab_name,
           ROUND(n / pieces, 3) AS top_prefab_share, creator_id AS top_creator_id,
           CAST(COALESCE(portal, 0) AS BIGINT) AS portal, CAST(COALESCE(bed, 0) AS BIGINT) AS bed
    FROM sc JOIN tp USING (cluster_id) LEFT JOIN tc USING (cluster_id) LEFT JOIN lm USING (cluster_id)""")
def cluster_report_query(spark, sf):
    return cluster_report(spark, sf)


@query("scan_objects", """
    SELECT l_orderkey, l_linenumber, x, y, z, prefab_name FROM b_points WHERE category IN ('PORTAL', 'BED')""")
def scan_objects_query(spark, sf):
    return scan_objects(bind(spark, sf, "b_points"), ["PORTAL", "BED"]).select(
        "l_orderkey", "l_linenumber", "x", "y", "z", "prefab_name")


@query("grid_count", """
    SELECT CAST(FLOOR(x / 16) AS BIGINT) AS cx, CAST(FLOOR(y / 16) AS BIGINT) AS cy, CAST(FLOOR(z / 16) AS BIGINT) AS cz,
           COUNT(*) AS pieces FROM b_points WHERE category = 'BUILDING' GROUP BY 1, 2, 3 HAVING COUNT(*) >= 4""")
def grid_count(spark, sf):
    return S.grid_count(_building(spark, sf), CELL, Y_CELL)


@query("connected_cells", CC + "SELECT cx, cy, cz, pieces, cluster_id FROM cc")
def connected_cells(spark, sf):
    return G.connected_cells(S.grid_count(_building(spark, sf), CELL, Y_CELL))


@query("cell_join", """
    WITH g AS (SELECT CAST(FLOOR(x / 16) AS BIGINT) AS cx, CAST(FLOOR(y / 16) AS BIGINT) AS cy, CAST(FLOOR(z / 16) AS BIGINT) AS cz
      FROM b_points WHERE category = 'BUILDING' GROUP BY 1, 2, 3 HAVING COUNT(*) >= 4)
    SELECT p.category, g.cx, g.cy, g.cz, COUNT(*) AS n, SUM(p.x) AS sx FROM b_points p JOIN g ON g.cx = CAST(FLOOR(p.x / 16) AS BIGINT)
      AND g.cy = CAST(FLOOR(p.y / 16) AS BIGINT) AND g.cz = CAST(FLOOR(p.z / 16) AS BIGINT) GROUP BY 1, 2, 3, 4""")
def cell_join(spark, sf):
    cells = S.grid_count(_building(spark, sf), CELL, Y_CELL).drop("pieces")
    return S.cell_join(bind(spark, sf, "b_points"), cells, CELL, Y_CELL).groupBy("category", "cx", "cy", "cz").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"))


@query("footprint_join", f"""
    WITH fp AS (SELECT DISTINCT CAST(FLOOR(x / 16) AS BIGINT) AS cx, CAST(FLOOR(z / 16) AS BIGINT) AS cz, cluster_id FROM {PIECES} t)
    SELECT f.cluster_id, p.category, COUNT(*) AS n FROM b_points p JOIN fp f ON f.cx = CAST(FLOOR(p.x / 16) AS BIGINT)
      AND f.cz = CAST(FLOOR(p.z / 16) AS BIGINT) WHERE p.category <> 'BUILDING' GROUP BY 1, 2""")
def footprint_join(spark, sf):
    cells = _pieces(spark, sf).select("cluster_id", S.cell_of(F.col("x"), CELL).alias("cx"), S.cell_of(F.col("z"), CELL).alias("cz"))
    marks = bind(spark, sf, "b_points").filter(F.col("category") != "BUILDING")
    return S.footprint_join(marks, cells, CELL).groupBy("cluster_id", "category").agg(F.count(F.lit(1)).alias("n"))


BOXES = """boxes AS (SELECT l_suppkey AS cluster_id, MIN(x) AS min_x, MAX(x) AS max_x, MIN(y) AS min_y, MAX(y) AS max_y, MIN(z) AS min_z,
      MAX(z) AS max_z, ROUND(AVG(x), 1) AS center_x, ROUND(AVG(z), 1) AS center_z FROM b_points GROUP BY l_suppkey)"""


def _tenths(value):
    """To one digit as the checking engine rounds: scaled first, halves away from zero."""
    scaled = value * 10
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / 10


def _boxes(points):
    return points.groupBy(F.col("l_suppkey").alias("cluster_id")).agg(
        *[f(a).alias(f"{m}_{a}") for a in ("x", "y", "z") for f, m in ((F.min, "min"), (F.max, "max"))],
        *[_tenths(F.avg(a)).alias(f"center_{a}") for a in ("x", "z")])


@query("box_join", f"""
    WITH {BOXES}
    SELECT b.cluster_id, COUNT(*) AS n, SUM(p.x) AS sx, SUM(p.y) AS sy FROM b_points p JOIN boxes b
      ON p.x BETWEEN min_x - 8 AND max_x + 8 AND p.y BETWEEN min_y - 4 AND max_y + 4 AND p.z BETWEEN min_z - 8 AND max_z + 8
    GROUP BY b.cluster_id""")
def box_join(spark, sf):
    points = bind(spark, sf, "b_points")
    return S.box_totals(points, _boxes(points), ["x", "y"]).select("cluster_id", "n", F.col("sum_x").alias("sx"), F.col("sum_y").alias("sy"))


@query("assign_nearest", f"""
    WITH {BOXES},
    m AS (SELECT DISTINCT b.cluster_id, p.category, p.prefab_name, p.x, p.y, p.z,
        (p.x - center_x) * (p.x - center_x) + (p.z - center_z) * (p.z - center_z) AS d2
      FROM b_points p JOIN boxes b ON p.x BETWEEN min_x - 8 AND max_x + 8 AND p.y BETWEEN min_y - 4 AND max_y + 4
        AND p.z BETWEEN min_z - 8 AND max_z + 8),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY category, prefab_name, x, y, z ORDER BY ROUND(d2, 4), cluster_id) AS k FROM m)
    SELECT category, prefab_name, x, y, z, cluster_id, ROUND(d2, 4) AS d2 FROM r WHERE k = 1""")
def assign_nearest(spark, sf):
    points = bind(spark, sf, "b_points")
    return S.assign_nearest(points, _boxes(points), "category", "prefab_name")


@query("nearest_within", """
    WITH c AS (SELECT s_suppkey AS center_id, CAST(s_suppkey * 37 % 600 AS DOUBLE) AS center_x, CAST(s_suppkey * 91 % 320 AS DOUBLE) AS center_z FROM supplier),
    p AS (SELECT o_orderkey AS id, CAST(o_custkey % 600 AS DOUBLE) AS x, CAST(o_orderkey % 320 AS DOUBLE) AS z FROM orders),
    m AS (SELECT id, center_id, (x - center_x) * (x - center_x) + (z - center_z) * (z - center_z) AS d2 FROM p JOIN c
            ON center_x BETWEEN x - 25 AND x + 25 AND center_z BETWEEN z - 25 AND z + 25),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY d2, center_id) AS k FROM m WHERE d2 <= 625)
    SELECT p.id, center_id, ROUND(SQRT(d2), 6) AS distance FROM p LEFT JOIN (SELECT * FROM r WHERE k = 1) b ON b.id = p.id""")
def nearest_within(spark, sf):
    key = F.col("s_suppkey")
    centers = table(spark, sf, "supplier").select(key.alias("center_id"), (key * 37 % 600).cast("double").alias("center_x"),
                                                  (key * 91 % 320).cast("double").alias("center_z"))
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 600).cast("double").alias("x"),
                                               (F.col("o_orderkey") % 320).cast("double").alias("z"))
    return S.nearest_within(points, centers, "id", 25.0).withColumn("distance", F.round("distance", 6))


@query("radius_pairs", """
    SELECT a.sample, a.region, a.entity AS observer, b.entity AS target, (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) AS d2
    FROM b_positions a JOIN b_positions b ON a.sample = b.sample AND a.region = b.region AND a.entity <> b.entity
    WHERE (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) <= 2500""")
def radius_pairs(spark, sf):
    return S.radius_pairs(bind(spark, sf, "b_positions"), 50.0, ["sample", "region"])


@query("around_center", "SELECT sample, entity, x, z FROM b_positions WHERE (x - 150) * (x - 150) + (z - 150) * (z - 150) <= 10000")
def around_center(spark, sf):
    return S.around_center(bind(spark, sf, "b_positions"), 150.0, 150.0, 100.0).select("sample", "entity", "x", "z")


STATS = f"""st AS (SELECT cluster_id, COUNT(*) AS pieces, MIN(x) AS min_x, MAX(x) AS max_x, AVG(x) AS cen_x, MIN(y) AS min_y, MAX(y) AS max_y,
      AVG(y) AS cen_y, MIN(z) AS min_z, MAX(z) AS max_z, AVG(z) AS cen_z, COUNT(DISTINCT prefab_name) AS distinct_prefabs,
      COUNT(DISTINCT creator_id) AS distinct_creators, MEDIAN(y) AS med_y FROM {PIECES} t GROUP BY cluster_id HAVING COUNT(*) >= 400)"""


@query("cluster_stats", f"""WITH {STATS} SELECT cluster_id, pieces, min_x, max_x, min_y, max_y, min_z, max_z, ROUND(cen_x, 6) AS cen_x,
    ROUND(cen_y, 6) AS cen_y, ROUND(cen_z, 6) AS cen_z, distinct_prefabs, distinct_creators, med_y FROM st""")
def cluster_stats(spark, sf):
    return S.cluster_stats(_pieces(spark, sf)).withColumns({f"cen_{a}": F.round(f"cen_{a}", 6) for a in ("x", "y", "z")})


@query("cluster_features", f"""
    WITH {STATS} SELECT cluster_id, CASE WHEN SQRT(cen_x * cen_x + cen_z * cen_z) <= 1000 THEN 'in-world' ELSE 'outland' END AS region,
      med_y > 500 AS sky, ROUND(LOG10(pieces) * 2 + LEAST(max_y - min_y, 60) / 20 + LEAST(distinct_prefabs, 60) / 30.0
        + LEAST(pieces / (GREATEST(max_x - min_x, 1) * GREATEST(max_z - min_z, 1)) * 4, 2), 3) AS score,
      ROUND(SQRT(cen_x * cen_x + cen_z * cen_z), 1) AS radius_m, max_x - min_x AS size_x, max_y - min_y AS size_y, max_z - min_z AS size_z,
      ROUND(GREATEST(SQRT((max_x - min_x) ** 2 + (max_y - min_y) ** 2 + (max_z - min_z) ** 2) * 0.9, 20), 1) AS suggested_standoff_m,
      ROUND(med_y + GREATEST((max_y - min_y) * 0.6, 8), 1) AS suggested_camera_y
    FROM st""")
def cluster_features(spark, sf):
    return S.cluster_features(S.cluster_stats(_pieces(spark, sf)), 1000.0).select(
        "cluster_id", "region", "sky", "score", "radius_m", "size_x", "size_y", "size_z", "suggested_standoff_m", "suggested_camera_y")


@query("top_value", f"""
    SELECT cluster_id, creator_id AS top_creator_id, n AS top_creator_id_n FROM (
      SELECT cluster_id, creator_id, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY COUNT(*) DESC, creator_id) AS k
      FROM {PIECES} t WHERE creator_id <> 0 GROUP BY 1, 2) u WHERE k = 1""")
def top_value(spark, sf):
    return S.top_value(_pieces(spark, sf), "cluster_id", "creator_id", ignore=0)


@query("category_pivot", """
    SELECT creator_id, CAST(SUM(CASE WHEN category = 'PORTAL' THEN 1 ELSE 0 END) AS BIGINT) AS portal,
           CAST(SUM(CASE WHEN category = 'BED' THEN 1 ELSE 0 END) AS BIGINT) AS bed,
           CAST(SUM(CASE WHEN category = 'SIGN' THEN 1 ELSE 0 END) AS BIGINT) AS sign FROM b_points GROUP BY creator_id""")
def category_pivot(spark, sf):
    return S.category_pivot(bind(spark, sf, "b_points"), "creator_id", "category", ["PORTAL", "BED", "SIGN"])


@query("level_bands", """
    WITH f AS (SELECT l_suppkey AS cluster_id, x, z, y / 8 + (l_orderkey % 4) * 0.25 + CASE WHEN l_partkey % 2 = 0 THEN 8.0 ELSE 0.0 END AS y FROM b_points),
    b AS (SELECT *, CAST(round_even(y * 2, 0) AS DOUBLE) / 2 AS level FROM f),
    l AS (SELECT cluster_id, level, LAG(level) OVER (PARTITION BY cluster_id ORDER BY level) AS before FROM (SELECT DISTINCT cluster_id, level FROM b) t),
    g AS (SELECT cluster_id, level, CAST(SUM(CASE WHEN level - before > 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id ORDER BY level) AS BIGINT) AS band FROM l)
    SELECT cluster_id, band, ROUND(AVG(y), 2) AS y, COUNT(*) AS count, MIN(x) AS min_x, MAX(x) AS max_x, MIN(z) AS min_z, MAX(z) AS max_z,
           ROUND(AVG(x), 1) AS cx, ROUND(AVG(z), 1) AS cz
    FROM b JOIN g USING (cluster_id, level) JOIN (SELECT cluster_id, COUNT(*) AS floors FROM f GROUP BY 1) n USING (cluster_id)
    GROUP BY cluster_id, band, floors HAVING COUNT(*) >= GREATEST(8, FLOOR(floors * 0.02))""")
def level_bands(spark, sf):
    floors = bind(spark, sf, "b_points").select(
        F.col("l_suppkey").alias("cluster_id"), "x", "z",
        (F.col("y") / 8 + F.col("l_orderkey") % 4 * 0.25 + F.when(F.col("l_partkey") % 2 == 0, 8.0).otherwise(0.0)).alias("y"))
    return S.level_bands(floors)


@query("thin_points", """
    SELECT category, ROUND(kx.p['x'], 1) AS x, ROUND(kx.p['y'], 1) AS y, ROUND(kx.p['z'], 1) AS z FROM (
      SELECT category, MIN({'x': x / 4, 'y': y / 4, 'z': z / 4}) AS p FROM b_points
      GROUP BY category, round_even(x / 4, 0), round_even(z / 4, 0), round_even(y / 8, 0)) kx""")
def thin_points(spark, sf):
    quarter = bind(spark, sf, "b_points").select("category", *[(F.col(a) / 4).alias(a) for a in ("x", "y", "z")])
    return S.thin_points(quarter, ["category"]).select("category", "x", "y", "z")


@query("pair_nearest", """
    WITH s AS (SELECT s_suppkey AS seat_id, CAST(s_suppkey * 7 % 40 AS DOUBLE) AS x, CAST(s_suppkey % 3 AS DOUBLE) AS y, CAST(s_suppkey * 13 % 40 AS DOUBLE) AS z FROM supplier),
    t AS (SELECT c_custkey AS id, CAST(c_custkey * 11 % 41 AS DOUBLE) AS x, CAST(c_custkey % 5 AS DOUBLE) AS y, CAST(c_custkey * 17 % 43 AS DOUBLE) AS z FROM customer),
    near AS (SELECT seat_id, id, (s.x - t.x) * (s.x - t.x) + (s.z - t.z) * (s.z - t.z) AS d2, ABS(s.y - t.y) AS dy FROM s JOIN t
      ON t.x BETWEEN s.x - 8 AND s.x + 8 AND t.z BETWEEN s.z - 8 AND s.z + 8),
    best AS (SELECT seat_id, id, d2, ROW_NUMBER() OVER (PARTITION BY seat_id ORDER BY d2, id DESC) AS k FROM near WHERE d2 <= 9 AND dy <= 1.5)
    SELECT s.seat_id, b.id AS table_id, ROUND(SQRT(b.d2), 6) AS distance,
           EXISTS (SELECT 1 FROM near n WHERE n.seat_id = s.seat_id AND n.d2 <= 64 AND n.dy <= 3) AS near_fire,
           (SELECT COUNT(*) FROM near n WHERE n.seat_id = s.seat_id AND n.d2 <= 1.6 * 1.6 AND n.dy <= 2.5) AS crowding
    FROM s LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON b.seat_id = s.seat_id""")
def pair_nearest(spark, sf):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    seats = table(spark, sf, "supplier").select(s.alias("seat_id"), (s * 7 % 40).cast("double").alias("x"),
                                                (s % 3).cast("double").alias("y"), (s * 13 % 40).cast("double").alias("z"))
    things = table(spark, sf, "customer").select(c.alias("id"), (c * 11 % 41).cast("double").alias("x"),
                                                 (c % 5).cast("double").alias("y"), (c * 17 % 43).cast("double").alias("z"))
    return S.pair_nearest(seats, things, things, things).withColumn("distance", F.round("distance", 6))


@query("sightline_hits", """
    WITH g AS (SELECT s_suppkey AS segment_id, CAST(s_suppkey * 7 % 40 AS DOUBLE) AS ax, 1.0 AS ay, CAST(s_suppkey * 13 % 40 AS DOUBLE) AS az,
        CAST(s_suppkey * 3 % 40 AS DOUBLE) AS ex, 4.0 AS ey, CAST(s_suppkey * 5 % 40 AS DOUBLE) AS ez FROM supplier),
    n AS (SELECT *, CAST(FLOOR(SQRT((ex - ax) ** 2 + (ey - ay) ** 2 + (ez - az) ** 2) / 0.5) AS BIGINT) AS steps FROM g),
    smp AS (SELECT segment_id, i, ax + (ex - ax) * (i / steps) AS sx, ay + (ey - ay) * (i / steps) AS sy, az + (ez - az) * (i / steps) AS sz
      FROM (SELECT *, UNNEST(range(1, steps)) AS i FROM n) u),
    w AS (SELECT DISTINCT CAST(c_custkey * 11 % 41 AS DOUBLE) AS x, CAST(c_custkey % 5 AS DOUBLE) * 3 AS y, CAST(c_custkey * 17 % 43 AS DOUBLE) AS z FROM customer),
    h AS (SELECT segment_id, i FROM smp WHERE EXISTS (SELECT 1 FROM w WHERE ABS(w.y - sy) <= 2 AND (w.x - sx) ** 2 + (w.z - sz) ** 2 <= 1))
    SELECT g.segment_id, COUNT(h.i) AS hits FROM g LEFT JOIN h USING (segment_id) GROUP BY g.segment_id""")
def sightline_hits(spark, sf):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    segments = table(spark, sf, "supplier").select(
        s.alias("segment_id"), (s * 7 % 40).cast("double").alias("ax"), F.lit(1.0).alias("ay"), (s * 13 % 40).cast("double").alias("az"),
        (s * 3 % 40).cast("double").alias("bx"), F.lit(4.0).alias("by"), (s * 5 % 40).cast("double").alias("bz"))
    walls = table(spark, sf, "customer").select((c * 11 % 41).cast("double").alias("x"), (c % 5 * 3).cast("double").alias("y"),
                                                (c * 17 % 43).cast("double").alias("z"))
    return S.sightline_hits(segments, walls)


GROUND = f"""base AS (SELECT cluster_id, MIN(x) AS min_x, MAX(x) AS max_x, MIN(z) AS min_z, MAX(z) AS max_z, 0.0 AS ground_y FROM {PIECES} t GROUP BY 1),
    grid AS (SELECT b.*, ix, UNNEST(range(0, GREATEST(CAST(CEIL((max_z - min_z) / 2) AS BIGINT), 1))) AS iz FROM (
      SELECT *, UNNEST(range(0, GREATEST(CAST(CEIL((max_x - min_x) / 2) AS BIGINT), 1))) AS ix FROM base) b),
    cover AS (SELECT DISTINCT p.cluster_id, CAST(FLOOR((x - min_x) / 2) AS BIGINT) AS ix, CAST(FLOOR((z - min_z) / 2) AS BIGINT) AS iz
      FROM {PIECES} p JOIN base USING (cluster_id) WHERE prefab_name = 'RF' OR (prefab_name = 'AF' AND y > ground_y + 2)),
    open_c AS (SELECT g.* FROM grid g WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE c.cluster_id = g.cluster_id AND c.ix = g.ix AND c.iz = g.iz))"""


def _ground(spark, sf):
    pieces = _pieces(spark, sf)
    base = pieces.groupBy("cluster_id").agg(*[f(a).alias(f"{m}_{a}") for a in ("x", "z") for f, m in ((F.min, "min"), (F.max, "max"))],
                                            F.lit(0.0).alias("ground_y"))
    opened = S.open_cells(base, pieces.filter("prefab_name = 'RF'"), pieces.filter("prefab_name = 'AF'"))
    return pieces, base, opened


@query("open_cells", f"WITH {GROUND} SELECT cluster_id, ix, iz FROM open_c")
def open_cells(spark, sf):
    return _ground(spark, sf)[2].select("cluster_id", F.col("ix").cast("bigint").alias("ix"), F.col("iz").cast("bigint").alias("iz"))


ENCLOSED = GROUND + f""",
    w AS (SELECT DISTINCT cluster_id, x, z FROM {PIECES} t WHERE prefab_name = 'NO' AND y <= 8),
    inner_c AS (SELECT *, min_x + (ix + 0.5) * 2 AS px, min_z + (iz + 0.5) * 2 AS pz FROM open_c
      WHERE min_x + (ix + 0.5) * 2 - min_x >= 4 AND max_x - (min_x + (ix + 0.5) * 2) >= 4
        AND min_z + (iz + 0.5) * 2 - min_z >= 4 AND max_z - (min_z + (iz + 0.5) * 2) >= 4),
    held AS (SELECT cluster_id, ix, iz FROM inner_c c WHERE
        CAST(EXISTS (SELECT 1 FROM w WHERE w.cluster_id = c.cluster_id AND w.z - pz > 0 AND w.z - pz <= 20 AND ABS(w.x - px) <= 6) AS INT)
      + CAST(EXISTS (SELECT 1 FROM w WHERE w.cluster_id = c.cluster_id AND pz - w.z > 0 AND pz - w.z <= 20 AND ABS(w.x - px) <= 6) AS INT)
      + CAST(EXISTS (SELECT 1 FROM w WHERE w.cluster_id = c.cluster_id AND w.x - px > 0 AND w.x - px <= 20 AND ABS(w.z - pz) <= 6) AS INT)
      + CAST(EXISTS (SELECT 1 FROM w WHERE w.cluster_id = c.cluster_id AND px - w.x > 0 AND px - w.x <= 20 AND ABS(w.z - pz) <= 6) AS INT) >= 3)"""


def _enclosed(spark, sf):
    pieces, base, opened = _ground(spark, sf)
    walls = pieces.filter("prefab_name = 'NO'").select("cluster_id", "x", "y", "z").join(
        base.select("cluster_id", F.col("min_x").alias("x0"), F.col("min_z").alias("z0"), "ground_y"), "cluster_id")
    return S.enclosed_cells(opened, walls)


@query("enclosed_cells", f"WITH {ENCLOSED} SELECT cluster_id, ix, iz FROM held")
def enclosed_cells(spark, sf):
    return _enclosed(spark, sf).select("cluster_id", F.col("ix").cast("bigint").alias("ix"), F.col("iz").cast("bigint").alias("iz"))


@query("connected_patches", f"""
    WITH RECURSIVE {ENCLOSED.replace("held AS (", "held AS MATERIALIZED (")},
    beside AS MATERIALIZED (SELECT h.cluster_id, h.ix, h.iz, n.ix AS nx, n.iz AS nz FROM held h, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(a, b)
      JOIN held n ON n.cluster_id = h.cluster_id AND n.ix = h.ix + d.a AND n.iz = h.iz + d.b),
    lab(cluster_id, ix, iz, root) USING KEY (cluster_id, ix, iz) AS (
      SELECT cluster_id, ix, iz, (ix, iz) FROM held
      UNION SELECT b.cluster_id, b.nx, b.nz, MIN(l.root) FROM lab l JOIN beside b ON b.cluster_id = l.cluster_id AND b.ix = l.ix AND b.iz = l.iz
        JOIN recurring.lab r ON r.cluster_id = b.cluster_id AND r.ix = b.nx AND r.iz = b.nz WHERE l.root < r.root GROUP BY 1, 2, 3),
    size AS (SELECT cluster_id, root, COUNT(*) AS patch_cells FROM lab GROUP BY ALL),
    best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY patch_cells DESC, root) AS place FROM size)
    SELECT cluster_id, ix, iz, patch_cells FROM lab JOIN best USING (cluster_id, root) WHERE place = 1 AND patch_cells >= 4""")
def connected_patches(spark, sf):
    return G.connected_patches(cut_lineage(_enclosed(spark, sf).select("cluster_id", "ix", "iz")), "cluster_id", 4)


@query("dag_layers", """
    WITH RECURSIVE walk(node, layer) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey <= 1
      UNION ALL SELECT p.p_partkey, w.layer + 1 FROM part p JOIN walk w ON p.p_partkey // 2 = w.node AND p.p_partkey > 1)
    SELECT node, layer FROM walk""")
def dag_layers(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    return G.dag_layers(nodes, nodes.filter("node > 1").select("node", F.expr("node div 2").alias("depends_on")))


@query("early_completions", """
    SELECT a.p_partkey AS node, b.p_partkey AS depends_on FROM part a JOIN part b ON a.p_partkey // 2 = b.p_partkey
    WHERE a.p_partkey > 1 AND a.p_size > 25 AND b.p_size <= 25""")
def early_completions(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") > 25).alias("complete"))
    return G.early_completions(nodes, nodes.filter("node > 1").select("node", F.expr("node div 2").alias("depends_on")))


@query("spread_pick", """
    WITH RECURSIVE c AS (SELECT CAST(FLOOR(x / 16) AS BIGINT) AS cx, CAST(FLOOR(z / 16) AS BIGINT) AS cz, COUNT(*) AS pieces, MIN(l_suppkey) AS owner FROM b_points GROUP BY 1, 2),
    o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY pieces DESC, cx, cz) AS n FROM c),
    s AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS cells, CAST([] AS BIGINT[]) AS owners, CAST(NULL AS BIGINT) AS picked
      UNION ALL SELECT n, CASE WHEN ok THEN list_append(cells, cx * 100000 + cz) ELSE cells END, CASE WHEN ok THEN list_append(owners, owner) ELSE owners END, CASE WHEN ok THEN n END
      FROM (SELECT o.*, s.cells, s.owners, LEN(s.cells) < 12 AND NOT list_contains(s.owners, o.owner) AND NOT list_has_any(s.cells, [(o.cx + -1) * 100000 + o.cz + -1, (o.cx + -1) * 100000 + o.cz + 0, (o.cx + -1) * 100000 + o.cz + 1, (o.cx + 0) * 100000 + o.cz + -1, (o.cx + 0) * 100000 + o.cz + 0, (o.cx + 0) * 100000 + o.cz + 1, (o.cx + 1) * 100000 + o.cz + -1, (o.cx + 1) * 100000 + o.cz + 0, (o.cx + 1) * 100000 + o.cz + 1]) AS ok
        FROM s JOIN o ON o.n = s.n + 1) x)
    SELECT cx, cz, pieces, owner, ROW_NUMBER() OVER (ORDER BY o.n) AS pick FROM s JOIN o ON o.n = s.picked""")
def spread_pick(spark, sf):
    cells = bind(spark, sf, "b_points").groupBy(S.cell_of(F.col("x"), CELL).alias("cx"), S.cell_of(F.col("z"), CELL).alias("cz")).agg(
        F.count(F.lit(1)).alias("pieces"), F.min("l_suppkey").alias("owner"))
    return G.spread_pick(cells, 12).withColumn("pick", F.col("pick").cast("bigint"))


@query("camera_fanout", f"""
    WITH {STATS},
    c AS (SELECT cluster_id, ROUND(cen_x, 1) AS cx, ROUND(cen_z, 1) AS cz, min_y, (min_y + max_y) / 2 AS cy, max_x - min_x AS sx, max_y - min_y AS sy,
        max_z - min_z AS sz FROM st),
    d AS (SELECT *, CASE WHEN sx >= sz THEN 0 ELSE 90 END AS base, GREATEST(18, LEAST(40, 40 - 60 * sy / GREATEST(sx, sz, 1))) AS el,
        GREATEST(sy, LEAST(sx, sz), 8) / 2 / TAN(RADIANS(32.5)) * 1.15 AS ideal FROM c),
    s AS (SELECT d.*, v.* FROM d, (VALUES ('orbit1', 45, 'Clear', 0.64), ('orbit2', 135, 'Clear', 0.64), ('orbit3', 225, 'Clear', 0.64),
        ('orbit4', 315, 'Clear', 0.64), ('dawn', -1, 'Clear', 0.32), ('weather', -1, 'Misty', 0.66)) v(shot, turn, environment, tod)),
    a AS (SELECT *, CASE WHEN turn < 0 THEN CASE WHEN base = 0 THEN 45 ELSE (90 + 135) % 360 END ELSE (base + turn) % 360 END AS az, LEAST(ideal, 120) AS far FROM s),
    k AS (SELECT *, cx + far * COS(RADIANS(el)) * SIN(RADIANS(az)) AS x, cz + far * COS(RADIANS(el)) * COS(RADIANS(az)) AS z,
        GREATEST(cy + far * SIN(RADIANS(el)), min_y + 3) AS y FROM a),
    n AS (SELECT *, SQRT((cx - x) ** 2 + (cy - y) ** 2 + (cz - z) ** 2) AS nn FROM k)
    SELECT cluster_id, shot, CAST(az AS DOUBLE) AS azimuth_deg, ROUND(x, 1) AS cam_x, ROUND(y, 1) AS cam_y, ROUND(z, 1) AS cam_z, ROUND(cy, 1) AS aim_y,
           ROUND((DEGREES(ATAN2(cx - x, cz - z)) + 360) % 360, 2) AS yaw_deg, ROUND(DEGREES(-ASIN((cy - y) / nn)), 2) AS pitch_deg,
           ROUND(far, 1) AS distance_m, ROUND(el, 1) AS elevation_deg, ideal <= 120 AS frames_whole_build, environment,
           CAST(tod AS DOUBLE) AS time_of_day FROM n""")
def camera_fanout(spark, sf):
    return S.camera_fanout(S.cluster_features(S.cluster_stats(_pieces(spark, sf))))
