"""Queries of faces, regions, rooms, walls and doors."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..functions import shapes as G
from ..operators import building as B
from ..operators import crossings as C
from ..operators import joins as J
from ..operators import surfaces as S
from ..operators import volume as V
from .aggregate_queries import _TRIANGLES, triangles
from .shape_queries import _P2, _VOX, leaves, plane_points
from .inputs import points, sql, table
from .registry import query, round_all


def _leaves(spark, sf_dir):
    return leaves(spark, sf_dir).withColumn("probability", F.when(F.col("interior"), 0.9).otherwise(0.2))


@query("g78_x50_leaf_faces")
def leaf_faces(spark, sf_dir):
    lv = _leaves(spark, sf_dir)
    return round_all(S.leaf_faces(V.boundary_faces(lv, J.face_neighbours(lv)), lv))


@query("t14_g10_planar_regions")
def planar_regions(spark, sf_dir):
    lv = _leaves(spark, sf_dir)
    f = S.leaf_faces(V.boundary_faces(lv, J.face_neighbours(lv)), lv)
    f = f.withColumns({"face": F.xxhash64("interior", "exterior"), "hw": F.lit(0.5), "planarity": F.lit(1.0)})
    regions = S.planar_regions(f, S.face_links(f))
    return round_all(S.region_summary(f.join(regions, "face")).drop("region"))


_REGION = "f AS (SELECT l_suppkey AS region, l_quantity AS area, 1 - l_tax AS planarity, l_extendedprice / 1000 AS fx, l_discount * 100 AS fy, l_tax * 100 AS fz FROM lineitem)"


@query("a42_a61_region_summary", f"WITH {_REGION}, c AS (SELECT region, sum(area) AS area, min(planarity) AS planarity, avg(fx) AS cx, avg(fy) AS cy, avg(fz) AS cz FROM f GROUP BY 1) SELECT region, round(any_value(c.area), 4) AS area, round(any_value(c.planarity), 6) AS planarity, round(any_value(c.cx), 6) AS cx, round(max(greatest(abs(fx - cx), abs(fy - cy), abs(fz - cz))), 6) AS radius FROM f JOIN c USING (region) GROUP BY region")
def region_summary(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("region"), F.col("l_quantity").alias("area"), (1 - F.col("l_tax")).alias("planarity"), (F.col("l_extendedprice") / 1000).alias("fx"), (F.col("l_discount") * 100).alias("fy"), (F.col("l_tax") * 100).alias("fz"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    s = S.region_summary(f)
    return s.select("region", F.round("area", 4).alias("area"), *[F.round(c, 6).alias(c) for c in ("planarity", "cx", "radius")])


@query("a62_a63_directions", f"WITH {_P2}, q AS (SELECT *, greatest(ax - 5, 5 - ax, ay - 6, 6 - ay, cx, -cx) AS m FROM p) SELECT k, CASE WHEN ax - 5 = m THEN 'x+' WHEN 5 - ax = m THEN 'x-' WHEN ay - 6 = m THEN 'y+' WHEN 6 - ay = m THEN 'y-' WHEN cx = m THEN 'z+' ELSE 'z-' END AS direction, CASE WHEN bx >= 2 AND abs(cx) >= 1 THEN CASE WHEN cx > 0 THEN 'floor' ELSE 'ceiling' END END AS kind FROM q")
def directions(spark, sf_dir):
    p = plane_points(spark, sf_dir)
    return p.select("k", S.dominant_direction(F.col("ax") - 5, F.col("ay") - 6, F.col("cx")).alias("direction"), S.horizontal_kind(F.col("cx"), F.col("bx"), 2.0, 1.0).alias("kind"))


@query("a67_quadric_error", f"WITH {_REGION} SELECT region, round(sum(area * (0.6 * (1 - fx) + 0.8 * (3 - fz)) * (0.6 * (1 - fx) + 0.8 * (3 - fz))), 1) AS error FROM f GROUP BY 1")
def quadric_error(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("region"), F.col("l_quantity").alias("area"), (F.col("l_extendedprice") / 1000).alias("fx"), (F.col("l_discount") * 100).alias("fy"), (F.col("l_tax") * 100).alias("fz"), F.lit(0.6).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.8).alias("nz"))
    return round_all(S.quadric_error(f, ["region"], G.lits(1, 2, 3)), 1)


@query("a70_g12_corners", f"WITH {_VOX}, d AS (SELECT a.x, b.y, c.z FROM (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(y), (VALUES (0), (1)) c(z)), c AS (SELECT CAST(ix + d.x AS DOUBLE) AS x, CAST(iy + d.y AS DOUBLE) AS y, CAST(iz + d.z AS DOUBLE) AS z, avg(CASE WHEN (ix + iy) % 3 > 0 THEN 0.9 ELSE 0.2 END) AS p FROM vox, d GROUP BY ALL) SELECT x, y, z, round(p, 6) AS probability FROM c")
def corner_probability(spark, sf_dir):
    lv = _leaves(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return round_all(S.corner_probability(V.corners(lv), lv))


@query("g12_corner_edges", f"WITH {_VOX}, d AS (SELECT a.x, b.y, c.z FROM (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(y), (VALUES (0), (1)) c(z)), c AS (SELECT DISTINCT CAST(ix + d.x AS DOUBLE) AS x, CAST(iy + d.y AS DOUBLE) AS y, CAST(iz + d.z AS DOUBLE) AS z FROM vox, d) SELECT a.x, a.y, a.z, b.x AS ox, b.y AS oy, b.z AS oz FROM c a JOIN c b ON (b.x - a.x, b.y - a.y, b.z - a.z) IN ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))")
def corner_edges(spark, sf_dir):
    return S.corner_edges(V.corners(leaves(spark, sf_dir)).select("x", "y", "z"), 1.0)


@query("g60_nearest_region", "SELECT l_orderkey AS face, arg_min(l_suppkey, (abs(0.6 * 1 + 0.8 * l_linenumber - (l_discount * 10 + l_suppkey * 0.0001)), l_suppkey)) AS region FROM lineitem GROUP BY 1")
def nearest_region(spark, sf_dir):
    # numbers that SQL writes as decimals are decimals here too: regions that lie equally far by one and not by the other would tie differently
    one, zero, slope, unit = (F.lit(Decimal(v)) for v in ("1", "0", "0.6", "0.0001"))
    line = table(spark, sf_dir, "lineitem")
    f = line.select(F.col("l_orderkey").alias("face")).distinct().withColumns({"fx": one, "fy": zero, "fz": one})
    c = line.select(F.col("l_orderkey").alias("face"), F.col("l_suppkey").alias("region"), slope.alias("nx"), zero.alias("ny"), (F.lit(Decimal("0.8")) * F.col("l_linenumber")).alias("nz"), (F.col("l_discount") * 10 + F.col("l_suppkey") * unit).alias("d"))
    return S.nearest_region(f, c).select("face", "region")


@query("g66_g67_region_neighbours", "WITH l AS (SELECT DISTINCT l_suppkey AS u, l_partkey % 100 + 1 AS v FROM lineitem WHERE l_suppkey <> l_partkey % 100 + 1), s AS (SELECT l_suppkey AS region, count(*) AS faces FROM lineitem GROUP BY 1) SELECT a.region, arg_max(b.region, (b.faces, -b.region)) AS into FROM s a JOIN l ON l.u = a.region JOIN s b ON b.region = l.v AND b.faces > a.faces WHERE a.faces <= 600 GROUP BY 1".replace("AS into", 'AS "into"'))
def region_neighbours(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    links = line.select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") % 100 + 1).alias("v")).where("u <> v").distinct()
    return S.largest_neighbour(links, line.groupBy(F.col("l_suppkey").alias("region")).agg(F.count("*").alias("faces")), 600)


@query("g61_vertex_regions", "SELECT l_partkey AS v, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS regions FROM lineitem GROUP BY 1")
def vertex_regions(spark, sf_dir):
    r = S.vertex_regions(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("region"), F.col("l_partkey").alias("v")))
    return r.select("v", F.concat_ws(",", F.transform("regions", lambda x: x.cast("string"))).alias("regions"))


@query("j29_windows_on_walls", "WITH w AS (SELECT p_size AS v1, p_partkey % 30 AS v2, count(*) AS n FROM part GROUP BY ALL), q AS (SELECT s_suppkey AS window, s_suppkey % 50 AS v1, s_nationkey AS v2 FROM supplier) SELECT window, CAST(count(w.n) AS BIGINT) AS matches FROM q LEFT JOIN w ON least(q.v1, q.v2) = least(w.v1, w.v2) AND greatest(q.v1, q.v2) = greatest(w.v1, w.v2) GROUP BY 1".replace("window,", '"window",').replace("AS window", 'AS "window"'))
def windows_on_walls(spark, sf_dir):
    walls = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("v1"), (F.col("p_partkey") % 30).alias("v2")).agg(F.count("*").alias("n"))
    win = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("window"), (F.col("s_suppkey") % 50).alias("v1"), F.col("s_nationkey").cast("long").alias("v2"))
    return B.windows_on_walls(win, walls).select("window", "matches").distinct()


_TRI2 = f"WITH {_P2}, t AS (SELECT k AS t, ax, ay, bx, by2, cx, cy FROM p)"
_IN = "least((bx - ax) * (y - ay) - (by2 - ay) * (x - ax), (cx - bx) * (y - by2) - (cy - by2) * (x - bx), (ax - cx) * (y - cy) - (ay - cy) * (x - cx)) >= 0 OR greatest((bx - ax) * (y - ay) - (by2 - ay) * (x - ax), (cx - bx) * (y - by2) - (cy - by2) * (x - bx), (ax - cx) * (y - cy) - (ay - cy) * (x - cx)) <= 0"


@query("j45_locate", f"{_TRI2}, q AS (SELECT k AS c, px + 0.0131 AS x, py + 0.0173 AS y FROM p) SELECT c, min(t) AS t FROM q, t WHERE {_IN} GROUP BY c")
def locate(spark, sf_dir):
    p = plane_points(spark, sf_dir)
    tri = p.select(F.col("k").alias("t"), "ax", "ay", "bx", F.col("by2").alias("by"), "cx", "cy")
    return B.locate(p.select(F.col("k").alias("c"), (F.col("px") + 0.0131).alias("x"), (F.col("py") + 0.0173).alias("y")), tri, 2.0, ["c"])


@query("j46_g31_segment_triangles")
def segment_triangles(spark, sf_dir):
    p = plane_points(spark, sf_dir)
    tri = p.select(F.col("k").alias("t"), "ax", "ay", "bx", F.col("by2").alias("by"), "cx", "cy")
    seg = p.select(F.col("px").alias("x0"), F.col("py").alias("y0"), (F.col("bx") + 0.017).alias("x1"), (F.col("cy") + 0.019).alias("y1"))
    return C.crossing_counts(seg, tri)


@query("w12_rooms_of_vertices", f"WITH {_TRIANGLES}, e AS (SELECT t % 4 AS room, i AS v FROM tri UNION SELECT t % 4, j FROM tri UNION SELECT t % 4, k FROM tri) SELECT v, array_to_string(list_sort(list(room)), ',') AS rooms FROM e GROUP BY v")
def rooms_of_vertices(spark, sf_dir):
    r = B.rooms_of_vertices(triangles(spark, sf_dir).withColumn("room", F.col("t") % 4))
    return r.select("v", F.concat_ws(",", F.transform("rooms", lambda x: x.cast("string"))).alias("rooms"))


@query("g20_wall_samples", "WITH w AS (SELECT p_partkey AS wall, p_size * 0.3 AS len, p_retailprice / 500 AS h FROM part) SELECT wall, CAST(greatest(1, ceil(len / 0.7)) * greatest(1, ceil(h / 0.7)) AS BIGINT) AS n, round(len / 2, 6) AS x, round(h / 2, 6) AS z FROM w")
def wall_samples(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("wall"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), (F.col("p_size") * 0.3).alias("bx"), F.lit(0.0).alias("by"), F.lit(0.0).alias("z_min"), (F.col("p_retailprice") / 500).alias("z_max"))
    return round_all(B.wall_samples(w, 0.7).groupBy("wall").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("z").alias("z")))


@query("g24_g25_alignment_cost", "SELECT l_suppkey AS wall, round(sum(CASE WHEN l_discount * 10 <= 0.5 THEN (1 - l_discount * 10) * l_quantity * l_quantity * l_tax ELSE 0.0 END), 4) AS cost FROM lineitem GROUP BY 1")
def alignment_cost(spark, sf_dir):
    lv = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("wall"), (F.col("l_discount") * 10).alias("probability"), F.col("l_quantity").alias("hw"), F.col("l_tax").alias("planarity"))
    return round_all(B.alignment_cost(lv, ["wall"]), 4)


@query("g26_g27_door_positions")
def door_positions(spark, sf_dir):
    cells = points(spark, sf_dir).groupBy(F.floor(F.col("x") / 4).alias("i0"), F.floor(F.col("y") / 4).alias("i1")).agg(F.avg("z").alias("open_height"))
    doors = plane_points(spark, sf_dir).select(F.col("k").alias("door"), (F.col("px") * 4).alias("x"), (F.col("py") * 4).alias("y"), (F.col("k") % 7 * 0.4).alias("angle"))
    return round_all(B.door_positions(doors, cells, 6.0, 8, 4.0))


@query("g38_voxelise", sql("SELECT DISTINCT CAST(floor(x / 8) AS BIGINT) AS ix, CAST(floor(y / 8) AS BIGINT) AS iy, CAST(floor(z / 8) AS BIGINT) AS iz FROM points WHERE sqrt((x - 40) * (x - 40) + (y - 20) * (y - 20) + (z - 5) * (z - 5)) <= 30.0001", "points"))
def voxelise(spark, sf_dir):
    return B.voxelise(points(spark, sf_dir).withColumns({"px": F.lit(40.0), "py": F.lit(20.0), "pz": F.lit(5.0)}), 8.0, 30.0001)


@query("o09_farthest_pair", "WITH p AS (SELECT s_suppkey AS p, s_nationkey AS room, s_acctbal / 1000 AS x, s_suppkey % 13 * 0.7 AS y FROM supplier) SELECT a.room, round(max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 8) AS distance FROM p a JOIN p b ON a.room = b.room AND a.p < b.p GROUP BY 1")
def farthest_pair(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p"), F.col("s_nationkey").alias("room"), (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_suppkey") % 13 * 0.7).alias("y"))
    return round_all(B.farthest_pair(p, ["room"]).select("room", "distance"), 8)
