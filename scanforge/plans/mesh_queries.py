"""Queries of carving, surfaces, polygons, cameras and regions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import camera as M
from ..functions import shapes as G
from ..operators import aggregates as A
from ..operators import carving as C
from ..operators import mesh as S
from ..operators import volume as V
from .shape_queries import _P2, _P3, plane_points, space_points, voxels
from .inputs import points, samples, sql, table
from .registry import query, round_all


@query("x05_point_covariance", f"WITH {_P3}, q AS (SELECT k, ax + 0.5 AS x, ay AS y, az AS z FROM p) SELECT k, round(x * x / (x * x + y * y + z * z) * (0.25 - 0.01) + 0.01, 8) AS xx, round(x * y / (x * x + y * y + z * z) * (0.25 - 0.01), 8) AS xy, round(z * z / (x * x + y * y + z * z) * (0.25 - 0.01) + 0.01, 8) AS zz FROM q")
def point_covariance(spark, sf_dir):
    c = C.point_covariance([F.col("ax") + 0.5, F.col("ay"), F.col("az")], F.lit(0.5), F.lit(0.1))
    return space_points(spark, sf_dir).select("k", *[F.round(F.get(c, i), 8).alias(n) for i, n in ((0, "xx"), (1, "xy"), (5, "zz"))])


_DENSE = "d AS (SELECT frame, p, lead(p) OVER (PARTITION BY frame ORDER BY p) AS q, row_number() OVER (PARTITION BY frame ORDER BY p) - 1 AS i FROM (SELECT DISTINCT l_orderkey AS frame, l_linenumber AS p FROM lineitem)), o AS (SELECT frame, lead(frame) OVER (ORDER BY frame) AS nf FROM (SELECT DISTINCT frame FROM d))"


@query("w03_j15_wedges", f"WITH {_DENSE} SELECT row_number() OVER (ORDER BY a.frame, a.p) - 1 AS wedge_id, a.frame AS frame_a, a.p AS a1, a.q AS a2, b.frame AS frame_b, b.p AS b1, b.q AS b2 FROM d a JOIN o ON a.frame = o.frame JOIN d b ON b.frame = o.nf AND b.i = a.i WHERE a.q IS NOT NULL AND b.q IS NOT NULL")
def wedges(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("point")).distinct()
    return C.wedges(p).select("wedge_id", "frame_a", "a1", "a2", "frame_b", "b1", "b2")


@query("a07_wedge_samples")
def wedge_samples(spark, sf_dir):
    cmap = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("point")).agg(F.avg("l_quantity").alias("w"), *[F.sqrt(F.avg(f"l_{c}") + 0.0031).alias(n) for n, c in (("p", "discount"), ("surface", "tax"), ("corner", "tax"), ("planar", "discount"))])
    got = C.wedge_sample(C.wedge_points(C.wedges(cmap.select("frame", "point")), cmap), ["wedge_id"], F.col("w"))
    return round_all(got, 7)


@query("j37_room_labels", sql("SELECT frame, max(CASE WHEN x BETWEEN 20 AND 60 AND y BETWEEN 10 AND 40 THEN 2 WHEN x BETWEEN 5 AND 30 AND y BETWEEN 5 AND 20 THEN 1 ELSE -1 END) AS room, count(*) AS n FROM points GROUP BY frame", "points"))
def room_labels(spark, sf_dir):
    box = lambda k, x0, y0, x1, y1: F.struct(F.lit(k).alias("room"), F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]).alias("polygon"), F.lit(-1.0).alias("z_min"), F.lit(99.0).alias("z_max"))
    rooms = spark.range(1).select(F.inline(F.array(box(1, 5, 5, 30, 20), box(2, 20, 10, 60, 40))))
    leaves = points(spark, sf_dir).select("frame", *[F.col(a).alias(f"c{a}") for a in "xyz"], F.monotonically_increasing_id().alias("leaf"))
    return C.label_rooms(leaves, rooms, 8.0).groupBy("frame").agg(F.max("fp_room").alias("room"), F.count("*").alias("n"))


@query("j32_g21_visibility", "WITH h AS (SELECT l_orderkey AS scan, l_suppkey AS c, l_quantity AS w, l_tax AS t FROM lineitem WHERE l_discount < 0.06), m AS (SELECT c, count(*) AS considered, max(w) AS w FROM h GROUP BY c), b AS (SELECT arg_max(c, (w, c)) AS c FROM h GROUP BY scan), n AS (SELECT c, count(*) AS chosen FROM b GROUP BY c) SELECT c, considered, coalesce(chosen, 0) AS chosen, CASE WHEN coalesce(chosen, 0) < 0.37 * considered THEN 0.0 ELSE w END AS weight FROM m LEFT JOIN n USING (c)")
def visibility(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_suppkey").alias("c"), F.col("l_quantity").alias("w"), F.col("l_discount").alias("f"))
    return C.scan_visibility(hits, ["scan"], ["c"], "w", F.col("f") < 0.06, 0.37)


@query("g39_g73_marching_cubes")
def marching_cubes(spark, sf_dir):
    return S.marching_cubes(voxels(spark, sf_dir))


@query("j26_ray_hits", f"""WITH {_P3}, t AS (SELECT k AS t, ax, ay, az, bx, by2, bz, cx, cy, cz FROM p), {_P2.replace("p AS", "s AS")}, r AS (SELECT k AS ray, 0.11 AS ox, 0.13 AS oy, -5.0 AS oz, px + 0.0171 AS ex, py + 0.0233 AS ey, 12.0 AS ez FROM s),
    m AS (SELECT ray, t, ex - ox AS dx, ey - oy AS dy, ez - oz AS dz, bx - ax AS ux, by2 - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz, ox - ax AS sx, oy - ay AS sy, oz - az AS sz FROM r, t),
    h AS (SELECT *, dy * vz - dz * vy AS hx, dz * vx - dx * vz AS hy, dx * vy - dy * vx AS hz, sy * uz - sz * uy AS qx, sz * ux - sx * uz AS qy, sx * uy - sy * ux AS qz FROM m),
    d AS (SELECT *, ux * hx + uy * hy + uz * hz AS det FROM h), f AS (SELECT ray, t, sqrt(dx * dx + dy * dy + dz * dz) AS n, (sx * hx + sy * hy + sz * hz) / nullif(det, 0) AS u, (dx * qx + dy * qy + dz * qz) / nullif(det, 0) AS v, (vx * qx + vy * qy + vz * qz) / nullif(det, 0) AS w FROM d)
    SELECT ray, round(min(w * n), 6) AS distance FROM f WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND w > 0 AND w <= 1 GROUP BY ray""")
def ray_hits(spark, sf_dir):
    tri = space_points(spark, sf_dir).withColumnsRenamed({"k": "t", "by2": "by"})
    rays = plane_points(spark, sf_dir).select(F.col("k").alias("ray"), *[F.lit(v).alias(c) for c, v in (("ox", 0.11), ("oy", 0.13), ("oz", -5.0), ("ez", 12.0))], (F.col("px") + 0.0171).alias("ex"), (F.col("py") + 0.0233).alias("ey"))
    return round_all(S.ray_hits(rays, tri, 2.0, ["ray"]).select("ray", "distance"))


@query("x28_x31_polygons", f"WITH {_P2} SELECT k, round(greatest(0, least(px + 2, 4) - greatest(px, 1)) * greatest(0, least(py + 2, 5) - greatest(py, 1)), 6) AS area, 4 AS corners FROM p")
def polygons(spark, sf_dir):
    ring = lambda *ps: F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ps])
    x, y, one = F.col("px"), F.col("py"), [F.lit(float(v)) for v in (1, 4, 5)]
    square = ring((x, y), (x + 1, y), (x + 2, y), (x + 2, y + 2), (x, y + 2))
    frame = ring((one[0], one[0]), (one[1], one[0]), (one[1], one[2]), (one[0], one[2]))
    cut = plane_points(spark, sf_dir).select("k", S.clip_polygon(square, frame).alias("c"), S.simplify_polygon(square, 0.001).alias("s"))
    return cut.select("k", F.round(F.when(F.size("c") > 2, G.polygon_area(F.col("c"))).otherwise(0.0), 6).alias("area"), F.size("s").alias("corners"))


@query("g29_delaunay")
def delaunay(spark, sf_dir):
    k = F.col("k")
    cells = space_points(spark, sf_dir).select(F.floor(k / 40).alias("level"), k.alias("cell"), (F.col("ax") + F.col("cx") / 10).alias("x"), (F.col("bx") + F.col("ay") / 10).alias("y"))
    return S.triangulate(cells, ["level"], "cell")


@query("g08_o10_coalesce_regions")
def regions(spark, sf_dir):
    s = samples(spark, sf_dir)
    nodes = s.select("user_id", F.col("event_id").alias("node"), F.lit(1.0).alias("size"), "value")
    edges = s.select("user_id", F.col("event_id").alias("u"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("t")).alias("v")).where("v is not null")
    return S.coalesce_regions(nodes, edges, "user_id", 2.0).groupBy("user_id").agg(F.count_distinct("region").alias("regions"))


@query("j39_w10_spacing")
def spacing(spark, sf_dir):
    return S.keep_spaced(samples(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], ["event_id"], ["value"], 10.0)


@query("g05_o05_small_rooms")
def small_rooms(spark, sf_dir):
    p, s = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    line = table(spark, sf_dir, "lineitem")
    rooms = line.groupBy((p % 5).alias("level"), p.alias("room")).agg(F.round(F.sum("l_quantity"), 3).alias("area"))
    borders = line.where((p < s) & (p % 5 == s % 5)).groupBy((p % 5).alias("level"), p.alias("room_a"), s.alias("room_b")).agg(F.round(F.sum("l_tax"), 3).alias("length"))
    return S.drop_small_rooms(rooms, borders, "level", 2.4384)


@query("x47_rectilinear", f"WITH {_P3}, q AS (SELECT k, ax / (cz + 1) AS x, ay / (cz + 1) AS y FROM p) SELECT k, round(320 + 500 * (x * (1 + 0.01 * (x * x + y * y)) + 0.004 * x * y + 0.001 * (3 * x * x + y * y)), 6) AS u FROM q")
def rectilinear(spark, sf_dir):
    u, _ = M.rectilinear_pixel([F.col("ax"), F.col("ay"), F.col("cz") + 1], 500, 500, 320, 240, (0.01,), (0.002, 0.001))
    return space_points(spark, sf_dir).select("k", F.round(u, 6).alias("u"))


@query("x46_x76_fisheye")
def fisheye(spark, sf_dir):
    u, v = M.fisheye_pixel(G.vec(*C3), [300.0, 150.0, 10.0], (1.0, 0.001, -0.001), (640.0, 480.0))
    return round_all(space_points(spark, sf_dir).select("k", u.alias("u"), v.alias("v")))


C3 = ["cx", "cy", "cz"]


@query("j40_best_colour", "SELECT l_orderkey AS p, arg_max(l_partkey % 256, (l_discount, -l_linenumber, l_partkey % 256)) AS colour, max(l_discount) AS quality FROM lineitem WHERE l_discount >= 0 GROUP BY 1")
def best_colour(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("p"), F.col("l_discount").alias("quality"), (F.col("l_partkey") % 256).alias("colour"), F.col("l_linenumber").alias("o"))
    return M.best_colour(c, ["p"], "quality", "colour", "o")


@query("j48_blended_colour")
def blended_colour(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("p"), F.col("l_discount").alias("quality"), (F.col("l_partkey") % 256).cast("double").alias("colour"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("o"))
    return round_all(M.blended_colour(c, ["p"], "quality", "colour", "o", 0.02))


@query("j28_first_room_images", "SELECT room, count(*) AS images FROM (SELECT l_orderkey, min(l_suppkey % 30) AS room FROM lineitem GROUP BY 1) GROUP BY room")
def first_room_images(spark, sf_dir):
    return M.first_room_images(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 30).alias("room")), "l_orderkey", "room")


@query("x19_x20_boxes", f"WITH {_P2} SELECT k, px <= 4 AND 1 <= px + 2 AND py <= 5 AND 1 <= py + 2 AS meet FROM p")
def boxes(spark, sf_dir):
    x, y = F.col("px"), F.col("py")
    return plane_points(spark, sf_dir).select("k", G.boxes_meet([x, y], [x + 2, y + 2], G.lits(1, 1), G.lits(4, 5)).alias("meet"))


@query("x35_x36_attitude", f"WITH {_P3} SELECT k, round(atan2(ay, az + 0.5), 8) AS roll, round(atan2(-ax, sqrt(ay * ay + (az + 0.5) * (az + 0.5))), 8) + 0 AS pitch, round(ay, 6) AS east, round(-az, 6) + 0 AS up FROM p")
def attitude(spark, sf_dir):
    roll, pitch, _ = G.from_gravity(F.col("ax"), F.col("ay"), F.col("az") + 0.5, F.lit(0.0))
    enu = G.ned_to_enu(G.vec("ax", "ay", "az"))
    return space_points(spark, sf_dir).select("k", F.round(roll, 8).alias("roll"), (F.round(pitch, 8) + 0.0).alias("pitch"), F.round(enu[0], 6).alias("east"), (F.round(enu[2], 6) + 0.0).alias("up"))


@query("x66_tetrahedra", f"WITH {_P3} SELECT k, ax / 10 >= 0 AND ay / 10 >= 0 AND az / 10 >= 0 AND ax / 10 + ay / 10 + az / 10 <= 1.00001 AS inside FROM p")
def tetrahedra(spark, sf_dir):
    p = [F.col(c) / 10 for c in ("ax", "ay", "az")]
    return space_points(spark, sf_dir).select("k", G.in_tetrahedron(p, *[G.lits(*v) for v in ((0, 0, 0), (1.00001, 0, 0), (0, 1.00001, 0), (0, 0, 1.00001))]).alias("inside"))


@query("x67_three_planes", f"WITH {_P3} SELECT k, round(ax + 1, 8) AS x, round((ay + 2) / 2, 8) AS y, round(az - ax - 1, 8) + 0 AS z FROM p")
def three_planes(spark, sf_dir):
    q = G.three_planes([G.lits(1, 0, 0), G.lits(0, 2, 0), G.lits(1, 0, 1)], [F.col("ax") + 1, F.col("ay") + 2, F.col("az")])
    return space_points(spark, sf_dir).select("k", F.round(q[0], 8).alias("x"), F.round(q[1], 8).alias("y"), (F.round(q[2], 8) + 0.0).alias("z"))


@query("x79_window_corners", "SELECT p_partkey AS k, round(p_size * 0.25, 6) AS x, round(2.5 * (p_partkey % 4 * 0.25), 6) AS z FROM part")
def window_corners(spark, sf_dir):
    s, k = F.col("p_size").cast("double"), F.col("p_partkey") % 4 * 0.25
    c = G.window_corners([F.lit(0.0), F.lit(0.0)], [s, F.lit(0.0)], F.lit(0.0), F.lit(2.5), F.lit(0.25), k, F.lit(0.75), F.lit(1.0))[0]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(c[0], 6).alias("x"), F.round(c[2], 6).alias("z"))


@query("a30_neighbourhood_sums", sql(", c AS (SELECT CAST(floor(x / 4) AS BIGINT) AS i0, CAST(floor(y / 4) AS BIGINT) AS i1, CAST(count(*) AS DOUBLE) AS v FROM points GROUP BY ALL) SELECT c.i0, c.i1, sum(o.v) AS total FROM c JOIN c o ON abs(c.i0 - o.i0) + abs(c.i1 - o.i1) <= 1 GROUP BY ALL", "points"))
def neighbourhood_sums(spark, sf_dir):
    cells = points(spark, sf_dir).groupBy(A.cell_key("x", 4.0).alias("i0"), A.cell_key("y", 4.0).alias("i1")).agg(F.count("*").cast("double").alias("v"))
    return A.neighbourhood_sums(cells, "v", 1)


@query("a50_mean_heading", "SELECT user_id, round(atan2(avg(sin(value)), avg(cos(value))), 8) AS heading FROM events GROUP BY 1")
def mean_heading(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (3 * F.cos("value")).alias("mx"), (3 * F.sin("value")).alias("my"))
    return round_all(A.mean_heading(e, ["user_id"]), 8)


@query("g17_missing_children", "WITH l AS (SELECT DISTINCT 5 AS depth, p_partkey % 32 AS ix, (p_partkey // 32) % 32 AS iy, p_size % 32 AS iz FROM part), o AS (SELECT a.x, b.y, c.z FROM (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(y), (VALUES (0), (1)) c(z)), f AS (SELECT DISTINCT depth, ix // 2 * 2 + x AS ix, iy // 2 * 2 + y AS iy, iz // 2 * 2 + z AS iz FROM l, o) SELECT depth, ix, iy, CAST(iz AS BIGINT) AS iz FROM f WHERE (ix, iy, iz) NOT IN (SELECT (ix, iy, iz) FROM l)")
def missing_children(spark, sf_dir):
    k = F.col("p_partkey")
    leaves = table(spark, sf_dir, "part").select(F.lit(5).alias("depth"), (k % 32).alias("ix"), (F.floor(k / 32) % 32).alias("iy"), (F.col("p_size") % 32).cast("long").alias("iz")).distinct()
    return V.missing_children(leaves)


@query("k25_leaf_voxels", "WITH l AS (SELECT DISTINCT 3 AS depth, p_partkey % 8 AS ix, p_size % 8 AS iy, p_partkey % 5 AS iz FROM part) SELECT 4 AS depth, CAST(ix * 2 + x AS BIGINT) AS ix, CAST(iy * 2 + y AS BIGINT) AS iy, CAST(iz * 2 + z AS BIGINT) AS iz FROM l, (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(y), (VALUES (0), (1)) c(z)")
def leaf_voxels(spark, sf_dir):
    k = F.col("p_partkey")
    return V.leaf_voxels(table(spark, sf_dir, "part").select(F.lit(3).alias("depth"), (k % 8).alias("ix"), (F.col("p_size") % 8).alias("iy"), (k % 5).alias("iz")).distinct(), 4)


@query("g04_flood_rooms")
def flood_rooms(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("level"), F.col("o_orderkey").alias("t"))
    nxt = F.lead("t").over(Window.partitionBy("level").orderBy("t"))
    borders = o.select("level", F.col("t").alias("u"), nxt.alias("v"), (F.col("t") % 13 + 1.0).alias("length")).where("v is not null")
    ranked = o.withColumn("room", F.row_number().over(Window.partitionBy("level").orderBy(F.xxhash64("t"))))
    return V.flood_rooms(o, borders, ranked.where("room <= 5"), "level")
