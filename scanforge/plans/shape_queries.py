"""Queries of scalar functions, and of operators on cells, voxels, leaves and meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import shapes as G
from ..functions import probability as P
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import volume as V
from ..operators import windows as W
from .aggregate_queries import _TRIANGLES, triangles
from .inputs import points, sql, table
from .registry import query, round_all

# Three plane points and one more from each supplier, and the same in space from each part; all are whole multiples of 1 / 64, so
# that what is degenerate is exactly so
_P2 = "p AS (SELECT s_suppkey AS k, floor(s_acctbal / 16) / 64::DOUBLE AS ax, s_nationkey * 0.5::DOUBLE AS ay, s_suppkey % 13 * 0.75::DOUBLE AS bx, s_suppkey % 7 * 1.25::DOUBLE AS by2, s_suppkey % 5 * 1.125::DOUBLE - 2 AS cx, s_suppkey % 11 * 0.875::DOUBLE AS cy, s_suppkey % 17 * 0.375::DOUBLE AS px, s_suppkey % 19 * 0.3125::DOUBLE AS py FROM supplier)"
_P3 = "p AS (SELECT p_partkey AS k, p_size * 0.25::DOUBLE AS ax, p_partkey % 7 * 1.0::DOUBLE AS ay, p_partkey % 11 * 0.5::DOUBLE AS az, p_partkey % 13 * 0.75::DOUBLE AS bx, p_size % 9 * 1.125::DOUBLE AS by2, p_partkey % 5 * 1.0::DOUBLE AS bz, p_partkey % 17 * 0.3125::DOUBLE AS cx, p_partkey % 3 * 2.0::DOUBLE AS cy, p_size % 4 * 1.5::DOUBLE AS cz FROM part)"


def plane_points(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("k"), (F.floor(F.col("s_acctbal") / 16) / 64).alias("ax"), (F.col("s_nationkey") * 0.5).alias("ay"), (k % 13 * 0.75).alias("bx"), (k % 7 * 1.25).alias("by2"), (k % 5 * 1.125 - 2).alias("cx"), (k % 11 * 0.875).alias("cy"), (k % 17 * 0.375).alias("px"), (k % 19 * 0.3125).alias("py"))


def space_points(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("k"), (s * 0.25).alias("ax"), (k % 7 * 1.0).alias("ay"), (k % 11 * 0.5).alias("az"), (k % 13 * 0.75).alias("bx"), (s % 9 * 1.125).alias("by2"), (k % 5 * 1.0).alias("bz"), (k % 17 * 0.3125).alias("cx"), (k % 3 * 2.0).alias("cy"), (s % 4 * 1.5).alias("cz"))


A2, B2, C2, P2 = ["ax", "ay"], ["bx", "by2"], ["cx", "cy"], ["px", "py"]
A3, B3, C3 = ["ax", "ay", "az"], ["bx", "by2", "bz"], ["cx", "cy", "cz"]


@query("x21_x26_triangles", f"WITH {_P2}, q AS (SELECT *, (bx - ax) * (cy - ay) - (by2 - ay) * (cx - ax) AS o FROM p) SELECT k, round(o, 9) AS orient, round(abs(o) / 2, 9) AS area, round((ax + bx + cx) / 3, 9) AS mx, round(sqrt((ax - bx) * (ax - bx) + (ay - by2) * (ay - by2)), 9) AS edge FROM q")
def triangle_measures(spark, sf_dir):
    a, b, c = (G.vec(*n) for n in (A2, B2, C2))
    return round_all(plane_points(spark, sf_dir).select("k", G.orient2d(a, b, c).alias("orient"), G.triangle_area(a, b, c).alias("area"), G.centroid(a, b, c)[0].alias("mx"), G.distance(a, b).alias("edge")), 9)


@query("x22_in_triangle", f"WITH {_P2}, q AS (SELECT k, (bx - ax) * (py - ay) - (by2 - ay) * (px - ax) AS s, (cx - bx) * (py - by2) - (cy - by2) * (px - bx) AS t, (ax - cx) * (py - cy) - (ay - cy) * (px - cx) AS u FROM p) SELECT k, least(s, t, u) >= 0 OR greatest(s, t, u) <= 0 AS inside FROM q")
def in_triangle(spark, sf_dir):
    return plane_points(spark, sf_dir).select("k", G.in_triangle(*(G.vec(*n) for n in (P2, A2, B2, C2))).alias("inside"))


@query("x23_x61_circles", f"WITH {_P2}, q AS (SELECT *, 2 * ((bx - ax) * (cy - ay) - (by2 - ay) * (cx - ax)) AS d, (bx - ax) * (bx - ax) + (by2 - ay) * (by2 - ay) AS m, (cx - ax) * (cx - ax) + (cy - ay) * (cy - ay) AS n FROM p), r AS (SELECT *, ((cy - ay) * m - (by2 - ay) * n) / nullif(d, 0) AS ux, ((bx - ax) * n - (cx - ax) * m) / nullif(d, 0) AS uy FROM q) SELECT k, round(ax + ux, 9) AS x, round(sqrt(ux * ux + uy * uy), 9) AS radius FROM r")
def circles(spark, sf_dir):
    a, b, c = (G.vec(*n) for n in (A2, B2, C2))
    x, _, r = G.circumcircle(a, b, c)
    return round_all(plane_points(spark, sf_dir).select("k", x.alias("x"), r.alias("radius")), 9)


@query("x25_x63_segments", f"WITH {_P2}, q AS (SELECT *, bx - ax AS rx, by2 - ay AS ry, px - cx AS sx, py - cy AS sy FROM p), t AS (SELECT *, greatest(0.0, least(1.0, coalesce(((px - ax) * rx + (py - ay) * ry) / nullif(rx * rx + ry * ry, 0), 0.0))) AS f FROM q) SELECT k, round(((cx - ax) * sy - (cy - ay) * sx) / nullif(rx * sy - ry * sx, 0), 9) AS t, round(sqrt((px - ax - rx * f) * (px - ax - rx * f) + (py - ay - ry * f) * (py - ay - ry * f)), 9) AS d FROM t")
def segments(spark, sf_dir):
    a, b, c, p = (G.vec(*n) for n in (A2, B2, C2, P2))
    return plane_points(spark, sf_dir).select("k", F.round(G.segment_crossing(a, b, c, p)[0], 9).alias("t"), F.round(G.point_segment_distance(p, a, b), 9).alias("d"))


@query("x14_x18_segment_box", f"""WITH {_P2}, q AS (SELECT k, ax, ay, bx, by2, (1 - ax) / nullif(bx - ax, 0) AS tx0, (4 - ax) / nullif(bx - ax, 0) AS tx1, (2 - ay) / nullif(by2 - ay, 0) AS ty0, (5 - ay) / nullif(by2 - ay, 0) AS ty1 FROM p)
    SELECT k, NOT (bx = ax AND (ax < 1 OR ax > 4)) AND NOT (by2 = ay AND (ay < 2 OR ay > 5)) AND greatest(0.0, CASE WHEN bx = ax THEN 0.0 ELSE least(tx0, tx1) END, CASE WHEN by2 = ay THEN 0.0 ELSE least(ty0, ty1) END) <= least(1.0, CASE WHEN bx = ax THEN 1.0 ELSE greatest(tx0, tx1) END, CASE WHEN by2 = ay THEN 1.0 ELSE greatest(ty0, ty1) END) AS hit FROM q""")
def segment_box(spark, sf_dir):
    return plane_points(spark, sf_dir).select("k", G.segment_meets_box(G.vec(*A2), G.vec(*B2), G.lits(1, 2), G.lits(4, 5)).alias("hit"))


@query("x15_x16_planes", f"WITH {_P3} SELECT k, round(ax, 9) AS x, 2.0 AS z, round((2 - az) / nullif(bz - az, 0), 9) + 0 AS t FROM p")
def planes(spark, sf_dir):
    a, b, n, at = G.vec(*A3), G.vec(*B3), G.lits(0, 0, 1), G.lits(5, 7, 2)
    df = space_points(spark, sf_dir)
    q = G.project_on_plane(a, n, at)
    return df.select("k", F.round(q[0], 9).alias("x"), F.round(q[2], 9).alias("z"), (F.round(G.plane_hit(a, b, n, at), 9) + 0.0).alias("t"))


@query("x26_x69_normals", f"WITH {_P3}, q AS (SELECT k, (by2 - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by2 - ay) * (cx - ax) AS nz FROM p) SELECT k, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 9) AS area, round(nx / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0), 9) + 0 AS nx FROM q")
def normals(spark, sf_dir):
    a, b, c = (G.vec(*n) for n in (A3, B3, C3))
    return space_points(spark, sf_dir).select("k", F.round(G.triangle_area(a, b, c), 9).alias("area"), (F.round(G.triangle_normal(a, b, c)[0], 9) + 0.0).alias("nx"))


@query("x32_x40_rigid", f"WITH {_P3}, q AS (SELECT *, ax / 10 AS r, ay / 10 AS pi, bx / 10 AS yw FROM p) SELECT k, round(r, 6) AS roll, round(pi, 6) AS pitch, round(yw, 6) AS yaw, round(cx, 9) AS x, round(cos(yw) * cos(pi) * cx + (cos(yw) * sin(pi) * sin(r) - sin(yw) * cos(r)) * cy + (cos(yw) * sin(pi) * cos(r) + sin(yw) * sin(r)) * cz + 1, 9) AS wx FROM q")
def rigid(spark, sf_dir):
    df = space_points(spark, sf_dir)
    m, t, p = G.rotation_from_rpy(F.col("ax") / 10, F.col("ay") / 10, F.col("bx") / 10), G.lits(1, 2, 3), G.vec(*C3)
    df = df.select("k", *C3, F.array(*[F.array(*row) for row in m]).alias("m"))
    m = [[F.get(F.get("m", i), j) for j in range(3)] for i in range(3)]
    world = G.apply(m, p, t)
    back = G.apply(*([G.invert(m, t)[0], world, G.invert(m, t)[1]]))
    return df.select("k", *[F.round(c, 6).alias(n) for c, n in zip(G.rpy_from_rotation(m), ("roll", "pitch", "yaw"))], F.round(back[0], 9).alias("x"), F.round(world[0], 9).alias("wx"))


@query("x65_corner_cosine", f"WITH {_P3} SELECT k, round(((bx - ax) * (cx - ax) + (by2 - ay) * (cy - ay)) / nullif(sqrt((bx - ax) * (bx - ax) + (by2 - ay) * (by2 - ay)) * sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)), 0), 9) + 0 AS cosine FROM p")
def corner_cosine(spark, sf_dir):
    a, b, c = (G.vec(*n[:2]) for n in (A3, B3, C3))
    return space_points(spark, sf_dir).select("k", (F.round(G.corner_cosine(a, b, c), 9) + 0.0).alias("cosine"))


@query("x29_polygon_contains", f"WITH {_P2} SELECT k, (px BETWEEN 1 AND 4 AND py BETWEEN 1 AND 2) OR (px BETWEEN 1 AND 2 AND py BETWEEN 1 AND 4) AS inside, 5.0::DOUBLE AS area FROM p")
def polygon_contains(spark, sf_dir):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1, 1), (4, 1), (4, 2), (2, 2), (2, 4), (1, 4))])
    return plane_points(spark, sf_dir).select("k", G.polygon_contains(F.col("px"), F.col("py"), ring).alias("inside"), G.polygon_area(ring).alias("area"))


_ERF = "(1 - (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-v * v))"


@query("x01_x55_normal", f"WITH q AS (SELECT p_partkey AS k, (p_size - 25) / 10 AS x, abs((p_size - 25) / 10) / sqrt(2) AS v, 1 / (1 + 0.3275911 * abs((p_size - 25) / 10) / sqrt(2)) AS t FROM part) SELECT k, round(exp(-x * x / 2) / sqrt(2 * pi()), 7) AS pdf, round(0.5 * (1 + sign(x) * {_ERF}), 7) AS cdf FROM q")
def normal(spark, sf_dir):
    x = (F.col("p_size") - 25) / 10
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(P.gauss_pdf(x), 7).alias("pdf"), F.round(P.normal_cdf(x), 7).alias("cdf"))


@query("x60_butterworth", "SELECT p_partkey AS k, round(1 / (1 + pow(p_size / 20.0, 6)), 8) AS w FROM part")
def butterworth(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(P.butterworth(F.col("p_size").cast("double"), 20.0, 3), 8).alias("w"))


@query("x43_noise_colour", "SELECT p_size AS s, CAST(floor(255 * least(1.0, p_size / 500.0 / 0.1)) AS INT) AS r, CAST(floor(255 * (1 - least(1.0, p_size / 500.0 / 0.1))) AS INT) AS b, count(*) AS n FROM part GROUP BY ALL")
def noise_colour(spark, sf_dir):
    c = C.noise_colour(F.col("p_size") / 500.0)
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("s"), c["r"].alias("r"), c["b"].alias("b")).agg(F.count("*").alias("n"))


@query("x42_x44_colours")
def colours(spark, sf_dir):
    h, t = C.height_colour(F.col("z"), 4.0), C.time_colour(F.col("y"), F.lit(1.0), F.lit(50.0))
    return points(spark, sf_dir).groupBy(h["r"].alias("hr"), t["g"].alias("tg")).agg(F.count("*").alias("n"))


@query("x57_x59_text", "SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.001 WHEN 2 THEN 0.3048 END AS f, n_name AS name, 'a\\_b\\%' AS tex FROM nation")
def text(spark, sf_dir):
    k = F.col("n_nationkey")
    unit = F.element_at(F.array(*[F.lit(v) for v in ("meters", "Millimeters ", "feet", "none")]), k % 4 + 1)
    path = F.concat(F.lit("/data/x.y/"), F.col("n_name"), F.lit(".mad"))
    return table(spark, sf_dir, "nation").select(k.alias("k"), C.unit_factor(unit).alias("f"), C.dataset_name(path).alias("name"), C.latex_text(F.lit("a_b%")).alias("tex"))


@query("x82_child_octant", sql("SELECT (x >= 50)::INT + 2 * (y >= 25)::INT + 4 * (z >= 5)::INT AS octant, count(*) AS n FROM points GROUP BY 1", "points"))
def octant(spark, sf_dir):
    return points(spark, sf_dir).groupBy(G.child_octant(G.vec("x", "y", "z"), G.lits(50, 25, 5)).alias("octant")).agg(F.count("*").alias("n"))


@query("x50_x53_faces", "WITH q AS (SELECT p_partkey AS k, p_size / 60.0 AS pa, p_partkey % 10 / 12.0 + 0.1 AS pb FROM part) SELECT k, round(CASE WHEN (0.5 - pa) / nullif(pb - pa, 0) BETWEEN 0 AND 1 THEN 1 + 2 * (0.5 - pa) / (pb - pa) ELSE 2.0 END, 5) AS x, 0.25::DOUBLE AS area FROM q")
def faces(spark, sf_dir):
    pa, pb = F.col("p_size") / 60.0, F.col("p_partkey") % 10 / 12.0 + 0.1
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(G.face_position(pa, pb, F.lit(1.0), F.lit(3.0)), 5).alias("x"), G.face_area(F.lit(0.5), F.lit(0.25)).alias("area"))


# --- voxels, leaves, meshes -------------------------------------------------------------------------------------------

_VOX = "vox AS (SELECT DISTINCT CAST(floor(l_extendedprice / 4000) AS BIGINT) AS ix, CAST(floor(l_quantity / 4) AS BIGINT) AS iy, CAST(floor(l_discount * 100 / 2) AS BIGINT) AS iz FROM lineitem)"
_FACE = "face AS (SELECT * FROM (VALUES (0, -1, 0, 4), (1, 0, 0, 8), (0, 1, 0, 1), (-1, 0, 0, 2), (0, 0, -1, 32), (0, 0, 1, 16)) f(dx, dy, dz, bit))"


def voxels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_extendedprice") / 4000).alias("ix"), F.floor(F.col("l_quantity") / 4).alias("iy"), F.floor(F.col("l_discount") * 100 / 2).alias("iz")).distinct()


@query("g36_boundary_voxels", f"WITH {_VOX}, {_FACE} SELECT ix + dx AS ix, iy + dy AS iy, iz + dz AS iz, CAST(bit_or(bit) AS INT) AS state FROM vox, face WHERE NOT EXISTS (SELECT 1 FROM vox o WHERE o.ix = vox.ix + dx AND o.iy = vox.iy + dy AND o.iz = vox.iz + dz) GROUP BY ALL")
def boundary_voxels(spark, sf_dir):
    return V.boundary_voxels(voxels(spark, sf_dir))


@query("g02_thin_voxels", f"WITH RECURSIVE {_VOX}, {_FACE} SELECT vox.ix, vox.iy, vox.iz, CAST(6 - count(o.ix) AS INT) AS open_sides FROM vox CROSS JOIN face LEFT JOIN vox o ON o.ix = vox.ix + dx AND o.iy = vox.iy + dy AND o.iz = vox.iz + dz GROUP BY ALL")
def open_sides(spark, sf_dir):
    return V.open_sides(voxels(spark, sf_dir))


@query("g02_outlier_removal")
def outlier_removal(spark, sf_dir):
    return V.remove_thin_voxels(voxels(spark, sf_dir))


@query("g72_cube_masks", f"WITH {_VOX}, d AS (SELECT a.x, b.y, c.z, 1 << (a.x + 2 * b.y + 4 * c.z) AS bit FROM (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(y), (VALUES (0), (1)) c(z)) SELECT ix - x AS ix, iy - y AS iy, iz - z AS iz, CAST(bit_or(bit) AS INT) AS mask FROM vox, d GROUP BY ALL")
def cube_masks(spark, sf_dir):
    return V.cube_masks(voxels(spark, sf_dir))


def leaves(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return v.select(F.concat_ws(",", "ix", "iy", "iz").alias("leaf"), *[(F.col(f"i{a}") + 0.5).alias(f"c{a}") for a in "xyz"], F.lit(0.5).alias("hw"), ((F.col("ix") + F.col("iy")) % 3 > 0).alias("interior"))


_AXES = "ax AS (SELECT * FROM (VALUES ('x', 1, 0, 0), ('y', 0, 1, 0), ('z', 0, 0, 1)) f(axis, dx, dy, dz))"


@query("g07_boundary_faces", f"WITH {_VOX}, {_AXES}, n AS (SELECT a.*, axis, (a.ix + a.iy) % 3 > 0 AS ai, (b.ix + b.iy) % 3 > 0 AS bi, concat_ws(',', a.ix, a.iy, a.iz) AS a, concat_ws(',', b.ix, b.iy, b.iz) AS b FROM vox a, ax, vox b WHERE b.ix = a.ix + dx AND b.iy = a.iy + dy AND b.iz = a.iz + dz) SELECT CASE WHEN ai THEN a ELSE b END AS interior, CASE WHEN ai THEN b ELSE a END AS exterior, axis, CASE WHEN ai THEN 1 ELSE -1 END AS sign, 1.0::DOUBLE AS area FROM n WHERE ai <> bi")
def boundary_faces(spark, sf_dir):
    lv = leaves(spark, sf_dir)
    return V.boundary_faces(lv, J.face_neighbours(lv))


@query("g11_corners", f"WITH {_VOX}, d AS (SELECT a.x, b.y, c.z FROM (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(y), (VALUES (0), (1)) c(z)) SELECT CAST(ix + d.x AS DOUBLE) AS x, CAST(iy + d.y AS DOUBLE) AS y, CAST(iz + d.z AS DOUBLE) AS z, CAST(count(*) AS INT) AS leaves FROM vox, d GROUP BY ALL")
def corners(spark, sf_dir):
    return V.corners(leaves(spark, sf_dir)).withColumn("leaves", F.size("leaves"))


@query("g01_majority_flip")
def majority_flip(spark, sf_dir):
    lv = leaves(spark, sf_dir)
    return V.majority_flip(lv, J.face_neighbours(lv), 0.6).select("leaf", "interior")


@query("g03_watershed")
def watershed(spark, sf_dir):
    cells = points(spark, sf_dir).groupBy(A.cell_key("x", 4.0).alias("i0"), A.cell_key("y", 4.0).alias("i1")).agg(F.count("*").cast("double").alias("open_height"))
    return V.watershed(cells, W.local_maxima(cells, "open_height").select("i0", "i1", "seed"))


@query("g41_laplace", f"WITH {_TRIANGLES}, v AS (SELECT n AS v, n % 11 * 0.25::DOUBLE AS x, n * 0.5::DOUBLE AS y, n % 3 * 1.0::DOUBLE AS z FROM (SELECT i AS n FROM tri UNION SELECT j FROM tri UNION SELECT k FROM tri)), e AS (SELECT i AS v, j AS n FROM tri UNION ALL SELECT i, k FROM tri UNION ALL SELECT j, i FROM tri UNION ALL SELECT j, k FROM tri UNION ALL SELECT k, i FROM tri UNION ALL SELECT k, j FROM tri), s AS (SELECT e.v, count(*) AS m, sum(v.x) AS x, sum(v.y) AS y, sum(v.z) AS z FROM e JOIN v ON e.n = v.v GROUP BY e.v) SELECT v.v, round((v.x * 2 + coalesce(s.x, 0)) / (2 + coalesce(m, 0)), 6) AS x, round((v.y * 2 + coalesce(s.y, 0)) / (2 + coalesce(m, 0)), 6) AS y, round((v.z * 2 + coalesce(s.z, 0)) / (2 + coalesce(m, 0)), 6) AS z FROM v LEFT JOIN s USING (v)")
def laplace(spark, sf_dir):
    n = F.col("n")
    v = triangles(spark, sf_dir).select(F.explode(F.array("i", "j", "k")).alias("n")).distinct()
    v = v.select(n.alias("v"), (n % 11 * 0.25).alias("x"), (n * 0.5).alias("y"), (n % 3 * 1.0).alias("z"))
    return round_all(V.laplace_smooth(v, triangles(spark, sf_dir)))


@query("g22_offset_search", "WITH o AS (SELECT p_partkey AS wall, d AS shift, round(abs(d * 10 - p_size % 7 + 3) + 0.01 * abs(d), 6) AS cost FROM part, (SELECT unnest([-0.2, -0.1, 0.0, 0.1, 0.2])::DOUBLE AS d)) SELECT wall, arg_min(shift, (cost, abs(shift), shift)) AS shift, min(cost) AS cost FROM o GROUP BY wall")
def offset_search(spark, sf_dir):
    walls = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("wall"), "p_size")
    cost = F.round(F.abs(F.col("shift") * 10 - F.col("p_size") % 7 + 3) + 0.01 * F.abs("shift"), 6)
    return V.offset_search(walls, [-0.2, -0.1, 0.0, 0.1, 0.2], cost)
