"""Queries of operators and scalar functions that no other module's queries run by themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..arguments import Tag
from ..arguments import parse as parse_arguments
from ..functions import camera as M
from ..functions import colour as C
from ..functions import shapes as G
from ..operators import aggregates as A
from ..operators import building as B
from ..operators import carving as K
from ..operators import filters as L
from ..operators import joins as J
from ..operators import mesh as E
from ..operators import sets as S
from ..operators import surfaces as U
from ..operators import volume as V
from ..operators.components import checkpoint_folder
from ..operators.script import run_script
from ..sources import sensors
from ..sources import text as T
from .inputs import points, poses, samples, seconds, sql, table
from .registry import query, round_all
from .shape_queries import _P2, _P3, _VOX, leaves, plane_points, space_points, voxels

A3, B3, C3 = ["ax", "ay", "az"], ["bx", "by2", "bz"], ["cx", "cy", "cz"]
A2, B2, C2, P2 = ["ax", "ay"], ["bx", "by2"], ["cx", "cy"], ["px", "py"]


# --- filters --------------------------------------------------------------------------------------------------------------


@query("f15_u03_u04_scope_words", sql("SELECT x, CASE WHEN x BETWEEN 5 AND 60 AND y BETWEEN 5 AND 45 AND z BETWEEN 0 AND 8 THEN y + 1 ELSE y END AS y, CASE WHEN x BETWEEN 5 AND 60 AND y BETWEEN 5 AND 45 AND z BETWEEN 0 AND 8 THEN r ELSE 9 END AS r FROM points", "points"))
def scope_words(spark, sf_dir):
    """Commands of one script on the rows inside a box, and on those outside."""
    script = "PartitionAABB 5 60 5 45 0 8\nTranslate 0 1 0 VALID\nRecolor 9 9 9 INVALID\n"
    return run_script(points(spark, sf_dir), script, ["timestamp", "index", "x", "y", "z", "part"]).select("x", "y", "r")


@query("f21_depth_points", "SELECT event_id AS frame_idx, CAST(p AS INT) AS pixel, (user_id % 100 + p) / 1000 AS x, (p + 1) / 1000 AS z, CAST(p AS BIGINT) AS intensity FROM events, (VALUES (0), (1), (2)) v(p)")
def depth_points(spark, sf_dir):
    numbers = lambda c: F.array(*[c(k).cast("long") for k in range(3)])
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_idx"), seconds("ts").alias("timestamp"), numbers(lambda k: F.col("user_id") % 100 + k).alias("xs"), numbers(lambda k: F.lit(0)).alias("ys"), numbers(lambda k: F.lit(k + 1)).alias("zs"), numbers(F.lit).alias("ns"))
    return sensors.depth_points(e).select("frame_idx", "pixel", "x", "z", "intensity")


@query("f23_unproject", sql("SELECT part, round(((g - 100) / 500.0 * z) * 0.0 - ((r - 120) / 500.0 * z) + 1, 9) AS x, round((g - 100) / 500.0 * z + 2, 9) AS y, round(z + 3, 9) AS z FROM points WHERE z > 0", "points"))
def unproject(spark, sf_dir):
    """The pose turns by a quarter about z: x goes to y, and y to -x."""
    h = 0.5**0.5
    pose = {"qw": h, "qx": 0.0, "qy": 0.0, "qz": h, "px": 1.0, "py": 2.0, "pz": 3.0}
    p = points(spark, sf_dir).select("part", F.col("g").alias("u"), F.col("r").alias("v"), F.col("z").alias("depth"), *[F.lit(v).alias(c) for c, v in pose.items()])
    return round_all(B.unproject(p, 500.0, 500.0, 100.0, 120.0).select("part", "x", "y", "z"), 9)


@query("f24_inside_plans", f"WITH {_VOX} SELECT ix, iy, iz FROM vox WHERE (ix <= 4 AND ix + 1 >= 1 AND iy <= 6 AND iy + 1 >= 2 AND iz <= 3 AND iz + 1 >= 0) OR (ix <= 20 AND ix + 1 >= 15 AND iy <= 12 AND iy + 1 >= 0 AND iz <= 9 AND iz + 1 >= 4)")
def inside_plans(spark, sf_dir):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(f"{m}_{a}") for x, (a, m) in zip(v, [(a, m) for a in "xyz" for m in ("min", "max")])])
    plans = spark.range(1).select(F.inline(F.array(box(1.5, 3.5, 2.5, 5.5, 0.5, 2.5), box(15.5, 19.5, 0.5, 11.5, 4.5, 8.5))))
    at = F.split("leaf", ",")
    return B.inside_plans(leaves(spark, sf_dir), plans, 0.5).select(*[F.get(at, k).cast("long").alias(f"i{a}") for k, a in enumerate("xyz")])


@query("f25_whitelist", "SELECT p_partkey AS leaf FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def whitelist(spark, sf_dir):
    return B.only(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("leaf")), table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("leaf")))


@query("f26_cells_with_poses", sql("SELECT CAST(floor(x / 5) AS BIGINT) AS i0, CAST(floor(y / 5) AS BIGINT) AS i1, count(*) AS num_pts FROM points GROUP BY ALL HAVING count(CASE WHEN part % 50 = 0 THEN 1 END) > 0", "points"))
def cells_with_poses(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("pose", F.when(F.col("part") % 50 == 0, F.col("part")))
    return A.with_poses(A.occupancy_cells(p, 5.0)).select("i0", "i1", "num_pts")


@query("f27_linked_cells", "SELECT s_suppkey AS cell FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey % 7 = 0 UNION SELECT l_partkey FROM lineitem WHERE l_partkey % 7 = 0)")
def linked_cells(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").where("l_partkey % 7 = 0").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"))
    return B.without_links(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell")), links, "cell")


@query("f28_clear_rooms", "SELECT p_partkey AS leaf, -1 AS fp_room FROM part")
def clear_rooms(spark, sf_dir):
    return B.clear_rooms(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("leaf"), F.col("p_size").alias("fp_room")))


@query("f36_polygon_covers_box", f"WITH {_P2} SELECT k, px >= 1 AND px + 1 <= 4 AND py >= 1 AND py + 1 <= 5 AS covers FROM p")
def covers(spark, sf_dir):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1, 1), (4, 1), (4, 5), (1, 5))])
    low = G.vec(*P2)
    return plane_points(spark, sf_dir).select("k", B.polygon_covers_box(ring, low, [c + 1 for c in low]).alias("covers"))


@query("f14_output", sql("SELECT x, z + 1 AS z, timestamp FROM points WHERE x BETWEEN 5 AND 60 AND y BETWEEN 5 AND 45 AND z BETWEEN 0 AND 8", "points"))
def output(spark, sf_dir):
    """The rows in scope in the middle of a script, as they were then."""
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4()}.xyz"
    run_script(points(spark, sf_dir), f"PartitionAABB 5 60 5 45 0 8\nTranslate 0 0 1\nOutput {path} VALID\nScale 7\n", ["timestamp", "index", "x", "y", "z", "part"])
    return T.load_points(spark, path).select("x", "z", "timestamp")


_PIXELS = "px AS (SELECT s_suppkey % 5 AS camera, CAST(n AS INT) AS col, s_suppkey % 40 AS row FROM supplier, (SELECT unnest(generate_series(0, 39)) AS n))"


def _pixels(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((k % 5).alias("camera"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("col"), (k % 40).alias("row"))


@query("f37_room_pixels", f"WITH {_PIXELS} SELECT camera, col, row FROM px WHERE ((col - 2) * 0.5 BETWEEN 1 AND 6 AND (row - 3) * 0.5 BETWEEN 1 AND 4) OR ((col - 2) * 0.5 BETWEEN 9 AND 14 AND (row - 3) * 0.5 BETWEEN 0 AND 12)")
def room_pixels(spark, sf_dir):
    ring = lambda x0, y0, x1, y1: F.struct(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]).alias("polygon"))
    rooms = spark.range(1).select(F.inline(F.array(ring(1, 1, 6, 4), ring(9, 0, 14, 12))))
    return B.room_pixels(_pixels(spark, sf_dir), rooms, 0.5, 2.0, 3.0, 3.0)


@query("f38_unmasked_pixels", f"WITH {_PIXELS} SELECT camera, col, row FROM px WHERE (camera + col) % 3 > 0 AND row % 2 = 0")
def unmasked(spark, sf_dir):
    px = _pixels(spark, sf_dir)
    mask = px.where("row % 2 = 0").withColumn("usable", (F.col("camera") + F.col("col")) % 3 > 0)
    return M.unmasked(px, mask, ["camera"])


@query("u05_arguments", "SELECT n_nationkey AS k, n_name || '.xyz' AS infile, n_regionkey * 0.5::DOUBLE AS res, n_nationkey % 2 = 0 AS fast FROM nation")
def arguments(spark, sf_dir):
    """A command line for each nation, told apart again; command lines are a few words on the driver."""
    tags = [Tag("-i", values=0, extensions=(".xyz", ".pts"), required=True), Tag("-r", values=1, required=True), Tag("--fast")]
    rows = []
    for r in table(spark, sf_dir, "nation").collect():
        got = parse_arguments(tags, ["-r", str(r["n_regionkey"] * 0.5), f"{r['n_name']}.xyz", *(["--fast"] if r["n_nationkey"] % 2 == 0 else [])])
        rows.append((r["n_nationkey"], got["-i"][0], float(got["-r"][0]), got["--fast"]))
    return spark.createDataFrame(rows, "k int, infile string, res double, fast boolean")


# --- joins ----------------------------------------------------------------------------------------------------------------


@query("j12_j14_pose_of_points", sql("SELECT q.frame, q.index, max(p.ts) AS ts FROM points q ASOF LEFT JOIN poses p ON q.timestamp >= p.ts GROUP BY ALL", "points", "poses"))
def pose_of_points(spark, sf_dir):
    got = J.as_of(points(spark, sf_dir), poses(spark, sf_dir).select("ts"), "timestamp", "ts", 30 * 86400.0)
    return got.groupBy("frame", "index").agg(F.max("ts").alias("ts"))


@query("j17_j18_j25_boxes_in_cells", f"WITH {_P2}, b AS (SELECT k, least(ax, bx) AS x0, greatest(ax, bx) AS x1, least(ay, by2) AS y0, greatest(ay, by2) AS y1 FROM p), c AS (SELECT k, unnest(generate_series(CAST(floor(x0 / 2) AS BIGINT), CAST(floor(x1 / 2) AS BIGINT))) AS i0, y0, y1 FROM b) SELECT k, i0, unnest(generate_series(CAST(floor(y0 / 2) AS BIGINT), CAST(floor(y1 / 2) AS BIGINT))) AS i1 FROM c")
def boxes_in_cells(spark, sf_dir):
    b = plane_points(spark, sf_dir).select("k", *[f(F.col(a), F.col(c)).alias(n) for (a, c), d in (((A2[0], B2[0]), "x"), ((A2[1], B2[1]), "y")) for n, f in ((f"lo{d}", F.least), (f"hi{d}", F.greatest))])
    return J.box_cells(b, ["lox", "loy"], ["hix", "hiy"], 2.0).select("k", "i0", "i1")


@query("j19_u06_subdivided_cells", "WITH l AS (SELECT l_partkey % 32 AS i0, count(*) AS n, sum(l_quantity) AS w FROM lineitem GROUP BY 1) SELECT i0 * 2 + d AS i0, CAST(greatest(1, n // 8) AS BIGINT) AS count, round(w * greatest(1, n // 8) / n, 6) AS total_weight FROM l, (VALUES (0), (1)) v(d)")
def subdivided_cells(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 32).alias("i0"), F.col("l_quantity").alias("w"), *[F.lit(0.5).alias(c) for c in ("p", "surface", "corner", "planar")])
    parts = A.subdivide_leaf(A.leaf_statistics(line, ["i0"]))
    return round_all(parts.withColumn("d", F.explode(F.array(F.lit(0), F.lit(1)))).select((F.col("i0") * 2 + F.col("d")).alias("i0"), "count", "total_weight"))


@query("j20_leaf_of_points", sql(", c AS (SELECT CAST(floor(x / 8) AS BIGINT) AS i0, CAST(floor(y / 8) AS BIGINT) AS i1, count(*) AS n FROM points WHERE z > 5 GROUP BY ALL) SELECT coalesce(c.n, -1) AS n, count(*) AS points FROM points p LEFT JOIN c ON floor(p.x / 8) = i0 AND floor(p.y / 8) = i1 GROUP BY 1", "points"))
def leaf_of_points(spark, sf_dir):
    p = points(spark, sf_dir)
    cells = p.where("z > 5").groupBy(F.floor(F.col("x") / 8).alias("i0"), F.floor(F.col("y") / 8).alias("i1")).agg(F.count("*").alias("n"))
    return J.cell_lookup(p, cells, 8.0, ["x", "y"], "n", -1).groupBy("n").agg(F.count("*").alias("points"))


@query("j30_j31_t24_walls", "WITH w AS (SELECT p_size AS wall, list(p_partkey ORDER BY p_partkey) AS windows FROM part GROUP BY 1) SELECT a.wall AS a, b.wall AS b FROM w a, w b WHERE a.wall < b.wall AND len(list_intersect(list_transform(a.windows, lambda v: v % 11), list_transform(b.windows, lambda v: v % 11))) > 0")
def walls(spark, sf_dir):
    """Windows gathered by wall; walls meet over the numbers that they have in common, which is what sharing means."""
    w = table(spark, sf_dir, "part").select(F.col("p_size").alias("wall"), (F.col("p_partkey") % 11).alias("source")).distinct()
    own = w.groupBy("wall").agg(F.collect_set("source").alias("sources"))
    pairs = w.select(F.col("wall").alias("a"), "source").join(w.select(F.col("wall").alias("b"), "source"), "source").where("a < b").select("a", "b").distinct()
    both = pairs.join(own.select(F.col("wall").alias("a"), F.col("sources").alias("sa")), "a").join(own.select(F.col("wall").alias("b"), F.col("sources").alias("sb")), "b")
    return both.where(F.arrays_overlap("sa", "sb")).select("a", "b")


@query("j34_j53_j54_face_links", f"WITH {_VOX}, t AS (SELECT ix, iy, max(iz) AS iz FROM vox GROUP BY ALL) SELECT a.ix, a.iy, count(*) AS links FROM t a JOIN t b ON a.iz = b.iz AND abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1 GROUP BY ALL")
def face_links(spark, sf_dir):
    top = voxels(spark, sf_dir).groupBy("ix", "iy").agg(F.max("iz").alias("iz"))
    f = top.select((F.col("ix") * 100000 + F.col("iy")).alias("face"), F.lit("z").alias("axis"), F.lit(1).alias("sign"), (F.col("ix") + 0.5).alias("fx"), (F.col("iy") + 0.5).alias("fy"), (F.col("iz") + 1.0).alias("fz"), F.lit(0.5).alias("hw"))
    links = U.face_links(f)
    both = links.select("u").union(links.select("v")).groupBy(F.col("u").alias("face")).agg(F.count("*").alias("links"))
    return both.select(F.floor(F.col("face") / 100000).alias("ix"), (F.col("face") % 100000).alias("iy"), "links")


@query("j42_o07_camera_of_points", "SELECT l_orderkey AS p, arg_max(l_suppkey, (l_tax, -l_linenumber, l_suppkey)) AS camera, max(l_tax) AS quality FROM lineitem GROUP BY 1")
def camera_of_points(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("p"), F.col("l_tax").alias("quality"), F.col("l_suppkey").alias("camera"), F.col("l_linenumber").alias("o"))
    return M.best_colour(c, ["p"], "quality", "camera", "o")


@query("j55_j56_children_neighbours", f"WITH {_VOX}, c AS (SELECT DISTINCT ix // 2 AS ix, iy // 2 AS iy, iz // 2 AS iz FROM vox) SELECT a.ix, a.iy, a.iz, count(*) AS n FROM c a JOIN c b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1 GROUP BY ALL")
def children_neighbours(spark, sf_dir):
    v = voxels(spark, sf_dir).select(*[F.floor(F.col(f"i{a}") / 2).alias(f"i{a}") for a in "xyz"]).distinct()
    lv = v.select(F.concat_ws(",", "ix", "iy", "iz").alias("leaf"), *[(F.col(f"i{a}") + 0.5).alias(f"c{a}") for a in "xyz"], F.lit(0.5).alias("hw"))
    pairs = J.face_neighbours(lv)
    ends = pairs.select("a").union(pairs.select("b")).groupBy("a").agg(F.count("*").alias("n"))
    at = F.split("a", ",")
    return ends.select(*[F.get(at, k).cast("long").alias(f"i{a}") for k, a in enumerate("xyz")], "n")


# --- aggregates, windows, order -------------------------------------------------------------------------------------------


@query("a16_depth", "SELECT p_partkey AS k, CAST(ceil(log2(2 * p_size / 0.3)) AS BIGINT) AS depth FROM part")
def depth(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), G.depth_for(F.col("p_size").cast("double"), 0.3).alias("depth"))


@query("a24_a25_levels", "SELECT n_nationkey * 4.0::DOUBLE AS floor, n_nationkey * 4.0 + 3::DOUBLE AS ceiling, CASE WHEN n_nationkey < 24 THEN n_nationkey * 4.0 + 3.5 END::DOUBLE AS split FROM nation")
def levels(spark, sf_dir):
    """Storeys from peaks of floors and ceilings, one for each nation and some clutter; peaks are a few numbers on the driver."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()
    floors = [(r[0] * 4.0, 10.0 + r[1]) for r in n] + [(r[0] * 4.0 + 0.5, 1.0) for r in n]
    ceilings = [(r[0] * 4.0 + 3, 5.0) for r in n]
    found = A.pair_levels(floors, ceilings)
    splits = [*A.split_heights(found), None]
    return spark.createDataFrame([(a, b, c) for (a, b), c in zip(found, splits)], "floor double, ceiling double, split double")


@query("a48_a57_a65_w11_extent", sql("SELECT count(*) AS n, round(min(x) / 2, 6) AS min_x, round(max(x) / 2, 6) AS max_x, round(min(y) / 2, 6) AS min_y, round(max(y) / 2, 6) AS max_y, round(min(z) / 2, 6) AS min_z, round(max(z) / 2, 6) AS max_z FROM points WHERE part % 2 = 0", "points"))
def extent(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("valid", F.col("part") % 2 == 0)
    return round_all(L.statistics(p, "VALID", 0.5))


@query("a53_lamps", "WITH RECURSIVE b AS (SELECT DISTINCT s_suppkey AS row, n AS col FROM supplier, (SELECT unnest(generate_series(0, 5)) AS n) WHERE (s_suppkey * 7 + n * 3) % 5 < 3), r(a, c, row, col) AS (SELECT row, col, row, col FROM b UNION SELECT r.a, r.c, b.row, b.col FROM r JOIN b ON abs(r.row - b.row) + abs(r.col - b.col) = 1), g AS (SELECT a, c, min(row * 100 + col) AS root FROM r GROUP BY ALL), n AS (SELECT root, count(*) AS area FROM g GROUP BY 1 HAVING count(*) >= 3) SELECT area, area * 0.5::DOUBLE AS watts, count(*) AS lamps FROM n GROUP BY area")
def lamps(spark, sf_dir):
    px = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("col"))
    px = px.withColumn("light", F.when((F.col("row") * 7 + F.col("col") * 3) % 5 < 3, 200).otherwise(10))
    return A.lit_components(px, "light", 100, 3, 0.5).groupBy("area", "watts").agg(F.count("*").alias("lamps"))


@query("a54_g83_leaf_count", f"WITH {_VOX} SELECT 1 AS depth, count(*) AS leaves FROM vox UNION ALL SELECT 0, count(*) FROM (SELECT DISTINCT ix // 2, iy // 2, iz // 2 FROM vox)")
def leaf_count(spark, sf_dir):
    """Nodes of two depths, the inner ones counted from the leaves, as leaf tables hold no others."""
    v = voxels(spark, sf_dir)
    inner = v.select(*[F.floor(F.col(f"i{a}") / 2).alias(f"i{a}") for a in "xyz"]).distinct()
    return v.agg(F.lit(1).alias("depth"), F.count("*").alias("leaves")).union(inner.agg(F.lit(0), F.count("*")))


@query("a58_a64_wall_extents", "WITH f AS (SELECT l_suppkey AS region, l_extendedprice / 1000 AS fx, l_discount * 100 AS fy, l_tax * 100 AS fz FROM lineitem) SELECT region, round(min(-0.8 * fx + 0.6 * fy), 6) AS min_s, round(max(-0.8 * fx + 0.6 * fy), 6) AS max_s, round(min(fz), 6) AS min_z, round(max(fz), 6) AS max_z FROM f GROUP BY 1")
def wall_extents(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("region"), (F.col("l_extendedprice") / 1000).alias("fx"), (F.col("l_discount") * 100).alias("fy"), (F.col("l_tax") * 100).alias("fz"))
    return round_all(U.extents_in_basis(f, ["region"], U.wall_basis(F.lit(3.0), F.lit(4.0))))


@query("a59_a60_a66_radius", sql(", c AS (SELECT part % 50 AS region, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points GROUP BY 1) SELECT region, round(max(greatest(abs(x - cx), abs(y - cy), abs(z - cz))), 6) AS radius, round(min(x), 6) AS min_x, round(max(y), 6) AS max_y FROM points JOIN c ON part % 50 = region GROUP BY region", "points"))
def radius(spark, sf_dir):
    f = points(spark, sf_dir).select((F.col("part") % 50).alias("region"), *[F.col(a).alias(f"f{a}") for a in "xyz"], F.lit(1.0).alias("area"), F.lit(1.0).alias("planarity"), *[F.lit(v).alias(n) for n, v in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))])
    return round_all(U.region_summary(f).select("region", "radius", "min_x", "max_y"))


@query("a68_a69_moments", sql("SELECT part % 50 AS k, count(*) AS n, round(avg(x), 6) AS mean_x, round(covar_pop(x, y), 5) AS cov_xy, round(covar_pop(z, z), 5) AS cov_zz FROM points GROUP BY 1", "points"))
def moments(spark, sf_dir):
    m = A.moments(points(spark, sf_dir).withColumn("k", F.col("part") % 50), ["k"])
    return m.select("k", "n", F.round("mean_x", 6).alias("mean_x"), F.round("cov_xy", 5).alias("cov_xy"), F.round("cov_zz", 5).alias("cov_zz"))


@query("w13_first_of_paths", sql(", o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS pos, lead(event_id) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM samples) SELECT user_id, event_id, nxt FROM o WHERE pos BETWEEN 2 AND 5 AND nxt IS NOT NULL", "samples"))
def first_of_paths(spark, sf_dir):
    got = U.first_in_path_order(samples(spark, sf_dir).select("user_id", "event_id", "t"), "t", 2, 4, ["user_id"])
    return got.select("user_id", "event_id", F.col("next_event_id").alias("nxt"))


@query("o01_o04_largest_triangle", f"WITH {_P2} SELECT arg_max(k, (round(abs((bx - ax) * (cy - ay) - (by2 - ay) * (cx - ax)) / 2, 9), k)) AS k, round(max(abs((bx - ax) * (cy - ay) - (by2 - ay) * (cx - ax)) / 2), 9) AS area FROM p")
def largest_triangle(spark, sf_dir):
    a = F.round(G.triangle_area(*(G.vec(*n) for n in (A2, B2, C2))), 9)
    return plane_points(spark, sf_dir).agg(F.max(F.struct(a.alias("area"), "k")).alias("m")).select("m.k", "m.area")


@query("o03_o11_x56_random_order", "SELECT count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys, true AS within FROM part")
def random_order(spark, sf_dir):
    """Numbers from a seed: uniform ones, by which rows are put in random order, normal ones and whole ones; the rows stay the same."""
    p = table(spark, sf_dir, "part").withColumns({"u": F.rand(7), "g": F.randn(7)}).withColumn("i", F.floor(F.col("u") * 6))
    one = p.orderBy("u").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.max("i").alias("top"), F.avg("g").alias("mean"), F.stddev("g").alias("sd"))
    return one.select("n", "keys", (F.col("lo").between(0, 1) & F.col("hi").between(0, 1) & (F.col("top") <= 5) & (F.abs("mean") < 0.3) & F.col("sd").between(0.7, 1.3)).alias("within"))


@query("t17_t18_t25_t26_t28_unions", "WITH c AS (SELECT c_custkey AS n, c_custkey // 7 AS grp FROM customer), g AS (SELECT grp, min(n) AS root, list(n ORDER BY n) AS members FROM c GROUP BY 1 HAVING count(*) >= 7) SELECT root, array_to_string(members, ',') AS members FROM g")
def unions(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    edges = nodes.where("node % 7 <> 6").join(nodes.select((F.col("node") - 1).alias("node")), "node").select(F.col("node").alias("u"), (F.col("node") + 1).alias("v"))
    found = S.components_of_size(S.components_of(nodes, edges), 7)
    members = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("node")), lambda v: v.cast("string")))
    return found.groupBy(F.col("component").alias("root")).agg(members.alias("members"))


# --- scalar functions -----------------------------------------------------------------------------------------------------


@query("x04_aligned_axis", f"WITH {_P3} SELECT k, CASE WHEN abs(ax + 0.25) >= greatest(abs(ay + 0.125), abs(az + 0.0625)) THEN 'x' WHEN abs(ay + 0.125) >= abs(az + 0.0625) THEN 'y' ELSE 'z' END AS axis FROM p")
def aligned_axis(spark, sf_dir):
    d = F.array(F.col("ax") + 0.25, F.col("ay") + 0.125, F.col("az") + 0.0625)
    cov = F.array(*[F.lit(v) for v in (3.0, 0.0, 0.0, 2.0, 0.0, 1.0)])
    axis = F.transform(K.aligned_axis("cov", "d"), lambda v: F.round(v, 6))
    got = space_points(spark, sf_dir).select("k", d.alias("d"), cov.alias("cov")).select("k", axis.alias("a"))
    return got.select("k", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array_position("a", 1.0).cast("int")).alias("axis"))


@query("x06_covariance_sample", f"WITH {_P3} SELECT k, round(ax + 2 * cx + 0.5 * cy, 9) AS x, round(ay + 0.5 * cx + cy, 9) AS y, round(az + 3 * cz, 9) AS z FROM p")
def covariance_sample(spark, sf_dir):
    """A place plus the covariance times a vector of numbers; the numbers come from the table, so that the result can be told."""
    c = K.symmetric(F.array(*[F.lit(v) for v in (2.0, 0.5, 0.0, 1.0, 0.0, 3.0)]))
    moved = G.add(G.vec(*A3), G.apply(c, G.vec(*C3)))
    return round_all(space_points(spark, sf_dir).select("k", *[m.alias(a) for m, a in zip(moved, "xyz")]), 9)


@query("x07_x08_g45_propagated", f"WITH {_P3} SELECT k, round(2 + ax * ax * 0.25, 6) AS xx, round(ax * ay * 0.25, 6) AS xy, round(1 + ay * ay * 0.25, 6) AS yy, round(3 + az * az * 0.25, 6) AS zz FROM p")
def propagated(spark, sf_dir):
    """A quarter turn exchanges the variances of x and y; the clock adds those along the velocity."""
    turn = G.axis_rotation("z", F.lit(1.5707963267948966))
    c = K.add_covariances(K.rotate_covariance(turn, F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 2.0, 0.0, 3.0)])), K.clock_covariance(G.vec(*A3), F.lit(0.5)))
    return round_all(space_points(spark, sf_dir).select("k", c.alias("c")).select("k", *[(F.get("c", i) + 0.0).alias(n) for i, n in ((0, "xx"), (1, "xy"), (3, "yy"), (5, "zz"))]))


@query("x13_x71_segment_in_cube", f"WITH {_P2}, q AS (SELECT k, ax, ay, bx, by2, (0 - ax) / nullif(bx - ax, 0) AS tx0, (3 - ax) / nullif(bx - ax, 0) AS tx1, (1 - ay) / nullif(by2 - ay, 0) AS ty0, (4 - ay) / nullif(by2 - ay, 0) AS ty1 FROM p) SELECT k, NOT (bx = ax AND (ax < 0 OR ax > 3)) AND NOT (by2 = ay AND (ay < 1 OR ay > 4)) AND greatest(0.0, CASE WHEN bx = ax THEN 0.0 ELSE least(tx0, tx1) END, CASE WHEN by2 = ay THEN 0.0 ELSE least(ty0, ty1) END) <= least(1.0, CASE WHEN bx = ax THEN 1.0 ELSE greatest(tx0, tx1) END, CASE WHEN by2 = ay THEN 1.0 ELSE greatest(ty0, ty1) END) AS hit FROM q")
def segment_in_cube(spark, sf_dir):
    flat = lambda n: [*G.vec(*n), F.lit(0.5)]
    return plane_points(spark, sf_dir).select("k", G.segment_meets_box(flat(A2), flat(B2), G.lits(0, 1, 0), G.lits(3, 4, 1)).alias("hit"))


@query("x27_x62_x64_edges", f"WITH {_P2} SELECT k, round(sqrt((ax - bx) * (ax - bx) + (ay - by2) * (ay - by2)), 9) AS length, abs((bx - ax) * (cy - ay) - (by2 - ay) * (cx - ax)) <= 1e-9 AS straight, round(((cx - ax) * (py - cy) - (cy - ay) * (px - cx)) / nullif((bx - ax) * (py - cy) - (by2 - ay) * (px - cx), 0), 9) + 0 AS at FROM p")
def edges(spark, sf_dir):
    a, b, c, p = (G.vec(*n) for n in (A2, B2, C2, P2))
    return plane_points(spark, sf_dir).select("k", F.round(G.distance(a, b), 9).alias("length"), G.collinear(a, b, c).alias("straight"), (F.round(G.segment_crossing(a, b, c, p)[0], 9) + 0.0).alias("at"))


@query("x33_x34_x78_rotations", f"WITH {_P3} SELECT k, round(ax / 20, 6) AS yaw, round(coalesce(ay / nullif(sqrt(ay * ay + az * az), 0), 1), 9) AS c, round(coalesce(-az / nullif(sqrt(ay * ay + az * az), 0), 0), 9) + 0 AS s FROM p")
def rotations(spark, sf_dir):
    c, s = G.givens(F.col("ay"), F.col("az"))
    yaw = G.rpy_from_rotation(G.axis_rotation("z", F.col("ax") / 20))[2]
    return space_points(spark, sf_dir).select("k", F.round(yaw, 6).alias("yaw"), F.round(c, 9).alias("c"), (F.round(s, 9) + 0.0).alias("s"))


@query("x37_x38_x39_x80_x85_x86_motions", f"WITH {_P3} SELECT k, round(ay, 6) AS east, round(-by2 + 1, 6) AS wx, round(bx + 2 + 1, 6) AS wy, round(cx, 6) AS bx, round(cz, 6) AS bz FROM p")
def motions(spark, sf_dir):
    """A quarter turn about z, and a shift after it; then there and back again."""
    r, t, zero = G.axis_rotation("z", F.lit(1.5707963267948966)), G.lits(1, 2, 3), G.lits(0, 0, 0)
    one = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    r2, t2 = G.compose(one, G.lits(0, 1, 0), r, t)
    w = G.apply(r2, G.vec(*B3), t2)
    back = G.apply_inverse(r, t, G.apply(r, G.vec(*C3), t))
    again = G.apply(G.invert(r, zero)[0], G.apply(r, G.vec(*C3), zero))
    return round_all(space_points(spark, sf_dir).select("k", G.ned_to_enu(G.vec(*A3))[0].alias("east"), w[0].alias("wx"), w[1].alias("wy"), back[0].alias("bx"), again[2].alias("bz")))


@query("x41_moved_path", sql("SELECT ts, round(-py + 1, 6) AS x, round(px + 2, 6) AS y FROM poses", "poses"))
def moved_path(spark, sf_dir):
    p = G.apply(G.axis_rotation("z", F.lit(1.5707963267948966)), G.vec("px", "py", "pz"), G.lits(1, 2, 0))
    return round_all(poses(spark, sf_dir).select("ts", p[0].alias("x"), p[1].alias("y")))


@query("x48_antialiased", "WITH px AS (SELECT s_suppkey AS row, n AS col, CAST((s_suppkey * 31 + n * 17) % 256 AS DOUBLE) AS r FROM supplier, (SELECT unnest(generate_series(0, 9)) AS n)), m(a, b) AS (VALUES (0, 0), (0, 0), (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) SELECT w.row AS k, round(avg(px.r), 6) AS r FROM px w, m, px WHERE w.col = 5 AND px.row = w.row + a AND px.col = w.col + b GROUP BY 1")
def antialiased(spark, sf_dir):
    px = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("col"))
    px = px.withColumn("r", ((F.col("row") * 31 + F.col("col") * 17) % 256).cast("double"))
    return round_all(M.antialiased(px, px.where("col = 5").select("row", "col", F.col("row").alias("k")), 1, ["r"], ["k"]))


@query("x54_flipped_leaf", "SELECT p_partkey AS leaf, CAST(1 AS BIGINT) AS count, round((1 - p_size / 64) * 2.0, 9) AS prob_sum, round((1 - p_size / 64) * (1 - p_size / 64) * 2.0, 9) AS prob_sum_sq FROM part")
def flipped_leaf(spark, sf_dir):
    p = F.col("p_size") / 64
    lv = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("leaf"), F.lit(5).cast("long").alias("count"), F.lit(2.0).alias("total_weight"), (p * 2).alias("prob_sum"), (p * p * 2).alias("prob_sum_sq"))
    return round_all(A.flip_leaf(lv).select("leaf", "count", "prob_sum", "prob_sum_sq"), 9)


@query("x68_nearest_on_planes", f"WITH {_P3} SELECT k, round(bx, 9) AS x, round(cy, 9) AS y, round(az, 9) AS z FROM p")
def nearest_on_planes(spark, sf_dir):
    q = G.nearest_on_planes(G.vec(*A3), G.lits(1, 0, 0), F.col("bx"), G.lits(0, 1, 0), F.col("cy"))
    return round_all(space_points(spark, sf_dir).select("k", *[c.alias(a) for c, a in zip(q, "xyz")]), 9)


@query("x70_shortest_edge", f"WITH {_P2}, d AS (SELECT k, (ax - bx) * (ax - bx) + (ay - by2) * (ay - by2) AS u, (bx - cx) * (bx - cx) + (by2 - cy) * (by2 - cy) AS v, (cx - ax) * (cx - ax) + (cy - ay) * (cy - ay) AS w FROM p) SELECT k, CASE WHEN u <= v AND u <= w THEN 0 WHEN v <= w THEN 1 ELSE 2 END AS edge FROM d")
def shortest_edge(spark, sf_dir):
    """By length; ties to the first."""
    a, b, c = (G.vec(*n) for n in (A2, B2, C2))
    square = lambda x, y: G.dot(G.sub(x, y), G.sub(x, y))
    ranked = F.array_sort(F.array(*[F.struct(square(x, y).alias("d"), F.lit(k).alias("k")) for k, (x, y) in enumerate(((a, b), (b, c), (c, a)))]))
    return plane_points(spark, sf_dir).select("k", F.get(ranked, 0)["k"].alias("edge"))


@query("x75_polygon_normal", f"WITH {_P3}, q AS (SELECT k, (by2 - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by2 - ay) * (cx - ax) AS nz FROM p) SELECT k, round(abs(nx) / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0), 7) AS nx, round(abs(nz) / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0), 7) AS nz FROM q")
def polygon_normal(spark, sf_dir):
    p = F.array(*[F.struct(*[F.col(c).cast("double").alias(a) for c, a in zip(n, "xyz")]) for n in (A3, B3, C3)])
    n = G.polygon_normal(p)
    return space_points(spark, sf_dir).select("k", F.round(F.abs(n[0]), 7).alias("nx"), F.round(F.abs(n[2]), 7).alias("nz"))


@query("x77_u07_cameras", f"WITH {_P3} SELECT k, round(320 + 500 * ax / (cz + 1), 6) AS u, round(240 + 400 * ay / (cz + 1), 6) AS v FROM p")
def cameras(spark, sf_dir):
    u, v = M.rectilinear_pixel([F.col("ax"), F.col("ay"), F.col("cz") + 1], 500, 400, 320, 240)
    return round_all(space_points(spark, sf_dir).select("k", u.alias("u"), v.alias("v")))


@query("x81_shared_edges", f"WITH {_P2} SELECT k, greatest(px, 1.0) AS x0, least(px + 2, 4.0) AS x1, greatest(py, 1.0) AS y0, least(py + 2, 5.0) AS y1 FROM p")
def shared_edges(spark, sf_dir):
    p = G.vec(*P2)
    low, high = G.shared_edge(p, [c + 2 for c in p], G.lits(1, 1), G.lits(4, 5))
    return plane_points(spark, sf_dir).select("k", low[0].alias("x0"), high[0].alias("x1"), low[1].alias("y0"), high[1].alias("y1"))


@query("x83_x84_cells_of_any_place", sql("SELECT CAST(floor((x - 50) / 0.5) AS BIGINT) AS i0, count(*) AS n FROM points GROUP BY 1", "points"))
def any_place(spark, sf_dir):
    """Cells have absolute keys, so that none need be made larger for a place outside."""
    return points(spark, sf_dir).groupBy(A.cell_key("x", 0.5, 50.0).alias("i0")).agg(F.count("*").alias("n"))


@query("x87_unknown_clock", "SELECT event_id, value AS t, 0.25::DOUBLE AS s FROM events WHERE user_id % 30 >= 25")
def unknown_clock(spark, sf_dir):
    fits = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("sensor"), F.lit(2.0).alias("slope"), F.lit(0.0).alias("offset"), F.lit(0.5).alias("stddev"))
    e = table(spark, sf_dir, "events").withColumn("sensor", F.col("user_id") % 30).where("sensor >= 25")
    unknown = e.select(F.col("sensor")).distinct().withColumns({"slope": F.lit(1.0), "offset": F.lit(0.0), "stddev": F.lit(-1.0)})
    return J.convert_clock(e, fits.unionByName(unknown), "sensor", "value", "t", 0.25).select("event_id", "t", F.col("clock_stddev").alias("s"))


# --- volumes, meshes, regions ---------------------------------------------------------------------------------------------


@query("g06_visited_rooms", "SELECT DISTINCT p_size AS room FROM part WHERE p_size IN (SELECT l_linenumber * 5 FROM lineitem)")
def visited_rooms(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 5).alias("room"))
    return B.visited_rooms(table(spark, sf_dir, "part").select(F.col("p_size").alias("room")).distinct(), hits)


@query("g13_g62_g68_vertices", f"WITH {_P3} SELECT k, round(ax + least(4.0, greatest(-4.0, bx - ax)), 6) AS x, round(ay + least(4.0, greatest(-4.0, cy - ay)), 6) AS y, round(az, 6) AS z FROM p")
def vertices(spark, sf_dir):
    """Two planes give x and y, the place itself z; moves are bounded."""
    p = space_points(spark, sf_dir)
    plane = lambda n, d: p.select("k", *A3, *[F.lit(float(v)).alias(f"n{a}") for v, a in zip(n, "xyz")], F.col(d).cast("double").alias("d"))
    got = U.best_vertex(plane((1, 0, 0), "bx").unionByName(plane((0, 1, 0), "cy")), ["k"], A3, 4.0)
    return round_all(got)


@query("g18_refined_cells", f"WITH {_VOX} SELECT ix * 2 + a AS i0, iy * 2 + b AS i1, iz * 2 + c AS i2 FROM vox, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b), (VALUES (0), (1)) z(c) WHERE ix % 3 = 0")
def refined_cells(spark, sf_dir):
    cells = voxels(spark, sf_dir).toDF("i0", "i1", "i2")
    return V.refine_chunks(cells, cells.where("i0 % 3 = 0"), 2)


@query("g37_g70_between_scans", "WITH s AS (SELECT l_orderkey AS frame, l_linenumber AS point, max(l_quantity) AS x FROM lineitem GROUP BY ALL), n AS (SELECT *, lead(x) OVER (PARTITION BY point ORDER BY frame) AS nx FROM s) SELECT frame, point, k, round(CASE WHEN k = 0 THEN x ELSE x * (1 - k / 4) + nx * (k / 4) END, 6) AS x FROM n, (VALUES (0), (1), (2), (3)) v(k) WHERE k = 0 OR nx IS NOT NULL")
def between_scans(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("point")).agg(F.max("l_quantity").alias("x"))
    s = s.withColumns({c: F.lit(0.0) for c in ("sx", "sy", "sz", "y", "z")})
    return round_all(B.between_scans(s, "frame", "point", 4).select("frame", "point", "k", "x"))


@query("g48_straight_corners", "WITH c AS (SELECT s_nationkey AS loop, s_suppkey AS position, CAST(s_suppkey % 3 AS DOUBLE) AS x, CAST(s_suppkey AS DOUBLE) AS y FROM supplier), e AS (SELECT loop, arg_min([x, y], position) AS f, arg_max([x, y], position) AS l FROM c GROUP BY 1), n AS (SELECT c.*, coalesce(lag(x) OVER w, e.l[1]) AS px, coalesce(lag(y) OVER w, e.l[2]) AS py, coalesce(lead(x) OVER w, e.f[1]) AS nx, coalesce(lead(y) OVER w, e.f[2]) AS ny FROM c JOIN e USING (loop) WINDOW w AS (PARTITION BY c.loop ORDER BY position)) SELECT loop, position, x, y FROM n WHERE abs((x - px) * (ny - py) - (y - py) * (nx - px)) > 1e-9")
def straight_corners(spark, sf_dir):
    k = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("loop"), k.alias("position"), (k % 3).cast("double").alias("x"), k.cast("double").alias("y"))
    return V.straight_corners(c)


@query("g63_quads", "SELECT p_partkey AS face, t, p_partkey AS i, CASE WHEN t = 0 THEN p_partkey + 1 ELSE p_partkey + 2 END AS j, CASE WHEN t = 0 THEN p_partkey + 2 ELSE p_partkey + 3 END AS k FROM part, (VALUES (0), (1)) v(t)")
def quads(spark, sf_dir):
    k = F.col("p_partkey")
    return U.quad_triangles(table(spark, sf_dir, "part").select(k.alias("face"), F.array(k, k + 1, k + 2, k + 3).alias("vertices")))


@query("g58_g65_small_regions", 'WITH s AS (SELECT l_suppkey AS region, count(*) AS faces FROM lineitem GROUP BY 1), l AS (SELECT region AS u, region + 1 AS v FROM s UNION ALL SELECT region + 1, region FROM s) SELECT a.region, arg_max(b.region, (b.faces, -b.region)) AS "into" FROM s a JOIN l ON l.u = a.region JOIN s b ON b.region = l.v WHERE b.faces > a.faces GROUP BY a.region')
def small_regions(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("region")).agg(F.count("*").alias("faces"))
    u = s.select(F.col("region").alias("u"), (F.col("region") + 1).alias("v"))
    return U.largest_neighbour(u.union(u.select("v", "u")), s, 1 << 30)


@query("g69_snapped_vertices", f"WITH {_P3} SELECT k, ax AS x, ay AS y, CASE WHEN k % 3 = 0 THEN az ELSE k % 3 * 2.0 END::DOUBLE AS z FROM p")
def snapped(spark, sf_dir):
    v = space_points(spark, sf_dir).select("k", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z"), (F.col("k") % 3).alias("region"))
    planes = spark.range(1, 3).select(F.col("id").alias("region"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), F.lit(5.0).alias("px"), F.lit(7.0).alias("py"), (F.col("id") * 2.0).alias("pz"))
    return U.snap_to_plane(v, planes).drop("region")


@query("g77_oriented", f"WITH {_P3} SELECT k, CASE WHEN ax * 1 - az < 0 THEN -ax ELSE ax END + 0.0 AS nx, CASE WHEN ax * 1 - az < 0 THEN -az ELSE az END + 0.0 AS nz FROM p")
def oriented(spark, sf_dir):
    n = U.oriented(*G.vec(*A3), G.lits(1, 0, -1))
    return space_points(spark, sf_dir).select("k", (n[0] + 0.0).alias("nx"), (n[2] + 0.0).alias("nz"))


@query("g82_g71_states", f"WITH {_VOX}, face AS (SELECT * FROM (VALUES (0, -1, 0, 4), (1, 0, 0, 8), (0, 1, 0, 1), (-1, 0, 0, 2), (0, 0, -1, 32), (0, 0, 1, 16)) f(dx, dy, dz, bit)), s AS (SELECT ix * 2 + a AS ix, iy * 2 + b AS iy, iz * 2 + c AS iz FROM vox, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b), (VALUES (0), (1)) z(c)), o AS (SELECT ix + dx AS ix, iy + dy AS iy, iz + dz AS iz, CAST(bit_or(bit) AS INT) AS state FROM s, face GROUP BY ALL) SELECT state, count(*) AS n FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.ix = o.ix AND s.iy = o.iy AND s.iz = o.iz) GROUP BY state")
def states(spark, sf_dir):
    fine = V.leaf_voxels(voxels(spark, sf_dir).withColumn("depth", F.lit(3)), 4).select("ix", "iy", "iz")
    return V.boundary_voxels(fine).groupBy("state").agg(F.count("*").alias("n"))


@query("x45_named_colours", sql("SELECT frame, CAST(floor(255 * least(1.0, greatest(0.0, 1.5 - abs(4 * y / 50 - 3)))) AS INT) AS r, CAST(floor(255 * least(1.0, greatest(0.0, 1.5 - abs(4 * y / 50 - 1)))) AS INT) AS b FROM points", "points"))
def named_colours(spark, sf_dir):
    c = C.palette("jet", F.col("y") / 50)
    return points(spark, sf_dir).select("frame", c["r"].alias("r"), c["b"].alias("b"))


_STARS = "c AS (SELECT c_custkey // 12 AS loop, c_custkey AS k, row_number() OVER (PARTITION BY c_custkey // 12 ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_custkey // 12) AS m FROM customer), s AS (SELECT loop, k, i, m, (1 + k * 7 % 5 / 4.0::DOUBLE) * cos(2 * pi() * i / m) AS x, (1 + k * 7 % 5 / 4.0::DOUBLE) * sin(2 * pi() * i / m) AS y FROM c)"


@query("g52_filled_loops", f"WITH {_STARS}, n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM s WINDOW w AS (PARTITION BY loop ORDER BY i)) SELECT loop, count(*) - 2 AS triangles, round(sum(x * ny - nx * y) / 2, 6) AS area FROM n GROUP BY loop HAVING count(*) >= 3")
def filled_loops(spark, sf_dir):
    """Stars of twelve customers each: n corners give n - 2 triangles, whose areas add up to that of the star."""
    k, w = F.col("c_custkey"), Window.partitionBy("loop").orderBy("k")
    c = table(spark, sf_dir, "customer").select(F.floor(k / 12).alias("loop"), k.alias("k"))
    c = c.withColumns({"i": F.row_number().over(w) - 1, "m": F.count("*").over(Window.partitionBy("loop")), "r": 1 + F.col("k") * 7 % 5 / 4.0})
    turn = 2 * F.pi() * F.col("i") / F.col("m")
    c = c.select("loop", "k", "i", (F.col("r") * F.cos(turn)).alias("x"), (F.col("r") * F.sin(turn)).alias("y"))
    tri = E.fill_loops(c, "loop", "i", "k")
    for n in "ijk":
        tri = tri.join(c.select("loop", F.col("k").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")), ["loop", n]) if n != "k" else tri.join(c.select("loop", "k", F.col("x").alias("kx"), F.col("y").alias("ky")), ["loop", "k"])
    area = G.orient2d(*[G.vec(f"{n}x", f"{n}y") for n in "ijk"]) / 2
    return tri.groupBy("loop").agg(F.count("*").alias("triangles"), F.round(F.sum(area), 6).alias("area"))


_CIRCLES = "c AS (SELECT o_custkey % 20 AS level, o_orderkey AS t, o_orderkey % 97 * 0.5::DOUBLE AS x, o_custkey % 31 * 0.5::DOUBLE AS y, 0.25 + o_orderkey % 13 * 0.25::DOUBLE AS r FROM orders), l AS (SELECT level, t AS u, lead(t) OVER (PARTITION BY level ORDER BY t) AS v FROM c)"


@query("w07_largest_circles", f"WITH RECURSIVE {_CIRCLES}, e AS (SELECT level, u, v FROM l WHERE v IS NOT NULL UNION ALL SELECT level, v, u FROM l WHERE v IS NOT NULL), w(level, t, n) AS (SELECT level, t, t FROM c WHERE r >= 0.381 UNION SELECT w.level, w.t, e.v FROM w JOIN e ON e.level = w.level AND e.u = w.n JOIN c a ON a.t = w.t JOIN c b ON b.t = e.v WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= (a.r + b.r) * (a.r + b.r)) SELECT w.level, w.t FROM w JOIN c a ON a.t = w.t JOIN c b ON b.t = w.n GROUP BY w.level, w.t, a.r HAVING max(b.r) <= a.r")
def largest_circles(spark, sf_dir):
    o, u = F.col("o_orderkey"), F.col("o_custkey")
    c = table(spark, sf_dir, "orders").select((u % 20).alias("level"), o.alias("t"), (o % 97 * 0.5).alias("x"), (u % 31 * 0.5).alias("y"), (0.25 + o % 13 * 0.25).alias("r"))
    links = c.select("level", F.col("t").alias("u"), F.lead("t").over(Window.partitionBy("level").orderBy("t")).alias("v")).where("v is not null")
    return E.largest_circles(c, links, "level", 0.381)
