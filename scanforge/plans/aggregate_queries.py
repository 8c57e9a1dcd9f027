"""Queries of statistics, histograms, grids, rooms and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import shapes as G
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import sets as S
from .inputs import points, poses, samples, seconds, sql, table
from .registry import query, round_all

_SAMPLES = "s AS (SELECT l_partkey % 64 AS leaf, l_suppkey % 8 AS grp, l_quantity AS w, l_discount * 10 AS p, l_tax * 10 AS surface, l_tax * 5 AS corner, l_discount AS planar FROM lineitem)"
_STATE = "count(*) AS count, sum(w) AS total_weight, sum(w * p) AS prob_sum, sum(w * p * p) AS prob_sum_sq, sum(w * surface) AS surface_sum, sum(w * corner) AS corner_sum, sum(w * planar) AS planar_sum"


def leaf_samples(spark, sf_dir):
    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 64).alias("leaf"), (F.col("l_suppkey") % 8).alias("grp"), F.col("l_quantity").alias("w"), (d * 10).alias("p"), (F.col("l_tax") * 10).alias("surface"), (F.col("l_tax") * 5).alias("corner"), d.alias("planar"))


@query("a01_a06_leaf_statistics", f"WITH {_SAMPLES}, t AS (SELECT leaf, {_STATE} FROM s GROUP BY leaf) SELECT leaf, count, round(prob_sum / total_weight, 8) AS probability, round(CASE WHEN count <= 1 THEN 1.0 ELSE prob_sum_sq / total_weight - (prob_sum / total_weight) * (prob_sum / total_weight) END, 8) AS uncertainty, round(surface_sum / total_weight, 8) AS surface, round(corner_sum / total_weight, 8) AS corner, round(planar_sum / total_weight, 8) AS planar FROM t")
def leaf_statistics(spark, sf_dir):
    s = A.leaf_statistics(leaf_samples(spark, sf_dir), ["leaf"])
    return round_all(s.select("leaf", "count", A.probability().alias("probability"), A.uncertainty().alias("uncertainty"), *[A.mean_of(f"{c}_sum").alias(c) for c in ("surface", "corner", "planar")]), 8)


@query("a02_merge_leaves", f"WITH {_SAMPLES} SELECT grp, count(*) AS count, round(sum(w * p), 3) AS prob_sum, max(leaf) AS fp_room, bool_or(leaf = 7) AS carved FROM s GROUP BY grp")
def merge_leaves(spark, sf_dir):
    parts = A.leaf_statistics(leaf_samples(spark, sf_dir), ["grp", "leaf"]).withColumns({"fp_room": F.col("leaf"), "carved": F.col("leaf") == 7})
    return round_all(A.merge_leaves(parts, ["grp"]).select("grp", "count", "prob_sum", "fp_room", "carved"), 3)


@query("a03_subdivide_leaf", f"WITH {_SAMPLES}, t AS (SELECT leaf, {_STATE} FROM s GROUP BY leaf) SELECT leaf, greatest(1, count // 8)::BIGINT AS count, round(total_weight * (greatest(1, count // 8) / count), 5) AS total_weight FROM t")
def subdivide(spark, sf_dir):
    return round_all(A.subdivide_leaf(A.leaf_statistics(leaf_samples(spark, sf_dir), ["leaf"])).select("leaf", "count", "total_weight"), 5)


@query(
    "a08_simplify_leaves",
    """WITH l AS (SELECT p_partkey % 16 AS ix, (p_partkey // 16) % 16 AS iy, (p_partkey // 256) % 16 AS iz, min(p_size) > 25 AS label, count(*) AS n FROM part GROUP BY ALL),
    g AS (SELECT ix // 2 AS ix, iy // 2 AS iy, iz // 2 AS iz, min(label) AS label, sum(n)::BIGINT AS n FROM l GROUP BY ALL HAVING count(*) = 8 AND min(label) = max(label)),
    h AS (SELECT ix // 2 AS ix, iy // 2 AS iy, iz // 2 AS iz, min(label) AS label, sum(n)::BIGINT AS n FROM g GROUP BY ALL HAVING count(*) = 8 AND min(label) = max(label)),
    a AS (SELECT 4 AS depth, * FROM l WHERE (ix // 2, iy // 2, iz // 2) NOT IN (SELECT (ix, iy, iz) FROM g) UNION ALL SELECT 3, * FROM g WHERE (ix // 2, iy // 2, iz // 2) NOT IN (SELECT (ix, iy, iz) FROM h) UNION ALL SELECT 2, * FROM h)
    SELECT depth, label, count(*) AS leaves, sum(n)::BIGINT AS n FROM a GROUP BY ALL""",
)
def simplify(spark, sf_dir):
    k = F.col("p_partkey")
    leaves = table(spark, sf_dir, "part").groupBy((k % 16).alias("ix"), (F.floor(k / 16) % 16).alias("iy"), (F.floor(k / 256) % 16).alias("iz")).agg((F.min("p_size") > 25).alias("label"), F.count("*").alias("count"))
    leaves = leaves.withColumns({"depth": F.lit(4), **{c: F.lit(0.0) for c in A.LEAF_SUMS}})
    return A.simplify_leaves(leaves, ["label"], top=2).groupBy("depth", "label").agg(F.count("*").alias("leaves"), F.sum("count").alias("n"))


_CELL = "CAST(floor(x / 5) AS BIGINT) AS i0, CAST(floor(y / 5) AS BIGINT) AS i1"


@query("a09_a15_wall_cells", sql(f", c AS (SELECT {_CELL}, sum(r + 1) AS weight, sum((r + 1) * x) / sum(r + 1) AS mean_x, sum((r + 1) * (x - 50)) / sum(r + 1) AS nx, sum((r + 1) * (y - 25)) / sum(r + 1) AS ny, min(CASE WHEN z <= 9 THEN z END) AS z_min, max(CASE WHEN z <= 9 THEN 9.0 END) AS z_max FROM points GROUP BY ALL) SELECT i0, i1, CAST(weight AS BIGINT) AS weight, round(mean_x, 6) AS mean_x, round(nx / sqrt(nx * nx + ny * ny), 6) AS nx, round(ny / sqrt(nx * nx + ny * ny), 6) AS ny, z_min, z_max FROM c", "points"))
def wall_cells(spark, sf_dir):
    df = points(spark, sf_dir).withColumns({"nx": F.col("x") - 50, "ny": F.col("y") - 25, "z_min": F.col("z"), "z_max": F.lit(9.0)})
    cells = A.unit_normal(A.wall_cells(df, 5.0, F.col("r") + 1))
    return round_all(cells.select("i0", "i1", "weight", "mean_x", F.col("mean_nx").alias("nx"), F.col("mean_ny").alias("ny"), "z_min", "z_max"))


@query("a11_centred_grid", sql("SELECT CAST(floor((x - 1) / 4 + 0.5) AS BIGINT) AS i0, count(*) AS n FROM points GROUP BY 1", "points"))
def centred_grid(spark, sf_dir):
    return points(spark, sf_dir).groupBy(A.centred_key("x", 4.0, 1.0).alias("i0")).agg(F.count("*").alias("n"))


@query("a17_f34_occupancy", sql(f", c AS (SELECT {_CELL}, count(*) AS num_pts, avg(x) AS mean_x, count(DISTINCT b) AS poses, count(DISTINCT CAST(trunc(z / 0.1) AS BIGINT)) AS height_bins FROM points GROUP BY ALL) SELECT i0, i1, num_pts, round(mean_x, 4) AS mean_x, CAST(poses AS INT) AS poses, height_bins FROM c WHERE num_pts >= 50 AND height_bins >= 0.8 / 0.1", "points"))
def occupancy(spark, sf_dir):
    cells = A.with_poses(A.occupancy_cells(points(spark, sf_dir), 5.0, pose="b"))
    return round_all(A.wall_coverage(cells, 50, 0.8).select("i0", "i1", "num_pts", "mean_x", F.size("poses").alias("poses"), "height_bins"), 4)


_HIST = "h AS (SELECT CAST(trunc((value - 40) / 2.5) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY 1)"


def _histogram(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "events").withColumn("v", F.col("value") - 40), "v", 2.5)


@query("a18_histogram", f"WITH {_HIST} SELECT bin, weight, (bin + 0.5) * 2.5 AS centre FROM h")
def histogram(spark, sf_dir):
    return _histogram(spark, sf_dir).withColumn("centre", A.bin_centre(2.5))


@query("a19_merge_histograms", f"WITH {_HIST}, g AS (SELECT CAST(trunc(value / 1.7) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY 1) SELECT bin, sum(weight) AS weight FROM (SELECT bin, weight FROM h UNION ALL SELECT CAST(trunc((bin + 0.5) * 1.7 / 2.5) AS BIGINT), weight FROM g) GROUP BY bin")
def merge_histograms(spark, sf_dir):
    return A.merge_histograms(_histogram(spark, sf_dir), 2.5, A.histogram(table(spark, sf_dir, "events"), "value", 1.7), 1.7)


@query("a20_mode", f"WITH {_HIST} SELECT (bin + 0.5) * 2.5 AS mode, weight FROM h WHERE weight > 0 ORDER BY weight DESC, bin LIMIT 1")
def mode(spark, sf_dir):
    return A.mode(_histogram(spark, sf_dir), 2.5)


@query("a21_peaks", f"WITH {_HIST} SELECT bin, weight FROM (SELECT *, max(weight) OVER (ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM h) WHERE weight >= m")
def peaks(spark, sf_dir):
    return A.peaks(_histogram(spark, sf_dir), 2.5, 5.0)


@query("a22_level_peaks", f"WITH {_HIST}, g AS (SELECT avg(weight) + sqrt(greatest(0, (sum(weight * weight) - sum(weight)) / count(*))) AS gate FROM h) SELECT bin, weight FROM (SELECT *, max(weight) OVER (ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM h), g WHERE weight >= m AND weight >= gate")
def level_peaks(spark, sf_dir):
    return A.level_peaks(_histogram(spark, sf_dir), 2.5, 5.0)


@query("a23_floor_ceiling", sql("SELECT z > pz AS ceiling, CAST(trunc(z / 0.5) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM points q ASOF JOIN poses p ON q.timestamp >= p.ts GROUP BY ALL", "points", "poses"))
def floor_ceiling(spark, sf_dir):
    j = J.as_of(points(spark, sf_dir), poses(spark, sf_dir), "timestamp", "ts", 30 * 86400.0).where("ts is not null").withColumn("ceiling", F.col("z") > F.col("pz"))
    return A.histogram(j, "z", 0.5, by=["ceiling"])


@query("a26_a29_open_heights", "WITH l AS (SELECT CAST(floor(l_extendedprice / 4000) AS BIGINT) AS ix, CAST(floor(l_quantity / 4) AS BIGINT) AS iy, CAST(floor(l_discount * 100 / 2) AS BIGINT) AS iz, avg(l_tax * 10) AS p FROM lineitem GROUP BY ALL) SELECT ix AS i0, iy AS i1, count(*) * 1.0::DOUBLE AS open_height, CAST(min(iz) AS DOUBLE) AS min_z, max(iz) + 1.0::DOUBLE AS max_z FROM l WHERE p > 0.3512 GROUP BY ALL")
def open_heights(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    leaves = df.groupBy(F.floor(F.col("l_extendedprice") / 4000).alias("ix"), F.floor(F.col("l_quantity") / 4).alias("iy"), F.floor(F.col("l_discount") * 100 / 2).alias("iz")).agg(F.avg(F.col("l_tax") * 10).alias("p"))
    leaves = leaves.select(*[(F.col(f"i{a}") + 0.5).alias(f"c{a}") for a in "xyz"], F.lit(0.5).alias("hw"), F.lit(1).alias("count"), F.lit(1.0).alias("total_weight"), (F.col("p") + 0.1488).alias("prob_sum"))
    return A.open_heights(leaves, 1.0)


@query("a31_o06_image_ranking", sql(", c AS (SELECT CAST(floor(x / 10) AS BIGINT) AS i0, index AS img, max(y) AS score FROM points GROUP BY ALL) SELECT i0, array_to_string(list(img ORDER BY score DESC, img DESC), ',') AS images, first(img ORDER BY score DESC, img DESC) AS best FROM c GROUP BY i0", "points"))
def image_ranking(spark, sf_dir):
    c = points(spark, sf_dir).groupBy(A.cell_key("x", 10.0).alias("i0"), F.col("index").alias("img")).agg(F.max("y").alias("score"))
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("score", "img")), False), lambda s: s.img)
    return c.groupBy("i0").agg(F.concat_ws(",", F.transform(ranked, lambda v: v.cast("string"))).alias("images"), F.get(ranked, 0).alias("best"))


@query("a32_a38_rooms", "SELECT coalesce(p_brand, 'total') AS room, round(sum(4 * sqrt(p_size)), 5) AS perimeter, CAST(sum(p_size) AS BIGINT) AS area, round(sum(p_size * p_retailprice / 1000), 5) AS volume FROM part GROUP BY ROLLUP (p_brand)")
def rooms(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_brand").alias("room"), (4 * F.sqrt("p_size")).alias("perimeter"), F.col("p_size").alias("area"), (F.col("p_retailprice") / 1000).alias("height"))
    return round_all(A.room_table(df, "room", "perimeter", "area", "height").withColumn("room", F.coalesce("room", F.lit("total"))), 5)


@query("a35_weighted_floor", "SELECT p_brand AS room, round(sum(p_retailprice * p_size) / sum(p_size), 5) AS z FROM part GROUP BY 1")
def weighted_floor(spark, sf_dir):
    return round_all(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("room")).agg(A.weighted_mean("p_retailprice", "p_size").alias("z")), 5)


_MEDIAN = "SELECT p_brand AS room, list_sort(list(p_retailprice))[count(*) // 2 + 1] AS {} FROM part GROUP BY 1"


@query("a39_upper_median", _MEDIAN.format("z"))
def upper_median(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("room")).agg(A.upper_median("p_retailprice").alias("z"))


@query("a40_ranked_upper_median", _MEDIAN.format("upper_median"))
def ranked_upper_median(spark, sf_dir):
    return A.ranked_upper_median(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "room"), ["room"], "p_retailprice")


@query("a41_border_lengths", "SELECT least(l_partkey % 20, l_suppkey % 20) AS room_a, greatest(l_partkey % 20, l_suppkey % 20) AS room_b, round(sum(l_quantity), 3) AS length FROM lineitem WHERE l_partkey % 20 <> l_suppkey % 20 GROUP BY ALL")
def border_lengths(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).alias("a"), (F.col("l_suppkey") % 20).alias("b"), "l_quantity")
    return round_all(A.border_lengths(e, "a", "b", "l_quantity"), 3)


@query("a44_region_strength", "WITH r AS (SELECT l_suppkey AS region, sum(l_quantity) AS area, min(1 - l_tax) AS planarity, avg(l_discount) * 8 - 0.2 AS nz FROM lineitem GROUP BY 1) SELECT region, round(CASE WHEN area < 100 OR abs(nz) > 0.25 THEN 0.0 ELSE area * planarity * (1 - abs(nz)) END, 4) AS strength FROM r")
def region_strength(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("region")).agg(F.sum("l_quantity").alias("area"), F.min(1 - F.col("l_tax")).alias("planarity"), (F.avg("l_discount") * 8 - 0.2).alias("nz"))
    return round_all(r.select("region", A.region_strength(F.col("area"), F.col("planarity"), F.col("nz"), 100, 0.25).alias("strength")), 4)


@query("a45_a46_fit_planes")
def fit_planes(spark, sf_dir):
    return round_all(A.fit_planes(points(spark, sf_dir).withColumn("k", F.col("part") % 40), ["k"]), 6)


@query("a47_fit_lines", sql(", m AS (SELECT part % 40 AS k, count(*) AS n, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(y, y) AS c FROM points GROUP BY 1) SELECT k, n, round(atan2(2 * b, a - c) / 2, 5) AS angle, round((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), 4) AS error FROM m", "points"))
def fit_lines(spark, sf_dir):
    f = A.fit_lines(points(spark, sf_dir).withColumn("k", F.col("part") % 40), ["k"])
    return f.select("k", "n", F.round("angle", 5).alias("angle"), F.round("error", 4).alias("error"))


@query("a49_z_buffer", sql(", p AS (SELECT CAST(floor(x / 5) AS BIGINT) AS px, CAST(floor(y / 5) AS BIGINT) AS py, r, g, b, timestamp, z, row_number() OVER (PARTITION BY floor(x / 5), floor(y / 5) ORDER BY z DESC, timestamp DESC, index DESC, x DESC, y DESC, part DESC) AS k FROM points) SELECT px, py, r, g, b, timestamp, z FROM p WHERE k = 1", "points"))
def z_buffer(spark, sf_dir):
    return A.z_buffer(points(spark, sf_dir), 5.0, ["timestamp", "index", "x", "y", "part"])


@query("a52_keep_rate", "SELECT user_id, round(count(*) / ((max(epoch(ts)) - min(epoch(ts))) * 1000 * 40.0 / 1000), 10) AS keep_rate FROM events GROUP BY 1")
def keep_rate(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("ms", seconds("ts") * 1000)
    return round_all(A.keep_rate(df, "ms", ["user_id"]), 10)


@query("o02_morton", "SELECT p_partkey, (" + " + ".join(f"((p_size >> {b} & 1) << {3 * b}) + ((p_partkey % 64 >> {b} & 1) << {3 * b + 1}) + ((p_partkey // 64 % 64 >> {b} & 1) << {3 * b + 2})" for b in range(6)) + ")::BIGINT AS z FROM part")
def morton(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", G.morton(F.col("p_size"), k % 64, F.floor(k / 64) % 64, 6).alias("z"))


_ARRAYS = "WITH u AS (SELECT user_id, list_sort(list_distinct(list(event_id % 7) FILTER (event_type IN ('click', 'view')))) AS a, list_sort(list_distinct(list(event_id % 7) FILTER (event_type = 'view'))) AS b FROM events GROUP BY 1)"


@query("t01_t03_array_sets", f"{_ARRAYS} SELECT user_id, array_to_string(list_sort(list_intersect(coalesce(a, []), coalesce(b, []))), ',') AS both, len(list_distinct(list_concat(a, b))) AS total FROM u")
def array_sets(spark, sf_dir):
    m = F.col("event_id") % 7
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type").isin("click", "view"), m)).alias("a"), F.collect_set(F.when(F.col("event_type") == "view", m)).alias("b"))
    both = F.transform(F.array_sort(F.array_intersect("a", "b")), lambda v: v.cast("string"))
    return u.select("user_id", F.concat_ws(",", both).alias("both"), F.size(F.array_union("a", "b")).cast("long").alias("total"))


@query("t04_coalesce_intervals", sql(", r AS (SELECT user_id, t AS t0, t + value * 600 AS t1 FROM samples), k AS (SELECT *, sum(CASE WHEN t0 <= m THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t0, t1) AS i FROM (SELECT *, max(t1) OVER (PARTITION BY user_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r)) SELECT user_id, min(t0) AS t0, round(max(t1), 6) AS t1 FROM k GROUP BY user_id, i", "samples"))
def coalesce_intervals(spark, sf_dir):
    r = samples(spark, sf_dir).withColumn("end", F.col("t") + F.col("value") * 600)
    return round_all(S.coalesce_intervals(r, "end", "t", ["user_id"]))


@query("t05_integer_intervals", "WITH d AS (SELECT DISTINCT user_id AS u, CAST(trunc(value) AS BIGINT) AS v FROM events), k AS (SELECT *, v - row_number() OVER (PARTITION BY u ORDER BY v) AS i FROM d) SELECT u, min(v) - 0.51::DOUBLE AS t0, max(v) + 0.51::DOUBLE AS t1 FROM k GROUP BY u, i")
def integer_intervals(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.col("value").cast("long").alias("v")).distinct()
    return S.integer_intervals(d, "v", ["u"])


@query("t06_t10_parse_ranges", "SELECT n_nationkey AS k, unnest(generate_series(n_nationkey, n_nationkey + 3)) AS n FROM nation UNION ALL SELECT n_nationkey, n_regionkey FROM nation UNION ALL SELECT n_nationkey, 1 FROM nation")
def parse_ranges(spark, sf_dir):
    text = F.concat(F.lit("["), F.col("n_nationkey") + 3, F.lit(","), F.col("n_nationkey"), F.lit("];"), F.col("n_regionkey"), F.lit(";x;"))
    r = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.explode(S.parse_ranges(text)).alias("r")).select("k", "r.*")
    return S.covered_integers(r, "t0", "t1").select("k", F.col("n").cast("int").alias("n"))


@query("t11_t12_components", "SELECT c_custkey AS node, c_custkey - c_custkey % 5 AS component, c_custkey // 5 AS number FROM customer")
def components(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    edges = S.same_label_edges(nodes.select(F.col("node").alias("u"), (F.col("node") + 1).alias("v")), nodes.withColumn("five", F.floor(F.col("node") / 5)), ["five"])
    return S.components_of(nodes, edges).select("node", "component", F.col("number").cast("long").alias("number"))


@query("t13_t16_labelled_components", "WITH e AS (SELECT k AS u, k + 1 AS v FROM (SELECT unnest(generate_series(1, (SELECT max(c_custkey) FROM customer) - 1)) AS k)), l AS (SELECT c_custkey AS node, CAST(c_nationkey % 2 AS INT) AS label FROM customer), r AS (SELECT node, label, sum(CASE WHEN label = p THEN 0 ELSE 1 END) OVER (ORDER BY node) AS run FROM (SELECT *, lag(label) OVER (ORDER BY node) AS p FROM l)) SELECT min(node) OVER (PARTITION BY run) AS component, node FROM r QUALIFY count(*) OVER (PARTITION BY run) >= 3")
def labelled_components(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") % 2).alias("label"))
    edges = nodes.select(F.col("node").alias("u"), (F.col("node") + 1).alias("v"))
    found = S.components_of(nodes.select("node"), S.same_label_edges(edges, nodes, ["label"]))
    return S.components_of_size(found, 3).select("component", "node")


_TRIANGLES = "tri AS (SELECT p_partkey AS t, p_partkey AS i, p_partkey + 1 + p_size % 3 AS j, p_partkey + 5 + p_size % 2 AS k FROM part)"
_RINGS = "ring AS (SELECT c_custkey AS a, c_custkey // 7 AS grp, coalesce(lead(c_custkey) OVER (PARTITION BY c_custkey // 7 ORDER BY c_custkey), min(c_custkey) OVER (PARTITION BY c_custkey // 7)) AS b FROM customer)"
_EDGES = "edge AS (SELECT t, i AS a, j AS b FROM tri UNION ALL SELECT t, j, k FROM tri UNION ALL SELECT t, k, i FROM tri)"


def triangles(spark, sf_dir):
    """A triangle for each part, over vertices that near-by parts share."""
    i, n = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(i.alias("t"), i.alias("i"), (i + 1 + n % 3).alias("j"), (i + 5 + n % 2).alias("k"))


@query("t19_t22_boundary_edges", f"WITH {_TRIANGLES}, {_EDGES} SELECT a, b FROM edge e WHERE NOT EXISTS (SELECT 1 FROM edge o WHERE o.a = e.b AND o.b = e.a)")
def boundary_edges(spark, sf_dir):
    return S.boundary_edges(triangles(spark, sf_dir))


@query("j35_neighbour_triangles", f"WITH {_TRIANGLES}, {_EDGES} SELECT DISTINCT e.t, o.t AS other FROM edge e JOIN edge o ON least(e.a, e.b) = least(o.a, o.b) AND greatest(e.a, e.b) = greatest(o.a, o.b) AND e.t <> o.t")
def neighbour_triangles(spark, sf_dir):
    return S.neighbour_triangles(triangles(spark, sf_dir))


@query("t29_cliques", "WITH e AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey) SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b")
def cliques(spark, sf_dir):
    return S.triangles_of_graph(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v")))


@query("t20_t27_loops", f"WITH RECURSIVE {_RINGS}, r(loop, position, vertex) AS (SELECT min(a), 0::BIGINT, min(a) FROM ring GROUP BY grp UNION ALL SELECT r.loop, r.position + 1, ring.b FROM r JOIN ring ON ring.a = r.vertex WHERE ring.b <> r.loop) SELECT * FROM r")
def loops(spark, sf_dir):
    """Rings of seven customers each, chained from their smallest one."""
    k = F.col("c_custkey")
    ring = table(spark, sf_dir, "customer").select(k.alias("a"), F.floor(k / 7).alias("grp"), F.lead(k).over(Window.partitionBy(F.floor(k / 7)).orderBy(k)).alias("b"), F.min(k).over(Window.partitionBy(F.floor(k / 7))).alias("first"))
    return S.chain_loops(ring.select("a", F.coalesce("b", "first").alias("b")))


@query("t23_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def last_wins(spark, sf_dir):
    return S.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id").select("user_id", "event_type", "value")
