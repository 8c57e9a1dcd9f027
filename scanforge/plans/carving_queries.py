"""Queries of carving: samples of single maps, corners of wedges, the cells that they meet, and the statistics of those cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import carving as C
from .inputs import table
from .registry import query, round_all

RES = 2.0
SENSOR_COV = (0.011, 0.023, 0.017)
POINT_COV = (0.09, 0.0625)

# The maps have diagonal covariances, so that the axis nearest to a ray is that of its largest component
_MAPS = """m AS (SELECT l_orderkey AS frame, CAST(l_linenumber AS BIGINT) AS p, l_orderkey % 97 * 0.013::DOUBLE AS s0, l_orderkey % 89 * 0.011::DOUBLE AS s1, l_orderkey % 83 * 0.007::DOUBLE AS s2,
    min(l_quantity) / 10 + 0.5 AS p0, min(l_discount) * 40 + 0.3137 AS p1, min(l_tax) * 40 + 0.2291 AS p2, 0.04::DOUBLE + l_linenumber * 0.01::DOUBLE AS v0, min(l_discount) AS planar, min(l_tax) AS corner FROM lineitem GROUP BY l_orderkey, l_linenumber),
    n AS (SELECT *, sqrt((p0 - s0) * (p0 - s0) + (p1 - s1) * (p1 - s1) + (p2 - s2) * (p2 - s2)) AS n FROM m),
    r AS (SELECT *, (p0 - s0) / n AS r0, (p1 - s1) / n AS r1, (p2 - s2) / n AS r2 FROM n),
    map AS (SELECT *, 0.011 * r0 * r0 + 0.023 * r1 * r1 + 0.017 * r2 * r2 AS sv, v0 * r0 * r0 + 0.09 * r1 * r1 + 0.0625 * r2 * r2 AS pv FROM r),
    far AS (SELECT *, p0 + 3 * sqrt(pv) * r0 AS e0, p1 + 3 * sqrt(pv) * r1 AS e1, p2 + 3 * sqrt(pv) * r2 AS e2 FROM map)"""
_POLY = "(((((1.061405429 * {0} - 1.453152027) * {0} + 1.421413741) * {0} - 0.284496736) * {0} + 0.254829592) * {0})"


def _along(of):
    return f"CASE WHEN abs(r0) >= abs(r1) AND abs(r0) >= abs(r2) THEN ({of}0 - x0) / r0 WHEN abs(r1) >= abs(r2) THEN ({of}1 - x1) / r1 ELSE ({of}2 - x2) / r2 END"


def _samples(of: str, size: str) -> str:
    """Steps from rows of a map and a place x0, x1, x2 to y: the same with pr, w and su."""
    return f"""d AS (SELECT *, {_along("s")} AS ts, {_along("p")} AS tp FROM {of}),
    f AS (SELECT *, greatest(0.0, least(1.0, -ts / (tp - ts))) AS f FROM d),
    o AS (SELECT *, x0 - ((1 - f) * s0 + f * p0) AS o0, x1 - ((1 - f) * s1 + f * p1) AS o1, x2 - ((1 - f) * s2 + f * p2) AS o2, (1 - f) * 0.011 + f * v0 AS c0, (1 - f) * 0.023 + f * 0.09 AS c1, (1 - f) * 0.017 + f * 0.0625 AS c2 FROM f),
    v AS (SELECT *, o0 * o0 + o1 * o1 + o2 * o2 AS far2, (c0 * o0 * o0 + c1 * o1 * o1 + c2 * o2 * o2) / (o0 * o0 + o1 * o1 + o2 * o2) AS var FROM o),
    z AS (SELECT *, exp(-far2 / var / 2) / (sqrt(var) * sqrt(2 * pi())) * {size} AS w, -ts / sqrt(sv) AS za, tp / sqrt(pv) AS zb FROM v),
    t AS (SELECT *, 1 / (1 + 0.3275911 * abs(za) / sqrt(2)) AS ta, 1 / (1 + 0.3275911 * abs(zb) / sqrt(2)) AS tb FROM z),
    g AS (SELECT *, 0.5 * (1 + sign(za) * (1 - {_POLY.format("ta")} * exp(-za * za / 2))) AS ga, 0.5 * (1 + sign(zb) * (1 - {_POLY.format("tb")} * exp(-zb * zb / 2))) AS gb FROM t),
    y AS (SELECT *, ga * w * gb + 0.5 * (1 - ga * w) AS pr, {size} * {size} * {size} * exp(-((x0 - p0) * (x0 - p0) / v0 + (x1 - p1) * (x1 - p1) / 0.09 + (x2 - p2) * (x2 - p2) / 0.0625) / 2) * pow(2 * pi(), -1.5) / sqrt(v0 * 0.09 * 0.0625) AS su FROM g)"""


_WEDGES = """c AS (SELECT frame, p, lead(p) OVER (PARTITION BY frame ORDER BY p) AS q, row_number() OVER (PARTITION BY frame ORDER BY p) - 1 AS i FROM m), nx AS (SELECT frame, lead(frame) OVER (ORDER BY frame) AS nf FROM (SELECT DISTINCT frame FROM c)),
    wedge AS (SELECT row_number() OVER (ORDER BY a.frame, a.p) - 1 AS wedge_id, a.frame AS fa, a.p AS a1, a.q AS a2, b.frame AS fb, b.p AS b1, b.q AS b2 FROM c a JOIN nx ON a.frame = nx.frame JOIN c b ON b.frame = nx.nf AND b.i = a.i WHERE a.q IS NOT NULL AND b.q IS NOT NULL),
    ends AS (SELECT wedge_id, a.s0 AS a0, a.s1 AS aa1, a.s2 AS aa2, [[a.s0, a.s1, a.s2], [a.e0, a.e1, a.e2], [b.e0, b.e1, b.e2], [c2.s0, c2.s1, c2.s2], [c2.e0, c2.e1, c2.e2], [d2.e0, d2.e1, d2.e2]] AS cs
        FROM wedge JOIN far a ON a.frame = fa AND a.p = a1 JOIN far b ON b.frame = fa AND b.p = a2 JOIN far c2 ON c2.frame = fb AND c2.p = b1 JOIN far d2 ON d2.frame = fb AND d2.p = b2)"""
_HITS = """tri(a, b, c) AS (VALUES (0, 1, 2), (3, 4, 5), (0, 3, 4), (0, 1, 4), (0, 2, 5), (0, 3, 5), (1, 4, 5), (1, 2, 5), (0, 1, 5), (2, 3, 4)),
    x AS (SELECT wedge_id, cs, i0, unnest(generate_series(CAST(floor(list_min(list_transform(cs, lambda v: v[2])) / 2) AS BIGINT), CAST(floor(list_max(list_transform(cs, lambda v: v[2])) / 2) AS BIGINT))) AS i1
        FROM (SELECT wedge_id, cs, unnest(generate_series(CAST(floor(list_min(list_transform(cs, lambda v: v[1])) / 2) AS BIGINT), CAST(floor(list_max(list_transform(cs, lambda v: v[1])) / 2) AS BIGINT))) AS i0 FROM ends)),
    cell AS (SELECT wedge_id, cs, i0, i1, unnest(generate_series(CAST(floor(list_min(list_transform(cs, lambda v: v[3])) / 2) AS BIGINT), CAST(floor(list_max(list_transform(cs, lambda v: v[3])) / 2) AS BIGINT))) AS i2 FROM x),
    pts AS (SELECT wedge_id, i0, i1, i2, cs[a + 1][1] - (i0 + 0.5) * 2 AS ax, cs[a + 1][2] - (i1 + 0.5) * 2 AS ay, cs[a + 1][3] - (i2 + 0.5) * 2 AS az, cs[b + 1][1] - (i0 + 0.5) * 2 AS bx, cs[b + 1][2] - (i1 + 0.5) * 2 AS by2, cs[b + 1][3] - (i2 + 0.5) * 2 AS bz, cs[c + 1][1] - (i0 + 0.5) * 2 AS cx, cs[c + 1][2] - (i1 + 0.5) * 2 AS cy, cs[c + 1][3] - (i2 + 0.5) * 2 AS cz FROM cell, tri),
    eds AS (SELECT *, bx - ax AS ux, by2 - ay AS uy, bz - az AS uz, cx - bx AS vx, cy - by2 AS vy, cz - bz AS vz, ax - cx AS tx, ay - cy AS ty, az - cz AS tz FROM pts
        WHERE least(ax, bx, cx) <= 1 AND greatest(ax, bx, cx) >= -1 AND least(ay, by2, cy) <= 1 AND greatest(ay, by2, cy) >= -1 AND least(az, bz, cz) <= 1 AND greatest(az, bz, cz) >= -1),
    axs AS (SELECT *, [[uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx], [0, uz, -uy], [-uz, 0, ux], [uy, -ux, 0], [0, vz, -vy], [-vz, 0, vx], [vy, -vx, 0], [0, tz, -ty], [-tz, 0, tx], [ty, -tx, 0]] AS l FROM eds),
    hit AS (SELECT DISTINCT wedge_id, i0, i1, i2 FROM axs WHERE len(list_filter(l, lambda n: least(n[1] * ax + n[2] * ay + n[3] * az, n[1] * bx + n[2] * by2 + n[3] * bz, n[1] * cx + n[2] * cy + n[3] * cz) > abs(n[1]) + abs(n[2]) + abs(n[3]) OR greatest(n[1] * ax + n[2] * ay + n[3] * az, n[1] * bx + n[2] * by2 + n[3] * bz, n[1] * cx + n[2] * cy + n[3] * cz) < -(abs(n[1]) + abs(n[2]) + abs(n[3])))) = 0)"""


def maps(spark, sf_dir):
    """A map for each order line: the order is the frame, whose sensor is the same for all its lines."""
    f = F.col("l_orderkey")
    sensor = F.array(f % 97 * 0.013, f % 89 * 0.011, f % 83 * 0.007)
    # dealt by frame, so that what gathers frames after this need not shuffle maps, which are wider
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").repartition("l_orderkey")
    rows = rows.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(f"l_{c}").alias(c) for c in ("quantity", "discount", "tax")])
    diagonal = lambda x, y, z: F.array(x, F.lit(0.0), F.lit(0.0), y, F.lit(0.0), z)
    lits = lambda *v: [F.lit(x) for x in v]
    return rows.select(
        f.alias("frame"),
        F.col("l_linenumber").cast("long").alias("point"),
        sensor.alias("sensor_mean"),
        diagonal(*lits(*SENSOR_COV)).alias("sensor_cov"),
        F.array(F.col("quantity") / 10 + 0.5, F.col("discount") * 40 + 0.3137, F.col("tax") * 40 + 0.2291).alias("point_mean"),
        diagonal(0.04 + F.col("l_linenumber") * 0.01, *lits(*POINT_COV)).alias("point_cov"),
        F.col("discount").alias("planar_prob"),
        F.col("tax").alias("corner_prob"),
    )


def wedges(spark, sf_dir):
    return C.wedges(maps(spark, sf_dir).select("frame", "point"))


def carved(spark, sf_dir):
    every = maps(spark, sf_dir)
    return C.carve_wedges(C.wedge_pairs(every.select("frame", "point")), every, RES)


@query("x02_x03_carve_probability", f"WITH {_MAPS}, q AS (SELECT *, s0 + u * (p0 - s0) + 0.21 AS x0, s1 + u * (p1 - s1) - 0.13 AS x1, s2 + u * (p2 - s2) + 0.17 AS x2 FROM map, (VALUES (0.05::DOUBLE), (0.6), (0.95), (1.1)) k(u)), {_samples('q', '0.5')} SELECT frame, p AS point, u, round(pr, 6) AS p, round(w, 6) AS w, round(su, 6) AS surface FROM y")
def carve_probability(spark, sf_dir):
    rays = C.ray_models(maps(spark, sf_dir)).select(F.struct("*").alias("m"), F.explode(F.array(*map(F.lit, (0.05, 0.6, 0.95, 1.1)))).alias("u"))
    place = [F.get("m.sensor_mean", k) + F.col("u") * (F.get("m.point_mean", k) - F.get("m.sensor_mean", k)) + o for k, o in enumerate((0.21, -0.13, 0.17))]
    said = rays.select("m.frame", "m.point", "u", F.inline(C.map_samples(F.array("m"), place, 0.5)))
    return round_all(said.select("frame", "point", "u", "p", "w", "surface"))


@query("x09_wedge_corners", f"WITH {_MAPS}, {_WEDGES} SELECT wedge_id, round(cs[2][1], 6) AS x1, round(cs[3][2], 6) AS y2, round(cs[5][3], 6) AS z4, round(cs[6][1], 6) AS x5, round(cs[4][1], 6) AS x3 FROM ends")
def wedge_corners(spark, sf_dir):
    at = lambda v, k: F.get(F.get("corners", v), k)
    w = C.wedge_corners(wedges(spark, sf_dir), maps(spark, sf_dir))
    return round_all(w.select("wedge_id", at(1, 0).alias("x1"), at(2, 1).alias("y2"), at(4, 2).alias("z4"), at(5, 0).alias("x5"), at(3, 0).alias("x3")))


@query("x10_x72_x74_wedge_cells", f"WITH {_MAPS}, {_WEDGES}, {_HITS} SELECT i0, i1, i2, count(*) AS wedges FROM hit GROUP BY ALL")
def wedge_cells(spark, sf_dir):
    return carved(spark, sf_dir).select("i0", "i1", "i2", F.col("count").alias("wedges"))


@query(
    "j16_g47_carve",
    f"""WITH {_MAPS}, {_WEDGES}, {_HITS}, e4 AS (SELECT wedge_id, fa AS frame, a1 AS p FROM wedge UNION ALL SELECT wedge_id, fa, a2 FROM wedge UNION ALL SELECT wedge_id, fb, b1 FROM wedge UNION ALL SELECT wedge_id, fb, b2 FROM wedge),
    q AS (SELECT hit.*, map.*, (i0 + 0.5) * 2 AS x0, (i1 + 0.5) * 2 AS x1, (i2 + 0.5) * 2 AS x2 FROM hit JOIN e4 USING (wedge_id) JOIN map USING (frame, p)), {_samples('q', '2.0')},
    k AS (SELECT wedge_id, i0, i1, i2, sum(w) AS w, coalesce(sum(w * pr) / nullif(sum(w), 0), 0) AS pr, 1 - product(1 - su) AS su, coalesce(sum(w * planar) / nullif(sum(w), 0), 0) AS planar, coalesce(sum(w * corner) / nullif(sum(w), 0), 0) AS corner FROM y GROUP BY ALL)
    SELECT i0, i1, i2, count(*) AS count, round(sum(w), 3) AS total_weight, round(sum(w * pr), 3) AS prob_sum, round(sum(w * pr * pr), 3) AS prob_sum_sq, round(sum(w * su), 3) AS surface_sum, round(sum(w * corner), 3) AS corner_sum, round(sum(w * planar), 3) AS planar_sum FROM k GROUP BY ALL""",
)
def carve_wedges(spark, sf_dir):
    return round_all(carved(spark, sf_dir), 3)


_FLAT = "f AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS point, min(l_quantity) / 10 AS x, min(l_discount) * 20 AS y FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query(
    "w05_neighbourhood_planarity",
    f"""WITH {_FLAT}, b AS (SELECT a.frame, a.point, a.x, a.y, n.x AS nx, n.y AS ny, (a.x - n.x) * (a.x - n.x) + (a.y - n.y) * (a.y - n.y) <= 2.5 * 2.5 AS close FROM f a JOIN f n ON a.frame = n.frame AND abs(a.point - n.point) <= floor(atan2(2.5, 4.0) / 0.3)),
    l AS (SELECT frame, point, avg(nx) AS mx, avg(ny) AS my, covar_pop(nx, nx) AS a, covar_pop(nx, ny) AS b, covar_pop(ny, ny) AS c FROM b WHERE close GROUP BY ALL),
    d AS (SELECT *, atan2(2 * b, a - c) / 2 AS t FROM l WHERE (a - c) * (a - c) + b * b > 0.000001),
    e AS (SELECT b.frame, b.point, avg(abs((nx - mx) * sin(t) - (ny - my) * cos(t)) / 0.5) AS e FROM b JOIN d USING (frame, point) GROUP BY ALL),
    t AS (SELECT *, 1 / (1 + 0.3275911 * e) AS t FROM e) SELECT frame, point, round({_POLY.format("t")} * exp(-e * e), 5) AS planar_prob FROM t""",
)
def neighbourhood_planarity(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_quantity") / 10).alias("x"), (F.min("l_discount") * 20).alias("y"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    pts = rows.select(F.col("l_orderkey").alias("frame"), nth.cast("long").alias("point"), "x", "y", F.lit(0.0).alias("z"), F.lit(4.0).alias("range"), F.lit(0.25).alias("point_var"))
    got = C.neighbourhood_planarity(pts, 2.5, 0.3)
    # where the neighbours have no direction, any line through them is as good, so that two programs need not agree
    pairs = pts.alias("a").join(pts.alias("n"), "frame").where("abs(a.point - n.point) <= 1 and (a.x - n.x) * (a.x - n.x) + (a.y - n.y) * (a.y - n.y) <= 6.25")
    spread = pairs.groupBy("frame", F.col("a.point").alias("point")).agg((F.pow(F.covar_pop("n.x", "n.x") - F.covar_pop("n.y", "n.y"), 2) + F.pow(F.covar_pop("n.x", "n.y"), 2)).alias("s"))
    return got.join(spread.where("s > 0.000001"), ["frame", "point"], "left_semi").withColumn("planar_prob", F.round("planar_prob", 5))
