"""Queries of joins in time and space, and of operators along ordered rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import shapes as G
from ..operators import joins as J
from ..operators import windows as W
from .inputs import points, poses, samples, seconds, sql, table
from .registry import query, round_all

MONTH = 30 * 86400.0
HOUR = 3600.0
RADIUS = 2.0


def pose_times(spark, sf_dir):
    return points(spark, sf_dir).select(F.col("timestamp").alias("t")).distinct()


@query("j01_as_of_clamped", sql("""SELECT t, coalesce(p.ts, (SELECT min(ts) FROM poses)) AS ts, round(coalesce(p.px, (SELECT arg_min(px, ts) FROM poses)), 6) AS px
    FROM (SELECT DISTINCT timestamp AS t FROM points) q ASOF LEFT JOIN poses p ON q.t >= p.ts""", "points", "poses"))
def as_of_clamped(spark, sf_dir):
    return round_all(J.as_of_clamped(pose_times(spark, sf_dir), poses(spark, sf_dir).select("ts", "px"), "t", "ts", MONTH))


@query(
    "j02_interpolate",
    sql(
        """, s AS (SELECT ts, px, py, lead(ts) OVER (ORDER BY ts) AS nt, lead(px) OVER (ORDER BY ts) AS nx, lead(py) OVER (ORDER BY ts) AS ny, min(ts) OVER () AS first FROM poses),
        q AS (SELECT DISTINCT timestamp + 3607 * (part % 23) + 0.123456 AS t FROM points),
        j AS (SELECT q.t, coalesce(s.ts, (SELECT min(ts) FROM s)) AS ts FROM q ASOF LEFT JOIN s ON q.t >= s.ts),
        k AS (SELECT j.t, s.*, (s.ts = s.first OR s.nt IS NULL OR j.t <= s.ts) AS hold FROM j JOIN s USING (ts))
        SELECT t, round(CASE WHEN hold THEN px ELSE px * (1 - (t - ts) / (nt - ts)) + nx * ((t - ts) / (nt - ts)) END, 6) AS px, round(CASE WHEN hold THEN py ELSE py * (1 - (t - ts) / (nt - ts)) + ny * ((t - ts) / (nt - ts)) END, 6) AS py FROM k""",
        "points",
        "poses",
    ),
)
def interpolate(spark, sf_dir):
    q = points(spark, sf_dir).select((F.col("timestamp") + 3607 * (F.col("part") % 23) + 0.123456).alias("t")).distinct()
    return round_all(J.interpolate(q, poses(spark, sf_dir), "t", "ts", ["px", "py"], MONTH))


@query(
    "j03_to_world",
    sql(
        """, j AS (SELECT q.*, p.ts, p.px, p.py, p.pz, p.yaw FROM points q ASOF JOIN poses p ON q.timestamp >= p.ts)
        SELECT ts, count(*) AS n, round(avg(cos(radians(yaw)) * x - sin(radians(yaw)) * y + px), 5) AS wx, round(avg(sin(radians(yaw)) * x + cos(radians(yaw)) * y + py), 5) AS wy, round(avg(z + pz), 5) AS wz FROM j GROUP BY ts""",
        "points",
        "poses",
    ),
)
def to_world(spark, sf_dir):
    j = J.as_of(points(spark, sf_dir), poses(spark, sf_dir), "timestamp", "ts", MONTH).where("ts is not null")
    world = G.apply(G.axis_rotation("z", F.radians("yaw")), G.vec("x", "y", "z"), G.vec("px", "py", "pz"))
    return round_all(j.groupBy("ts").agg(F.count("*").alias("n"), *[F.avg(c).alias(n) for c, n in zip(world, ("wx", "wy", "wz"))]), 5)


@query("j04_j10_clock", "SELECT user_id % 25 AS sensor, count(*) AS n, round(avg((1 + n_regionkey / 1000) * value + n_nationkey), 6) AS t, max(CASE WHEN n_regionkey - 2 < 0 THEN 0.5 ELSE n_regionkey - 2 END) AS s FROM events JOIN nation ON user_id % 25 = n_nationkey GROUP BY 1")
def clock(spark, sf_dir):
    fits = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("sensor"), (1 + F.col("n_regionkey") / 1000).alias("slope"), F.col("n_nationkey").cast("double").alias("offset"), (F.col("n_regionkey") - 2.0).alias("stddev"))
    df = J.convert_clock(table(spark, sf_dir, "events").withColumn("sensor", F.col("user_id") % 25), fits, "sensor", "value", "t", 0.5)
    return round_all(df.groupBy("sensor").agg(F.count("*").alias("n"), F.avg("t").alias("t"), F.max("clock_stddev").alias("s")))


_NEAREST = """, q AS (SELECT event_id, user_id, t FROM samples WHERE event_type = 'click'), r AS (SELECT user_id, t AS rt, min(event_id) AS other FROM samples WHERE event_type = 'view' GROUP BY ALL),
    b AS (SELECT q.*, r.rt AS bt, r.other AS bo FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.t >= r.rt),
    a AS (SELECT b.*, r.rt AS nt, r.other AS ao FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.t < r.rt)
    SELECT event_id, CASE WHEN bt IS NOT NULL AND (nt IS NULL OR nt - t {} t - bt) THEN bo ELSE ao END AS other FROM a"""


def _nearest(spark, sf_dir, later):
    s = samples(spark, sf_dir)
    views = s.where("event_type = 'view'").groupBy("user_id", F.col("t").alias("rt")).agg(F.min("event_id").alias("other"))
    return J.nearest(s.where("event_type = 'click'").select("event_id", "user_id", "t"), views, "t", "rt", HOUR * 24, ["user_id"], later).select("event_id", "other")


@query("j07_nearest_later", sql(_NEAREST.format(">"), "samples"))
def nearest_later(spark, sf_dir):
    return _nearest(spark, sf_dir, True)


@query("j08_nearest_earlier", sql(_NEAREST.format(">="), "samples"))
def nearest_earlier(spark, sf_dir):
    return _nearest(spark, sf_dir, False)


_RESTS = ", rests AS (SELECT user_id, t AS t0, t + value * 60 AS t1 FROM samples WHERE event_type = 'error')"


def _rests(s):
    return s.where("event_type = 'error'").select("user_id", F.col("t").alias("t0"), (F.col("t") + F.col("value") * 60).alias("t1"))


@query("f31_outside_intervals", sql(_RESTS + " SELECT event_id FROM samples s WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM rests r WHERE r.user_id = s.user_id AND s.t BETWEEN r.t0 AND r.t1)", "samples"))
def outside(spark, sf_dir):
    s = samples(spark, sf_dir)
    return J.outside_intervals(s.where("event_type <> 'error'"), _rests(s), "t", HOUR * 6, by=["user_id"]).select("event_id")


@query("t07_inside_intervals", sql(_RESTS + " SELECT event_id FROM samples s WHERE event_type <> 'error' AND EXISTS (SELECT 1 FROM rests r WHERE r.user_id = s.user_id AND s.t BETWEEN r.t0 AND r.t1)", "samples"))
def inside(spark, sf_dir):
    s = samples(spark, sf_dir)
    return J.inside_intervals(s.where("event_type <> 'error'"), _rests(s), "t", HOUR * 6, by=["user_id"]).select("event_id")


def _sites(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 200).alias("x"), (F.col("s_suppkey") % 37).cast("double").alias("y"))


def _people(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), (F.col("c_acctbal") / 200).alias("x"), (F.col("c_custkey") % 37).cast("double").alias("y"))


_SITES = "WITH sites AS (SELECT s_suppkey AS k, s_acctbal / 200 AS x, CAST(s_suppkey % 37 AS DOUBLE) AS y FROM supplier), people AS (SELECT c_custkey AS c, c_acctbal / 200 AS x, CAST(c_custkey % 37 AS DOUBLE) AS y FROM customer)"
_D2 = "((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y))"


@query("j23_radius_join", f"{_SITES} SELECT c, k, round(sqrt({_D2}), 6) AS distance FROM people p, sites s WHERE {_D2} < 4.0")
def radius_join(spark, sf_dir):
    pairs = J.radius_join(_people(spark, sf_dir), _sites(spark, sf_dir), RADIUS, ["x", "y"], "s_")
    return round_all(pairs.select("c", F.col("s_k").alias("k"), "distance"))


@query("j22_nearest_within", f"{_SITES} SELECT c, arg_min(k, (sqrt({_D2}), k)) AS k, round(min(sqrt({_D2})), 6) AS distance FROM people p, sites s WHERE {_D2} <= 4.0 GROUP BY c")
def nearest_within(spark, sf_dir):
    return round_all(J.nearest_within(_people(spark, sf_dir), _sites(spark, sf_dir), RADIUS, ["x", "y"], ["c"], "k"))


@query("j21_j43_cell_lookup", f"{_SITES}, cells AS (SELECT CAST(floor(x / 5) AS BIGINT) AS i0, CAST(floor(y / 5) AS BIGINT) AS i1, max(k) AS top FROM sites GROUP BY ALL) SELECT c, coalesce(top, -1) AS top FROM people p LEFT JOIN cells ON floor(p.x / 5) = i0 AND floor(p.y / 5) = i1")
def cell_lookup(spark, sf_dir):
    cells = _sites(spark, sf_dir).groupBy(F.floor(F.col("x") / 5).alias("i0"), F.floor(F.col("y") / 5).alias("i1")).agg(F.max("k").alias("top"))
    return J.cell_lookup(_people(spark, sf_dir), cells, 5.0, ["x", "y"], "top", -1).select("c", "top")


@query("j36_chunk_keys", sql("SELECT CAST(floor(x / 16) AS BIGINT) AS i, CAST(floor(y / 16) AS BIGINT) AS j, CAST(floor(z / 4) AS BIGINT) AS k, count(DISTINCT frame) AS frames FROM points GROUP BY ALL", "points"))
def chunk_keys(spark, sf_dir):
    df = points(spark, sf_dir)
    return df.groupBy(*[F.floor(F.col(c) / w).alias(n) for c, w, n in (("x", 16, "i"), ("y", 16, "j"), ("z", 4, "k"))]).agg(F.count_distinct("frame").alias("frames"))


@query(
    "j24_segment_cells",
    """WITH seg AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS ax, s_suppkey % 7 + 0.31 AS ay, s_nationkey * 0.7 + 0.137 AS ex, s_suppkey % 11 + 0.77 AS ey FROM supplier),
    cell AS (SELECT seg.*, i0, i1 FROM seg, LATERAL (SELECT unnest(generate_series(CAST(floor(least(ax, ex)) AS BIGINT), CAST(floor(greatest(ax, ex)) AS BIGINT))) AS i0), LATERAL (SELECT unnest(generate_series(CAST(floor(least(ay, ey)) AS BIGINT), CAST(floor(greatest(ay, ey)) AS BIGINT))) AS i1))
    SELECT k, i0, i1 FROM cell WHERE greatest(0.0, least((i0 - ax) / (ex - ax), (i0 + 1 - ax) / (ex - ax)), least((i1 - ay) / (ey - ay), (i1 + 1 - ay) / (ey - ay))) < least(1.0, greatest((i0 - ax) / (ex - ax), (i0 + 1 - ax) / (ex - ax)), greatest((i1 - ay) / (ey - ay), (i1 + 1 - ay) / (ey - ay)))""",
)
def segment_cells(spark, sf_dir):
    k = F.col("s_suppkey")
    seg = table(spark, sf_dir, "supplier").select(k.alias("k"), (F.col("s_acctbal") / 1000).alias("ax"), (k % 7 + 0.31).alias("ay"), (F.col("s_nationkey") * 0.7 + 0.137).alias("ex"), (k % 11 + 0.77).alias("ey"))
    return J.segment_cells(seg, ["ax", "ay"], ["ex", "ey"], 1.0).select("k", "i0", "i1")


_LEAVES = "leaves AS (SELECT CAST(floor(l_extendedprice / 8000) AS BIGINT) AS ix, CAST(floor(l_quantity / 8) AS BIGINT) AS iy, CAST(floor(l_discount * 100 / 4) AS BIGINT) AS iz, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 2)"


def _leaves(spark, sf_dir):
    df = points(spark, sf_dir)
    cells = df.groupBy(F.floor(F.col("x") / 8).alias("ix"), F.floor(F.col("y") / 8).alias("iy"), F.floor(F.col("z") / 4).alias("iz")).agg(F.count("*").alias("n")).where("n >= 2")
    return cells.withColumn("leaf", F.concat_ws(",", "ix", "iy", "iz")).withColumns({f"c{a}": F.col(f"i{a}") + 0.5 for a in "xyz"}).withColumn("hw", F.lit(0.5))


@query("j33_face_neighbours", f"""WITH {_LEAVES}, d AS (SELECT 'x' AS axis, 1 AS dx, 0 AS dy, 0 AS dz UNION ALL SELECT 'y', 0, 1, 0 UNION ALL SELECT 'z', 0, 0, 1)
    SELECT concat_ws(',', a.ix, a.iy, a.iz) AS a, concat_ws(',', b.ix, b.iy, b.iz) AS b, axis, CAST(1.0 AS DOUBLE) AS area FROM leaves a, d, leaves b WHERE b.ix = a.ix + dx AND b.iy = a.iy + dy AND b.iz = a.iz + dz""")
def face_neighbours(spark, sf_dir):
    return J.face_neighbours(_leaves(spark, sf_dir))


@query("j38_changes", sql("SELECT event_type AS value, previous, count(*) AS n FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS previous FROM samples) WHERE previous <> event_type GROUP BY ALL", "samples"))
def changes(spark, sf_dir):
    return W.changes(samples(spark, sf_dir), "event_type", ["t", "event_id"], ["user_id"]).groupBy(F.col("event_type").alias("value"), "previous").agg(F.count("*").alias("n"))


@query("w01_velocities", sql("SELECT event_id, round((lead(value) OVER w - value) / nullif(lead(t) OVER w - t, 0), 8) AS v_value FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY t)", "samples"))
def velocities(spark, sf_dir):
    return round_all(W.velocities(samples(spark, sf_dir), "t", ["value"], ["user_id"]).select("event_id", "v_value"), 8)


@query("w01_angular_speed", sql("SELECT event_id, round(radians(((((lead(value) OVER w - value + 180) % 360) + 360) % 360) - 180) / nullif(lead(t) OVER w - t, 0), 8) + 0 AS omega FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY t)", "samples"))
def angular_speed(spark, sf_dir):
    return round_all(W.angular_speed(samples(spark, sf_dir), "t", "value", ["user_id"]).select("event_id", "omega"), 8)


@query("w02_out_of_order", "SELECT o_orderkey FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE o_orderdate < p")
def out_of_order(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("t", seconds("o_orderdate"))
    return W.out_of_order(df, "t", ["o_orderkey"], ["o_custkey"]).select("o_orderkey")


_FRAMES = "f AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS point FROM lineitem)"


@query("w03_frame_pairs", f"WITH {_FRAMES}, g AS (SELECT frame, lead(frame) OVER (ORDER BY frame) AS next_frame FROM (SELECT DISTINCT frame FROM f)) SELECT f.frame, point, coalesce(lead(point) OVER (PARTITION BY f.frame ORDER BY point), -1) AS next_point, coalesce(next_frame, -1) AS next_frame FROM f JOIN g USING (frame)")
def frame_pairs(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), (F.row_number().over(w) - 1).cast("long").alias("point"))
    return W.frame_pairs(f, "frame", "point").select("frame", "point", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("next_point", "next_frame")])


@query("w03_w04_valid_index", sql("SELECT event_id, coalesce(sum((value > 20)::INT) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS i, coalesce(last_value(CASE WHEN value > 20 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t), first_value(CASE WHEN value > 20 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS near FROM samples", "samples"))
def valid_index(spark, sf_dir):
    ok = F.col("value") > 20
    return samples(spark, sf_dir).select("event_id", W.compact_index(ok, ["t"], ["user_id"]).alias("i"), W.nearest_valid(F.when(ok, F.col("event_id")), ["t"], ["user_id"]).alias("near"))


@query("w06_local_maxima", sql(""", c AS (SELECT CAST(floor(x / 4) AS BIGINT) AS i0, CAST(floor(y / 4) AS BIGINT) AS i1, count(*) AS v FROM points GROUP BY ALL)
    SELECT i0, i1, v, row_number() OVER (ORDER BY i0, i1) - 1 AS seed FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE abs(o.i0 - c.i0) <= 1 AND abs(o.i1 - c.i1) <= 1 AND (o.v > c.v OR o.v = c.v AND (o.i0, o.i1) < (c.i0, c.i1)))""", "points"))
def local_maxima(spark, sf_dir):
    cells = points(spark, sf_dir).groupBy(F.floor(F.col("x") / 4).alias("i0"), F.floor(F.col("y") / 4).alias("i1")).agg(F.count("*").alias("v"))
    return W.local_maxima(cells, "v")


@query("w08_sample_by_distance")
def sample_by_distance(spark, sf_dir):
    return W.sample_by_distance(samples(spark, sf_dir).select("event_id", "user_id", "t", "value"), ["value"], "t", ["user_id"], 25.0)


@query("w09_slowest", sql(", p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS pos FROM samples) SELECT a.event_id, arg_min(b.pos, (abs(b.value), b.pos)) AS slowest FROM p a JOIN p b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 3 AND a.pos + 3 GROUP BY 1", "samples"))
def slowest(spark, sf_dir):
    return W.slowest_in_window(samples(spark, sf_dir), "value", "t", ["user_id"], 3).select("event_id", F.col("slowest").cast("long").alias("slowest"))


@query("a51_path_length", sql("SELECT user_id, round(coalesce(sum(abs(value - p)), 0), 5) AS length FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t) AS p FROM samples) GROUP BY 1", "samples"))
def path_length(spark, sf_dir):
    return round_all(W.path_length(samples(spark, sf_dir), ["value"], "t", ["user_id"]), 5)
