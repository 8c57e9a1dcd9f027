"""Queries of the filter script and of the row operators on points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probability as P
from ..operators import aggregates as A
from ..operators import filters as L
from ..operators.script import run_script
from .inputs import points, sql, table
from .registry import query, round_all

ORDER = ["timestamp", "index", "x", "y", "z", "part"]
ARRIVAL = "timestamp, index, x, y, z, part"

SCRIPT = """
# a box, its contents at half size, and their extent by cell
PartitionAABB 5 60  5 45  0 8
Kill INVALID
Scale 0.5
"""


@query(
    "f01_script_cells",
    sql(
        """, kept AS (SELECT x * 0.5 AS x, y * 0.5 AS y, z * 0.5 AS z FROM points WHERE x BETWEEN 5 AND 60 AND y BETWEEN 5 AND 45 AND z BETWEEN 0 AND 8)
        SELECT CAST(floor(x / 5) AS BIGINT) AS i0, CAST(floor(y / 5) AS BIGINT) AS i1, count(*) AS n, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(avg(z), 6) AS mean_z FROM kept GROUP BY ALL""",
        "points",
    ),
)
def script_cells(spark, sf_dir):
    df = run_script(points(spark, sf_dir), SCRIPT, ORDER)
    cells = df.groupBy(A.cell_key("x", 5.0).alias("i0"), A.cell_key("y", 5.0).alias("i1")).agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.avg("z").alias("mean_z"))
    return round_all(cells)


@query("f02_flip_valid", sql("SELECT NOT (x BETWEEN 5 AND 60) AS valid, count(*) AS n FROM points GROUP BY 1", "points"))
def flip_valid(spark, sf_dir):
    df = L.flip_valid(L.partition_box(points(spark, sf_dir), (5, -1e9, -1e9), (60, 1e9, 1e9)))
    return df.groupBy("valid").agg(F.count("*").alias("n"))


@query("f03_kill", sql("SELECT count(*) AS n, round(sum(y), 4) AS y FROM points WHERE x < 30", "points"))
def kill(spark, sf_dir):
    df = L.kill(L.partition_plane(points(spark, sf_dir), (-1, 0, 0), (30, 0, 0)), L.INVALID)
    return round_all(df.agg(F.count("*").alias("n"), F.sum("y").alias("y")), 4)


@query("f04_decimate", sql(f"SELECT frame, count(*) AS n, round(sum(x), 6) AS x FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {ARRIVAL}) - 1 AS k FROM points) WHERE k % 3 = 0 GROUP BY frame", "points"))
def decimate(spark, sf_dir):
    df = L.decimate(points(spark, sf_dir), 3, ORDER, partition=["frame"]).where("valid")
    return round_all(df.groupBy("frame").agg(F.count("*").alias("n"), F.sum("x").alias("x")), 6)


@query("f04_decimate_valid_scope", sql(f"SELECT frame, count(*) AS n FROM (SELECT *, sum(CASE WHEN y > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY {ARRIVAL}) - 1 AS k FROM points) WHERE y > 10 AND k % 2 = 0 GROUP BY frame", "points"))
def decimate_valid(spark, sf_dir):
    df = L.partition_plane(points(spark, sf_dir), (0, 1, 0), (0, 10, 0))
    return L.decimate(df, 2, ORDER, L.VALID, ["frame"]).where("valid").groupBy("frame").agg(F.count("*").alias("n"))


@query(
    "f05_f08_partitions",
    sql(
        """SELECT 1.0 * (x - 20) + 2.0 * (y - 20) + 0.5 * (z - 3) > 0 AS plane, NOT ((x - 30) * (x - 30) + (y - 25) * (y - 25) + (z - 5) * (z - 5) > 225) AS sphere,
        NOT ((x - 10) * (x - 10) + (y - 10) * (y - 10) > 400) AS cylinder, x BETWEEN 10 AND 40 AND y BETWEEN 10 AND 30 AND z BETWEEN 2 AND 6 AS box, count(*) AS n FROM points GROUP BY ALL""",
        "points",
    ),
)
def partitions(spark, sf_dir):
    df = points(spark, sf_dir)
    marks = {"plane": lambda d: L.partition_plane(d, (1, 2, 0.5), (20, 20, 3)), "sphere": lambda d: L.partition_radius(d, (30, 25, 5), 15), "cylinder": lambda d: L.partition_cylinder(d, (10, 10, 0), (0, 0, 1), 20), "box": lambda d: L.partition_box(d, (10, 10, 2), (40, 30, 6))}
    for name, mark in marks.items():
        df = mark(df).withColumnRenamed("valid", name).withColumn("valid", F.lit(True))
    return df.groupBy(*marks).agg(F.count("*").alias("n"))


@query("f09_rotate", sql("SELECT part % 50 AS k, round(avg(-y), 6) AS x, round(avg(x), 6) AS y, round(avg(z), 6) AS z FROM points GROUP BY 1", "points"))
def rotate(spark, sf_dir):
    df = L.rotate(points(spark, sf_dir), L.euler_matrix(0, 0, 90))
    return round_all(df.groupBy((F.col("part") % 50).alias("k")).agg(*[F.avg(c).alias(c) for c in "xyz"]))


@query("f10_f12_scale_translate_recolor", sql("SELECT part % 50 AS k, round(avg(x * 2 + 1), 6) AS x, round(avg(y * 3 - 1), 6) AS y, round(avg(z * 4 + 0.5), 6) AS z, max(CASE WHEN z > 5 THEN 9 ELSE r END) AS r, count(*) AS n FROM points GROUP BY 1", "points"))
def scale_translate(spark, sf_dir):
    df = L.translate(L.scale(points(spark, sf_dir), (2, 3, 4)), (1, -1, 0.5))
    df = L.recolor(L.partition_plane(df, (0, 0, 1), (0, 0, 20.5)), 9, 8, 7, scope=L.VALID)
    return round_all(df.groupBy((F.col("part") % 50).alias("k")).agg(*[F.avg(c).alias(c) for c in "xyz"], F.max("r").alias("r"), F.count("*").alias("n")))


@query("f13_statistics", sql("SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM points WHERE y > 10", "points"))
def statistics(spark, sf_dir):
    return L.statistics(L.partition_plane(points(spark, sf_dir), (0, 1, 0), (0, 10, 0)), L.VALID)


@query("f16_model_transform", sql("SELECT round(sum(x * 0.3048 + 2), 3) AS x, round(max(z * 0.3048 + 2), 6) AS z FROM points", "points"))
def model_transform(spark, sf_dir):
    df = L.model_transform(points(spark, sf_dir), 0.3048, 2)
    return df.agg(F.round(F.sum("x"), 3).alias("x"), F.round(F.max("z"), 6).alias("z"))


@query("f17_f18_units_and_bias", sql("SELECT frame, round(sum(x * 0.001 * (1 + 0.02 / sqrt(x * x * 1e-6 + y * y * 1e-6 + z * z * 1e-6))), 6) AS x FROM points GROUP BY frame", "points"))
def units_and_bias(spark, sf_dir):
    df = L.to_metres(points(spark, sf_dir).withColumn("bias", F.lit(20.0)), 0.001)
    return round_all(L.correct_bias(df).groupBy("frame").agg(F.sum("x").alias("x")))


@query(
    "f19_f20_range_scan",
    """SELECT l_linenumber AS line, count(*) AS n, round(sum(l_extendedprice / 1000 * cos(l_discount * 10)), 4) AS x, sum(CASE WHEN l_extendedprice BETWEEN 500 AND 30000 THEN 1 ELSE 0 END) AS good,
    round(avg(CASE WHEN l_extendedprice BETWEEN 500 AND 30000 THEN CASE WHEN l_extendedprice < 10000 THEN 0.03 ELSE 0.05 END END), 6) AS stddev, round(avg(CASE WHEN l_extendedprice BETWEEN 500 AND 30000 THEN (0.0006 * l_extendedprice + 1.48) / 1000 END), 8) AS width
    FROM lineitem WHERE l_extendedprice >= 1000 AND l_extendedprice <= 60000 GROUP BY 1""",
)
def range_scan(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumns({"range_mm": F.col("l_extendedprice"), "angle": F.col("l_discount") * 10})
    df = L.range_scan_points(L.range_between(df, 1000, 60000))
    ok = F.col("stddev") < float("inf")
    return df.groupBy(F.col("l_linenumber").alias("line")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("x"), F.sum(ok.cast("long")).alias("good"), F.round(F.avg(F.when(ok, F.col("stddev"))), 6).alias("stddev"), F.round(F.avg(F.when(ok, F.col("width"))), 8).alias("width"))


@query("f22_zoned_noise", sql("SELECT CASE WHEN z < 0.1 OR z > 6 THEN -1.0 WHEN z BETWEEN 0.5 AND 4 THEN 0.01 ELSE 0.03 END AS sigma, count(*) AS n FROM points GROUP BY 1", "points"))
def zoned_noise(spark, sf_dir):
    s = P.zoned_noise(F.col("z"))
    return points(spark, sf_dir).groupBy(F.when(s < 1, F.round(s, 6)).otherwise(-1.0).alias("sigma")).agg(F.count("*").alias("n"))


@query("f29_f30_levels", sql("SELECT CASE WHEN z < 2.5 THEN 0 WHEN z < 2.75 THEN 0 WHEN z < 6.25 THEN 1 ELSE 2 END AS level, CASE WHEN z < 2.75 THEN 0 WHEN z < 6.25 THEN 1 ELSE 2 END AS slot, count(*) AS n FROM points GROUP BY ALL", "points"))
def levels(spark, sf_dir):
    level = L.level_of_point(F.col("z"), [0.0, 3.0, 6.5], [2.5, 6.0, 10.0])
    return points(spark, sf_dir).groupBy(level.alias("level"), L.level_of_elevation(F.col("z"), [2.75, 6.25]).alias("slot")).agg(F.count("*").alias("n"))


@query("f32_f33_interior", "SELECT l_discount * 10 > 0.5 AS interior, (l_discount * 10 <= 0.5) AND l_linenumber - 3 >= 0 AS object, (l_discount * 10 > 0.5) OR l_linenumber - 3 >= 0 AS room, count(*) AS n FROM lineitem GROUP BY ALL")
def interior(spark, sf_dir):
    p, room = F.col("l_discount") * 10, F.col("l_linenumber") - 3
    return table(spark, sf_dir, "lineitem").groupBy(L.is_interior(p).alias("interior"), L.segmentation_interior(p, room, "OBJECTS").alias("object"), L.segmentation_interior(p, room, "ROOM").alias("room")).agg(F.count("*").alias("n"))
