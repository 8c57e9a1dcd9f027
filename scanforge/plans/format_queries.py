"""Queries of sources and sinks: rows of the tables are written in a format, read again, and returned as they come back."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators.components import checkpoint_folder
from ..sources import binary as B
from ..sources import sensors as S
from ..sources import text as T
from ..sources import writers as K
from .inputs import points, poses, seconds, sql, table
from .registry import query, round_all


def _folder(spark, end: str = "") -> str:
    """A new folder's name in the shared folder."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4()}{end}"


def _lines(lines: DataFrame, end: str = "") -> str:
    path = _folder(lines.sparkSession, end)
    lines.write.text(path)
    return path


def _documents(files: DataFrame) -> str:
    path = _folder(files.sparkSession)
    K.write_documents(files, path)
    return path


def _key(column: str = "file"):
    """The number in the name of a folder file=..."""
    return F.regexp_extract(column, r"file=(\d+)", 1).cast("long")


def _with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("file", _key())


def _line(*cols):
    return F.concat_ws(" ", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]).alias("value")


#: Order of the lines of an order.
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


# --- points ---------------------------------------------------------------------------------------------------------------


@query("s02_k02_xyz", sql("SELECT x, y, z, r, g, b, index, timestamp, valid FROM points", "points"))
def xyz(spark, sf_dir):
    path = _folder(spark)
    K.write_points(points(spark, sf_dir), path, "xyz")
    return T.load_points(spark, path, "xyz")


@query("s03_k03_pts", sql("SELECT x, y, z, r, g, b, 0 AS index, 0.0::DOUBLE AS timestamp FROM points", "points"))
def pts(spark, sf_dir):
    path = _folder(spark)
    K.write_points(points(spark, sf_dir), path, "pts")
    return T.load_points(spark, path, "pts").drop("valid")


@query("s04_k04_obj", sql("SELECT x, y, z FROM points", "points"))
def obj(spark, sf_dir):
    path = _folder(spark)
    K.write_points(points(spark, sf_dir), path, "obj")
    return T.load_points(spark, path, "obj").select("x", "y", "z")


@query("k05_pcd", sql("SELECT x, y, z, r * 65536 + g * 256 + b AS rgb FROM points UNION ALL SELECT count(*), 0, 0, 0 FROM points", "points"))
def pcd(spark, sf_dir):
    path = _folder(spark)
    K.write_points(points(spark, sf_dir), path, "pcd")
    t = F.split("value", " ")
    body = spark.read.text(path).select(*[F.get(t, k).cast("double").alias(a) for k, a in enumerate("xyz")], F.get(t, 3).cast("int").alias("rgb"))
    header = spark.read.text(f"{path}/header").where("value like 'POINTS %'").select(F.get(t, 1).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0).alias("rgb"))
    return body.union(header)


@query("s05_k06_las", sql("SELECT round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, r, g, b, timestamp FROM points", "points"))
def las(spark, sf_dir):
    files = B.encoded(points(spark, sf_dir).withColumn("file", F.col("frame") % 64), "file", lambda p: B.encode_las(p, 0.00001))
    return round_all(B.read_las(spark, files).select("x", "y", "z", "r", "g", "b", "timestamp"), 5)


@query("s01_k01_formats", sql("SELECT fmt, count(*) AS n, round(sum(z), 3) AS z FROM points, (VALUES ('xyz'), ('pts'), ('obj')) f(fmt) GROUP BY fmt", "points"))
def formats(spark, sf_dir):
    """The format is taken from the extension, for writing and for reading."""
    out = None
    for fmt in ("xyz", "pts", "obj"):
        path = _folder(spark, f".{fmt}")
        K.write_points(points(spark, sf_dir), path, fmt)
        one = T.load_points(spark, path).agg(F.lit(fmt).alias("fmt"), F.count("*").alias("n"), F.round(F.sum("z"), 3).alias("z"))
        out = one if out is None else out.union(one)
    return out


@query("s06_scaled_points", sql("SELECT round(x * 0.01, 9) AS x, CASE WHEN part % 3 > 0 THEN r ELSE 0 END AS r, CASE WHEN part % 3 = 2 THEN index ELSE 0 END AS index, CASE part % 3 WHEN 1 THEN 0.0 ELSE timestamp END AS timestamp FROM points", "points"))
def scaled(spark, sf_dir):
    p, n = points(spark, sf_dir), F.col("part") % 3
    lines = p.select(F.when(n == 0, _line("x", "y", "z", "timestamp")).when(n == 1, _line("x", "y", "z", "r", "g", "b")).otherwise(_line("x", "y", "z", "r", "g", "b", "index", "timestamp", F.lit("s1"))).alias("value"))
    return round_all(T.read_scaled_points(spark, _lines(lines), "cm").select("x", "r", "index", "timestamp"), 9)


@query("s46_nearest_pose_of_points", sql(", q AS (SELECT timestamp, count(*) AS n FROM points GROUP BY 1) SELECT q.timestamp, n, (SELECT arg_min(ts, (abs(ts - q.timestamp), -ts)) FROM poses p) AS ts FROM q", "points", "poses"))
def points_at_poses(spark, sf_dir):
    path = _folder(spark)
    K.write_points(points(spark, sf_dir), path, "xyz")
    counts = T.load_points(spark, path, "xyz").groupBy("timestamp").agg(F.count("*").alias("n"))
    return J.nearest(counts, poses(spark, sf_dir).select("ts"), "timestamp", "ts", 30 * 86400.0).select("timestamp", "n", "ts")


@query("k23_level_split", sql("SELECT part % 5 AS level, x, y, z, timestamp FROM points", "points"))
def level_split(spark, sf_dir):
    path = _folder(spark)
    K.write_by_level(points(spark, sf_dir).withColumn("level", F.col("part") % 5), path)
    t = F.split("value", " ")
    return spark.read.text(path).select(F.col("level").cast("long").alias("level"), *[F.get(t, k).cast("double").alias(a) for k, a in ((0, "x"), (1, "y"), (2, "z"), (7, "timestamp"))])


@query("k56_transformed_points", sql("SELECT round(x * 2 + 1.5, 9) AS x, round(y * 2 + 1.5, 9) AS y, round(z * 2 + 1.5, 9) AS z FROM points", "points"))
def transformed(spark, sf_dir):
    from ..operators.filters import model_transform

    path = _folder(spark)
    K.write_points(model_transform(points(spark, sf_dir), 2.0, 1.5), path, "obj")
    return round_all(T.load_points(spark, path, "obj").select("x", "y", "z"), 9)


# --- paths, wedges, chunks, trees -----------------------------------------------------------------------------------------


@query("s07_path_text", sql("SELECT ts AS timestamp, px AS x, py AS y, pz AS z FROM poses", "poses"))
def path_text(spark, sf_dir):
    return T.read_path_text(spark, _lines(poses(spark, sf_dir).select(_line("px", "py", "pz", "ts"))))


@query("s25_camera_poses", sql("SELECT ts AS timestamp, px AS x, py AS y, pz AS z, 0.5::DOUBLE AS roll, -1.5::DOUBLE AS pitch, yaw FROM poses", "poses"))
def camera_poses(spark, sf_dir):
    return T.read_camera_poses(spark, _lines(poses(spark, sf_dir).select(_line("ts", "px", "py", "pz", F.lit(0.5), F.lit(-1.5), "yaw"))))


def _path_rows(spark, sf_dir):
    return poses(spark, sf_dir).select((F.col("yaw") % 8).cast("long").alias("file"), F.col("ts").alias("timestamp"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), F.lit(0.25).alias("roll"), F.lit(0.5).alias("pitch"), "yaw")


@query("s26_k10_k55_path", sql("SELECT CAST(yaw % 8 AS BIGINT) AS file, ts AS timestamp, px AS x, py AS y, pz AS z, 0.25::DOUBLE AS roll, yaw FROM poses", "poses"))
def path(spark, sf_dir):
    files = B.encoded(_path_rows(spark, sf_dir), "file", lambda p: B.encode_path(p.sort_values("timestamp"), [(p["timestamp"].min(), p["timestamp"].max())]))
    return B.read_path(spark, files).select(F.col("path").cast("long").alias("file"), "timestamp", "x", "y", "z", "roll", "yaw")


@query("s26_path_rests", sql("SELECT CAST(yaw % 8 AS BIGINT) AS file, min(ts) AS t0, max(ts) AS t1 FROM poses GROUP BY 1", "poses"))
def path_rests(spark, sf_dir):
    files = B.encoded(_path_rows(spark, sf_dir), "file", lambda p: B.encode_path(p, [(p["timestamp"].min(), p["timestamp"].max())]))
    return B.read_path_rests(spark, files).select(F.col("path").cast("long").alias("file"), "t0", "t1")


@query("s27_k09_noisy_path", sql("SELECT ts AS timestamp, px AS mean_x, yaw AS mean_yaw, px / 4 AS cxx, yaw + 5 AS crr FROM poses", "poses"))
def noisy_path(spark, sf_dir):
    def encode(p):
        rec = pd.DataFrame({"timestamp": p["timestamp"], "mean_x": p["x"], "mean_y": p["y"], "mean_z": p["z"], "mean_roll": p["roll"], "mean_pitch": p["pitch"], "mean_yaw": p["yaw"]})
        rec["cov_pos"] = [[v / 4] + [0.0] * 5 for v in p["x"]]
        rec["cov_rot"] = [[0.0] * 5 + [v + 5] for v in p["yaw"]]
        return B.encode_noisy_path(rec)

    got = B.read_noisy_path(spark, B.encoded(_path_rows(spark, sf_dir), "file", encode))
    return got.select("timestamp", "mean_x", "mean_yaw", F.get("cov_pos", 0).alias("cxx"), F.get("cov_rot", 5).alias("crr"))


@query("s10_s28_nearest_record", sql(", q AS (SELECT DISTINCT timestamp + 3600 * 5 AS t FROM points) SELECT t, (SELECT arg_min(ts, (abs(ts - t), -ts)) FROM poses) AS near FROM q", "points", "poses"))
def nearest_record(spark, sf_dir):
    files = B.encoded(_path_rows(spark, sf_dir), "file", lambda p: B.encode_path(p.sort_values("timestamp")))
    q = points(spark, sf_dir).select((F.col("timestamp") + 3600 * 5).alias("t")).distinct()
    return J.nearest(q, B.read_path(spark, files).select(F.col("timestamp").alias("near")), "t", "near", 30 * 86400.0).select("t", "near")


@query("s29_k11_carve_map", "WITH c AS (SELECT l_suppkey % 16 AS file, dense_rank() OVER (PARTITION BY l_suppkey % 16 ORDER BY l_orderkey) - 1 AS frame, row_number() OVER (PARTITION BY l_suppkey % 16, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS point, l_quantity AS x, l_discount AS planar_prob, l_orderkey * 1.0::DOUBLE AS sx FROM lineitem) SELECT file, frame, point, x, x + 1 AS cov, planar_prob, sx FROM c")
def carve_map(spark, sf_dir):
    def encode(file, p, sizes):
        keys = p["l_orderkey"].to_numpy(float)[np.cumsum(sizes) - sizes]
        points = np.zeros((len(p), 11))
        points[:, 0], points[:, 3], points[:, 9], points[:, 10] = p["l_quantity"], p["l_quantity"] + 1, p["l_discount"], p["l_tax"]
        return B.carve_bytes(np.c_[keys, np.zeros((len(keys), 2)), np.full((len(keys), 6), 0.5)], sizes, points)

    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("file"), "l_orderkey", *_LINE_ORDER, "l_quantity", "l_discount", "l_tax")
    files = B.encoded_frames(rows, "file", "l_orderkey", _LINE_ORDER, encode, lambda file, n: b"carvmap\0" + struct.pack("<Q", n))
    got = B.read_carve_map(spark, files)
    return got.select(F.col("path").cast("long").alias("file"), "frame", "point", F.get("point_mean", 0).alias("x"), F.get("point_cov", 0).alias("cov"), "planar_prob", F.get("sensor_mean", 0).alias("sx"))


@query("s30_k12_wedges", "SELECT l_suppkey % 16 AS file, l_orderkey AS frame_a, CAST(l_linenumber AS BIGINT) AS a1, l_partkey AS b2, count(*) AS n FROM lineitem GROUP BY ALL")
def wedges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("file"), F.col("l_orderkey").alias("frame_a"), F.col("l_linenumber").alias("a1"), (F.col("l_linenumber") + 1).alias("a2"), (F.col("l_orderkey") + 1).alias("frame_b"), F.col("l_linenumber").alias("b1"), F.col("l_partkey").alias("b2"))
    got = B.read_wedges(spark, B.encoded(rows, "file", lambda p: B.encode_wedges(p, 3.0)))
    return got.groupBy(F.col("path").cast("long").alias("file"), "frame_a", "a1", "b2").agg(F.count("*").alias("n"))


@query("s32_k13_chunks", "SELECT DISTINCT printf('%016x', l_suppkey) AS chunk_id, l_suppkey * 0.5::DOUBLE AS cx, l_partkey AS wedge_id FROM lineitem")
def chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), "l_partkey")
    files = B.encoded(rows, "file", lambda p: B.encode_chunk(int(p["file"].iloc[0]), (p["file"].iloc[0] * 0.5, 0.0, 0.0, 1.0), p["l_partkey"]))
    return B.read_chunks(spark, files).select("chunk_id", "cx", "wedge_id")


@query("s31_k14_chunk_list", "SELECT s_nationkey AS file, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS chunk_id, s_nationkey + 0.5::DOUBLE AS cx, 100.0::DOUBLE AS hw FROM supplier")
def chunk_list(spark, sf_dir):
    n = F.col("s_nationkey")
    rows = table(spark, sf_dir, "supplier").select(n.alias("file"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("chunk_id"), (n + 0.5).alias("cx"), F.lit(0.0).alias("cy"), F.lit(1.0).alias("cz"), F.lit(100.0).alias("hw"))
    return _with_key(T.read_chunk_list(spark, _documents(K.chunk_list_documents(rows)))).select(F.col("file").cast("int").alias("file"), "chunk_id", "cx", "hw")


@query("s33_s60_k15_tree", "SELECT 5 AS depth, p_partkey % 32 + 0.5::DOUBLE AS cx, (p_partkey // 32) % 32 + 0.5::DOUBLE AS cy, count(*) AS count, sum(p_size) * 1.0::DOUBLE AS total_weight, max(p_size) AS fp_room FROM part GROUP BY ALL")
def tree(spark, sf_dir):
    k = F.col("p_partkey")
    zero = {c: F.lit(0.0) for c in ("prob_sum", "prob_sum_sq", "surface_sum", "corner_sum", "planar_sum")}
    leaves = table(spark, sf_dir, "part").groupBy((k % 32 + 0.5).alias("cx"), (F.floor(k / 32) % 32 + 0.5).alias("cy")).agg(F.count("*").alias("count"), F.sum("p_size").cast("double").alias("total_weight"), F.max("p_size").alias("fp_room"))
    leaves = leaves.withColumns(zero | {"cz": F.lit(0.5), "hw": F.lit(0.5), "file": F.lit(1)})
    files = B.encoded(leaves, "file", lambda p: B.encode_tree(p, (16.0, 16.0, 16.0, 16.0), 5))
    return B.read_tree(spark, files).select("depth", "cx", "cy", "count", "total_weight", "fp_room")


@query("s34_k16_interior_histogram", "SELECT CAST(p_size AS INT) AS level, p_partkey * 0.5::DOUBLE AS cx, p_retailprice AS open_height, 0.25::DOUBLE AS res FROM part")
def interior_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("file"), (F.col("p_partkey") * 0.5).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("min_z"), F.lit(2.0).alias("max_z"), F.col("p_retailprice").alias("open_height"))
    files = B.encoded(rows, "file", lambda p: B.encode_interior_histogram(p, int(p["file"].iloc[0]), 0.25))
    return B.read_interior_histogram(spark, files).select("level", "cx", "open_height", "res")


# --- scans and sensor logs ------------------------------------------------------------------------------------------------

_FORMS = ("ascii", "little_endian", "big_endian")


def _scan_files(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 15).alias("file"), "l_orderkey", *_LINE_ORDER, "l_quantity", "l_tax", "l_discount")
    form = lambda file: _FORMS[file % 3]

    def encode(file, p, sizes):
        points = np.zeros(len(p), B.FSS_POINT)
        for name, values in (("x", p["l_quantity"]), ("y", p["l_extendedprice"]), ("z", p["l_tax"]), ("intensity", p["l_linenumber"]), ("bias", 0.25), ("stddev", p["l_discount"]), ("width", 0.5)):
            points[name] = values
        return B.scan_bytes(p["l_orderkey"].to_numpy(float)[np.cumsum(sizes) - sizes], sizes, points, form(file))

    return B.encoded_frames(rows, "file", "l_orderkey", _LINE_ORDER, encode, lambda file, n: B.scan_head(f"scanner{file}", "centimeters", form(file), n))


@query("s08_s11_s61_k07_frames", "SELECT concat('scanner', l_suppkey % 15) AS scanner, CAST(l_orderkey AS DOUBLE) AS timestamp, count(*) AS points, round(sum(l_quantity), 6) AS x, CAST(sum(l_linenumber) AS BIGINT) AS intensity FROM lineitem GROUP BY ALL")
def frames(spark, sf_dir):
    got = B.read_scan_frames(spark, _scan_files(spark, sf_dir)).select("scanner", "timestamp", F.explode("points").alias("p"))
    return got.groupBy("scanner", "timestamp").agg(F.count("*").alias("points"), F.round(F.sum("p.x"), 6).alias("x"), F.sum("p.intensity").alias("intensity"))


@query("s09_scan_points", "SELECT concat('scanner', l_suppkey % 15) AS scanner, CAST(l_orderkey AS DOUBLE) AS timestamp, l_linenumber AS intensity, round(l_extendedprice * 0.01 * (1 + 0.0025 / sqrt(l_quantity * l_quantity * 0.0001 + l_extendedprice * l_extendedprice * 0.0001 + l_tax * l_tax * 0.0001)), 5) AS y FROM lineitem")
def scan_points(spark, sf_dir):
    got = B.scan_points(B.read_scan_frames(spark, _scan_files(spark, sf_dir)))
    return got.select("scanner", "timestamp", "intensity", F.round("y", 5).alias("y"))


def _log(spark, rows, kind, header, frame):
    """Rows of (file, ...) as logs of a kind, read again."""

    def encode(p):
        return S.encode(kind, header(p), [frame(r) for r in p.sort_values(list(p.columns)).to_dict("records")])

    return S.read_log(spark, B.encoded(rows, "file", encode), kind)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("file"), "event_id", "user_id", "value")


@query("s12_range_log", "SELECT event_id AS timestamp, CAST(user_id + 1 AS BIGINT) AS second, concat('H', user_id % 16) AS serial, 0.25::DOUBLE AS angle FROM events")
def range_log(spark, sf_dir):
    head = lambda p: {"major": 1, "minor": 0, "model": "m", "serial": f"H{p['file'].iloc[0]}", "header_size": 0, "intensities": 0, "points": 3, "max_range": 9, "min_range": 1, "angles": [0.0, 0.25, 0.5]}
    got = _log(spark, _events(spark, sf_dir), "range2d", head, lambda r: {"timestamp": r["event_id"], "ranges": [r["user_id"], r["user_id"] + 1, 7]})
    p = S.range_points(got).where("point = 1")
    serial = got.select("timestamp", "serial")
    return p.join(serial, "timestamp").select("timestamp", F.col("range_mm").cast("long").alias("second"), "serial", "angle")


@query("s13_depth_log", "SELECT event_id AS timestamp, user_id % 100 * 0.001::DOUBLE AS x, 0.002::DOUBLE AS z, 5 AS intensity FROM events")
def depth_log(spark, sf_dir):
    head = lambda p: {"width": 2, "height": 1, "fps": 30, "frequency": 1}
    got = _log(spark, _events(spark, sf_dir), "depth", head, lambda r: {"timestamp": r["event_id"], "xs": [r["user_id"] % 100, 1], "ys": [0, 0], "zs": [2, 3], "ns": [5, 6]})
    return S.depth_points(got).where("pixel = 0").select(F.col("timestamp").cast("long").alias("timestamp"), "x", "z", F.col("intensity").cast("int").alias("intensity"))


@query("s14_tango", "SELECT CAST(event_id AS DOUBLE) AS timestamp, value AS px, 0.5::DOUBLE AS qx, CAST(user_id AS DOUBLE) AS x FROM events")
def tango(spark, sf_dir):
    def encode(file, p, sizes):
        n, zero = len(p), np.zeros(len(p))
        points = np.tile(np.array([0.0, 1, 2, 3, 4, 5]), (n, 1))
        points[:, 0] = p["user_id"]
        return S.tango_bytes(p["event_id"].to_numpy(float), np.c_[p["value"], zero, zero], np.tile([1.0, 0.5, 0.0, 0.0], (n, 1)), np.full(n, 2), points)

    # each event is a frame of its own, so that a piece may end after any
    rows = _events(spark, sf_dir).withColumn("row", F.monotonically_increasing_id())
    files = B.encoded_frames(rows, "file", "row", [], encode, lambda file, n: S.TANGO_HEAD)
    got = S.read_tango(spark, files)
    return got.select("timestamp", F.get("position", 0).alias("px"), F.get("quaternion", 1).alias("qx"), F.get("points.x", 0).alias("x"))


@query("s15_inertial_log", "SELECT CAST(event_id AS DOUBLE) AS timestamp, CAST(user_id % 90 AS DOUBLE) AS yaw, 0.5::DOUBLE AS ax, CAST(user_id % 7 AS BIGINT) AS status FROM events WHERE event_id < 16000000")
def inertial_log(spark, sf_dir):
    zero = [0.0, 0.0, 0.0]
    blank = {"still_time": 0.0, "quaternion": [1.0, 0.0, 0.0, 0.0], "compass_yaw": 0.0, **{c: zero for c in ("rate_body", "rate_nav", "acceleration_nav", "velocity_nav", "rate_raw", "magnetic")}, "temperature": 20.0}
    head = lambda p: {"major": 1, "minor": 0, "model": "m", "serial": "s", "header_size": 0, "enhancement": 0, "sensitivity": 0, "query_ms": 5}
    # times are single precision: whole numbers hold up to 2 ** 24
    rows = _events(spark, sf_dir).where("event_id < 16000000")
    got = _log(spark, rows, "inertial", head, lambda r: blank | {"timestamp": r["event_id"], "euler": [0.0, 0.0, r["user_id"] % 90], "acceleration_body": [0.5, 0.0, 9.0], "status": r["user_id"] % 7})
    return got.select("timestamp", F.get("euler", 2).alias("yaw"), F.get("acceleration_body", 0).alias("ax"), "status")


@query("s16_magnetometer_log", "SELECT round(event_id * 0.001::DOUBLE, 6) AS timestamp, CAST(user_id % 1000 - 500 AS DOUBLE) AS second, 1.5::DOUBLE AS gain FROM events")
def magnetometer_log(spark, sf_dir):
    head = lambda p: {"major": 1, "minor": 0, "header_size": 0, "sensors": 1, "gain": 1.5, "unit": 0.001}
    got = _log(spark, _events(spark, sf_dir), "magnetometer", head, lambda r: {"timestamp": r["event_id"], "readings": [1, r["user_id"] % 1000 - 500, 3]})
    return got.select(F.round("timestamp", 6).alias("timestamp"), F.get("readings", 1).alias("second"), "gain")


@query("s17_barometer_log", "SELECT round(event_id * 0.001::DOUBLE, 6) AS timestamp, CAST(user_id % 300 AS BIGINT) AS temperature, round((event_id + 1) * 0.001::DOUBLE, 6) AS pressure_time, CAST(user_id % 60000 AS BIGINT) AS pressure, CAST(11 AS BIGINT) AS first FROM events")
def barometer_log(spark, sf_dir):
    head = lambda p: {"major": 1, "minor": 0, "header_size": 0, "calibration": list(range(11, 22)), "oversampling": 3, "unit": 0.001}
    got = _log(spark, _events(spark, sf_dir), "barometer", head, lambda r: {"timestamp": r["event_id"], "temperature": r["user_id"] % 300, "pressure_time": r["event_id"] + 1, "pressure": r["user_id"] % 60000, "pressure_low": 9})
    return got.select(F.round("timestamp", 6).alias("timestamp"), "temperature", F.round("pressure_time", 6).alias("pressure_time"), "pressure", F.get("calibration", 0).alias("first"))


@query("s18_gps_log", "SELECT event_id AS timestamp, concat('$GP', user_id) AS sentence FROM events")
def gps_log(spark, sf_dir):
    def frame(r):
        data = f"$GP{r['user_id']}".encode()
        return {"timestamp": r["event_id"], "size": len(data), "data": data}

    got = _log(spark, _events(spark, sf_dir), "gps", lambda p: {"major": 1, "minor": 0, "header_size": 0}, frame)
    return got.select(F.col("timestamp").cast("long").alias("timestamp"), F.decode("data", "utf-8").alias("sentence"))


@query("s19_wifi_log", "SELECT event_id AS seconds, printf('%02x', user_id % 256) || ':00:01:02:03:04' AS mac, concat('net ', user_id) AS ssid, CAST(2400 + user_id % 100 AS BIGINT) AS frequency, CAST(-(user_id % 90) AS BIGINT) AS level FROM events")
def wifi_log(spark, sf_dir):
    def frame(r):
        name = f"net {r['user_id']}"
        return {"seconds": r["event_id"], "micros": 1, "system_time": 2, "bssid": [r["user_id"] % 256, 0, 1, 2, 3, 4], "level": -(r["user_id"] % 90), "frequency": 2400 + r["user_id"] % 100, "tag": 0, "size": len(name), "ssid": name}

    got = _log(spark, _events(spark, sf_dir), "wifi", lambda p: {"major": 1, "minor": 0}, frame)
    return got.select("seconds", "mac", "ssid", "frequency", "level")


@query("s47_k08_planar_scans", "SELECT l_suppkey % 16 AS serial, CAST(l_orderkey AS DOUBLE) AS timestamp, count(*) AS points, round(sum(1 - l_tax), 6) AS x, round(sum(2 + l_quantity), 6) AS y, 3.0::DOUBLE AS z FROM lineitem GROUP BY ALL")
def planar_scans(spark, sf_dir):
    def encode(file, p, sizes):
        return B.planar_bytes(p["l_orderkey"].to_numpy(float)[np.cumsum(sizes) - sizes], sizes, p[["l_quantity", "l_tax"]].to_numpy(float) * 1000)

    head = lambda file, n: B.planar_head(int(file), [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 3.0], n)
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("file"), "l_orderkey", "l_quantity", "l_tax")
    got = B.read_planar_scans(spark, B.encoded_frames(rows, "file", "l_orderkey", [], encode, head))
    return got.groupBy("serial", "timestamp").agg(F.count("*").alias("points"), F.round(F.sum("x"), 6).alias("x"), F.round(F.sum("y"), 6).alias("y"), F.max("z").alias("z"))


@query("s59_camera_model", "SELECT n_name AS camera, n_nationkey + 100.5::DOUBLE AS fx, n_regionkey * 0.125::DOUBLE AS k1 FROM nation")
def camera_model(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file"), "n_name", "n_regionkey")
    files = B.encoded(rows, "file", lambda p: B.encode_camera_model(p["n_name"].iloc[0], [p["file"].iloc[0] + 100.5, *[0.0] * 8], [p["n_regionkey"].iloc[0] * 0.125, *[0.0] * 4]))
    return B.read_camera_model(spark, files).select("camera", F.get("k", 0).alias("fx"), F.get("distortion", 0).alias("k1"))


# --- lists and logs of images ---------------------------------------------------------------------------------------------


@query("s20_camera_log", "SELECT CAST(event_id AS INT) AS image, concat('i', event_id, '.jpg') AS file, epoch(ts) AS camera_time, value AS exposure, 1.5::DOUBLE AS gain FROM events")
def camera_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return T.read_camera_log(spark, _lines(e.select(_line(F.concat(F.lit("i"), "event_id", F.lit(".jpg")), "event_id", seconds("ts"), "value", F.lit(1.5)))))


@query("s21_image_list", "SELECT CAST(event_id AS INT) AS image, concat('i', event_id, '.jpg') AS file, epoch(ts) AS timestamp, value AS exposure, 1.5::DOUBLE AS gain FROM events")
def image_list(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return T.read_image_list(spark, _lines(e.select(_line("event_id", F.concat(F.lit("i"), "event_id", F.lit(".jpg")), seconds("ts"), "value", F.lit(1.5)))))


@query("s22_k62_camera_file", "SELECT o_custkey % 32 AS file, concat('V', o_custkey % 32) AS serial, 0.5::DOUBLE AS k0, o_custkey % 32 * 1.5::DOUBLE AS tx, 'mask.png' AS mask, concat('img', o_orderkey) AS image, o_totalprice AS timestamp FROM orders")
def camera_file(spark, sf_dir):
    f = F.col("o_custkey") % 32
    rows = table(spark, sf_dir, "orders").select(f.alias("file"), F.concat(F.lit("V"), f).alias("serial"), F.array(*[F.lit(0.5)] * 9).alias("k"), F.array(*[F.lit(1.0)] * 9).alias("r"), F.array(f * 1.5, F.lit(0.0), F.lit(0.0)).alias("translation"), F.concat(F.lit("img"), "o_orderkey").alias("image"), F.col("o_totalprice").alias("timestamp"))
    got = _with_key(T.read_camera_file(spark, _documents(K.camera_documents(rows, "mask.png"))))
    return got.select("file", "serial", F.get("k", 0).alias("k0"), F.get("translation", 0).alias("tx"), "mask", "image", "timestamp")


@query("s23_s24_s54_frame_list", "SELECT CAST(event_id AS INT) AS frame, concat('d', event_id) AS file, epoch(ts) AS timestamp FROM events")
def frame_list(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return T.read_frame_list(spark, _lines(e.select(_line("event_id", F.concat(F.lit("d"), "event_id"), seconds("ts")))))


@query("s43_k24_panorama_list", "SELECT concat('p', o_orderkey) AS file, CAST(o_orderkey AS DOUBLE) AS timestamp, o_totalprice AS x, o_custkey * 0.5::DOUBLE AS y, 1.0::DOUBLE AS z FROM orders")
def panorama_list(spark, sf_dir):
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((o % 32).alias("file"), o.alias("n"), F.concat(F.lit("p"), o).alias("name"), o.cast("double").alias("timestamp"), F.col("o_totalprice").alias("x"), (F.col("o_custkey") * 0.5).alias("y"), F.lit(1.0).alias("z"))
    return T.read_panorama_list(spark, _documents(K.panorama_list_documents(rows, 10, 20, ["left", "right"])))


@query("s41_image_map", "SELECT o_custkey * 0.5::DOUBLE AS cx, 2.0::DOUBLE AS cy, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS images FROM orders GROUP BY o_custkey")
def image_map(spark, sf_dir):
    cells = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") * 0.5).alias("cx")).agg(F.lit(2.0).alias("cy"), F.array_sort(F.collect_list("o_orderkey")).alias("images"))
    got = T.read_image_map(spark, _lines(K.image_map_lines(cells)))
    return got.select("cx", "cy", F.concat_ws(",", F.transform("images", lambda v: v.cast("string"))).alias("images"))


@query("s42_k57_coordinate_map", "SELECT n_nationkey AS file, 0.125::DOUBLE AS resolution, n_regionkey * 1.5::DOUBLE AS offset_x, n_nationkey - 7.25::DOUBLE AS offset_y FROM nation")
def coordinate_map(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_nationkey").alias("file"), F.lit(0.125).alias("resolution"), (F.col("n_regionkey") * 1.5).alias("offset_x"), (F.col("n_nationkey") - 7.25).alias("offset_y"))
    return T.read_coordinate_map(spark, _documents(K.coordinate_map_documents(rows))).select(_key().cast("int").alias("file"), "resolution", "offset_x", "offset_y")


# --- plans, grids, meshes -------------------------------------------------------------------------------------------------

_STRIP = "v AS (SELECT l_suppkey AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS v, l_partkey * 0.5::DOUBLE AS x, l_suppkey * 1.5::DOUBLE AS y FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)), t AS (SELECT file, v AS t, v AS i, v + 1 AS j, v + 2 AS k FROM v WHERE v + 2 <= (SELECT max(v) FROM v o WHERE o.file = v.file))"


def _strip(spark, sf_dir):
    """For each supplier a strip of triangles over its parts: (file, v, x, y) and (file, t, i, j, k)."""
    from pyspark.sql import Window

    s, p = F.col("l_suppkey"), F.col("l_partkey")
    w = Window.partitionBy("file").orderBy("p")
    v = table(spark, sf_dir, "lineitem").select(s.alias("file"), p.alias("p")).distinct()
    v = v.select("file", (F.row_number().over(w) - 1).alias("v"), (F.col("p") * 0.5).alias("x"), (F.col("file") * 1.5).alias("y"), F.lead("p", 2).over(w).alias("after"))
    t = v.where("after is not null").select("file", F.col("v").alias("t"), F.col("v").alias("i"), (F.col("v") + 1).alias("j"), (F.col("v") + 2).alias("k"))
    return v.drop("after"), t


def _plan(spark, sf_dir):
    v, t = _strip(spark, sf_dir)
    rooms = t.select("file", (F.col("t") % 3).alias("room"), F.lit(0.5).alias("z_min"), (F.col("t") % 3 + 2.5).alias("z_max"), "t")
    # rooms are numbered by their lines, from 0
    path = _documents(K.floor_plan_documents(0.05, v, t, rooms))
    return T.read_floor_plan(spark, path)


@query("s37_s38_k20_floor_plan", f"WITH {_STRIP} SELECT t.file, CAST(t AS INT) AS t, CAST(t % 3 AS INT) AS room, t % 3 + 2.5::DOUBLE AS z_max, CAST(k AS INT) AS k, a.x AS x, a.y AS y FROM t JOIN v a ON a.file = t.file AND a.v = t.i")
def floor_plan(spark, sf_dir):
    v, t, rooms = (_with_key(d) for d in _plan(spark, sf_dir))
    return t.join(rooms.select("file", "t", "room", "z_max"), ["file", "t"]).join(v.withColumnRenamed("v", "i"), ["file", "i"]).select("file", "t", "room", "z_max", "k", "x", "y")


@query("k21_extruded_plan", f"WITH {_STRIP}, n AS (SELECT file, count(*) AS v FROM v GROUP BY 1), m AS (SELECT file, count(*) AS t FROM t GROUP BY 1) SELECT n.file, 2 * n.v AS vertices, 2 * coalesce(m.t, 0) + 2 * CASE WHEN m.t IS NULL THEN 0 ELSE m.t + 2 END AS faces FROM n LEFT JOIN m USING (file)")
def extruded_plan(spark, sf_dir):
    """A strip of n triangles has n + 2 sides of one triangle only, and so as many walls of two triangles."""
    v, t = _strip(spark, sf_dir)
    path = _documents(K.extruded_plan_documents(v.withColumns({"z_min": F.lit(0.0), "z_max": F.lit(2.5)}), t))
    verts, faces = (_with_key(d) for d in T.read_mesh_obj(spark, path))
    return verts.groupBy("file").agg(F.count("*").alias("vertices")).join(faces.groupBy("file").agg(F.count("*").alias("faces")), "file", "left").select("file", "vertices", F.coalesce("faces", F.lit(0)).alias("faces"))


@query("s49_k30_mesh_obj", f"WITH {_STRIP} SELECT t.file, CAST(t AS INT) AS f, a.x AS x1, b.x AS x2, c.x AS x3 FROM t JOIN v a ON a.file = t.file AND a.v = i JOIN v b ON b.file = t.file AND b.v = j JOIN v c ON c.file = t.file AND c.v = k")
def mesh_obj(spark, sf_dir):
    v, t = _strip(spark, sf_dir)
    path = _documents(K.mesh_documents(v.withColumn("z", F.lit(0.0)), t.select("file", F.col("t").alias("f"), F.array("i", "j", "k").alias("vertices"))))
    return _corners(*(_with_key(d) for d in T.read_mesh_obj(spark, path)))


def _corners(verts, faces):
    out = faces
    for n in range(3):
        out = out.withColumn("v", F.get("vertices", n)).join(verts.select("file", "v", F.col("x").alias(f"x{n + 1}")), ["file", "v"])
    return out.select("file", F.col("f").cast("int").alias("f"), "x1", "x2", "x3")


def _ply_files(spark, sf_dir, coloured):
    v, t = _strip(spark, sf_dir)
    rows = v.withColumn("n", F.lit(None).cast("array<int>")).unionByName(t.select("file", F.col("t").alias("v"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.array("i", "j", "k").alias("n")))

    def encode(p):
        face = p["n"].notna()
        verts = p[~face].sort_values("v").assign(z=0.0)
        verts = verts.assign(r=verts["v"] % 256, g=7, b=9)
        return B.encode_mesh_ply(verts, [list(map(int, x)) for x in p[face].sort_values("v")["n"]], (*_FORMS, "little_endian")[p["file"].iloc[0] % 3], coloured)

    return B.encoded(rows, "file", encode)


@query("s48_k29_mesh_ply", f"WITH {_STRIP} SELECT t.file, CAST(t AS INT) AS f, a.x AS x1, b.x AS x2, c.x AS x3 FROM t JOIN v a ON a.file = t.file AND a.v = i JOIN v b ON b.file = t.file AND b.v = j JOIN v c ON c.file = t.file AND c.v = k")
def mesh_ply(spark, sf_dir):
    """Places are single precision in files: halves of numbers below 2 ** 23 come back as they are."""
    v, f = B.read_ply(spark, _ply_files(spark, sf_dir, False))
    named = lambda d: d.withColumn("file", F.col("path").cast("long"))
    return _corners(named(v), named(f))


@query("k60_coloured_ply", f"WITH {_STRIP} SELECT file, v, x, CAST(v % 256 AS INT) AS r, 7 AS g, 9 AS b FROM v")
def coloured_ply(spark, sf_dir):
    v, _ = B.read_ply(spark, _ply_files(spark, sf_dir, True))
    return v.select(F.col("path").cast("long").alias("file"), "v", "x", "r", "g", "b")


@query("s39_s40_k22_levels", "SELECT n_nationkey AS level, n_regionkey * 3.5::DOUBLE AS floor, n_regionkey * 3.5 + 2.75::DOUBLE AS ceiling FROM nation")
def levels(spark, sf_dir):
    r = F.col("n_regionkey") * 3.5
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("level"), r.alias("floor"), (r + 2.75).alias("ceiling"))
    return T.read_levels(spark, _lines(K.level_lines(rows).select(F.concat("value", F.lit("  # storey")).alias("value"))))


_SAMPLES = "WITH c AS (SELECT o_custkey * 0.5::DOUBLE AS x, 1.0::DOUBLE AS y, 0.0::DOUBLE AS min_z, 2.5::DOUBLE AS max_z, sum(o_totalprice) / 100000 AS weight, list(o_orderkey ORDER BY o_orderkey) AS poses FROM orders GROUP BY o_custkey)"


def _wall_cells(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") * 0.5).alias("x")).agg((F.sum("o_totalprice") / 100000).alias("weight"), F.array_sort(F.collect_list("o_orderkey")).alias("poses")).withColumns({"y": F.lit(1.0), "min_z": F.lit(0.0), "max_z": F.lit(2.5)})


def _read_cells(spark, lines):
    got = T.read_wall_samples(spark, _lines(lines))
    return got.select("x", "max_z", "num_pts", F.concat_ws(",", F.transform("poses", lambda v: v.cast("string"))).alias("poses"))


@query("s35_s36_k18_wall_samples", f"{_SAMPLES} SELECT x, max_z, CAST(trunc(weight) AS INT) AS num_pts, array_to_string(poses, ',') AS poses FROM c WHERE trunc(weight) > 0")
def wall_samples(spark, sf_dir):
    return _read_cells(spark, K.wall_sample_lines(_wall_cells(spark, sf_dir)))


@query("k17_wall_samples_of_trees", f"{_SAMPLES} SELECT x, max_z, CAST(trunc(weight) AS INT) + 1 AS num_pts, array_to_string(poses, ',') AS poses FROM c WHERE weight > 0")
def tree_wall_samples(spark, sf_dir):
    return _read_cells(spark, K.wall_sample_lines(_wall_cells(spark, sf_dir), form="tree"))


@query("k19_covered_wall_samples", sql(", c AS (SELECT CAST(floor(x / 5) AS BIGINT) AS i0, CAST(floor(y / 5) AS BIGINT) AS i1, count(*) AS num_pts, list_sort(list_distinct(list(b))) AS poses, count(DISTINCT CAST(trunc(z / 0.1) AS BIGINT)) AS bins FROM points GROUP BY ALL) SELECT i0 * 1.0::DOUBLE AS x, CAST(num_pts AS INT) AS num_pts, array_to_string(poses, ',') AS poses FROM c WHERE num_pts >= 50 AND bins >= 8", "points"))
def covered_samples(spark, sf_dir):
    cells = A.wall_coverage(A.with_poses(A.occupancy_cells(points(spark, sf_dir), 5.0, pose="b")), 50, 0.8)
    rows = cells.select(F.col("i0").cast("double").alias("x"), F.col("i1").cast("double").alias("y"), F.lit(0.0).alias("min_z"), F.lit(1.0).alias("max_z"), F.col("num_pts").cast("double").alias("weight"), F.array_sort("poses").alias("poses"))
    return _read_cells(spark, K.wall_sample_lines(rows)).drop("max_z")


@query("s44_k26_voxels", "SELECT CAST(l_orderkey % 1000 AS INT) AS ix, CAST(l_partkey % 100 AS INT) AS iy, CAST(l_linenumber AS INT) AS iz, CAST(l_suppkey % 64 AS INT) AS state, count(*) AS n FROM lineitem GROUP BY ALL")
def voxels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("ix"), (F.col("l_partkey") % 100).alias("iy"), F.col("l_linenumber").alias("iz"), (F.col("l_suppkey") % 64).alias("state"))
    return T.read_voxels(spark, _lines(K.voxel_lines(rows))).groupBy("ix", "iy", "iz", "state").agg(F.count("*").alias("n"))


@query("s50_windows", "SELECT CAST(p_size AS INT) AS v1, CAST(p_partkey AS INT) AS v2, 0.25::DOUBLE AS min_h, p_retailprice AS max_v FROM part")
def windows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(_line("p_size", "p_partkey", F.lit(0.25), F.lit(0.5), F.lit(0.75), "p_retailprice"))
    return T.read_windows(spark, _lines(rows)).select("v1", "v2", "min_h", "max_v")


@query("s51_s53_room_values", "SELECT s_nationkey AS file, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS room, s_acctbal AS watts FROM supplier")
def room_values(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("file")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_acctbal"))).alias("s"))
    path = _documents(rows.select("file", F.transform("s", lambda s: s["s_acctbal"].cast("string")).alias("lines")))
    return T.read_room_values(spark, path, "watts").select(_key().cast("int").alias("file"), "room", "watts")


def _xml(rows, root, tag):
    return _documents(rows.groupBy(F.lit(1).alias("file")).agg(F.concat(F.array(F.lit(f"<{root}>")), F.collect_list("x"), F.array(F.lit(f"</{root}>"))).alias("lines")))


@query("s55_clock_fits", "SELECT n_name AS sensor, 1 + n_regionkey * 0.25::DOUBLE AS slope, n_nationkey * 0.5::DOUBLE AS offset, CASE WHEN n_regionkey = 1 THEN -1.0 ELSE 0.125 END::DOUBLE AS stddev FROM nation")
def clock_fits(spark, sf_dir):
    r = F.col("n_regionkey")
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c.cast("string"), F.lit(f"</{n}>"))
    stddev = F.when(r == 1, F.lit("")).otherwise(tag("stddev", F.lit(0.125)))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("<sensor>"), tag("name", F.col("n_name")), tag("slope", 1 + r * 0.25), tag("offset", F.col("n_nationkey") * 0.5), stddev, F.lit("</sensor>")).alias("x"))
    return T.read_clock_fits(spark, _xml(rows, "sync", "sensor"))


@query("s56_s57_transforms", "SELECT n_name AS sensor, n_regionkey <> 1 AS enabled, n_nationkey * 0.5::DOUBLE AS r0, 2.5::DOUBLE AS t1 FROM nation")
def transforms(spark, sf_dir):
    numbers = lambda *v: F.concat_ws(" ", *[c.cast("string") for c in v])
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    on = F.when(F.col("n_regionkey") == 1, "false").otherwise("true")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("<sensor>"), tag("name", F.col("n_name")), tag("enable", on), tag("R", numbers(F.col("n_nationkey") * 0.5, *[F.lit(0.0)] * 8)), tag("T", numbers(F.lit(1.0), F.lit(2.5), F.lit(3.0))), F.lit("</sensor>")).alias("x"))
    return T.read_transforms(spark, _xml(rows, "hardware", "sensor")).select("sensor", "enabled", F.get("r", 0).alias("r0"), F.get("t", 1).alias("t1"))


@query("s58_settings", "SELECT 'tag' || n_nationkey AS tag, n_name AS value FROM nation")
def settings(spark, sf_dir):
    k = F.concat(F.lit("tag"), F.col("n_nationkey"))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("<"), k, F.lit("> "), "n_name", F.lit(" </"), k, F.lit(">")).alias("x"))
    found = T.read_settings(spark, _xml(rows, "settings", "s"))
    return spark.createDataFrame(sorted(found.items()), "tag string, value string")


@query("k31_panorama_points", "SELECT o_custkey % 32 AS file, o_totalprice AS x, CAST(o_orderkey % 256 AS INT) AS r, round((0.299 * (o_orderkey % 256) + 0.587 * 100 + 0.114 * 50) / 255, 9) AS grey, o_custkey % 32 + 0.5::DOUBLE AS cx FROM orders")
def panorama_points(spark, sf_dir):
    o, f = F.col("o_orderkey"), F.col("o_custkey") % 32
    rows = table(spark, sf_dir, "orders").select(f.alias("file"), (o % 7).alias("row"), o.alias("col"), F.col("o_totalprice").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), (o % 256).cast("int").alias("r"), F.lit(100).alias("g"), F.lit(50).alias("b"), (f + 0.5).alias("cx"), F.lit(1.0).alias("cy"), F.lit(2.0).alias("cz"))
    files = spark.read.text(_documents(K.panorama_point_documents(rows)), wholetext=True).select(F.col("file").cast("long").alias("file"), F.split("value", "\n").alias("lines"))
    t = F.split("line", " ")
    got = files.select("file", F.get(F.split(F.get("lines", 2), " "), 0).cast("double").alias("cx"), F.explode("lines").alias("line")).where(F.size(t) == 7)
    return got.select("file", F.get(t, 0).cast("double").alias("x"), F.get(t, 4).cast("int").alias("r"), F.round(F.get(t, 3).cast("double"), 9).alias("grey"), "cx")


@query("k35_room_stats", "SELECT p_brand AS room, round(sum(p_size), 6) * 1.0::DOUBLE AS area, round(sum(p_size) / 0.3048 / 0.3048, 4) AS area_sqft, round(sum(p_retailprice) / 0.3048 / 0.3048 / 0.3048, 2) AS volume_cuft FROM part GROUP BY 1")
def room_stats(spark, sf_dir):
    rooms = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("room")).agg(F.sum(F.sqrt("p_size")).alias("perimeter"), F.sum("p_size").cast("double").alias("area"), F.sum("p_retailprice").alias("volume"))
    path = _folder(spark)
    K.room_csv(rooms, path)
    got = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return got.select("room", F.col("area").cast("double").alias("area"), F.round("area_sqft", 4).alias("area_sqft"), F.round("volume_cuft", 2).alias("volume_cuft"))


def _tree_leaves(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("leaf"), (k % 64 + 0.5).alias("cx"), (F.floor(k / 64) + 0.5).alias("cy"), F.lit(0.5).alias("cz"), F.lit(0.5).alias("hw"), (k % 3).alias("count"), (k % 3 * 1.0).alias("total_weight"), (k % 3 * F.col("p_size") / 64).alias("prob_sum"), (k % 3 * F.col("p_size") * F.col("p_size") / 4096).alias("prob_sum_sq"), (k % 5 - 1).cast("int").alias("fp_room"))


_LEAVES = "l AS (SELECT p_partkey % 64 + 0.5::DOUBLE AS cx, p_partkey // 64 + 0.5::DOUBLE AS cy, p_partkey % 3 AS count, CASE WHEN p_partkey % 3 > 0 THEN p_size / 64 ELSE 0.5 END AS p, CAST(p_partkey % 5 - 1 AS INT) AS room FROM part)"


@query("k43_leaf_statistics_text", f"WITH {_LEAVES} SELECT p, CAST(CASE WHEN count < 2 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS variance, count(*) AS n FROM l GROUP BY ALL")
def leaf_statistics(spark, sf_dir):
    t = F.split("value", " ")
    got = spark.read.text(_lines(K.leaf_statistic_lines(_tree_leaves(spark, sf_dir))))
    return got.groupBy(F.get(t, 0).cast("double").alias("p"), (F.round(F.get(t, 1).cast("double"), 9) + 0.0).alias("variance")).agg(F.count("*").alias("n"))


@query("k49_leaf_obj", f"WITH {_LEAVES} SELECT cx AS x, cy AS y, CAST(floor(255 * (1 - p)) AS INT) AS r, CAST(floor(255 * p) AS INT) AS g FROM l")
def leaf_obj(spark, sf_dir):
    path = _lines(K.leaf_centre_lines(_tree_leaves(spark, sf_dir)))
    return T.load_points(spark, path, "obj").select("x", "y", "r", "g")


@query("k50_exterior_cubes", f"WITH {_LEAVES}, c(dx, dy, dz) AS (VALUES (1, 1, 1), (1, -1, 1), (-1, -1, 1), (-1, 1, 1), (1, 1, -1), (1, -1, -1), (-1, -1, -1), (-1, 1, -1)) SELECT cx + dx * 0.5 AS x, cy + dy * 0.5 AS y, CASE WHEN count = 0 THEN 255 ELSE 0 END AS r, CAST(floor(255 * p) AS INT) AS b FROM l, c WHERE p <= 0.5 AND room >= 0")
def exterior_cubes(spark, sf_dir):
    path = _lines(K.leaf_cube_lines(_tree_leaves(spark, sf_dir)))
    return T.load_points(spark, path, "obj").select("x", "y", "r", "b")


@query("k59_edges", "SELECT p_size * 0.5::DOUBLE AS x0, p_partkey * 1.0::DOUBLE AS y0, 2.5::DOUBLE AS x1, p_retailprice AS y1 FROM part")
def edges(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_size") * 0.5).alias("x0"), F.col("p_partkey").cast("double").alias("y0"), F.lit(2.5).alias("x1"), F.col("p_retailprice").alias("y1"))
    t = F.split("value", " ")
    return spark.read.text(_lines(K.edge_lines(rows))).select(*[F.get(t, k).cast("double").alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("k64_open_heights", "SELECT p_partkey AS i0, CAST(p_size AS BIGINT) AS i1, p_retailprice AS open_height FROM part")
def open_heights(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i0"), F.col("p_size").alias("i1"), F.col("p_retailprice").alias("open_height"))
    t = F.split("value", " ")
    return spark.read.text(_lines(K.open_height_lines(rows))).select(F.get(t, 0).cast("long").alias("i0"), F.get(t, 1).cast("long").alias("i1"), F.get(t, 2).cast("double").alias("open_height"))


@query("k65_room_labels", "SELECT p_partkey AS i0, CAST(p_size AS BIGINT) AS i1, p_partkey % 5 - 2 AS room FROM part WHERE p_partkey % 5 >= 2")
def room_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i0"), F.col("p_size").alias("i1"), (F.col("p_partkey") % 5 - 2).alias("room"))
    t = F.split("value", " ")
    return spark.read.text(_lines(K.room_label_lines(rows))).select(*[F.get(t, k).cast("long").alias(c) for k, c in enumerate(("i0", "i1", "room"))])


@query("k61_doors", "SELECT s_nationkey AS file, s_suppkey AS door, s_acctbal AS x0, s_suppkey * 0.5::DOUBLE AS x, 1.25::DOUBLE AS z FROM supplier")
def doors(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), k.alias("door"), F.col("s_acctbal").alias("x0"), k.cast("double").alias("y0"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(0.0).alias("floor"), F.lit(2.5).alias("ceiling"), (k * 0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(1.25).alias("z"))
    t = F.split("value", " ")
    got = spark.read.text(_documents(K.door_documents(rows))).where("value like 'door %'")
    return got.select(F.col("file").cast("int").alias("file"), F.get(t, 2).cast("double").cast("long").alias("door"), F.get(t, 1).cast("double").alias("x0"), F.get(t, 7).cast("double").alias("x"), F.get(t, 9).cast("double").alias("z"))


# --- whole exports: clocks, poses, rests and noise, down to lines ----------------------------------------------------------


@query("k52_export_of_ranges", "WITH e AS (SELECT event_id, user_id, value, epoch(ts) AS t FROM events) SELECT event_id, round(value / 1000 * cos(0.25), 9) AS x, round(value / 1000 * sin(0.25), 9) AS y FROM e WHERE value BETWEEN 10 AND 60 AND NOT EXISTS (SELECT 1 FROM e r WHERE r.event_id % 97 = 0 AND e.t BETWEEN r.t AND r.t + 600)")
def export_ranges(spark, sf_dir):
    """Ranges without those out of reach or taken while the system rested, as points, written and read again."""
    from ..operators.filters import range_between

    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("range_mm"), seconds("ts").alias("t"), F.lit(0.25).alias("angle"))
    rests = e.where("event_id % 97 = 0").select(F.col("t").alias("t0"), (F.col("t") + 600).alias("t1"))
    kept = J.outside_intervals(range_between(e, 10.0, 60.0), rests, "t", 3600.0)
    x = kept.select(_line(F.col("range_mm") / 1000 * F.cos("angle"), F.col("range_mm") / 1000 * F.sin("angle"), F.lit(0.0), "event_id"))
    t = F.split("value", " ")
    return spark.read.text(_lines(x)).select(F.get(t, 3).cast("long").alias("event_id"), *[F.round(F.get(t, k).cast("double"), 9).alias(a) for k, a in enumerate("xy")])


@query("k54_export_of_frames", sql(", q AS (SELECT l_suppkey % 15 AS s, CAST(l_orderkey AS DOUBLE) * 1000 + 700000000 AS t, l_quantity * 0.01 AS x, (l_discount + 0.5) * 0.01 AS noise FROM lineitem), p AS (SELECT ts, px FROM poses), w AS (SELECT q.*, coalesce(p.px, (SELECT arg_min(px, ts) FROM p)) AS px FROM q ASOF LEFT JOIN p ON q.t >= p.ts) SELECT s AS scanner, count(*) AS n, round(sum(x + px), 3) AS x, round(sum(noise), 4) AS noise FROM w GROUP BY s", "poses"))
def export_frames(spark, sf_dir):
    """Points of scan frames at the poses of their times; the noise of a point is the sum of its deviation and its width."""
    p = B.scan_points(B.read_scan_frames(spark, _scan_files(spark, sf_dir)), False).withColumns({"t": F.col("timestamp") * 1000 + 700000000, "noise": F.col("stddev") + F.col("width")})
    world = J.as_of_clamped(p, poses(spark, sf_dir).select("ts", "px"), "t", "ts", 30 * 86400.0)
    got = spark.read.text(_lines(world.select(_line(F.regexp_extract("scanner", r"\d+", 0), F.col("x") + F.col("px"), "noise"))))
    t = F.split("value", " ")
    return got.groupBy(F.get(t, 0).cast("long").alias("scanner")).agg(F.count("*").alias("n"), F.round(F.sum(F.get(t, 1).cast("double")), 3).alias("x"), F.round(F.sum(F.get(t, 2).cast("double")), 4).alias("noise"))
