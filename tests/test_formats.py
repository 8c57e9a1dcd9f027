from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanforge.sources import binary as B
from scanforge.sources import text as T
from scanforge.sources import writers as K


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(p)


def test_points(spark, tmp_path):
    xyz = T.load_points(spark, put(tmp_path, "a.xyz", "1 2 3 4 5 6 7 8.5 s\n\nbad line\n 9 8 7 6 5 4 3 2.5\n")).orderBy("x").collect()
    assert [(r["x"], r["b"], r["index"], r["timestamp"]) for r in xyz] == [(1.0, 6, 7, 8.5), (9.0, 4, 3, 2.5)]
    pts = T.load_points(spark, put(tmp_path, "a.pts", "1 2 3\n1 2 3 99 10 20 30\n")).orderBy("r").collect()
    assert [(r["r"], r["g"], r["b"]) for r in pts] == [(0, 0, 0), (10, 20, 30)]
    assert T.load_points(spark, put(tmp_path, "a.obj", "# c\nv 1 2 3\nf 1 1 1\nv 4 5 6 7 8 9\n")).count() == 2
    with pytest.raises(ValueError):
        T.load_points(spark, "a.unknown")


def test_round_trip_of_points(spark, tmp_path):
    df = spark.createDataFrame([(1.5, -2.0, 3.25, 1, 2, 3, 4, 5.5, True)], "x double, y double, z double, r int, g int, b int, index int, timestamp double, valid boolean")
    for fmt in ("xyz", "pts", "obj", "pcd"):
        K.write_points(df, str(tmp_path / fmt), fmt)
    assert T.load_points(spark, str(tmp_path / "xyz"), "xyz").collect() == df.collect()
    assert T.load_points(spark, str(tmp_path / "pts"), "pts").first()["b"] == 3
    assert "POINTS 1" in spark.read.text(str(tmp_path / "pcd" / "header"), wholetext=True).first()[0]


def test_scaled_points(spark, tmp_path):
    got = T.read_scaled_points(spark, put(tmp_path, "a.txt", "1000 0 0 7.5\n2000 0 0 1 2 3\n3000 0 0 1 2 3 4 5.5 s\n1 2\n"), "mm").orderBy("x").collect()
    assert [(r["x"], r["r"], r["timestamp"]) for r in got] == [(1.0, 0, 7.5), (2.0, 1, 0.0), (3.0, 1, 5.5)]


def test_small_text_formats(spark, tmp_path):
    levels = T.read_levels(spark, put(tmp_path, "l", "# head\nlevels\nversion 1 0\nnum_levels 2\nlevel 0 -3.1 -0.4 # low\nlevel 1 0.9 4.0\n")).orderBy("level").collect()
    assert [(r["level"], r["floor"], r["ceiling"]) for r in levels] == [(0, -3.1, -0.4), (1, 0.9, 4.0)]
    dq = T.read_wall_samples(spark, put(tmp_path, "d", "5\n10.0\n0 0\n1 2 0 3 50 2 7 9\n")).first()
    assert (dq["num_pts"], dq["poses"]) == (50, [7, 9])
    assert T.read_voxels(spark, put(tmp_path, "v", "0.1\n1 2 3 19\n")).first()["state"] == 19
    assert T.read_image_map(spark, put(tmp_path, "i", "0.5\n1 2 2 4 3\n")).first()["images"] == [4, 3]
    assert tuple(T.read_coordinate_map(spark, put(tmp_path, "c", "0.1\n5\n6\ncomment\n")).first())[:3] == (0.1, 5.0, 6.0)
    assert T.read_windows(spark, put(tmp_path, "w", "0 15 0.2 0.5 0.8 0.7\n")).first()["max_v"] == 0.7
    assert [(r["room"], r["people"]) for r in T.read_room_values(spark, put(tmp_path, "p", "3\n4\n"), "people").orderBy("room").collect()] == [(0, 3.0), (1, 4.0)]
    assert T.read_camera_poses(spark, put(tmp_path, "cam", "1 2 3 4 5 6 7\n")).first()["yaw"] == 7.0
    assert T.read_path_text(spark, put(tmp_path, "path", "1 2 3 4\n")).first()["timestamp"] == 4.0
    assert T.read_settings(spark, put(tmp_path, "s.xml", "<s><res>0.1</res><n> 4 </n></s>")) == {"res": "0.1", "n": "4"}


def test_clock_fits(spark, tmp_path):
    path = put(tmp_path, "t.xml", "<sync><sensor><name>a</name><slope>1.5</slope><offset>2</offset></sensor><sensor><name>b</name><slope>1</slope><offset>0</offset><stddev>0.1</stddev></sensor></sync>")
    got = T.read_clock_fits(spark, path).orderBy("sensor").collect()
    assert [tuple(r) for r in got] == [("a", 1.5, 2.0, -1.0), ("b", 1.0, 0.0, 0.1)]


def test_floor_plan_round_trip(spark, tmp_path):
    text = "0.05\n4\n2\n1\n0.0 0.0\n1.0 0.0\n1.0 1.0\n0.0 1.0\n0 1 2\n0 2 3\n0.0 2.5 2 0 1\n"
    v, t, r = T.read_floor_plan(spark, put(tmp_path, "a.fp", text))
    assert (v.count(), t.count(), r.count()) == (4, 2, 2)
    assert K.floor_plan_text(0.05, v, t, r) == text


def test_mesh_round_trip(spark, tmp_path):
    v, f = T.read_mesh_obj(spark, put(tmp_path, "m.obj", "v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1 2/2 3/3\n"))
    assert f.first()["vertices"] == [0, 1, 2]
    assert [r["value"] for r in K.mesh_lines(v, f)[1].collect()] == ["f 1 2 3"]


def test_wall_sample_counts(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0, 3.0, 2.7, [4, 5]), (1.0, 2.0, 0.0, 3.0, 0.5, [4]), (1.0, 2.0, 0.0, 3.0, 2.0, [])], "x double, y double, min_z double, max_z double, weight double, poses array<int>")
    assert [r["value"] for r in K.wall_sample_lines(df).collect()] == ["1.0 2.0 0.0 3.0 2 2 4 5"]
    assert [r["value"] for r in K.wall_sample_lines(df, form="tree").collect()] == ["1.0 2.0 0.0 3.0 3 2 4 5", "1.0 2.0 0.0 3.0 1 1 4"]


def test_noisy_path(spark, tmp_path):
    n = 5
    poses = pd.DataFrame({c: np.arange(n) + k for k, c in enumerate(B.POSE.names) if not c.startswith("cov")})
    poses["cov_pos"], poses["cov_rot"] = [[float(i)] * 6 for i in range(n)], [[2.0] * 6] * n
    path = put(tmp_path, "a.noisypath", B.encode_noisy_path(poses, [(1.0, 2.0)]))
    got = B.read_noisy_path(spark, path).orderBy("timestamp").collect()
    assert len(got) == n and got[3]["cov_pos"] == [3.0] * 6 and got[3]["mean_yaw"] == poses["mean_yaw"][3]
    assert [(r["t0"], r["t1"]) for r in B.read_rest_intervals(spark, path).collect()] == [(1.0, 2.0)]


def test_wedges_chunks_and_histogram(spark, tmp_path):
    w = pd.DataFrame({n: np.arange(3) + k for k, n in enumerate(B.WEDGE.names)})
    got = B.read_wedges(spark, put(tmp_path, "a.wedge", B.encode_wedges(w, 3.0))).orderBy("wedge_id").collect()
    assert [r["b2"] for r in got] == [5, 6, 7]
    c = B.read_chunks(spark, put(tmp_path, "a.chunk", B.encode_chunk(2**63 + 5, (1, 2, 3, 4), [9, 9, 7])))
    assert sorted((r["chunk_id"], r["wedge_id"]) for r in c.collect()) == [("8000000000000005", 7), ("8000000000000005", 9)]
    cells = pd.DataFrame({"cx": [0.5], "cy": [1.5], "min_z": [0.0], "max_z": [2.0], "open_height": [1.75]})
    h = B.read_interior_histogram(spark, put(tmp_path, "a.hia", B.encode_interior_histogram(cells, 2, 0.25))).first()
    assert (h["level"], h["res"], h["open_height"]) == (2, 0.25, 1.75)


def test_tree_round_trip(spark, tmp_path):
    leaves = pd.DataFrame([{"cx": 0.5, "cy": -0.5, "cz": 0.5, "hw": 0.5, "count": 3, "total_weight": 2.5, "prob_sum": 1.0, "prob_sum_sq": 0.5, "surface_sum": 0.1, "corner_sum": 0.2, "planar_sum": 0.3, "fp_room": -1}, {"cx": -0.25, "cy": -0.25, "cz": -0.25, "hw": 0.25, "count": 1, "total_weight": 1.0, "prob_sum": 0.9, "prob_sum_sq": 0.81, "surface_sum": 0.0, "corner_sum": 0.0, "planar_sum": 0.0, "fp_room": 4}])
    got = B.read_tree(spark, put(tmp_path, "a.oct", B.encode_tree(leaves, (0.0, 0.0, 0.0, 1.0), 3))).orderBy("depth").collect()
    assert [(r["depth"], r["hw"], r["count"], r["fp_room"], r["planar_sum"]) for r in got] == [(1, 0.5, 3, -1, 0.3), (2, 0.25, 1, 4, 0.0)]


@pytest.mark.parametrize("form", ["ascii", "little_endian", "big_endian"])
def test_scan_frames(spark, tmp_path, form):
    frames = [(1.5, [(3.0, 4.0, 0.0, 7, 5.0, 0.1, 0.2)]), (2.5, []), (3.5, [(1.0, 0.0, 0.0, 1, 0.0, 0.0, 0.0)] * 2)]
    df = B.read_scan_frames(spark, put(tmp_path, "a.fss", B.encode_scan_frames(frames, "cam", "centimeters", form)))
    assert [len(r["points"]) for r in df.orderBy("frame_idx").collect()] == [1, 0, 2]
    p = B.scan_points(df).where("frame_idx = 0").first()
    assert abs(p["x"] - 0.06) < 1e-12 and p["intensity"] == 7


def test_wrong_magic(spark, tmp_path):
    with pytest.raises(Exception, match="not a"):
        B.read_wedges(spark, put(tmp_path, "x.wedge", b"nothing here at all, really")).count()


def test_carve_map(spark, tmp_path):
    import struct

    body = b"carvmap\0" + struct.pack("<Q", 1) + struct.pack("<Q", 2) + struct.pack("<9d", *range(9)) + b"".join(struct.pack("<11d", *[k] * 11) for k in (1.0, 2.0))
    got = B.read_carve_map(spark, put(tmp_path, "a.carvemap", body)).orderBy("point").collect()
    assert got[1]["sensor_mean"] == [0.0, 1.0, 2.0] and got[1]["planar_prob"] == 2.0 and got[0]["point_cov"] == [1.0] * 6


def test_las(spark, tmp_path):
    import struct

    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<I", head, 96, 227)
    head[104] = 3
    struct.pack_into("<H", head, 105, 34)
    struct.pack_into("<I", head, 107, 1)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 10.0, 20.0, 30.0)
    point = struct.pack("<3i", 100, 200, 300) + bytes(8) + struct.pack("<d3H", 5.5, 256, 512, 65535)
    got = B.read_las(spark, put(tmp_path, "a.las", bytes(head) + point)).select("x", "y", "z", "r", "g", "b", "timestamp").first()
    assert [round(v, 9) for v in got] == [11.0, 22.0, 33.0, 1, 2, 255, 5.5]


def test_colours(spark):
    from scanforge.functions import colour as C

    got = spark.createDataFrame([(0.0,), (0.05,), (0.2,)], "s double").select(C.noise_colour(F.col("s")).alias("c")).collect()
    assert [(r["c"]["r"], r["c"]["b"]) for r in got] == [(0, 255), (127, 127), (255, 0)]
