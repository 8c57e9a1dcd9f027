from __future__ import annotations

import struct

import numpy as np
import pytest

from scanforge.operators.filters import range_scan_points
from scanforge.sources import sensors as N
from scanforge.sources import text as T


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(p)


@pytest.mark.parametrize("intensities", [0, 1])
def test_ranges(spark, tmp_path, intensities):
    extra = struct.pack("<2I", 7, 8) if intensities else b""
    body = b"LASER\0\1\0model\0s1\0" + struct.pack("<IiIiii", 0, intensities, 2, 2, 30000, 20) + struct.pack("<2f", 0.0, 0.5) + b"".join(struct.pack("<3I", t, 1000, 2000) + extra for t in (5, 6))
    p = N.range_points(N.read_log(spark, put(tmp_path, "a", body), "range2d"))
    got = range_scan_points(p).orderBy("frame_idx", "point").collect()
    assert [r["range_mm"] for r in got] == [1000.0, 2000.0] * 2 and abs(got[1]["x"] - 2 * np.cos(0.5)) < 1e-7 and got[3]["timestamp"] == 6


def test_inertial(spark, tmp_path):
    record = struct.pack("<32f", *range(32)) + b"\3"
    body = b"IC4\0\1\0m\0s\0" + struct.pack("<5I", 0, 1, 2, 3, 2) + record * 2
    got = N.read_log(spark, put(tmp_path, "a", body), "inertial").orderBy("frame_idx").collect()
    assert len(got) == 2 and got[1]["euler"] == [2.0, 3.0, 4.0] and got[1]["quaternion"] == [5.0, 6.0, 7.0, 8.0] and got[1]["temperature"] == 31.0 and got[0]["status"] == 3


def test_magnetometer_and_barometer(spark, tmp_path):
    body = b"HMC5883L\0\1\0" + struct.pack("<IBIdd", 0, 2, 1, 0.5, 0.001) + struct.pack("<I", 2000) + struct.pack(">6h", 1, -2, 3, 4, 5, 6)
    r = N.read_log(spark, put(tmp_path, "m", body), "magnetometer").first()
    assert (r["timestamp"], r["readings"], r["gain"]) == (2.0, [1.0, -2.0, 3.0, 4.0, 5.0, 6.0], 0.5)
    body = b"BMP085\0\1\0" + struct.pack("<I", 0) + struct.pack(">11H", *range(11)) + struct.pack("<IBd", 1, 3, 0.01) + struct.pack("<I", 100) + struct.pack(">h", -5) + struct.pack("<I", 200) + struct.pack(">H", 40000) + b"\7"
    r = N.read_log(spark, put(tmp_path, "b", body), "barometer").first()
    assert (r["timestamp"], r["temperature"], r["pressure_time"], r["pressure"], r["pressure_low"], r["calibration"][10]) == (1.0, -5, 2.0, 40000, 7, 10)


def test_gps_wifi_depth_tango(spark, tmp_path):
    body = b"GPS\0\1\0" + struct.pack("<II", 0, 1) + struct.pack("<QI", 2**63 + 1, 3) + b"abc"
    r = N.read_log(spark, put(tmp_path, "g", body), "gps").first()
    assert int(r["timestamp"]) == 2**63 + 1 and bytes(r["data"]) == b"abc"
    body = b"WIFI\0\1\0" + struct.pack("<I", 1) + struct.pack("<IIQ6HbHBB", 1, 2, 3, 1, 2, 3, 4, 5, 255, -60, 2412, 0, 3) + b"net"
    r = N.read_log(spark, put(tmp_path, "w", body), "wifi").first()
    assert (r["mac"], r["ssid"], r["frequency"], r["level"]) == ("01:02:03:04:05:ff", "net", 2412, -60)
    body = b"dimager\0" + struct.pack("<IIiiI", 2, 1, 30, 1, 1) + struct.pack("<Q", 9) + struct.pack("<2h2h2h2H", 1000, 2000, -500, 0, 3000, 1, 8, 9)
    got = N.depth_points(N.read_log(spark, put(tmp_path, "d", body), "depth")).orderBy("pixel").collect()
    assert [(r["x"], r["y"], r["z"], r["intensity"]) for r in got] == [(1.0, -0.5, 3.0, 8), (2.0, 0.0, 0.001, 9)]
    body = struct.pack(">i2x", 74960) + (struct.pack(">8di", 1.5, 1, 2, 3, 0, 0, 0, 1, 12) + struct.pack("<3f", 0.5, 0.25, 2.0)) * 2
    got = N.read_tango(spark, put(tmp_path, "t", body)).orderBy("frame_idx").collect()
    assert len(got) == 2 and got[1]["quaternion"] == [1.0, 0.0, 0.0, 0.0] and got[1]["points"][0]["z"] == 2.0
    with pytest.raises(ValueError):
        N.read_log(spark, "x", "sonar")


def test_text_lists(spark, tmp_path):
    got = T.read_image_list(spark, put(tmp_path, "i", "cam\n2\n90\nout\n\n0 a.jpg 1.5 100 2.5\n1 b.jpg 2.5 100 2.5\n"))
    assert got.count() == 2
    r = T.read_camera_file(spark, put(tmp_path, "c", "7 1\n1 0 0 0 1 0 0 0 1\n1 0 0 0 1 0 0 0 1\n0.1 0.2 0.3\na.jpg 5.5\nmask.png\n")).first()
    assert (r["serial"], r["translation"], r["mask"], r["image"], r["timestamp"]) == ("7", [0.1, 0.2, 0.3], "mask.png", "a.jpg", 5.5)
    v, f = T.read_mesh_ply(spark, put(tmp_path, "p.ply", "ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n"))
    assert v.count() == 3 and f.first()["vertices"] == [0, 1, 2]
    assert T.read_panorama_list(spark, put(tmp_path, "s", "scanolist\n10 20\n1\ncam0\n\nfile0.ptx 1.5 1 2 3\n")).first()["z"] == 3.0
