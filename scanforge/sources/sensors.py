"""Readers of raw sensor logs: each format is a layout of header fields and of records, decoded by one routine.

Layouts hold the field order and types of the formats, which are fixed values. A field is (name, numpy type) or (name, type,
count); a count may name an earlier field of the file. Type `z` is a text that ends in a zero byte.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import CHUNK, _gathered, _interleaved, _lists, _lists_of, _native, _read, _read_frames


@dataclass(frozen=True)
class Layout:
    magic: bytes
    header: tuple
    record: tuple
    schema: str
    kept: tuple = field(default=())  # header fields repeated on each row


_VEC = ("<f4", 3)
LAYOUTS = {
    "range2d": Layout(
        b"LASER\0",
        (("major", "u1"), ("minor", "u1"), ("model", "z"), ("serial", "z"), ("header_size", "<u4"), ("intensities", "<i4"), ("num", "<u4"), ("points", "<i4"), ("max_range", "<i4"), ("min_range", "<i4"), ("angles", "<f4", "points")),
        (("timestamp", "<u4"), ("ranges", "<u4", "points"), ("intensity", "<u4", "points", "intensities")),
        "frame_idx long, timestamp long, ranges array<long>, angles array<double>, serial string",
        ("angles", "serial"),
    ),
    "inertial": Layout(
        b"IC4\0",
        (("major", "u1"), ("minor", "u1"), ("model", "z"), ("serial", "z"), ("header_size", "<u4"), ("enhancement", "<u4"), ("sensitivity", "<u4"), ("query_ms", "<u4"), ("num", "<u4")),
        (("timestamp", "<f4"), ("still_time", "<f4"), ("euler", *_VEC), ("quaternion", "<f4", 4), ("compass_yaw", "<f4"), ("rate_body", *_VEC), ("rate_nav", *_VEC), ("acceleration_body", *_VEC), ("acceleration_nav", *_VEC), ("velocity_nav", *_VEC), ("rate_raw", *_VEC), ("magnetic", *_VEC), ("temperature", "<f4"), ("status", "u1")),
        "frame_idx long, timestamp double, euler array<double>, quaternion array<double>, rate_body array<double>, acceleration_body array<double>, magnetic array<double>, temperature double, status long",
    ),
    "magnetometer": Layout(
        b"HMC5883L\0",
        (("major", "u1"), ("minor", "u1"), ("header_size", "<u4"), ("sensors", "u1"), ("num", "<u4"), ("gain", "<f8"), ("unit", "<f8")),
        (("timestamp", "<u4"), ("readings", ">i2", "sensors*3")),
        "frame_idx long, timestamp double, readings array<double>, gain double",
        ("gain",),
    ),
    "barometer": Layout(
        b"BMP085\0",
        (("major", "u1"), ("minor", "u1"), ("header_size", "<u4"), ("calibration", ">u2", 11), ("num", "<u4"), ("oversampling", "u1"), ("unit", "<f8")),
        (("timestamp", "<u4"), ("temperature", ">i2"), ("pressure_time", "<u4"), ("pressure", ">u2"), ("pressure_low", "u1")),
        "frame_idx long, timestamp double, temperature long, pressure_time double, pressure long, pressure_low long, calibration array<long>",
        ("calibration",),
    ),
    "gps": Layout(b"GPS\0", (("major", "u1"), ("minor", "u1"), ("header_size", "<u4"), ("num", "<u4")), (("timestamp", "<u8"), ("size", "<u4"), ("data", "bytes", "size")), "frame_idx long, timestamp decimal(20,0), data binary"),
    "wifi": Layout(
        b"WIFI\0",
        (("major", "u1"), ("minor", "u1"), ("num", "<u4")),
        (("seconds", "<u4"), ("micros", "<u4"), ("system_time", "<u8"), ("bssid", "<u2", 6), ("level", "i1"), ("frequency", "<u2"), ("tag", "u1"), ("size", "u1"), ("ssid", "text", "size")),
        "frame_idx long, seconds long, micros long, mac string, ssid string, frequency long, level long",
    ),
    "depth": Layout(
        b"dimager\0",
        (("width", "<u4"), ("height", "<u4"), ("fps", "<i4"), ("frequency", "<i4"), ("num", "<u4")),
        (("timestamp", "<u8"), *((n, t, "width*height") for n, t in (("xs", "<i2"), ("ys", "<i2"), ("zs", "<i2"), ("ns", "<u2")))),
        "frame_idx long, timestamp decimal(20,0), xs array<long>, ys array<long>, zs array<long>, ns array<long>",
    ),
}


def _take(data: bytes, at: int, fields: tuple, known: dict) -> tuple[dict, int]:
    out: dict = {}
    for name, kind, *rest in fields:
        if len(rest) == 2 and not known.get(rest[1]):
            continue  # a field that only some files have
        if kind == "z":
            end = data.index(b"\0", at)
            out[name], at = data[at:end].decode("latin-1"), end + 1
        else:
            count = 1
            for part in str(rest[0]).split("*") if rest else ():
                count *= int(part) if part.isdigit() else int((known | out)[part])
            if kind in ("bytes", "text"):
                raw = data[at : at + count]
                out[name], at = raw if kind == "bytes" else raw.decode("utf-8", "replace"), at + count
            else:
                values = np.frombuffer(data, kind, count, at)
                out[name] = values.tolist() if rest else values[0].item()
                at += values.nbytes
    return out, at


def decode(content: bytes, kind: str):
    """Frames of one log as data frames, in pieces. Times on a clock with a unit become seconds."""
    layout = LAYOUTS[kind]
    if content[: len(layout.magic)] != layout.magic:
        raise ValueError(f"not a {kind} log")
    head, at = _take(content, len(layout.magic), layout.header, {})
    names = [c.split()[0] for c in layout.schema.replace("(20,0)", "").split(", ")]
    rows = []
    for i in range(head["num"]):
        row, at = _take(content, at, layout.record, head)
        row |= {"frame_idx": i, **{k: head[k] for k in layout.kept}}
        if "unit" in head:
            row |= {k: row[k] * head["unit"] for k in ("timestamp", "pressure_time") if k in row}
        if kind == "wifi":
            row["mac"] = ":".join(f"{v & 0xFF:02x}" for v in row["bssid"])
        if kind in ("gps", "depth"):
            row["timestamp"] = Decimal(row["timestamp"])
        rows.append([row[n] for n in names])
        if len(rows) >= CHUNK:
            yield pd.DataFrame(rows, columns=names)
            rows = []
    yield pd.DataFrame(rows, columns=names)


def _put(fields: tuple, values: dict, known: dict) -> bytes:
    out = b""
    for name, kind, *rest in fields:
        if len(rest) == 2 and not known.get(rest[1]):
            continue
        value = values[name]
        if kind == "z":
            out += value.encode("latin-1") + b"\0"
        elif kind in ("bytes", "text"):
            out += value if kind == "bytes" else value.encode()
        else:
            out += np.asarray(value, kind).tobytes()
    return out


def encode(kind: str, header: dict, frames: list[dict]) -> bytes:
    """A log of a kind from the raw values of its header and frames, as LAYOUTS names them; `num` is set here."""
    layout = LAYOUTS[kind]
    header = header | {"num": len(frames)}
    return layout.magic + _put(layout.header, header, header) + b"".join(_put(layout.record, f, header) for f in frames)


TANGO_HEAD = struct.pack(">ih", 74960, 1)
_XYZ = np.dtype([(a, "<f4") for a in "xyz"])


def tango_bytes(times: np.ndarray, positions: np.ndarray, turns: np.ndarray, sizes: np.ndarray, points: np.ndarray) -> bytes:
    """Frames of a depth log with poses, after TANGO_HEAD: times, positions (n x 3), quaternions (w, x, y, z), numbers of points, points (m x 3)."""
    heads = np.zeros(len(times), [("t", ">f8"), ("at", ">f8", 3), ("q", ">f8", 4), ("n", ">i4")])
    heads["t"], heads["at"], heads["q"], heads["n"] = times, positions, np.asarray(turns)[:, [1, 2, 3, 0]], sizes * _XYZ.itemsize
    return _interleaved(heads, sizes, np.ascontiguousarray(points, "<f4").reshape(-1, 3).view(_XYZ).ravel())


def encode_tango(frames: list[tuple]) -> bytes:
    """A depth log with poses of (timestamp, position, quaternion (w, x, y, z), points)."""
    out = TANGO_HEAD
    for t, (x, y, z), (qw, qx, qy, qz), points in frames:
        body = np.asarray(points, "<f4").tobytes()
        out += struct.pack(">8di", t, x, y, z, qx, qy, qz, qw, len(body)) + body
    return out


def read_log(spark: SparkSession, path: str | DataFrame, kind: str) -> DataFrame:
    """Frames of sensor logs of a kind: range2d, inertial, magnetometer, barometer, gps, wifi, depth."""
    if kind not in LAYOUTS:
        raise ValueError(f"unknown kind of log {kind}")
    return _read(spark, path, lambda b: decode(b, kind), LAYOUTS[kind].schema)


def read_tango(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Depth frames with poses: frame_idx, timestamp, position, quaternion (w, x, y, z), points (array of struct<x, y, z>)."""
    def decode(s):
        if s.unpack(">ih")[0] != 74960:
            raise ValueError("not a depth log with poses")
        done = 0
        for b, starts, heads in s.frames(None, ">8di", lambda v: v[8]):
            h = np.array(heads, float)
            sizes = h[:, 8].astype(int) // _XYZ.itemsize
            p, _, _ = _gathered(b, starts, sizes, _XYZ)
            yield {"frame_idx": np.arange(len(h)) + done, "timestamp": _native(h[:, 0], "f8"), "position": _lists(h[:, 1:4]), "quaternion": _lists(h[:, [7, 4, 5, 6]]), "points": _lists_of({a: _native(p[a], "f8") for a in "xyz"}, sizes)}
            done += len(h)

    return _read_frames(spark, path, decode, "frame_idx long, timestamp double, position array<double>, quaternion array<double>, points array<struct<x: double, y: double, z: double>>")


def range_points(frames: DataFrame) -> DataFrame:
    """One row for each range of planar frames: frame_idx, timestamp, point, range_mm, angle."""
    rows = frames.select("frame_idx", "timestamp", "angles", F.posexplode("ranges").alias("point", "range_mm"))
    return rows.select("frame_idx", "timestamp", "point", F.col("range_mm").cast("double").alias("range_mm"), F.get("angles", F.col("point")).alias("angle"))


def depth_points(frames: DataFrame) -> DataFrame:
    """One row for each pixel of depth frames, in metres."""
    rows = frames.select("frame_idx", "timestamp", F.posexplode(F.arrays_zip("xs", "ys", "zs", "ns")).alias("pixel", "p"))
    return rows.select("frame_idx", "timestamp", "pixel", *[(F.col(f"p.{a}s") / 1000).alias(a) for a in "xyz"], F.col("p.ns").alias("intensity"))
