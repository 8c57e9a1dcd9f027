"""Readers of text formats. Large files are read line by line in parallel; only small ones, whose lines count, as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.colour import UNITS

LAYOUTS = ("xyz", "pts", "obj")


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("value", F.trim("value")).where("value <> ''")
    return lines.select(F.split("value", r"\s+").alias("t"))


def _whole(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """(file, lines): each small file as an array of its lines that are not empty, without comments."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    clean = lambda v: F.trim(F.regexp_replace(v, f"{comment}.*$", "") if comment else v)
    return text.select("file", F.filter(F.transform("lines", clean), lambda v: v != "").alias("lines"))


def _numbered(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """(file, n, t): lines of small files that are not empty, numbered from 0 in each file, as arrays of words."""
    return _whole(spark, path, comment).select("file", F.posexplode("lines").alias("n", "line")).select("file", "n", F.split("line", r"\s+").alias("t"))


def _word(line: int, word: int = 0) -> Column:
    """A word of a line of `lines`."""
    return F.get(F.split(F.get("lines", line), r"\s+"), word)


def _part(files: DataFrame, start: Column, count: Column, name: str) -> DataFrame:
    """(file, name, t): `count` lines from `start` on of each file, numbered from 0, as arrays of words."""
    rows = files.select("file", F.posexplode(F.slice("lines", start + 1, F.greatest(F.lit(0), count))).alias(name, "line"))
    return rows.select("file", name, F.split("line", r"\s+").alias("t"))


def _num(i: int, kind: str = "double", of: str = "t") -> Column:
    return F.get(F.col(of), i).try_cast(kind)


def load_points(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """x, y, z, r, g, b, index, timestamp, valid of a point cloud; the format is taken from the extension. Unknown ones raise ValueError.

    Lines that are empty or whose coordinates are no numbers are left out, wherever they stand.
    """
    fmt = (fmt or path.rsplit(".", 1)[-1]).lower()
    if fmt in ("las", "laz"):
        from .binary import read_las

        return read_las(spark, path)
    if fmt not in LAYOUTS:
        raise ValueError(f"unknown point format {fmt}")
    rows = _tokens(spark, path)
    zero = F.lit(0)
    if fmt == "xyz":
        cols = [_num(0), _num(1), _num(2), *(_num(i, "int") for i in (3, 4, 5)), _num(6, "int"), _num(7)]
    elif fmt == "pts":
        last = [F.when(F.size("t") >= 6, F.try_element_at("t", F.lit(-i)).try_cast("int")).otherwise(zero) for i in (3, 2, 1)]
        cols = [_num(0), _num(1), _num(2), *last, zero, F.lit(0.0)]
    else:
        rows = rows.where(F.get("t", 0) == "v")
        cols = [_num(1), _num(2), _num(3), *(F.coalesce(_num(i, "int"), zero) for i in (4, 5, 6)), zero, F.lit(0.0)]
    named = [c.alias(n) for c, n in zip(cols, ("x", "y", "z", "r", "g", "b", "index", "timestamp"))]
    return rows.select(*named, F.lit(True).alias("valid")).where("x is not null and y is not null and z is not null" + (" and timestamp is not null" if fmt == "xyz" else ""))


def read_scaled_points(spark: SparkSession, path: str, unit: str = "m") -> DataFrame:
    """Point text of 4 columns (x y z t), 6 (x y z r g b) or 9 (x y z r g b index t serial), by line; lengths become metres."""
    f = UNITS[unit]
    t, n = _tokens(spark, path), F.size("t")
    return t.where(n.isin(4, 6, 9)).select(
        *[(_num(i) * f).alias(c) for i, c in enumerate("xyz")],
        *[F.when(n >= 6, _num(i, "int")).otherwise(0).alias(c) for i, c in zip((3, 4, 5), "rgb")],
        F.when(n == 9, _num(6, "int")).otherwise(0).alias("index"),
        F.when(n == 9, _num(7)).when(n == 4, _num(3)).otherwise(0.0).alias("timestamp"),
        F.lit(True).alias("valid"),
    ).where("x is not null and y is not null and z is not null")


def read_path_text(spark: SparkSession, path: str) -> DataFrame:
    """Poses of lines `x y z timestamp`."""
    return _tokens(spark, path).where(F.size("t") >= 4).select(_num(3).alias("timestamp"), *[_num(i).alias(c) for i, c in enumerate("xyz")]).where("timestamp is not null")


def read_camera_poses(spark: SparkSession, path: str) -> DataFrame:
    """Lines of timestamp, x, y, z, roll, pitch, yaw."""
    names = ("timestamp", "x", "y", "z", "roll", "pitch", "yaw")
    return _tokens(spark, path).where(F.size("t") >= 7).select(*[_num(i).alias(c) for i, c in enumerate(names)]).where("timestamp is not null")


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """level, floor, ceiling of a storey table; # starts a comment."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("value"))
    return lines.select(F.split("value", r"\s+").alias("t")).where((F.get("t", 0) == "level") & (F.size("t") >= 4)).select(_num(1, "int").alias("level"), _num(2).alias("floor"), _num(3).alias("ceiling"))


def read_wall_samples(spark: SparkSession, path: str) -> DataFrame:
    """x, y, min_z, max_z, num_pts, poses of the cells of a wall-sample file; its header lines are shorter."""
    rows = _tokens(spark, path).where(F.size("t") >= 6)
    poses = F.transform(F.slice("t", F.lit(7), _num(5, "int")), lambda v: v.try_cast("int"))
    return rows.select(*[_num(i).alias(c) for i, c in enumerate(("x", "y", "min_z", "max_z"))], _num(4, "int").alias("num_pts"), poses.alias("poses"))


def read_floor_plan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(v, x, y), (t, i, j, k) and (room, z_min, z_max, t) of floor plans, which are small files; each with its file."""
    files = _whole(spark, path).select("file", "lines", *[F.coalesce(_word(k).try_cast("int"), F.lit(0)).alias(c) for k, c in ((1, "nv"), (2, "nt"), (3, "nr"))])
    nv, nt, nr = (F.col(c) for c in ("nv", "nt", "nr"))
    verts = _part(files, F.lit(4), nv, "v").select("v", _num(0).alias("x"), _num(1).alias("y"), "file")
    tris = _part(files, 4 + nv, nt, "t0").select(F.col("t0").alias("n"), "t", "file").select("n", *[_num(i, "int").alias(c) for i, c in enumerate("ijk")], "file").withColumnRenamed("n", "t")
    rooms = _part(files, 4 + nv + nt, nr, "room").select("room", _num(0).alias("z_min"), _num(1).alias("z_max"), F.explode(F.transform(F.slice("t", F.lit(4), _num(2, "int")), lambda v: v.try_cast("int"))).alias("t"), "file")
    return verts, tris, rooms


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """ix, iy, iz, state; the line of the voxel size is shorter."""
    return _tokens(spark, path).where(F.size("t") == 4).select(*[_num(i, "int").alias(c) for i, c in enumerate(("ix", "iy", "iz", "state"))])


def read_image_map(spark: SparkSession, path: str) -> DataFrame:
    """cx, cy and the ordered images of each cell."""
    images = F.transform(F.slice("t", F.lit(4), _num(2, "int")), lambda v: v.try_cast("int"))
    return _tokens(spark, path).where(F.size("t") >= 3).select(_num(0).alias("cx"), _num(1).alias("cy"), images.alias("images"))


def read_coordinate_map(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: resolution, offset_x, offset_y, file. model = (image - offset) * resolution."""
    return _whole(spark, path).select(*[_word(k).try_cast("double").alias(c) for k, c in enumerate(("resolution", "offset_x", "offset_y"))], "file")


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    names = ("min_h", "min_v", "max_h", "max_v")
    return _tokens(spark, path).where(F.size("t") >= 6).select(_num(0, "int").alias("v1"), _num(1, "int").alias("v2"), *[_num(i + 2).alias(c) for i, c in enumerate(names)])


def read_room_values(spark: SparkSession, path: str, name: str) -> DataFrame:
    """room, value, file of files of one number a line, the line number being the room: lights, people, plug loads."""
    return _numbered(spark, path).select(F.col("n").alias("room"), _num(0).alias(name), "file")


def read_clock_fits(spark: SparkSession, path: str, row_tag: str = "sensor") -> DataFrame:
    """sensor, slope, offset, stddev of a time-synchronisation XML file; a missing stddev is -1."""
    rows = spark.read.format("xml").option("rowTag", row_tag).load(path)
    get = lambda n, d=None: F.col(n).cast("double") if n in rows.columns else F.lit(d).cast("double")
    name = "name" if "name" in rows.columns else "_name"
    return rows.select(F.col(name).alias("sensor"), get("slope", 1.0).alias("slope"), get("offset", 0.0).alias("offset"), F.coalesce(get("stddev"), F.lit(-1.0)).alias("stddev"))


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """Flat tag -> text of a settings XML file, a small file."""
    import xml.etree.ElementTree as ET

    text = spark.read.text(path, wholetext=True).first()[0]
    return {e.tag: (e.text or "").strip() for e in ET.fromstring(text) if len(e) == 0}


def _starting(word: str):
    return F.filter("lines", lambda v: v.startswith(f"{word} "))


def read_mesh_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (v, x, y, z, file), numbered from 0 in each file, and faces (f, vertices, file) of meshes, whose lines count.

    Faces may name vertices from the first (1) on or back from the last one so far (-1).
    """
    files = _whole(spark, path)
    verts = files.select("file", F.posexplode(_starting("v")).alias("v", "line")).select("v", F.split("line", r"\s+").alias("t"), "file")
    # the place of a face among vertices and faces, less its number, is how many vertices there are before it
    both = F.filter("lines", lambda v: v.startswith("v ") | v.startswith("f "))
    own = F.filter(F.transform(both, lambda v, i: F.struct(i.alias("i"), v.alias("line"))), lambda s: s["line"].startswith("f "))
    faces = files.select("file", F.posexplode(own).alias("f", "s")).select("file", "f", (F.col("s.i") - F.col("f")).alias("n"), F.split("s.line", r"\s+").alias("t"))
    number = lambda w: F.get(F.split(w, "/"), 0).try_cast("int")
    corner = F.transform(F.slice("t", F.lit(2), F.size("t") - 1), lambda w: F.when(number(w) < 0, F.col("n") + number(w)).otherwise(number(w) - 1))
    return verts.select("v", *[_num(i + 1).alias(c) for i, c in enumerate("xyz")], "file"), faces.select("f", corner.alias("vertices"), "file")


def read_image_list(spark: SparkSession, path: str) -> DataFrame:
    """image, file, timestamp, exposure, gain of an image list; its four header lines have fewer words."""
    rows = _tokens(spark, path).where(F.size("t") == 5)
    return rows.select(_num(0, "int").alias("image"), F.get("t", 1).alias("file"), _num(2).alias("timestamp"), _num(3).alias("exposure"), _num(4).alias("gain")).where("image is not null")


def read_camera_file(spark: SparkSession, path: str) -> DataFrame:
    """serial, k (9), r (9), translation (3), mask, image, timestamp and file of camera files, one row for each image; small files."""
    numbers = lambda line, c: F.transform(F.split(F.get("lines", line), r"\s+"), lambda v: v.try_cast("double")).alias(c)
    # what is of the file is taken before its lines are parted, or each row would carry all lines
    files = _whole(spark, path).select("file", _word(0).alias("serial"), numbers(1, "k"), numbers(2, "r"), numbers(3, "translation"), F.element_at("lines", -1).alias("mask"), F.slice("lines", F.lit(5), F.greatest(F.lit(0), F.size("lines") - 5)).alias("rest"))
    t = F.split("line", r"\s+")
    return files.select("file", "serial", "k", "r", "translation", "mask", F.explode("rest").alias("line")).withColumn("t", t).where("size(t) = 2").select("serial", "k", "r", "translation", "mask", F.get("t", 0).alias("image"), _num(1).alias("timestamp"), "file")


def read_panorama_list(spark: SparkSession, path: str) -> DataFrame:
    """file, timestamp and the position of each panorama of a list: lines of a file name and numbers after four header lines."""
    rows = _numbered(spark, path).where("n >= 4 and size(t) >= 5")
    return rows.select(F.get("t", 0).alias("file"), *[_num(i + 1).alias(c) for i, c in enumerate(("timestamp", "x", "y", "z"))])


def read_mesh_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (v, x, y, z, file) and faces (f, vertices, file) of ascii PLY files whose vertices begin with x y z; their lines count.

    binary.read_ply reads PLY files of any encoding and any properties.
    """
    size = lambda name: F.coalesce(F.regexp_extract(F.get(F.filter("lines", lambda v: v.startswith(f"element {name} ")), 0), r"(\d+)$", 1).try_cast("int"), F.lit(0))
    files = _whole(spark, path).withColumns({"end": F.array_position("lines", "end_header").cast("int"), "nv": size("vertex"), "nf": size("face")}).where("end > 0")
    verts = _part(files, F.col("end"), F.col("nv"), "v").select("v", *[_num(i).alias(c) for i, c in enumerate("xyz")], "file")
    corners = F.transform(F.slice(F.col("t"), F.lit(2), _num(0, "int")), lambda w: w.try_cast("int"))
    return verts, _part(files, F.col("end") + F.col("nv"), F.col("nf"), "f").select("f", corners.alias("vertices"), "file")


def read_chunk_list(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, cx, cy, cz, hw, file of chunk manifests: one row for each chunk, with the cube of the whole volume. Header lines may come in any order."""
    value = lambda key, i: F.get(F.split(F.get(F.filter("lines", lambda v: F.split(v, r"\s+")[0] == key), 0), r"\s+"), i).try_cast("double")
    files = _whole(spark, path).withColumn("end", F.array_position("lines", "end_header").cast("int")).where("end > 0")
    cube = [value("center", i + 1).alias(c) for i, c in enumerate(("cx", "cy", "cz"))]
    files = files.select(*cube, value("halfwidth", 1).alias("hw"), "file", F.slice("lines", F.col("end") + 1, F.size("lines")).alias("rest"))
    return files.select(F.explode("rest").alias("chunk_id"), "cx", "cy", "cz", "hw", "file")


def read_transforms(spark: SparkSession, path: str, row_tag: str = "sensor") -> DataFrame:
    """sensor, enabled, r (9), t (3) of a hardware XML file, whose elements hold name, enable, R and T as words; no enable means yes."""
    rows = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(path)
    name = "name" if "name" in rows.columns else "_name"
    numbers = lambda c: F.transform(F.split(F.trim(F.col(c)), r"[\s,]+"), lambda v: v.try_cast("double"))
    on = F.coalesce(F.lower("enable").isin("1", "true", "yes"), F.lit(True)) if "enable" in rows.columns else F.lit(True)
    return rows.select(F.col(name).alias("sensor"), on.alias("enabled"), numbers("R").alias("r"), numbers("T").alias("t"))


def read_camera_log(spark: SparkSession, path: str) -> DataFrame:
    """image, file, camera_time, exposure, gain of lines that begin with the file."""
    return _tokens(spark, path).where(F.size("t") >= 5).select(_num(1, "int").alias("image"), F.get("t", 0).alias("file"), _num(2).alias("camera_time"), _num(3).alias("exposure"), _num(4).alias("gain")).where("image is not null")


def read_frame_list(spark: SparkSession, path: str) -> DataFrame:
    """frame, file, timestamp of the index of depth maps, normal maps or depth video: lines of a number, a file and a time."""
    return _tokens(spark, path).where(F.size("t") >= 3).select(_num(0, "int").alias("frame"), F.get("t", 1).alias("file"), _num(2).alias("timestamp")).where("frame is not null and timestamp is not null")
