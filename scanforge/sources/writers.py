"""Writers of text formats: each row becomes a line in parallel; headers, where a format has one, go to a file that sorts first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT_FORMATS = ("xyz", "pts", "obj", "pcd")


def _line(*cols: Column | str) -> Column:
    return F.concat_ws(" ", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]).alias("value")


def point_lines(df: DataFrame, fmt: str) -> DataFrame:
    """Lines of a point format, without header."""
    if fmt not in POINT_FORMATS:
        raise ValueError(f"unknown point format {fmt}")
    if fmt == "xyz":
        return df.select(_line("x", "y", "z", "r", "g", "b", "index", "timestamp", F.lit(0)))
    if fmt == "obj":
        return df.select(_line(F.lit("v"), "x", "y", "z", *[F.col(c) / 255 for c in "rgb"]))
    if fmt == "pcd":
        packed = F.shiftleft(F.col("r"), 16) + F.shiftleft(F.col("g"), 8) + F.col("b")
        return df.select(_line("x", "y", "z", packed))
    return df.select(_line("x", "y", "z", "r", "g", "b"))


def pcd_header(n: int) -> str:
    return "\n".join(["VERSION .7", "FIELDS x y z rgb", "SIZE 8 8 8 4", "TYPE F F F U", "COUNT 1 1 1 1", f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA ascii"])


def write_points(df: DataFrame, path: str, fmt: str) -> None:
    """Write a folder of point lines; a pcd folder has its header, with the number of points, in the subfolder `header`."""
    point_lines(df, fmt).write.mode("errorifexists").text(path)
    if fmt == "pcd":
        spark = df.sparkSession
        spark.createDataFrame([(pcd_header(df.count()),)], "value string").coalesce(1).write.text(f"{path}/header")


def write_by_level(df: DataFrame, path: str, level: str = "level") -> None:
    """One folder of points for each storey."""
    lines = df.select(level, _line("x", "y", "z", "r", "g", "b", "index", "timestamp", F.lit(0)))
    lines.write.partitionBy(level).text(path)


def level_lines(levels: DataFrame) -> DataFrame:
    return levels.select(_line(F.lit("level"), "level", "floor", "ceiling"))


def wall_sample_lines(cells: DataFrame, weight: str = "weight", form: str = "grid") -> DataFrame:
    """Lines of cells with poses. The grid form drops weights that truncate to 0 and prints the truncated weight; the tree form
    drops weights of 0 or less and prints one more."""
    rows = cells.where(F.size("poses") > 0)
    whole = F.col(weight).cast("long")
    rows, count = (rows.where(whole > 0), whole) if form == "grid" else (rows.where(F.col(weight) > 0), whole + 1)
    return rows.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x", "y", "min_z", "max_z")], count.cast("string"), F.size("poses").cast("string"), F.concat_ws(" ", F.transform("poses", lambda p: p.cast("string")))).alias("value"))


def voxel_lines(voxels: DataFrame) -> DataFrame:
    return voxels.select(_line("ix", "iy", "iz", "state"))


def image_map_lines(cells: DataFrame) -> DataFrame:
    return cells.select(F.concat_ws(" ", F.col("cx").cast("string"), F.col("cy").cast("string"), F.size("images").cast("string"), F.concat_ws(" ", F.transform("images", lambda p: p.cast("string")))).alias("value"))


def open_height_lines(cells: DataFrame) -> DataFrame:
    return cells.select(_line("i0", "i1", "open_height"))


def room_label_lines(cells: DataFrame) -> DataFrame:
    return cells.where("room >= 0").select(_line("i0", "i1", "room"))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(_line("x0", "y0", "x1", "y1"))


#: Rows of a floor plan that one text may take to the driver; larger ones are written by floor_plan_documents.
MOST_PLAN_ROWS = 1_000_000


def floor_plan_text(res: float, verts: DataFrame, tris: DataFrame, rooms: DataFrame) -> str:
    """The text of a floor plan, a small file. Raises ValueError beyond MOST_PLAN_ROWS vertices, triangles or room triangles."""
    if any(d.limit(MOST_PLAN_ROWS + 1).count() > MOST_PLAN_ROWS for d in (verts, tris, rooms)):
        raise ValueError("too large a floor plan for one text; use floor_plan_documents")
    v, t = verts.orderBy("v").collect(), tris.orderBy("t").collect()
    r = rooms.groupBy("room", "z_min", "z_max").agg(F.array_sort(F.collect_list("t")).alias("ts")).orderBy("room").collect()
    lines = [str(res), str(len(v)), str(len(t)), str(len(r)), *(f"{x['x']!r} {x['y']!r}" for x in v), *(f"{x['i']} {x['j']} {x['k']}" for x in t)]
    return "\n".join([*lines, *(" ".join(map(str, (x["z_min"], x["z_max"], len(x["ts"]), *x["ts"]))) for x in r)]) + "\n"


def room_csv(rooms: DataFrame, path: str) -> None:
    """Perimeter, area and volume of rooms, in metres and feet."""
    f = 1 / 0.3048
    rooms.select("room", "perimeter", (F.col("perimeter") * f).alias("perimeter_ft"), "area", (F.col("area") * f * f).alias("area_sqft"), "volume", (F.col("volume") * f**3).alias("volume_cuft")).coalesce(1).write.option("header", True).csv(path)


def mesh_lines(verts: DataFrame, faces: DataFrame, one_based: bool = True) -> tuple[DataFrame, DataFrame]:
    """OBJ lines of vertices (v, x, y, z), numbered from 0, and faces (f, vertices), each in order."""
    shift = 1 if one_based else 0
    return (
        verts.orderBy("v").select(_line(F.lit("v"), "x", "y", "z")),
        faces.orderBy("f").select(F.concat_ws(" ", F.lit("f"), F.concat_ws(" ", F.transform("vertices", lambda i: (i + shift).cast("string")))).alias("value")),
    )


# --- small files, of which each is one row: (file, lines) ----------------------------------------------------------------


def write_documents(files: DataFrame, path: str) -> None:
    """A folder file=... for each row of (file, lines), with one file of those lines."""
    files.select("file", F.array_join("lines", "\n").alias("value")).write.partitionBy("file").text(path)


def _words(*cols: Column | str) -> Column:
    return F.concat_ws(" ", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def _ordered(rows: DataFrame, key: str, line: Column, name: str) -> DataFrame:
    """(file, name): the lines of each file in the order of a key. A file's lines are gathered, as a small file is one text."""
    return rows.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line")))), lambda s: s["line"]).alias(name))


def _joined(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "file", "full")
    names = [c for c in out.columns if c != "file"]
    return out.select("file", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in names])


def _count(name: str) -> Column:
    return F.size(name).cast("string")


def floor_plan_documents(res: float, verts: DataFrame, tris: DataFrame, rooms: DataFrame) -> DataFrame:
    """(file, lines) of floor plans from (file, v, x, y), (file, t, i, j, k) and (file, room, z_min, z_max, t), numbered from 0 in each file."""
    own = rooms.groupBy("file", "room", "z_min", "z_max").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    r = _ordered(own, "room", _words("z_min", "z_max", F.size("ts"), F.concat_ws(" ", F.transform("ts", lambda v: v.cast("string")))), "r")
    all_ = _joined(_ordered(verts, "v", _words("x", "y"), "v"), _ordered(tris, "t", _words("i", "j", "k"), "t"), r)
    return all_.select("file", F.concat(F.array(F.lit(str(res)), _count("v"), _count("t"), _count("r")), "v", "t", "r").alias("lines"))


def extruded_plan_documents(verts: DataFrame, tris: DataFrame) -> DataFrame:
    """(file, lines) of OBJ meshes of floor plans from (file, v, x, y, z_min, z_max) and (file, t, i, j, k).

    Floors are followed by ceilings, turned downwards, and by two triangles for each wall, walls being the sides of one triangle only.
    """
    v = _joined(_ordered(verts, "v", _words(F.lit("v"), "x", "y", "z_min"), "floor"), _ordered(verts, "v", _words(F.lit("v"), "x", "y", "z_max"), "ceiling"))
    n = verts.groupBy("file").agg(F.count("*").alias("n"))
    corner = lambda c, up=False: F.col(c) + 1 + (F.col("n") if up else 0)
    numbered = tris.join(n, "file")
    t = _joined(_ordered(numbered, "t", _words(F.lit("f"), *[corner(c) for c in "ijk"]), "down"), _ordered(numbered, "t", _words(F.lit("f"), *[corner(c, True) for c in "kji"]), "up"))
    sides = F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ("ij", "jk", "ki")]))
    edges = tris.select("file", sides.alias("e")).select("file", "e.a", "e.b", F.least("e.a", "e.b").alias("lo"), F.greatest("e.a", "e.b").alias("hi"))
    single = edges.groupBy("file", "lo", "hi").agg(F.count("*").alias("m"), F.first("a").alias("a"), F.first("b").alias("b")).where("m = 1").join(n, "file")
    wall = F.array_join(F.array(_words(F.lit("f"), corner("a"), corner("a", True), corner("b", True)), _words(F.lit("f"), corner("a"), corner("b", True), corner("b"))), "\n")
    w = _ordered(single.withColumn("k", F.struct("a", "b")), "k", wall, "walls")
    return _joined(v, t, w).select("file", F.concat("floor", "ceiling", "down", "up", "walls").alias("lines"))


def mesh_documents(verts: DataFrame, faces: DataFrame) -> DataFrame:
    """(file, lines) of OBJ meshes from (file, v, x, y, z) and (file, f, vertices), numbered from 0 in each file."""
    f = _words(F.lit("f"), F.concat_ws(" ", F.transform("vertices", lambda i: (i + 1).cast("string"))))
    return _joined(_ordered(verts, "v", _words(F.lit("v"), "x", "y", "z"), "v"), _ordered(faces, "f", f, "f")).select("file", F.concat("v", "f").alias("lines"))


def chunk_list_documents(chunks: DataFrame) -> DataFrame:
    """(file, lines) of chunk manifests from (file, chunk_id, cx, cy, cz, hw), the cube being that of the whole volume."""
    head = chunks.groupBy("file").agg(F.first(F.struct("cx", "cy", "cz", "hw")).alias("c"))
    all_ = _joined(_ordered(chunks, "chunk_id", F.col("chunk_id"), "ids")).join(head, "file")
    top = F.array(F.lit("chunklist"), _words(F.lit("center"), "c.cx", "c.cy", "c.cz"), _words(F.lit("halfwidth"), "c.hw"), _words(F.lit("num_chunks"), F.size("ids")), F.lit("chunk_dir chunks"), F.lit("end_header"))
    return all_.select("file", F.concat(top, "ids").alias("lines"))


def panorama_list_documents(poses: DataFrame, rows: int, cols: int, cameras: list[str]) -> DataFrame:
    """(file, lines) of panorama lists from (file, n, name, timestamp, x, y, z)."""
    p = _ordered(poses, "n", _words("name", "timestamp", "x", "y", "z"), "poses")
    top = F.array(F.lit("scanolist"), F.lit(f"{rows} {cols}"), _count("poses"), F.lit(" ".join(cameras)))
    return p.select("file", F.concat(top, "poses").alias("lines"))


def camera_documents(images: DataFrame, mask: str) -> DataFrame:
    """(file, lines) of camera files from (file, serial, k, r, translation, image, timestamp), one row for each image."""
    numbers = lambda c: F.concat_ws(" ", F.transform(F.col(c), lambda v: v.cast("string")))
    head = images.groupBy("file").agg(F.first(F.struct("serial", numbers("k").alias("k"), numbers("r").alias("r"), numbers("translation").alias("t"))).alias("c"))
    all_ = _ordered(images, "image", _words("image", "timestamp"), "images").join(head, "file")
    return all_.select("file", F.concat(F.array(_words("c.serial", F.size("images")), F.col("c.k"), F.col("c.r"), F.col("c.t")), "images", F.array(F.lit(mask))).alias("lines"))


def coordinate_map_documents(maps: DataFrame) -> DataFrame:
    return maps.select("file", F.array(*[F.col(c).cast("string") for c in ("resolution", "offset_x", "offset_y")]).alias("lines"))


def panorama_point_documents(points: DataFrame) -> DataFrame:
    """(file, lines) of panorama points from (file, row, col, x, y, z, r, g, b, cx, cy, cz), c being the centre: columns, rows, frame, points."""
    grey = (F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114) / 255
    body = _ordered(points.withColumn("k", F.struct("col", "row")), "k", _words("x", "y", "z", grey, "r", "g", "b"), "points")
    head = points.groupBy("file").agg(F.max("col").alias("nc"), F.max("row").alias("nr"), F.first(F.struct("cx", "cy", "cz")).alias("c"))
    at = _words("c.cx", "c.cy", "c.cz")
    fixed = [F.lit(v) for v in ("1 0 0", "0 1 0", "0 0 1", "1 0 0 0", "0 1 0 0", "0 0 1 0")]
    top = F.array((F.col("nc") + 1).cast("string"), (F.col("nr") + 1).cast("string"), at, *fixed, F.concat(at, F.lit(" 1")))
    return body.join(head, "file").select("file", F.concat(top, "points").alias("lines"))


def door_documents(doors: DataFrame) -> DataFrame:
    """(file, lines) of doors from (file, door, x0, y0, x1, y1, floor, ceiling, x, y, z), the file being the storey."""
    line = _words(F.lit("door"), "x0", "y0", "x1", "y1", "floor", "ceiling", "x", "y", "z")
    return _ordered(doors, "door", line, "d").select("file", F.concat(F.array(_words(F.lit("level_index"), "file")), "d").alias("lines"))


# --- leaves of trees, one or several lines each ---------------------------------------------------------------------------


def leaf_statistic_lines(leaves: DataFrame) -> DataFrame:
    """Probability, held within 0 and 1, and its variance for each leaf."""
    from ..operators.aggregates import probability, uncertainty

    return leaves.select(_line(F.greatest(F.lit(0.0), F.least(F.lit(1.0), probability())), uncertainty()))


def leaf_centre_lines(leaves: DataFrame) -> DataFrame:
    """A coloured OBJ vertex at the centre of each leaf: red what is solid, green what is empty, blue the more the surer."""
    from ..operators.aggregates import probability

    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), probability()))
    shade = lambda c: F.floor(255 * c).cast("int")
    return leaves.select(_line(F.lit("v"), "cx", "cy", "cz", shade(1 - p), shade(p), shade(2 * F.abs(p - 0.5))))


#: Corners of a cube, and its faces by corners counted back from the last one.
_CUBE = [(1, 1, 1), (1, -1, 1), (-1, -1, 1), (-1, 1, 1), (1, 1, -1), (1, -1, -1), (-1, -1, -1), (-1, 1, -1)]
_CUBE_FACES = ["-1 -4 -3 -2", "-5 -6 -7 -8", "-2 -3 -7 -6", "-1 -5 -8 -4", "-3 -4 -8 -7", "-6 -5 -1 -2"]


def leaf_cube_lines(leaves: DataFrame) -> DataFrame:
    """OBJ cubes, one row of 14 lines each, of leaves that are objects; red where nothing was observed, else green."""
    from ..operators.aggregates import probability
    from ..operators.filters import is_object

    seen = F.col("count") > 0
    colour = _words(F.when(seen, 0).otherwise(255), F.when(seen, 255).otherwise(0), F.floor(255 * probability()).cast("int"))
    corners = [_words(F.lit("v"), *[F.col(f"c{a}") + s * F.col("hw") for a, s in zip("xyz", c)], colour) for c in _CUBE]
    return leaves.where(is_object(probability(), F.col("fp_room"))).select(F.concat_ws("\n", *corners, *[F.lit(f"f {f}") for f in _CUBE_FACES]).alias("value"))
