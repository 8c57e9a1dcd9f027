"""Rooms, walls, windows and doors of floor plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shapes as G
from .joins import box_cells, met_first, segment_cells


def windows_on_walls(windows: DataFrame, walls: DataFrame) -> DataFrame:
    """Windows with the wall (v1, v2, ...) that they lie on, in either direction. `matches` is the number of walls found.

    A window of no wall, or of several, is an error of the plan: its matches differ from 1.
    """
    low = lambda df: df.withColumns({"__a": F.least("v1", "v2"), "__b": F.greatest("v1", "v2")})
    w = low(walls).drop("v1", "v2")
    n = w.groupBy("__a", "__b").agg(F.count("*").alias("matches"))
    joined = low(windows).join(n, ["__a", "__b"], "left").join(w, ["__a", "__b"], "left")
    return joined.withColumn("matches", F.coalesce("matches", F.lit(0))).drop("__a", "__b")


def locate(points: DataFrame, triangles: DataFrame, width: float, key: list[str]) -> DataFrame:
    """The smallest triangle (t, ax, ay, bx, by, cx, cy) that holds each point (x, y), its edges included."""
    box = triangles.select("*", *[f(*[F.col(f"{c}{a}") for c in "abc"]).alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.least), ("hi", F.greatest))])
    cells = box_cells(box, ["lox", "loy"], ["hix", "hiy"], width).drop("lox", "loy", "hix", "hiy")
    at = points.withColumns({"i0": F.floor(F.col("x") / width), "i1": F.floor(F.col("y") / width)})
    hit = at.join(cells, ["i0", "i1"]).where(G.in_triangle(G.vec("x", "y"), G.vec("ax", "ay"), G.vec("bx", "by"), G.vec("cx", "cy")))
    return hit.groupBy(*key).agg(F.min("t").alias("t"))


def segment_triangles(segments: DataFrame, triangles: DataFrame, width: float, key: list[str]) -> DataFrame:
    """Triangles that each segment (x0, y0)-(x1, y1) crosses or touches: key, t.

    A triangle without area is taken by the signs of its three sides like any other: it holds whatever lies on its line. Such
    triangles, which are few, meet all starts; the others meet segments in grid cells.
    """
    low, high = ["lox", "loy"], ["hix", "hiy"]
    box = triangles.select("*", *[f(*[F.col(f"{c}{a}") for c in "abc"]).alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.least), ("hi", F.greatest))])
    met = segment_cells(segments, ["x0", "y0"], ["x1", "y1"], width, "p").join(box_cells(box, low, high, width), ["i0", "i1"]).where(met_first("p", low, high, width))
    p, corners = G.vec("x0", "y0"), [G.vec(f"{c}x", f"{c}y") for c in "abc"]
    # step by step, so that no number is worked out twice; a filter would take all of them into the join, so that an explode picks the hits
    sides = [(corners[k], corners[(k + 1) % 3]) for k in range(3)]
    steps = {"__r": G.sub(G.vec("x1", "y1"), p)} | {f"__e{k}": G.sub(b, a) for k, (a, b) in enumerate(sides)} | {f"__w{k}": G.sub(a, p) for k, (a, _) in enumerate(sides)}
    met = met.select(*key, "t", *[c.alias(f"{n}{a}") for n, v in steps.items() for a, c in zip("xy", v)])
    turn = lambda u, v: F.col(f"{u}x") * F.col(f"{v}y") - F.col(f"{u}y") * F.col(f"{v}x")
    met = met.withColumns({f"__{n}{k}": turn(*uv) for k in range(3) for n, uv in (("o", (f"__w{k}", f"__e{k}")), ("l", (f"__w{k}", "__r")), ("d", ("__r", f"__e{k}")))})
    inside = (F.least("__o0", "__o1", "__o2") >= 0) | (F.greatest("__o0", "__o1", "__o2") <= 0)
    for k in range(3):
        inside = inside | F.coalesce(F.try_divide(f"__o{k}", f"__d{k}").between(0.0, 1.0) & F.try_divide(f"__l{k}", f"__d{k}").between(0.0, 1.0), F.lit(False))
    hit = met.select(*key, "t", F.explode(F.filter(F.array(inside), lambda v: v)))
    # rounding may leave a trace of an area
    flat = triangles.where(F.abs(G.orient2d(*corners)) <= 1e-9 * (1 + F.greatest(*[F.abs(F.col(f"{c}{a}")) for c in "abc" for a in "xy"]) ** 2))
    starts = segments.select("x0", "y0").distinct().join(flat, G.in_triangle(p, *corners)).select("x0", "y0", "t")
    return hit.select(*key, "t").union(segments.join(starts, ["x0", "y0"]).select(*key, "t")).distinct()


def visited_rooms(rooms: DataFrame, path_hits: DataFrame, room: str = "room") -> DataFrame:
    """Rooms that the path comes through."""
    return rooms.join(path_hits.select(room).distinct(), room, "left_semi")


def interior_triangles(triangles: DataFrame, crossed: DataFrame) -> DataFrame:
    """Triangles with a mark: those that a ray from a pose to a wall cell crosses are interior."""
    return triangles.join(crossed.select("t", F.lit(True).alias("interior")).distinct(), "t", "left").withColumn("interior", F.coalesce("interior", F.lit(False)))


def rooms_of_vertices(room_triangles: DataFrame) -> DataFrame:
    """(v, rooms): ordered set of the rooms of the triangles (room, i, j, k) at a vertex."""
    return room_triangles.select("room", F.explode(F.array("i", "j", "k")).alias("v")).groupBy("v").agg(F.array_sort(F.collect_set("room")).alias("rooms"))


def room_boxes(verts: DataFrame, room_triangles: DataFrame) -> DataFrame:
    """Bounding box of each room's vertices."""
    each = room_triangles.select("room", F.explode(F.array("i", "j", "k")).alias("v")).join(verts, "v")
    return each.groupBy("room").agg(*[f(a).alias(f"{n}_{a}") for a in "xy" for n, f in (("min", F.min), ("max", F.max))])


def wall_samples(walls: DataFrame, res: float) -> DataFrame:
    """A grid of points on each upright wall (wall, ax, ay, bx, by, z_min, z_max): wall, s, h, x, y, z; cell middles at `res`."""
    length = F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay")))
    n = lambda v: F.greatest(F.lit(1), F.ceil(v / res)).cast("long")
    grid = walls.withColumns({"ns": n(length), "nh": n(F.col("z_max") - F.col("z_min"))})
    grid = grid.withColumn("s", F.explode(F.expr("sequence(cast(0 as bigint), ns - 1)"))).withColumn("h", F.explode(F.expr("sequence(cast(0 as bigint), nh - 1)")))
    f, g = (F.col("s") + 0.5) / F.col("ns"), (F.col("h") + 0.5) / F.col("nh")
    return grid.select("wall", "s", "h", *[(F.col(f"a{a}") * (1 - f) + F.col(f"b{a}") * f).alias(a) for a in "xy"], (F.col("z_min") * (1 - g) + F.col("z_max") * g).alias("z"))


def alignment_cost(leaves: DataFrame, by: list[str]) -> DataFrame:
    """Sum of (1 - probability) * hw^2 * planarity over the exterior leaves next to each wall, floor or ceiling."""
    own = (1 - F.col("probability")) * F.col("hw") * F.col("hw") * F.col("planarity")
    return leaves.groupBy(*by).agg(F.sum(F.when(F.col("probability") <= 0.5, own).otherwise(0.0)).alias("cost"))


def door_positions(crossings: DataFrame, cells: DataFrame, half: float, steps: int, res: float, missing: float = 1e9) -> DataFrame:
    """For each crossing (door, x, y, angle) the place along its line where the passage is narrowest.

    2 * steps + 1 samples are taken over half a width each way; open heights come from plan cells (i0, i1, open_height); the
    least height wins, the sample nearest to the crossing at ties.
    """
    k = F.explode(F.sequence(F.lit(-steps), F.lit(steps)))
    at = crossings.withColumn("k", k).withColumn("off", F.col("k") * F.lit(half / steps))
    at = at.withColumns({"sx": F.col("x") + F.cos("angle") * F.col("off"), "sy": F.col("y") + F.sin("angle") * F.col("off")})
    hit = at.withColumns({"i0": F.floor(F.col("sx") / res), "i1": F.floor(F.col("sy") / res)}).join(cells.select("i0", "i1", "open_height"), ["i0", "i1"], "left")
    best = hit.groupBy("door").agg(F.min(F.struct(F.coalesce("open_height", F.lit(missing)).alias("h"), F.abs("k").alias("a"), "k", "sx", "sy")).alias("m"))
    return best.select("door", F.col("m.sx").alias("x"), F.col("m.sy").alias("y"), F.when(F.col("m.h") < missing, F.col("m.h")).alias("open_height"))


def unproject(pixels: DataFrame, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """World points of depth pixels (u, v, depth) with a pose (qw, qx, qy, qz, px, py, pz) on each row; depth 0 is nothing."""
    p = [(F.col("u") - cx) / fx * F.col("depth"), (F.col("v") - cy) / fy * F.col("depth"), F.col("depth")]
    w, x, y, z = G.vec("qw", "qx", "qy", "qz")
    r = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    world = G.apply(r, p, G.vec("px", "py", "pz"))
    return pixels.where("depth > 0").withColumns({a: v for a, v in zip("xyz", world)})


def inside_plans(leaves: DataFrame, plans: DataFrame, margin: float) -> DataFrame:
    """Leaves whose cube comes within `margin` of the box of some floor plan (min_x .. max_z): a trim of stray space. Plans are few."""
    low, high = [F.col(f"c{a}") - F.col("hw") for a in "xyz"], [F.col(f"c{a}") + F.col("hw") for a in "xyz"]
    meet = G.boxes_meet(low, high, [F.col(f"min_{a}") - margin for a in "xyz"], [F.col(f"max_{a}") + margin for a in "xyz"])
    return leaves.join(F.broadcast(plans.select(*[f"{m}_{a}" for a in "xyz" for m in ("min", "max")])), meet, "left_semi")  # a row a storey


def only(leaves: DataFrame, whitelist: DataFrame, key: str = "leaf") -> DataFrame:
    return leaves.join(whitelist.select(key).distinct(), key, "left_semi")


def without_links(cells: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Cells that have a link (u, v)."""
    ends = links.select(F.col("u").alias(key)).union(links.select(F.col("v").alias(key))).distinct()
    return cells.join(ends, key, "left_semi")


def clear_rooms(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("fp_room", F.lit(-1))


def polygon_covers_box(polygon: Column, low: list[Column], high: list[Column]) -> Column:
    """Whether a polygon holds all four corners and the centre of a plan box; exact for convex polygons."""
    middle = [(a + b) / 2 for a, b in zip(low, high)]
    out = G.polygon_contains(middle[0], middle[1], polygon)
    for x in (low[0], high[0]):
        for y in (low[1], high[1]):
            out = out & G.polygon_contains(x, y, polygon)
    return out


def voxelise(points: DataFrame, res: float, most: float) -> DataFrame:
    """Distinct voxels of points (x, y, z) at most `most` from their pose (px, py, pz)."""
    near = G.distance(G.vec("x", "y", "z"), G.vec("px", "py", "pz")) <= most
    return points.where(near).select(*[F.floor(F.col(a) / res).alias(f"i{a}") for a in "xyz"]).distinct()


def between_scans(scans: DataFrame, frame: str, point: str, steps: int) -> DataFrame:
    """Rays (sensor sx.. to point x..) of each scan, and `steps` - 1 rays interpolated to the next scan of the frame order by point number."""
    w = Window.partitionBy(point).orderBy(frame)
    cols = ["sx", "sy", "sz", "x", "y", "z"]
    both = scans.withColumns({f"n_{c}": F.lead(c).over(w) for c in cols}).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    f = F.col("k") / steps
    return both.where("k = 0 or n_x is not null").select(frame, point, "k", *[F.when(F.col("k") == 0, F.col(c)).otherwise(F.col(c) * (1 - f) + F.col(f"n_{c}") * f).alias(c) for c in cols])


def farthest_pair(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b): the two points (key p, x, y) furthest apart in each group, such as the triangles of a room, whose number is small."""
    other = points.select(*by, F.col("p").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    best = points.join(other, by).where("p < q").groupBy(*by).agg(F.max(F.struct(d2.alias("d"), (-F.col("p")).alias("a"), (-F.col("q")).alias("b"))).alias("m"))
    return best.select(*by, (-F.col("m.a")).alias("a"), (-F.col("m.b")).alias("b"), F.sqrt("m.d").alias("distance"))


def room_pixels(pixels: DataFrame, rooms: DataFrame, resolution: float, offset_x: float, offset_y: float, width: float) -> DataFrame:
    """Pixels (row, col) of a plan image that lie in the polygon of some room, its boundary included; the others are blanked by leaving them out.

    model = (image - offset) * resolution, as in coordinate maps. Rooms have polygon, an array of struct<x, y>; both sides meet on
    plan cells of a width.
    """
    cells = rooms.select("polygon")
    for n, a in enumerate("xy"):
        cells = cells.withColumn(f"i{n}", F.explode(F.sequence(F.floor(F.array_min(F.col(f"polygon.{a}")) / width), F.floor(F.array_max(F.col(f"polygon.{a}")) / width))))
    at = pixels.withColumns({"__x": (F.col("col") - offset_x) * resolution, "__y": (F.col("row") - offset_y) * resolution})
    at = at.withColumns({"i0": F.floor(F.col("__x") / width), "i1": F.floor(F.col("__y") / width)})
    on = (at["i0"] == cells["i0"]) & (at["i1"] == cells["i1"]) & G.polygon_contains(F.col("__x"), F.col("__y"), F.col("polygon"))
    return at.join(cells, on, "left_semi").select(*pixels.columns)
