from __future__ import annotations

import random

from pyspark.sql import functions as F

from scanforge.functions import shapes as G
from scanforge.operators import building as B
from scanforge.operators import joins as J
from scanforge.operators import surfaces as S
from scanforge.operators import volume as V


def leaf_table(spark):
    rows = [(f"{x}{y}", x + 0.5, y + 0.5, 0.5, 0.5, 0.9 if x == 0 else 0.1, 1.0) for x in (0, 1) for y in (0, 1, 2)]
    return spark.createDataFrame(rows, "leaf string, cx double, cy double, cz double, hw double, probability double, weight double").withColumn("interior", F.col("probability") > 0.5)


def test_faces_regions_and_corners(spark):
    leaves = leaf_table(spark)
    faces = S.leaf_faces(V.boundary_faces(leaves, J.face_neighbours(leaves)), leaves)
    got = sorted((r["interior"], r["fx"], r["nx"], round(r["px"], 9), r["area"]) for r in faces.collect())
    assert got == [("00", 1.0, -1.0, 1.0, 1.0), ("01", 1.0, -1.0, 1.0, 1.0), ("02", 1.0, -1.0, 1.0, 1.0)]
    named = faces.select(F.substring("interior", 2, 1).cast("long").alias("face"), "axis", "sign", "fx", "fy", "fz", "nx", "ny", "nz", "area", F.lit(0.5).alias("hw"), (F.col("fy") / 10).alias("planarity"))
    links = S.face_links(named)
    assert sorted(map(tuple, links.collect())) == [(0, 1), (1, 2)]
    regions = S.planar_regions(named, links)
    s = S.region_summary(named.join(regions, "face")).first()
    assert (s["area"], s["faces"], s["cy"], s["nx"], s["radius"], round(s["planarity"], 9)) == (3.0, 3, 1.5, -1.0, 1.0, 0.05)
    e = S.extents_in_basis(named.withColumn("r", F.lit(1)), ["r"], S.wall_basis(F.lit(-1.0), F.lit(0.0))).first()
    assert (e["min_s"], e["max_s"]) == (-2.5, -0.5)
    q = S.quadric_error(named.withColumn("r", F.lit(1)), ["r"], G.lits(3, 7, 9)).first()
    assert abs(q["error"] - 12.0) < 1e-9
    corners = V.corners(leaves)
    p = {(r["x"], r["y"], r["z"]): r["probability"] for r in S.corner_probability(corners, leaves).collect()}
    assert p[0.0, 0.0, 0.0] == 0.9 and abs(p[1.0, 1.0, 0.0] - 0.5) < 1e-12
    assert S.corner_edges(corners.select("x", "y", "z"), 1.0).count() == 2 * 12 + 3 * 4 + 2 * 8 - 6


def test_directions(spark):
    r = spark.range(1).select(S.dominant_direction(F.lit(0.1), F.lit(-0.9), F.lit(0.2)).alias("d"), S.horizontal_kind(F.lit(0.99), F.lit(5.0), 1.0, 0.9).alias("f"), S.horizontal_kind(F.lit(-0.99), F.lit(5.0), 1.0, 0.9).alias("c"), S.horizontal_kind(F.lit(0.5), F.lit(5.0), 1.0, 0.9).alias("n"), S.oriented(F.lit(1.0), F.lit(0.0), F.lit(0.0), G.lits(-1, 0, 0))[0].alias("o")).first()
    assert tuple(r) == ("y-", "floor", "ceiling", None, -1.0)


def test_vertices(spark):
    planes = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.5), (1, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.25), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 9.0)], "v int, x double, y double, z double, nx double, ny double, nz double, d double").withColumnsRenamed({"x": "ax", "y": "ay", "z": "az"})
    got = {r["v"]: (round(r["x"], 9), round(r["y"], 9), round(r["z"], 9)) for r in S.best_vertex(planes, ["v"], ["ax", "ay", "az"], 1.0).collect()}
    assert got == {1: (0.5, 0.25, 0.0), 2: (0.0, 0.0, 1.0)}
    v = spark.createDataFrame([(1, 5, 1.0, 2.0, 3.0), (2, 6, 1.0, 2.0, 3.0)], "v int, region int, x double, y double, z double")
    pl = spark.createDataFrame([(5, 0.0, 0.0, 1.0, 0.0, 0.0, 7.0)], "region int, nx double, ny double, nz double, px double, py double, pz double")
    assert {r["v"]: r["z"] for r in S.snap_to_plane(v, pl).collect()} == {1: 7.0, 2: 3.0}
    f = spark.createDataFrame([(1, [4, 5, 6, 7])], "face int, vertices array<int>")
    assert sorted((r["i"], r["j"], r["k"]) for r in S.quad_triangles(f).collect()) == [(4, 5, 6), (4, 6, 7)]
    assert S.vertex_regions(spark.createDataFrame([(2, 1), (1, 1), (2, 1)], "region int, v int")).first()["regions"] == [1, 2]


def test_region_neighbours(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3), (2, 4), (4, 2)], "u int, v int")
    sizes = spark.createDataFrame([(1, 2), (2, 50), (3, 9), (4, 3)], "region int, faces int")
    assert [tuple(r) for r in S.surrounded_regions(links, sizes, 5).collect()] == [(1, 2)]
    assert sorted(map(tuple, S.largest_neighbour(links, sizes, 5).collect())) == [(1, 2), (4, 2)]
    faces = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "face int, fx double, fy double, fz double")
    cand = spark.createDataFrame([(1, 7, 1.0, 0.0, 0.0, 3.0), (1, 8, 0.0, 1.0, 0.0, -1.0)], "face int, region int, nx double, ny double, nz double, d double")
    assert S.nearest_region(faces, cand).first()["region"] == 8


def test_smoothing_by_region(spark):
    v = spark.createDataFrame([(i, float(i * i), 0.0, 0.0) for i in range(5)], "v long, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 1, 2, 0), (1, 1, 2, 3, 0), (2, 2, 3, 4, 1)], "t int, i long, j long, k long, region int")
    inside = {r["v"]: r["x"] for r in S.smooth_regions(v, t).collect()}
    assert inside[2] == 4.0 and inside[3] == 9.0 and inside[0] != 0.0
    border = {r["v"]: r["x"] for r in S.smooth_regions(v, t, inside=False).collect()}
    assert border[0] == 0.0 and border[2] == (4 * 2 + 9) / 3 and border[3] == (9 * 2 + 4) / 3


def test_windows_and_doors(spark):
    walls = spark.createDataFrame([(0, 15, "a"), (7, 3, "b"), (3, 7, "c")], "v1 int, v2 int, name string")
    win = spark.createDataFrame([(1, 15, 0), (2, 3, 7), (3, 4, 5)], "w int, v1 int, v2 int")
    got = {r["w"]: r["matches"] for r in B.windows_on_walls(win, walls).collect()}
    assert got == {1: 1, 2: 2, 3: 0}
    cells = spark.createDataFrame([(i, 0, 1.0 if i == 2 else 3.0) for i in range(-3, 4)], "i0 long, i1 long, open_height double")
    d = B.door_positions(spark.createDataFrame([(1, 0.5, 0.5, 0.0)], "door int, x double, y double, angle double"), cells, 2.0, 4, 1.0).first()
    assert (d["x"], d["open_height"]) == (2.0, 1.0)


def test_triangles_of_points_and_segments(spark):
    rnd = random.Random(1)
    tris = [(i, *(rnd.uniform(0, 6) for _ in range(6))) for i in range(25)]
    t = spark.createDataFrame(tris, "t int, ax double, ay double, bx double, by double, cx double, cy double")
    pts = [(i, rnd.uniform(0, 6), rnd.uniform(0, 6)) for i in range(60)]
    segs = [(i, rnd.uniform(0, 6), rnd.uniform(0, 6), rnd.uniform(0, 6), rnd.uniform(0, 6)) for i in range(25)]

    def side(a, b, p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    def holds(q, p):
        c = [(q[1], q[2]), (q[3], q[4]), (q[5], q[6])]
        s = [side(c[k], c[(k + 1) % 3], p) for k in range(3)]
        return min(s) >= 0 or max(s) <= 0

    got = {r["p"]: r["t"] for r in B.locate(spark.createDataFrame(pts, "p int, x double, y double"), t, 0.8, ["p"]).collect()}
    assert got == {i: min(q[0] for q in tris if holds(q, (x, y))) for i, x, y in pts if any(holds(q, (x, y)) for q in tris)}

    def crosses(q, s):
        a, b = (s[1], s[2]), (s[3], s[4])
        c = [(q[1], q[2]), (q[3], q[4]), (q[5], q[6])]
        return holds(q, a) or any(side(a, b, c[k]) * side(a, b, c[(k + 1) % 3]) <= 0 and side(c[k], c[(k + 1) % 3], a) * side(c[k], c[(k + 1) % 3], b) <= 0 for k in range(3))

    found = {(r["s"], r["t"]) for r in B.segment_triangles(spark.createDataFrame(segs, "s int, x0 double, y0 double, x1 double, y1 double"), t, 0.8, ["s"]).collect()}
    assert found == {(s[0], q[0]) for s in segs for q in tris if crosses(q, s)}
    marked = B.interior_triangles(t, spark.createDataFrame([(3,), (3,)], "t int")).where("interior").count()
    assert marked == 1


def test_plans(spark):
    tris = spark.createDataFrame([(1, 0, 1, 2), (2, 1, 2, 3)], "room int, i int, j int, k int")
    assert {r["v"]: r["rooms"] for r in B.rooms_of_vertices(tris).collect()} == {0: [1], 1: [1, 2], 2: [1, 2], 3: [2]}
    verts = spark.createDataFrame([(i, float(i), float(-i)) for i in range(4)], "v int, x double, y double")
    assert {r["room"]: (r["min_x"], r["max_y"]) for r in B.room_boxes(verts, tris).collect()} == {1: (0.0, 0.0), 2: (1.0, -1.0)}
    walls = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0)], "wall int, ax double, ay double, bx double, by double, z_min double, z_max double")
    assert sorted((r["x"], r["z"]) for r in B.wall_samples(walls, 1.0).collect()) == [(0.5, 0.5), (1.5, 0.5)]
    assert B.visited_rooms(tris, spark.createDataFrame([(2,)], "room int")).count() == 1
    px = spark.createDataFrame([(10.0, 5.0, 2.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "u double, v double, depth double, qw double, qx double, qy double, qz double, px double, py double, pz double")
    assert [(r["x"], r["y"], r["z"]) for r in B.unproject(px, 10, 10, 0, 0).collect()] == [(3.0, 2.0, 3.0)]
    leaves = leaf_table(spark)
    box = spark.createDataFrame([(-1.0, 0.0, -1.0, 0.2, -1.0, 1.0)], "min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    assert B.inside_plans(leaves, box, 0.1).count() == 1 and B.only(leaves, leaves.limit(2)).count() == 2
    assert B.without_links(leaves, spark.createDataFrame([("00", "01")], "u string, v string"), "leaf").count() == 2
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    assert tuple(spark.range(1).select(B.polygon_covers_box(ring, G.lits(1, 1), G.lits(4, 4)).alias("a"), B.polygon_covers_box(ring, G.lits(1, 1), G.lits(5, 4)).alias("b")).first()) == (True, False)
    scans = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 1, 2.0, 0.0, 0.0, 3.0, 0.0, 0.0)], "frame int, point int, sx double, sy double, sz double, x double, y double, z double")
    assert sorted((r["frame"], r["k"], r["sx"], r["x"]) for r in B.between_scans(scans, "frame", "point", 2).collect()) == [(0, 0, 0.0, 1.0), (0, 1, 1.0, 2.0), (1, 0, 2.0, 3.0)]
    assert B.voxelise(scans.withColumns({f"p{a}": F.col(f"s{a}") for a in "xyz"}), 0.5, 5.0).count() == 2
    far = B.farthest_pair(spark.createDataFrame([(0, i, float(x), 0.0) for i, x in enumerate((0, 5, 2))], "g int, p int, x double, y double"), ["g"]).first()
    assert (far["a"], far["b"], far["distance"]) == (0, 1, 5.0)
    path = spark.createDataFrame([(0, float(i), float(i)) for i in range(5)], "k int, t double, x double")
    assert [(r["pos"], r["next_x"]) for r in S.first_in_path_order(path, "t", 1, 2, ["k"]).orderBy("pos").collect()] == [(1, 2.0), (2, 3.0)]
