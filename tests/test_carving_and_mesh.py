from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanforge.functions import camera as M
from scanforge.functions import shapes as G
from scanforge.operators import carving as C
from scanforge.operators import mesh as S


def full(u):
    return np.array([[u[0], u[1], u[2]], [u[1], u[3], u[4]], [u[2], u[4], u[5]]])


def test_point_covariance(spark):
    p = (1.0, 2.0, 2.0)
    df = spark.createDataFrame([p, (0.0, 0.0, 0.0)], "x double, y double, z double")
    got = df.select(C.point_covariance(G.vec("x", "y", "z"), F.lit(0.5), F.lit(0.1)).alias("c")).collect()
    u = np.array(p) / 3
    assert np.allclose(full(got[0]["c"]), 0.25 * np.outer(u, u) + 0.01 * (np.eye(3) - np.outer(u, u)))
    assert np.allclose(full(got[1]["c"]), 0.01 * np.eye(3))


def test_rotated_covariance(spark):
    cov = [4.0, 1.0, 0.5, 3.0, 0.2, 2.0]
    df = spark.createDataFrame([(cov, 0.7)], "c array<double>, a double").select("c", C.rotate_covariance(G.axis_rotation("z", F.col("a")), F.col("c")).alias("r"), C.add_covariances(F.col("c"), F.col("c")).alias("s")).first()
    r = np.array([[np.cos(0.7), -np.sin(0.7), 0], [np.sin(0.7), np.cos(0.7), 0], [0, 0, 1]])
    assert np.allclose(full(df["r"]), r @ full(cov) @ r.T) and df["s"] == [2 * v for v in cov]


def test_wedges(spark):
    pts = spark.createDataFrame([(f, p) for f, ps in ((0, (0, 2, 3)), (4, (1, 5)), (9, (0, 1, 2))) for p in ps], "frame long, point long")
    got = [tuple(r) for r in C.wedges(pts).select("wedge_id", "frame_a", "a1", "a2", "frame_b", "b1", "b2").orderBy("wedge_id").collect()]
    assert got == [(0, 0, 0, 2, 4, 1, 5), (1, 4, 1, 5, 9, 0, 1)]
    cmap = pts.withColumns({"p": F.lit(0.5), "w": F.lit(1.0), "surface": F.lit(0.5), "corner": F.lit(0.0), "planar": F.lit(1.0)})
    s = C.wedge_sample(C.wedge_points(C.wedges(pts), cmap), ["wedge_id"], F.col("w")).orderBy("wedge_id").first()
    assert (s["w"], s["p"], s["surface"], s["planar"]) == (4.0, 0.5, 1 - 0.5**4, 1.0)


MAP = "frame long, point long, sensor_mean array<double>, sensor_cov array<double>, point_mean array<double>, point_cov array<double>, planar_prob double, corner_prob double"


def phi(x):
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def slow_sample(m, x, size):
    s, sc, p, pc = np.array(m[2]), full(m[3]), np.array(m[4]), full(m[5])
    ray = (p - s) / np.linalg.norm(p - s)

    def plane(mean, cov):
        axes = np.linalg.eigh(cov)[1]
        a = axes[:, np.argmax(np.abs(ray @ axes))]
        return a @ (mean - x) / (a @ ray)

    ts, tp = plane(s, sc), plane(p, pc)
    f = min(1.0, max(0.0, -ts / (tp - ts)))
    off = x - ((1 - f) * s + f * p)
    far = np.linalg.norm(off)
    var = off @ ((1 - f) * sc + f * pc) @ off / far**2
    w = math.exp(-far * far / 2 / var) / math.sqrt(2 * math.pi * var) * size
    pf = phi(-ts / math.sqrt(ray @ sc @ ray)) * w
    d = x - p
    surface = size**3 * math.exp(-d @ np.linalg.inv(pc) @ d / 2) / math.sqrt((2 * math.pi) ** 3 * np.linalg.det(pc))
    return pf * phi(tp / math.sqrt(ray @ pc @ ray)) + 0.5 * (1 - pf), w, surface


def covs(rnd):
    a = rnd.normal(size=(3, 3)) * 0.2
    c = a @ a.T + 0.02 * np.eye(3)
    return [float(c[i, j]) for i in range(3) for j in range(i, 3)]


@pytest.fixture(scope="module")
def frames():
    rnd = np.random.default_rng(3)
    return [(f, i, [0.1 * f, 0.05, 0.03], c, [2.2 + 0.1 * f, 0.4 * i - 0.3, 0.2 * i + 0.1 * f], covs(rnd), 0.1 * i, 0.2) for f in range(3) for c in [covs(rnd)] for i in range(4)]


def test_samples_of_maps(spark, frames):
    df = spark.createDataFrame(frames, MAP)
    places = [(0.31, 0.17, 0.23), (1.7, 0.3, 0.2), (4.0, -1.0, 0.5)]
    rays = C.ray_models(df).select("frame", "point", F.struct("*").alias("m"), F.explode(F.array(*[F.array(*map(F.lit, p)) for p in places])).alias("x"))
    got = rays.select("frame", "point", "x", F.get(C.map_samples(F.array("m"), [F.get("x", k) for k in range(3)], 0.5), 0).alias("s")).collect()
    by = {(m[0], m[1]): m for m in frames}
    assert len(got) == len(frames) * len(places)
    for r in got:
        assert np.allclose(r["s"][:3], slow_sample(by[r["frame"], r["point"]], np.array(r["x"]), 0.5), atol=1e-5)


def test_carved_rays(spark, frames):
    got = {(r["i0"], r["i1"], r["i2"]): r for r in C.carve(spark.createDataFrame(frames, MAP), 0.5).collect()}
    want = {}
    for m in frames:
        s, p = np.array(m[2]), np.array(m[4])
        ray = (p - s) / np.linalg.norm(p - s)
        end = p + 3 * math.sqrt(ray @ full(m[5]) @ ray) * ray
        for cell in {tuple(c) for c in np.floor((s + (end - s) * np.linspace(0, 1, 20001)[:, None]) / 0.5).astype(int)}:
            want.setdefault(cell, []).append(slow_sample(m, (np.array(cell) + 0.5) * 0.5, 0.5))
    assert set(got) >= set(want) and len(got) <= len(want) + 3  # a sampled ray may step over a corner
    for cell, each in want.items():
        assert got[cell]["count"] == len(each)
        assert np.allclose([got[cell]["total_weight"], got[cell]["prob_sum"]], [sum(w for _, w, _ in each), sum(p * w for p, w, _ in each)], atol=1e-4)


def test_carved_wedges(spark, frames):
    df = spark.createDataFrame(frames, MAP)
    wedge = C.wedges(df.select("frame", "point"))
    got = {(r["i0"], r["i1"], r["i2"]): r for r in C.carve_wedges(wedge, df, 0.5).collect()}
    by = {(m[0], m[1]): m for m in frames}
    want = {}
    steps = np.array([(a, b, 1 - a - b) for a in np.linspace(0, 1, 161) for b in np.linspace(0, 1, 161) if a + b <= 1 + 1e-12])
    for r in wedge.collect():
        four = [by[r["frame_a"], r["a1"]], by[r["frame_a"], r["a2"]], by[r["frame_b"], r["b1"]], by[r["frame_b"], r["b2"]]]
        far = []
        for m in four:
            s, p = np.array(m[2]), np.array(m[4])
            ray = (p - s) / np.linalg.norm(p - s)
            far.append(p + 3 * math.sqrt(ray @ full(m[5]) @ ray) * ray)
        corners = np.array([four[0][2], far[0], far[1], four[2][2], far[2], far[3]])
        cells = {tuple(c) for t in C.WEDGE_TRIANGLES for c in np.floor(steps @ corners[list(t)] / 0.5).astype(int)}
        for cell in cells:
            each = [slow_sample(m, (np.array(cell) + 0.5) * 0.5, 0.5) for m in four]
            w = sum(e[1] for e in each)
            want.setdefault(cell, []).append((w, sum(e[0] * e[1] for e in each), w * (1 - np.prod([1 - e[2] for e in each]))))
    assert set(got) >= set(want) and len(got) - len(want) <= 0.05 * len(want)
    same = [cell for cell in want if got[cell]["count"] == len(want[cell])]
    assert len(same) > 0.9 * len(want)  # sampled triangles miss the cells that they barely touch
    for cell in same:
        assert np.allclose([got[cell][c] for c in ("total_weight", "prob_sum", "surface_sum")], np.sum(want[cell], axis=0), atol=1e-4)


def test_degenerate_maps(spark):
    flat = [0.0] * 6
    df = spark.createDataFrame([(0, 0, [0.0] * 3, flat, [0.0] * 3, flat, 0.0, 0.0), (0, 1, [0.0] * 3, flat, [1.0, 0.0, 0.0], flat, 0.0, 0.0)], MAP)
    assert C.ray_models(df).count() == 1  # a point at the sensor has no ray
    got = C.carve(df, 1.0).collect()
    assert all(r["total_weight"] == 0 and r["prob_sum"] == 0 for r in got)
    assert C.carve(df.limit(0), 1.0).count() == 0


def test_neighbourhood_planarity(spark):
    rnd = np.random.default_rng(5)
    pts = [(f, i, 0.1 * i, (0.0 if f == 0 else float(rnd.normal())), 1.0 + 0.02 * i, 2.0, 0.04) for f in (0, 1) for i in range(12)]
    df = spark.createDataFrame(pts, "frame long, point long, x double, y double, z double, range double, point_var double")
    got = {(r["frame"], r["point"]): r["planar_prob"] for r in C.neighbourhood_planarity(df, 0.35, 0.05).collect()}
    m = int(math.atan(0.35 / 2.0) / 0.05)
    for f, i, *_ in pts:
        own = [p for p in pts if p[0] == f and abs(p[1] - i) <= m]
        here = np.array(pts[f * 12 + i][2:5])
        x = np.array([p[2:5] for p in own])
        near = x[((x - here) ** 2).sum(1) <= 0.35**2]
        c = near - near.mean(0)
        d = np.linalg.svd(c)[2][0]
        e = np.mean([np.linalg.norm(np.cross(v - near.mean(0), d)) for v in x]) / 0.2
        assert abs(got[f, i] - (1 - math.erf(e))) < 1e-5 or len(near) == 1
    assert all(got[0, i] > 0.999 for i in range(12))


def test_room_labels(spark):
    leaves = spark.createDataFrame([("a", 0.5, 0.5, 1.0), ("b", 1.5, 0.5, 1.0), ("c", 0.5, 0.5, 9.0)], "leaf string, cx double, cy double, cz double")
    square = lambda x0, x1: [{"x": x0, "y": 0.0}, {"x": x1, "y": 0.0}, {"x": x1, "y": 1.0}, {"x": x0, "y": 1.0}]
    rooms = spark.createDataFrame([(0, square(0.0, 1.0), 0.0, 2.0), (1, square(0.2, 2.0), 0.0, 2.0)], "room int, polygon array<struct<x: double, y: double>>, z_min double, z_max double")
    assert {r["leaf"]: r["fp_room"] for r in C.label_rooms(leaves, rooms, 0.7).collect()} == {"a": 1, "b": 1, "c": -1}


def test_visibility(spark):
    hits = spark.createDataFrame([(1, 0, 5.0, 1), (1, 1, 9.0, 1), (2, 0, 5.0, 1), (2, 1, 9.0, -1), (3, 1, 9.0, 1), (3, 0, 5.0, 1), (4, 0, 5.0, 1), (4, 1, 9.0, 1)], "scan int, c int, w double, f int")
    got = {r["c"]: (r["considered"], r["chosen"], r["weight"]) for r in C.scan_visibility(hits, ["scan"], ["c"], "w", F.col("f") > 0, 0.5).collect()}
    assert got == {0: (4, 1, 0.0), 1: (3, 3, 9.0)}


def edges_of(tris):
    return [(t[k], t[(k + 1) % 3]) for t in tris for k in range(3)]


def test_cubes_by_rule():
    assert S.cube_triangles(0) == S.cube_triangles(255) == []
    for m in range(1, 255):
        tris = S.cube_triangles(m)
        # edges inside the cube are shared in opposite directions; those on faces are not
        inner = [(a, b) for a, b in edges_of(tris) if not any(a[i] == b[i] and a[i] in (0, 1) for i in range(3))]
        assert sorted(inner) == sorted((b, a) for a, b in inner)


def test_marching_cubes_close_and_face_outwards(spark):
    rnd = random.Random(2)
    cells = {(rnd.randrange(4), rnd.randrange(4), rnd.randrange(4)) for _ in range(30)}
    rows = S.marching_cubes(spark.createDataFrame(sorted(cells), "ix long, iy long, iz long")).collect()
    tris = [tuple((r[f"{c}x"], r[f"{c}y"], r[f"{c}z"]) for c in "abc") for r in rows]
    edges = edges_of(tris)
    assert sorted(edges) == sorted((b, a) for a, b in edges)
    volume = sum(np.dot(a, np.cross(b, c)) for a, b, c in (map(np.array, t) for t in tris)) / 6
    assert volume > 0
    one = S.marching_cubes(spark.createDataFrame([(5, 5, 5)], "ix long, iy long, iz long")).count()
    assert one == 8


def test_ray_hits(spark):
    rnd = np.random.default_rng(4)
    tris = rnd.uniform(0, 10, (60, 1, 3)) + rnd.uniform(-2, 2, (60, 3, 3))
    rays = rnd.uniform(0, 10, (40, 2, 3))
    t = spark.createDataFrame([(i, *map(float, v.ravel())) for i, v in enumerate(tris)], "t int, " + ", ".join(f"{c}{a} double" for c in "abc" for a in "xyz"))
    r = spark.createDataFrame([(i, *map(float, v.ravel())) for i, v in enumerate(rays)], "ray int, ox double, oy double, oz double, ex double, ey double, ez double")
    got = {x["ray"]: (x["t"], x["distance"]) for x in S.ray_hits(r, t, 1.5, ["ray"]).collect()}
    want = {}
    for i, (o, e) in enumerate(rays):
        d = e - o
        for k, (a, b, c) in enumerate(tris):
            m = np.stack([-d, b - a, c - a], 1)
            s, u, v = np.linalg.solve(m, o - a)
            if 0 < s <= 1 and u >= 0 and v >= 0 and u + v <= 1:
                want[i] = min(want.get(i, (9e9, -1)), (s * np.linalg.norm(d), k))
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (_, k) in want.items()}
    assert all(abs(got[i][1] - want[i][0]) < 1e-9 for i in got)


def poly(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def test_polygons(spark):
    df = spark.createDataFrame([(poly((0, 0), (1, 0.001), (2, 0), (2, 2), (0, 2)), poly((1, 1), (3, 1), (3, 3), (1, 3)))], "a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    r = df.select(S.simplify_polygon(F.col("a"), 0.01).alias("s"), S.clip_polygon(F.col("a"), F.col("b")).alias("c")).select("s", "c", G.polygon_area(F.col("c")).alias("area")).first()
    assert len(r["s"]) == 4 and abs(r["area"] - 1.0) < 1e-9
    far = spark.createDataFrame([(poly((0, 0), (1, 0), (0, 1)), poly((5, 5), (6, 5), (5, 6)))], "a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    assert far.select(S.clip_polygon(F.col("a"), F.col("b")).alias("c")).first()["c"] == []


def test_delaunay(spark):
    p = np.random.default_rng(6).uniform(0, 1, (40, 2))
    tris = S.delaunay(p)
    for t in tris:
        a, b, c = p[list(t)]
        assert (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > 0
        m = np.array([[*(v - q), (v - q) @ (v - q)] for q in p for v in (a, b, c)]).reshape(-1, 3, 3)
        assert (np.linalg.det(m) < 1e-9).all()
    area = sum(abs((p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0])) for a, b, c in tris) / 2
    assert 0.6 < area < 1.0 and S.delaunay(p[:2]) == []
    df = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(p)], "level int, cell long, x double, y double")
    assert S.triangulate(df, ["level"], "cell").count() == len(tris)


def test_regions_merge_best_first(spark):
    nodes = spark.createDataFrame([(0, i, 1.0, v) for i, v in enumerate((0.0, 0.1, 1.0, 1.05, 9.0))], "g int, node long, size double, value double")
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(4)], "g int, u long, v long")
    got = {r["node"]: r["region"] for r in S.coalesce_regions(nodes, edges, "g", 0.5).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_spacing_and_rooms(spark):
    doors = spark.createDataFrame([(0, i, float(x), 0.0) for i, x in enumerate((0, 0.5, 2, 2.5, 1))], "level int, n int, x double, y double")
    assert [r["n"] for r in S.keep_spaced(doors, ["level"], ["n"], ["x", "y"], 1.0).orderBy("n").collect()] == [0, 2, 4]
    rooms = spark.createDataFrame([(0, 1, 5.0), (0, 2, 6.0), (0, 3, 7.0)], "level int, room int, area double")
    borders = spark.createDataFrame([(0, 1, 2, 3.0), (0, 2, 3, 1.0)], "level int, room_a int, room_b int, length double")
    assert sorted(r["room"] for r in S.drop_small_rooms(rooms, borders, "level", 2.4384).collect()) == [2, 3]


def test_cameras(spark):
    df = spark.createDataFrame([(0.2, -0.3, 1.5), (0.0, 0.0, -1.0)], "x double, y double, z double")
    px = df.select(*[c.alias(n) for c, n in zip(M.rectilinear_pixel(G.vec("x", "y", "z"), 500, 510, 320, 240, (0.1,), (0.01, 0.02)), "uv")]).collect()
    x, y = 0.2 / 1.5, -0.2
    r2 = x * x + y * y
    assert abs(px[0]["u"] - (320 + 500 * (x * (1 + 0.1 * r2) + 0.02 * x * y + 0.02 * (r2 + 2 * x * x)))) < 1e-9 and px[1]["u"] is None
    ray = spark.range(1).select(*[c.alias(n) for c, n in zip(M.fisheye_ray(F.lit(120.0), F.lit(80.0), [-100.0, 0.0, 0.002], (1, 0, 0), (100.0, 100.0)), "xyz")]).first()
    assert abs(sum(v * v for v in ray) - 1) < 1e-12 and ray["x"] > 0 > ray["y"]
    back = spark.range(1).select(*[c.alias(n) for c, n in zip(M.fisheye_pixel([F.lit(3.0), F.lit(4.0), F.lit(0.0)], [10.0, 1.0], (1, 0, 0), (50.0, 60.0)), "uv")]).first()
    assert (back["u"], back["v"]) == (56.0, 68.0)


def test_colours_of_several_cameras(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 10.0), (1, 1, 0.55, 20.0), (1, 2, 2.0, 90.0), (1, 3, 0.1, 0.0), (1, 4, -1.0, 7.0)], "p int, o int, q double, v double")
    assert M.best_colour(df, ["p"], "q", "v", "o").first()["v"] == 90.0
    two = M.blended_colour(df.where("o < 2"), ["p"], "q", "v", "o", 0.1).first()
    assert (round(two["v"], 9), two["q"]) == (17.5, 0.5)
    assert M.blended_colour(df, ["p"], "q", "v", "o", 0.1).first()["v"] == 90.0
    pix = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(5) for c in range(5)], "row int, col int, v double")
    assert M.antialiased(pix, spark.createDataFrame([(2, 2, 1)], "row int, col int, k int"), 1, ["v"], ["k"]).first()["v"] == 22.0
    hits = spark.createDataFrame([(1, 5), (1, 2), (2, 5)], "i int, room int")
    assert {r["room"]: r["images"] for r in M.first_room_images(hits, "i", "room").collect()} == {2: 1, 5: 1}
