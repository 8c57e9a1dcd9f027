from __future__ import annotations

import pytest

import math

import pandas as pd
from pyspark.sql import functions as F

from scanforge.functions import shapes as G
from scanforge.operators import aggregates as A
from scanforge.operators import volume as V
from scanforge.sources import binary as B
from scanforge.sources import text as T


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(p)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_paths(spark, tmp_path):
    poses = pd.DataFrame({n: [1.0 * k, 2.0 * k] for k, n in enumerate(B.PATH_POSE.names)})
    path = put(tmp_path, "a.mad", B.encode_path(poses, [(0.5, 0.75)]))
    assert [r["yaw"] for r in B.read_path(spark, path).orderBy("yaw").collect()] == [6.0, 12.0]
    assert [(r["t0"], r["t1"]) for r in B.read_path_rests(spark, path).collect()] == [(0.5, 0.75)]
    cm = B.read_carve_map(spark, put(tmp_path, "c", B.encode_carve_map([([0.0] * 9, [[1.0] * 11, [2.0] * 11])])))
    assert cm.count() == 2


def test_lists(spark, tmp_path):
    c = T.read_chunk_list(spark, put(tmp_path, "l", "chunklist\nhalfwidth 100.0\ncenter 1.0 2.0 3.0\nchunk_dir chunks/\nnum_chunks 2\nend_header\n05A45BEF\n45E5DAC5\n")).orderBy("chunk_id").collect()
    assert [tuple(r)[:5] for r in c] == [("05A45BEF", 1.0, 2.0, 3.0, 100.0), ("45E5DAC5", 1.0, 2.0, 3.0, 100.0)]
    x = T.read_transforms(spark, put(tmp_path, "h.xml", "<h><sensor><name>a</name><enable>0</enable><R>1 0 0 0 1 0 0 0 1</R><T>1 2 3</T></sensor><sensor><name>b</name><R>1 0 0 0 1 0 0 0 1</R><T>0 0 0</T></sensor></h>")).orderBy("sensor").collect()
    assert [(r["sensor"], r["enabled"], r["t"]) for r in x] == [("a", False, [1.0, 2.0, 3.0]), ("b", True, [0.0, 0.0, 0.0])]
    assert T.read_camera_log(spark, put(tmp_path, "d", "a.jpg 3 1.5 100 2\n")).first()["image"] == 3
    assert T.read_frame_list(spark, put(tmp_path, "f", "0 a.png 1.5\nx\n")).count() == 1


def test_shapes(spark):
    ring = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(p, "xyz")]) for p in ((0, 0, 1), (2, 0, 1), (2, 2, 1), (0, 2, 1))])
    assert [round(v, 9) for v in one(spark, *[c.alias(n) for c, n in zip(G.polygon_normal(ring), "abc")])] == [0, 0, 1]
    p = one(spark, *[c.alias(n) for c, n in zip(G.nearest_on_planes(G.lits(5, 6, 7), G.lits(1, 0, 0), F.lit(1.0), G.lits(0, 1, 0), F.lit(2.0)), "abc")])
    assert tuple(p) == (1.0, 2.0, 7.0)
    w = G.window_corners(G.lits(0, 0), G.lits(4, 0), F.lit(0.0), F.lit(2.0), *[F.lit(v) for v in (0.25, 0.5, 0.75, 1.0)])
    assert tuple(one(spark, *[c.alias(n) for c, n in zip(w[2], "abc")])) == (3.0, 0.0, 2.0)
    q = one(spark, *[c.alias(n) for c, n in zip(G.three_planes([G.lits(1, 0, 0), G.lits(0, 2, 0), G.lits(0, 0, 1)], G.lits(1, 4, 3)), "abc")])
    assert tuple(q) == (1.0, 2.0, 3.0)
    t = [G.lits(*v) for v in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))]
    assert tuple(one(spark, G.in_tetrahedron(G.lits(0.2, 0.2, 0.2), *t).alias("a"), G.in_tetrahedron(G.lits(0.5, 0.5, 0.5), *t).alias("b"))) == (True, False)
    assert one(spark, G.in_circle(G.lits(0, 0), G.lits(1, 0), G.lits(0, 1), G.lits(0.5, 0.5)).alias("a"))["a"] > 0
    assert tuple(one(spark, G.boxes_abut(G.lits(0, 0), G.lits(1, 1), G.lits(1, 0), G.lits(2, 1), 1e-6).alias("a"), G.boxes_meet(G.lits(0, 0), G.lits(1, 1), G.lits(2, 0), G.lits(3, 1)).alias("b"))) == (True, False)
    r = G.from_gravity(F.lit(0.0), F.lit(0.0), F.lit(9.8), F.lit(1.0))
    assert tuple(one(spark, *[c.alias(n) for c, n in zip(r, "abc")])) == (0.0, 0.0, 1.0)
    c, s = one(spark, *[v.alias(n) for v, n in zip(G.givens(F.lit(3.0), F.lit(4.0)), "cs")])
    assert abs(3 * c - 4 * s - 5) < 1e-12 and abs(3 * s + 4 * c) < 1e-12
    e = one(spark, *[v.alias(n) for v, n in zip(G.ned_to_enu(G.lits(1, 2, 3)), "abc")])
    assert tuple(e) == (2.0, 1.0, -3.0)
    f = one(spark, G.face_planarity(F.lit(0.25), F.lit(0.75), F.lit(0.0), F.lit(1.0)).alias("a"), G.face_position_variance(F.lit(0.25), F.lit(0.75), F.lit(0.1), F.lit(0.1), F.lit(1.0)).alias("v"))
    assert f["a"] == 0.5 and f["v"] > 0


def test_leaves(spark):
    df = spark.createDataFrame([(4, 2.0, 1.5, 1.2)], "count long, total_weight double, prob_sum double, prob_sum_sq double")
    r = A.flip_leaf(df).withColumn("p", A.probability()).first()
    assert (r["count"], r["p"]) == (1, 0.25)
    part = spark.createDataFrame([(2, 0, 0, 0), (2, 1, 1, 1), (1, 1, 0, 0)], "depth int, ix int, iy int, iz int")
    assert V.missing_children(part).groupBy("depth").count().collect() and V.missing_children(part).count() == 13
    fine = V.refine_chunks(spark.createDataFrame([(0, 0, 1), (5, 5, 5)], "i0 long, i1 long, i2 long"), spark.createDataFrame([(0, 0, 1)], "i0 long, i1 long, i2 long"), 2)
    assert fine.count() == 8 and fine.agg(F.min("i2")).first()[0] == 2
    assert V.leaf_voxels(spark.createDataFrame([(1, 0, 0, 1)], "depth int, ix int, iy int, iz int"), 2).count() == 8


def test_headings_and_lamps(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0), (1, 0.0, 5.0), (2, 1.0, 0.0), (2, -3.0, 0.0)], "k int, mx double, my double")
    got = {r["k"]: r["heading"] for r in A.mean_heading(df, ["k"]).collect()}
    assert abs(got[1] - math.pi / 4) < 1e-12 and got[2] is None
    px = spark.createDataFrame([(r, c, 1.0) for r, c in ((0, 0), (0, 1), (1, 1), (5, 5))], "row int, col int, b double")
    lamps = A.lit_components(px, "b", 0.5, 2, 10.0).collect()
    assert [(r["area"], r["watts"]) for r in lamps] == [(3, 30.0)]


def test_gaps_block_neighbourhoods(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (3, 0, 4.0), (0, 1, 8.0), (1, 1, 16.0)], "i0 long, i1 long, v double")
    got = {(r["i0"], r["i1"]): r["total"] for r in A.neighbourhood_sums(cells, "v", 1).collect()}
    assert got[0, 0] == 11.0 and got[3, 0] == 4.0
    assert {(r["i0"], r["i1"]): r["total"] for r in A.neighbourhood_sums(cells, "v", 3).collect()}[0, 0] == 27.0


def test_loops_and_rooms(spark):
    loop = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(((0, 0), (1, 0), (2, 0), (2, 2), (0, 2), (0, 1)))], "loop int, position int, x double, y double")
    assert sorted(r["position"] for r in V.straight_corners(loop).collect()) == [0, 2, 3, 4]
    t = spark.createDataFrame([(0, i) for i in range(5)], "level int, t long")
    b = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 5.0), (0, 2, 3, 2.0)], "level int, u long, v long, length double")
    s = spark.createDataFrame([(0, 0, 7), (0, 3, 9)], "level int, t long, room long")
    assert {r["t"]: r["room"] for r in V.flood_rooms(t, b, s, "level").collect()} == {0: 7, 1: 9, 2: 9, 3: 9, 4: -1}


def test_arguments():
    from scanforge.arguments import Tag, parse

    tags = [Tag("-i", required=True, extensions=(".xyz", ".PTS")), Tag("-r", values=2), Tag("-v")]
    assert parse(tags, ["a.xyz", "-r", "1", "2", "b.pts", "-v"]) == {"-i": ["a.xyz", "b.pts"], "-r": ["1", "2"], "-v": True}
    assert parse(tags, ["a.xyz"]) == {"-i": ["a.xyz"], "-r": [], "-v": False}
    for words in ([], ["a.txt"], ["a.xyz", "-r", "1"], ["a.xyz", "-q"]):
        with pytest.raises(ValueError):
            parse(tags, words)
