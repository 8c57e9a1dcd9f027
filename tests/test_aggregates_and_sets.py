from __future__ import annotations

from pyspark.sql import functions as F

from scanforge.operators import aggregates as A
from scanforge.operators import sets as S
from scanforge.operators import volume as V


def test_leaf_statistics(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 3.0, 0.5)], "leaf int, w double, p double").withColumns({c: F.lit(0.0) for c in ("surface", "corner", "planar")})
    s = A.leaf_statistics(df, ["leaf"])
    r = s.withColumns({"pr": A.probability(), "u": A.uncertainty()}).first()
    assert (r["count"], r["total_weight"], r["prob_sum"], r["prob_sum_sq"], r["pr"], r["u"]) == (2, 4.0, 2.5, 1.75, 0.625, 0.046875)
    part = A.subdivide_leaf(s).first()
    assert (part["count"], part["total_weight"]) == (1, 2.0)


def test_unobserved_leaf(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0)], "count int, total_weight double, prob_sum double, prob_sum_sq double, surface_sum double")
    r = df.select(A.probability().alias("p"), A.uncertainty().alias("u"), A.mean_of("surface_sum").alias("s")).first()
    assert (r["p"], r["u"], r["s"]) == (0.5, 1.0, 0.0)


def test_histogram_truncates(spark):
    h = A.histogram(spark.createDataFrame([(-0.6,), (-0.4,), (0.2,), (0.6,)], "v double"), "v", 0.5)
    got = {r["bin"]: (r["weight"], r["c"]) for r in h.withColumn("c", A.bin_centre(0.5)).collect()}
    assert got == {-1: (1.0, -0.25), 0: (2.0, 0.25), 1: (1.0, 0.75)}


def test_peaks_keep_ties(spark):
    h = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 5.0), (3, 2.0)], "bin long, weight double")
    assert sorted(r["bin"] for r in A.peaks(h, 1.0, 1.0).collect()) == [1, 2]


def test_upper_median(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "k int, v double")
    assert df.groupBy("k").agg(A.upper_median("v").alias("m")).first()["m"] == 3.0
    assert A.ranked_upper_median(df, ["k"], "v").first()["upper_median"] == 3.0


def test_levels_pair_up():
    levels = A.pair_levels([(0.0, 9.0), (3.0, 8.0), (1.0, 1.0)], [(2.6, 5.0), (5.6, 4.0)])
    assert levels == [(0.0, 2.6), (3.0, 5.6)] and A.split_heights(levels) == [2.8]


def test_intervals_touch(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (3.0, 4.0)], "a double, b double")
    assert sorted((r["t0"], r["t1"]) for r in S.coalesce_intervals(df, "a", "b").collect()) == [(0.0, 2.0), (3.0, 4.0)]


def boundary(spark, tris):
    t = spark.createDataFrame([(n, *v) for n, v in enumerate(tris)], "t long, i long, j long, k long")
    return [r["vertex"] for r in S.chain_loops(S.boundary_edges(t)).orderBy("loop", "position").collect()]


FAN = [(1, 2, 3), (1, 3, 4), (1, 4, 5), (1, 5, 6), (1, 6, 2)]


def test_boundary_loops(spark):
    assert boundary(spark, [(1, 2, 3)]) == [1, 2, 3]
    assert boundary(spark, FAN) == [2, 3, 4, 5, 6]
    assert len(boundary(spark, [*FAN, (2, 7, 3), (4, 7, 5)])) == 7


def test_components(spark):
    nodes = spark.range(8).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(5, 1), (1, 3), (6, 7)], "u long, v long")
    got = {r["node"]: (r["component"], r["number"]) for r in S.components_of(nodes, edges).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (2, 2), 3: (1, 1), 4: (4, 3), 5: (1, 1), 6: (6, 4), 7: (6, 4)}
    assert S.components_of(nodes, edges.limit(0)).select("number").distinct().count() == 8


def test_long_chain_is_one_component(spark):
    edges = spark.range(3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).repartition(7)
    assert S.connected_components(edges).select("component").distinct().collect()[0][0] == 0


def test_simplify_merges_equal_octants(spark):
    base = [(1, x, y, z, True) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    cols = "depth int, ix int, iy int, iz int, label boolean"
    stats = {"count": F.lit(1), **{c: F.lit(1.0) for c in A.LEAF_SUMS}}
    whole = A.simplify_leaves(spark.createDataFrame(base, cols).withColumns(stats), ["label"]).collect()
    assert [(r["depth"], r["count"]) for r in whole] == [(0, 8)]
    mixed = spark.createDataFrame([*base[:-1], (1, 1, 1, 1, False)], cols).withColumns(stats)
    assert A.simplify_leaves(mixed, ["label"]).count() == 8


def test_watershed_blocks_at_walls(spark):
    cells = spark.createDataFrame([(i, 0, 0.0 if i == 3 else 1.0) for i in range(7)], "i0 long, i1 long, open_height double")
    seeds = spark.createDataFrame([(0, 0, 0), (6, 0, 1)], "i0 long, i1 long, seed long")
    got = {r["i0"]: r["room"] for r in V.watershed(cells, seeds).collect()}
    assert [got[i] for i in range(7)] == [0, 0, 0, 0, 1, 1, 1]


def test_majority_flip(spark):
    leaves = spark.createDataFrame([(i, i != 1) for i in range(3)], "leaf int, interior boolean")
    near = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "a int, b int, area double")
    assert V.majority_flip(leaves, near, 0.4).where("not interior").count() == 1
    assert V.majority_flip(leaves.where("leaf < 2").union(spark.createDataFrame([(2, True), (3, True)], "leaf int, interior boolean")), spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 3, 1.0), (2, 3, 1.0)], "a int, b int, area double"), 0.75).where("not interior").count() == 0


def test_majority_flip_runs_until_nothing_changes(spark):
    # heavier links outwards, each leaf held by the one before it, so that a single one flips in each round: 1 to 12 are inside
    leaves = spark.createDataFrame([(i, i > 0) for i in range(13)], "leaf int, interior boolean")
    near = spark.createDataFrame([(i, i + 1, 0.5**i) for i in range(12)], "a int, b int, area double")
    assert V.majority_flip(leaves, near, 0.6).where("interior").count() == 0


def test_one_voxel_has_six_neighbours(spark):
    one = spark.createDataFrame([(0, 0, 0)], "ix long, iy long, iz long")
    got = {(r["ix"], r["iy"], r["iz"]): r["state"] for r in V.boundary_voxels(one).collect()}
    # the voxel below in y shares its upper y face, which is face 2
    assert got[0, -1, 0] == 1 << 2 and got[0, 0, 1] == 1 << 4 and len(got) == 6
    assert V.remove_thin_voxels(one).count() == 0


def test_thin_sheet_erodes_to_nothing(spark):
    # from its corners, in more than 50 rounds
    sheet = spark.range(56 * 56).select((F.col("id") % 56).alias("ix"), F.floor(F.col("id") / 56).alias("iy"), F.lit(0).cast("long").alias("iz"))
    assert V.remove_thin_voxels(sheet).count() == 0


def test_holes_and_notches_are_filled(spark):
    block = {(x, y, z) for x in range(5) for y in range(5) for z in range(5)}
    # a hole of two voxels, the second of which has four neighbours or more only once the first is filled, and a spike
    holes = {(2, 2, 2), (2, 2, 3), (2, 2, 4)}
    df = spark.createDataFrame(sorted(block - holes | {(2, 0, 5)}), "ix long, iy long, iz long")
    got = {tuple(r) for r in V.remove_thin_voxels(df).collect()}

    def near(v):
        return sum((v[0] + a, v[1] + b, v[2] + c) in got for a, b, c in V.FACES)

    assert holes <= got and (2, 0, 5) not in got
    assert all(near(v) >= 3 for v in got)
    assert all(near((x, y, z)) <= 3 for x in range(-1, 7) for y in range(-1, 7) for z in range(-1, 7) if (x, y, z) not in got)


def test_double_surface(spark):
    t = spark.createDataFrame([(0, 1, 2, 3, 0.0, 0.0, 1.0), (1, 3, 2, 4, 0.0, 0.0, -1.0), (2, 7, 8, 9, 1.0, 0.0, 0.0), (3, 9, 8, 7, 1.0, 0.0, 0.0)], "t int, i int, j int, k int, nx double, ny double, nz double")
    assert [r["t"] for r in V.opposing_triangles(t).collect()] == [2]
