from __future__ import annotations

import random

from pyspark.sql import functions as F

from scanforge.operators import joins as J
from scanforge.operators import windows as W


def test_interpolation_clamps_and_holds_the_first_interval(spark):
    poses = spark.createDataFrame([(float(i), 10.0 * i) for i in range(4)], "ts double, x double")
    q = spark.createDataFrame([(-1.0,), (0.5,), (1.5,), (2.5,), (3.5,)], "t double")
    got = J.interpolate(q, poses, "t", "ts", ["x"], 1.0).orderBy("t").collect()
    assert [r["x"] for r in got] == [0, 0, 15, 25, 30]


def test_nearest_ties(spark):
    r = spark.createDataFrame([(0.0, 0), (1.0, 1)], "ts double, i int")
    q = spark.createDataFrame([(0.5,)], "t double")
    assert J.nearest(q, r, "t", "ts", 10.0).first()["i"] == 1
    assert J.nearest(q, r, "t", "ts", 10.0, later_wins=False).first()["i"] == 0


def test_as_of_against_a_loop(spark):
    rnd = random.Random(3)
    right = [(rnd.randrange(3), float(t), rnd.randrange(100)) for t in sorted(rnd.sample(range(500), 60))]
    left = [(i, rnd.randrange(4), rnd.uniform(-20, 520)) for i in range(200)]
    r = spark.createDataFrame(right, "k int, ts double, v int")
    q = spark.createDataFrame(left, "i int, k int, t double")
    for forward in (False, True):
        got = {x["i"]: x["v"] for x in J.as_of(q, r, "t", "ts", 37.0, ["k"], forward=forward).collect()}
        for i, k, t in left:
            own = [(ts, v) for kk, ts, v in right if kk == k and (ts >= t if forward else ts <= t)]
            assert got[i] == ((min(own) if forward else max(own))[1] if own else None)
    assert J.as_of(q.limit(0), r, "t", "ts", 5.0, ["k"]).count() == 0
    assert J.as_of(q, r.limit(0), "t", "ts", 5.0, ["k"]).where("v is not null").count() == 0


def test_slerp_halfway(spark):
    h = 2**-0.5
    df = spark.range(1).select(F.array(*J.slerp([F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)], [F.lit(h), F.lit(0.0), F.lit(0.0), F.lit(h)], F.lit(0.5))).alias("q")).first()
    assert abs(df["q"][0] - 0.9238795325) < 1e-9 and abs(df["q"][3] - 0.3826834324) < 1e-9


def test_face_neighbours_of_mixed_sizes(spark):
    # one large cube, and four small ones on its upper x side, one of them only touching along an edge
    leaves = spark.createDataFrame([("L", 1.0, 1.0, 1.0, 1.0), ("a", 2.5, 0.5, 0.5, 0.5), ("b", 2.5, 1.5, 1.5, 0.5), ("c", 3.5, 0.5, 0.5, 0.5), ("d", 2.5, 2.5, 0.5, 0.5)], "leaf string, cx double, cy double, cz double, hw double")
    got = {(r["a"], r["b"], r["axis"], r["area"]) for r in J.face_neighbours(leaves).collect()}
    assert got == {("L", "a", "x", 1.0), ("L", "b", "x", 1.0), ("a", "c", "x", 1.0)}


def test_sampling_by_distance(spark):
    df = spark.createDataFrame([(1, float(i), float(x)) for i, x in enumerate([0, 1, 4, 5, 9, 9.5])], "k int, t double, x double")
    assert [r["x"] for r in W.sample_by_distance(df, ["x"], "t", ["k"], 4.0).orderBy("t").collect()] == [0, 4, 9]


def test_segment_inside_one_cell_and_along_a_line(spark):
    df = spark.createDataFrame([(0, 0.2, 0.2, 0.4, 0.4), (1, 0.5, 0.5, 2.5, 0.5), (2, 0.3, 0.3, 0.3, 0.3)], "k int, ax double, ay double, bx double, bz double")
    got = sorted((r["k"], r["i0"], r["i1"]) for r in J.segment_cells(df, ["ax", "ay"], ["bx", "bz"], 1.0).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 0, 0)]
