from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scanforge.operators import filters as L
from scanforge.operators.script import parse, run_script, tokenize


def rows(spark, values):
    return spark.createDataFrame([(float(x), float(y), float(z), 1, 2, 3, i, float(i), True) for i, (x, y, z) in enumerate(values)], "x double, y double, z double, r int, g int, b int, index int, timestamp double, valid boolean")


def test_decimate_by_three(spark):
    df = L.decimate(rows(spark, [(i, 0, 0) for i in range(7)]), 3, ["index"])
    assert sorted(r["index"] for r in df.where("valid").collect()) == [0, 3, 6]
    assert L.decimate(rows(spark, [(0, 0, 0)] * 3), 0, ["index"]).where("valid").count() == 3


def test_plane_is_strict_and_box_is_closed(spark):
    df = rows(spark, [(0, 0, 0), (0, 0, 1)])
    assert [r["valid"] for r in L.partition_plane(df, (0, 0, 1), (0, 0, 0)).orderBy("index").collect()] == [False, True]
    assert L.partition_box(df, (0, 0, 0), (0, 0, 1)).where("valid").count() == 2
    assert L.partition_radius(df, (0, 0, 0), 1).where("valid").count() == 2


def test_script(spark):
    df = run_script(rows(spark, [(i, 0, 0) for i in range(10)]), "PartitionAABB 2 8 0 0 0 0 # keep the middle\nKill INVALID\nTranslate 1 VALID\nRecolor 7", ["index"])
    got = df.orderBy("index").collect()
    assert [r["x"] for r in got] == [float(i) for i in range(3, 10)] and {r["r"] for r in got} == {7}


def test_script_errors():
    assert tokenize("// nothing\n\nKill  ALL # all") == [["Kill", "ALL"]]
    with pytest.raises(ValueError):
        parse("Nonsense 1")
    with pytest.raises(ValueError):
        parse("Scale 1 2")


def test_quaternion_is_transposed_in_scripts(spark):
    import math

    h = math.sqrt(0.5)
    df = run_script(rows(spark, [(1, 0, 0)]), f"Rotate {h} 0 0 {h}", ["index"]).first()
    assert abs(df["y"] + 1) < 1e-12
    m = L.quaternion_matrix(h, 0, 0, h)
    assert abs(L.rotate(rows(spark, [(1, 0, 0)]), m).first()["y"] - 1) < 1e-12


def test_levels(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (5.0,)], "z double")
    got = df.select(L.level_of_point(F.col("z"), [-3.1, 0.9, 5.3], [-0.4, 4.0, 8.5]).alias("v")).collect()
    assert [r["v"] for r in got] == [0, 0, 1, 2]


def test_bias_at_origin_is_null(spark):
    df = L.correct_bias(rows(spark, [(0, 0, 0), (3, 4, 0)]).withColumn("bias", F.lit(5.0)))
    got = df.orderBy("index").collect()
    assert got[0]["x"] is None and got[1]["x"] == 6.0


def test_empty_points(spark):
    assert run_script(rows(spark, [(0, 0, 0)]).limit(0), "Decimate 2\nKill INVALID\nScale 2", ["index"]).count() == 0
