"""Counts of crossings: every pair counts, near ties go as in SQL, and no pair is a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from test_round_02 import against_sql, plane_tables

from scanforge.operators import building as B
from scanforge.operators import crossings as C
from scanforge.plans.library import QUERIES

NAME = "j46_g31_segment_triangles"


def test_crossings_of_equal_keys_and_missing_numbers_as_in_sql(spark, tmp_path):
    """Rows of one key count each; a triangle without its first corner is judged by the side that is known; no key, no row."""
    rows = plane_tables([19, 19, 57, 1311, 17, 2, 2, None, 1925], [10.0, 10.0, 99.0, 500.0, None, 1.0, None, 5.0, 930.0])
    rows = rows.astype({"s_suppkey": "Int64", "s_nationkey": "Int32"})
    rows.loc[3, "s_nationkey"] = pd.NA
    against_sql(spark, tmp_path, NAME, supplier=rows)
    against_sql(spark, tmp_path, NAME, supplier=rows.head(0))


def test_crossings_make_no_row_for_a_pair(spark, tmp_path):
    rows = plane_tables(range(900), [float(k * 7919 % 11000 - 999) for k in range(900)])
    rows["s_nationkey"] = (rows["s_suppkey"] % 25).astype("int32")
    against_sql(spark, tmp_path, NAME, supplier=rows)
    assert "Join" not in QUERIES[NAME](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def brute(tri, seg, weight):
    r, c = (v.ravel() for v in np.indices((len(tri), len(seg))))
    with np.errstate(all="ignore"):
        hit = C._touches(tri[r], seg[c]).reshape(len(tri), len(seg))
    return [int(weight[h].sum()) for h in hit]


@pytest.mark.parametrize("kind", ["lattice", "anywhere", "near", "far", "missing"])
def test_counts_equal_a_test_of_each_pair(kind):
    """On a lattice nearly all sides meet corners or lie on lines of others; near it rounding decides; far away a tolerance is coarse."""
    rng = np.random.default_rng(7)
    tri, seg = rng.integers(0, 5, (150, 6)) * 0.375, rng.integers(0, 5, (170, 4)) * 0.375
    if kind == "anywhere":
        tri, seg = rng.random((150, 6)), rng.random((170, 4))
    if kind == "near":
        tri, seg = tri * 0.1 + 0.3, seg * 0.1 + 0.3
    if kind == "far":
        seg[3] += 1e9
        tri[5] *= 1e-200
        tri[6, 0] = np.inf
    if kind == "missing":
        tri[rng.random(tri.shape) < 0.1] = np.nan
        seg[rng.random(seg.shape) < 0.1] = np.nan
    weight = rng.integers(1, 4, 170)
    assert C.count_touching(tri, seg, weight, 1000).tolist() == brute(tri, seg, weight)
    assert C.count_touching(tri, seg, weight + (1 << 24)).tolist() == brute(tri, seg, weight + (1 << 24))


def test_blocks_count_as_the_pairs_do(spark):
    """Blocks of a few rows, keys that are text, against the rows of segment_triangles."""
    rng = np.random.default_rng(3)
    tri = spark.createDataFrame([(f"t{k}", *map(float, v)) for k, v in enumerate(rng.random((40, 6)) * 9)], "t string, ax double, ay double, bx double, by double, cx double, cy double")
    seg = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(rng.random((30, 4)) * 9)], "s int, x0 double, y0 double, x1 double, y1 double")
    want = B.segment_triangles(seg, tri, 2.0, ["s"]).groupBy("t").count()
    assert sorted(map(tuple, C.crossing_counts(seg, tri, 8).collect())) == sorted(map(tuple, want.collect()))
