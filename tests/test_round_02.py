"""Small tables of what only larger ones showed: single rings, ties, touching figures, long files."""

from __future__ import annotations

import duckdb
import pandas as pd
from compare import canonical

from scanforge.operators import sets as O
from scanforge.plans.library import ORACLES, QUERIES


def against_sql(spark, folder, name, **tables):
    """A query on tables made here, against its SQL."""
    con = duckdb.connect()
    for t, rows in tables.items():
        path = f"{folder}/{t}.parquet"
        rows.to_parquet(path)
        con.sql(f"create view {t} as select * from read_parquet('{path}')")
    assert canonical(QUERIES[name](spark, str(folder)).toPandas()) == canonical(con.sql(ORACLES[name]).df())


def test_ring_of_one_vertex_is_a_loop(spark, tmp_path):
    against_sql(spark, tmp_path, "t20_t27_loops", customer=pd.DataFrame({"c_custkey": range(8)}))
    edges = spark.createDataFrame([(5, 5), (1, 2), (2, 1)], "a long, b long")
    assert sorted(map(tuple, O.chain_loops(edges).collect())) == [(1, 0, 1), (1, 1, 2), (5, 0, 5)]


def test_nearest_region_ties_as_in_sql(spark, tmp_path):
    rows = [(1, 0, 1, 0.0), (1, 38000, 7, 0.1), (2, 7500, 1, 0.0), (2, 58500, 7, 0.1)]
    against_sql(spark, tmp_path, "g60_nearest_region", lineitem=pd.DataFrame(rows, columns=["l_orderkey", "l_suppkey", "l_linenumber", "l_discount"]).astype({"l_linenumber": "int32"}))


def plane_tables(keys, balance):
    return pd.DataFrame({"s_suppkey": keys, "s_nationkey": 0, "s_acctbal": balance}).astype({"s_nationkey": "int32"})


def test_flat_triangles_as_in_sql(spark, tmp_path):
    """1925 has no area: (0.90625, 0), (0.75, 0), (-2, 0), and starts of other rows lie on its line beyond its ends."""
    against_sql(spark, tmp_path, "j46_g31_segment_triangles", supplier=plane_tables([1925, 19, 57, 1311, 17, 2], [930.0, 10.0, 99.0, 500.0, 7000.0, 1.0]))


def test_equal_rays_and_triangles_are_tested_once(spark):
    from scanforge.operators import mesh as M

    ends, corners = ("ox", "oy", "oz", "ex", "ey", "ez"), [f"{c}{a}" for c in "abc" for a in "xyz"]
    rays = spark.createDataFrame([(k, 0.3, 0.2, -5.0, 0.3, 0.2, 9.0) for k in range(40)], ("ray", *ends))
    tri = spark.createDataFrame([(t, -4.0, -4.0, z, 6.0, -4.0, z, 0.0, 6.0, z) for t, z in ((7, 1.0), (3, 1.0), (1, 4.0))], ("t", *corners))
    got = M.ray_hits(rays, tri, 2.0, ["ray"])
    assert sorted(map(tuple, got.collect())) == [(k, 3, 6.0) for k in range(40)]
    # one row for the rays' only direction meets the triangles
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 4


def in_parts(spark, content, size, path="a"):
    rows = [(path, k, content[k * size : (k + 1) * size]) for k in range(-(-len(content) // size))]
    return spark.createDataFrame(rows, "path string, part long, content binary").coalesce(1).sortWithinPartitions("path", "part")


def test_frames_are_read_from_any_parts(spark):
    from scanforge.sources import binary as B
    from scanforge.sources import sensors as N

    scans = [(0.5, [(1.0, 2.0, 3.0, 4, 0.1, 0.2, 0.3)] * 3), (1.5, []), (2.5, [(7.25, 0.0, -1.0, 9, 0.0, 0.5, 0.25)])]
    for form in ("ascii", "little_endian", "big_endian"):
        got = B.read_scan_frames(spark, in_parts(spark, B.encode_scan_frames(scans, "s", "meters", form), 7)).orderBy("frame_idx").collect()
        assert [(r["scanner"], r["frame_idx"], r["timestamp"], [tuple(p) for p in r["points"]]) for r in got] == [("s", k, t, p) for k, (t, p) in enumerate(scans)]
    carved = B.encode_carve_map([([1.0] * 9, [[float(v) for v in range(11)]] * 2), ([2.0] * 9, []), ([3.0] * 9, [[5.0] * 11])])
    assert [(r["frame"], r["point"], r["sensor_mean"], r["corner_prob"]) for r in B.read_carve_map(spark, in_parts(spark, carved, 13)).collect()] == [(0, 0, [1.0] * 3, 10.0), (0, 1, [1.0] * 3, 10.0), (2, 0, [3.0] * 3, 5.0)]
    tango = N.encode_tango([(1.0, (1, 2, 3), (4, 5, 6, 7), [[1, 2, 3], [4, 5, 6]]), (2.0, (0, 0, 0), (1, 0, 0, 0), [])])
    assert [(r["frame_idx"], r["quaternion"], len(r["points"])) for r in N.read_tango(spark, in_parts(spark, tango, 11)).collect()] == [(0, [4.0, 5.0, 6.0, 7.0], 2), (1, [1.0, 0.0, 0.0, 0.0], 0)]


def test_files_of_frames_are_made_in_parts(spark):
    """No task holds a file: parts are of batches, and a frame that goes on in the next batch stays whole."""
    from scanforge.sources import binary as B

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        rows = spark.createDataFrame([(f, k // 4, k, float(k)) for f in (1, 2, 3) for k in range(20)], "file long, frame long, n long, x double")
        encode = lambda file, p, sizes: B.planar_bytes(p["frame"].to_numpy(float)[sizes.cumsum() - sizes], sizes, p[["x", "n"]].to_numpy(float))
        files = B.encoded_frames(rows, "file", "frame", ["n"], encode, lambda file, n: B.planar_head(file, [1.0, 0, 0, 0, 1, 0, 0, 0, 1], [0.0, 0, 0], n))
        assert all(n > 3 for n in (r["count"] for r in files.groupBy("path").count().collect()))
        got = B.read_planar_scans(spark, files).groupBy("serial", "timestamp").count().collect()
        assert sorted(map(tuple, got)) == [(f, float(t), 4) for f in (1, 2, 3) for t in range(5)]
    finally:
        spark.conf.set(key, kept)


def test_rows_of_camera_files_carry_no_lines(spark, tmp_path):
    """A file of n images took n times its own text, as each row carried all lines."""
    from scanforge.sources import text as T

    (tmp_path / "c").write_text("\n".join(["V1 2", " ".join(["0.5"] * 9), " ".join(["1.0"] * 9), "1 2 3", "a.jpg 1.5", "b.jpg 2.5", "mask.png"]))
    got = T.read_camera_file(spark, str(tmp_path / "c"))
    assert [(r["serial"], r["k"][0], r["translation"], r["mask"], r["image"], r["timestamp"]) for r in got.orderBy("image").collect()] == [("V1", 0.5, [1.0, 2.0, 3.0], "mask.png", "a.jpg", 1.5), ("V1", 0.5, [1.0, 2.0, 3.0], "mask.png", "b.jpg", 2.5)]
    generate = next(line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in line)
    assert "lines#" not in generate.split("[", 1)[1]


def test_faces_count_the_vertices_before_them(spark, tmp_path):
    from scanforge.sources import text as T

    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\n# note\nv 0 1 0\nf -3 -2 -1\nvn 0 0 1\nv 2 2 2\nf 1 -1 2\nf 4 3 2\n")
    _, faces = T.read_mesh_obj(spark, str(tmp_path / "m.obj"))
    assert sorted((r["f"], r["vertices"]) for r in faces.collect()) == [(0, [0, 1, 2]), (1, [0, 3, 1]), (2, [3, 2, 1])]
    assert "aggregate(" not in faces._jdf.queryExecution().optimizedPlan().toString()


def test_wedges_are_carved_in_arrays(spark, tmp_path):
    """Cells of a wedge are not rows of the plan, wedges need no number, and sensors on corners of cells touch as in the SQL."""
    from scanforge.operators import carving as C
    from scanforge.plans import carving_queries as Q

    keys = [0, 97, 8633, 716539, 716540, 716541]
    rows = [(k, n, 1.0 + (7 * k + 11 * n) % 50, 0.01 * ((k + 3 * n) % 11), 0.01 * ((k + n) % 9)) for k in keys for n in range(1, 2 + (k + 2) % 5)]
    rows += [(716541, 1, 9.0, 0.1, 0.02)]
    table = pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]).astype({"l_linenumber": "int32"})
    against_sql(spark, tmp_path, "j16_g47_carve", lineitem=table)
    every = Q.maps(spark, str(tmp_path))
    got = C.carve_wedges(C.wedge_pairs(every.select("frame", "point")), every, 2.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_wedges_and_cubes_by_all_axes():
    import numpy as np
    from scanforge.operators import carving as C

    rnd = np.random.default_rng(5)
    corners = np.concatenate([rnd.normal(size=(6, 3, 3000)) * rnd.uniform(0.3, 3.0, 3000) + rnd.normal(size=(3, 3000)) * 2, rnd.integers(-3, 4, (6, 3, 3000)).astype(float)], axis=2)

    def meets(w):
        for t in C.WEDGE_TRIANGLES:
            tri = corners[list(t), :, w]
            edges = [tri[(k + 1) % 3] - tri[k] for k in range(3)]
            axes = [*np.eye(3), np.cross(edges[0], edges[1]), *(np.cross(e, u) for e in edges for u in np.eye(3))]
            if all((tri @ a).min() <= np.abs(a).sum() and (tri @ a).max() >= -np.abs(a).sum() for a in axes):
                return True
        return False

    want = [meets(w) for w in range(corners.shape[2])]
    assert C.wedges_meet_cubes(corners, 1.0).tolist() == want and 1000 < sum(want) < 5500
