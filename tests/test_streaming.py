from __future__ import annotations

import pytest

from scanforge.streaming import live

SCHEMA = "path int, ts timestamp, x double, y double, z double, valid boolean"


def source(spark, tmp_path, rows):
    spark.createDataFrame(rows, "path int, t long, x double, y double, z double").selectExpr("path", "timestamp_seconds(t) AS ts", "x", "y", "z", "true AS valid").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
        return spark.sql(f"SELECT * FROM {name}").collect()
    finally:
        q.stop()


def test_script_and_cells(spark, tmp_path):
    rows = [(1, t, float(t % 3), 0.5, float(t)) for t in range(0, 120, 10)] + [(1, 4000, 0.0, 0.0, 0.0)]
    s = live.run_script_live(source(spark, tmp_path, rows), "PartitionAABB 0 1 0 1 0 1000\nKill INVALID")
    got = drain(spark, live.cell_statistics(s, "ts", 1.0), "cells", "append", tmp_path)
    assert sum(r["n"] for r in got) == sum(1 for _, t, x, *_ in rows[:-1] if x <= 1)
    with pytest.raises(ValueError):
        live.run_script_live(s, "Decimate 2")


def test_path_lengths(spark, tmp_path):
    source(spark, tmp_path, [(1, 0, 0.0, 0.0, 0.0), (1, 1, 3.0, 4.0, 0.0), (2, 5, 1.0, 1.0, 1.0)])
    s = source(spark, tmp_path, [(1, 2, 3.0, 4.0, 2.0), (1, 0, 9.0, 9.0, 9.0)])
    got = drain(spark, live.path_lengths(s, "path", "ts", ["x", "y", "z"]), "lengths", "update", tmp_path)
    assert max(r["length"] for r in got if r["path"] == 1) >= 7.0 and {r["path"] for r in got} == {1, 2}
