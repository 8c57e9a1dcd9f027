"""Connected components over edges, and the checkpoints that iterative plans need."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where none is configured, a temporary one is set, in local mode only.

    On a cluster no machine's own folder can be shared, so that a missing setting raises RuntimeError.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors need not redo what led to it.

    Not for loops: the optimiser keeps its estimate of the size, which a join multiplies, so that a loop of joins soon has it
    multiply numbers of millions of digits. See stored().
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: columnar, compressed and of known size, for wide tables and for loops."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the undirected edges a[i]-b[i]."""
    root = np.arange(n, dtype=np.int64)
    while a.size:
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        # only roots move: a node hooked elsewhere by itself would leave its tree
        np.minimum.at(nxt, root[a], low)
        np.minimum.at(nxt, root[b], low)
        while True:
            jump = nxt[nxt]
            if np.array_equal(jump, nxt):
                break
            nxt = jump
        if np.array_equal(nxt, root):
            break
        root = nxt
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def _contract(batches):
    """Replace each batch of edges by a spanning star of every component within it."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not a.size:
            continue
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(at[: a.size], at[a.size :], ids.size)
        off = root != np.arange(ids.size)
        yield pa.RecordBatch.from_arrays([pa.array(ids[off], pa.int64()), pa.array(ids[root[off]], pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (two long columns); component is the smallest node reachable.

    Alternating large-star and small-star rounds. Every batch of edges is first contracted to stars where it lies, and
    minima are taken by partial aggregation, so a hub is never gathered in one task. Each round is stored.
    """
    a, b = edges.columns[:2]
    cur = (
        edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
        .where("u <> v")
        .mapInArrow(_contract, "u long, v long")
        .distinct()
    )
    cur = stored(cur)
    seen = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        cur = stored(small)
        mark = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
