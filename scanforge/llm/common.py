"""Helpers shared by the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import checkpoint_folder, connected_components, cut, local_roots, stored

__all__ = ["bound_batches", "checkpoint_folder", "connected_components", "cut", "held_out", "local_roots", "shuffles_freed", "slices", "stored", "table"]

SPLIT_MODULUS = 3
HELD_OUT_REMAINDER = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Let Arrow batches to Python hold at most `size` bytes, as texts may be long; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key, None) or "").lower().rstrip("b")
    if not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Actions on frames made herein free their shuffle files as they end, not when the driver happens to collect its garbage.

    For work whose every action ends in a table in the shared folder or a few rows. Frames that are handed out belong behind it: one that
    is made herein and run twice has its stages run twice.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the rows kept away from training: crc32 of the id as text, mod 3, is 1. Null ids are held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % SPLIT_MODULUS == HELD_OUT_REMAINDER, F.lit(True))


def slices(batches, rows: int = 512):
    """Arrow batches cut into small ones, so that Python holds the objects of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
