"""Embedding near-dedup by randomised-rotation binary codes with stored correction factors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, local_roots
from .vectors import matrix, usable

THRESHOLD = 0.93
BLOCK = 4096
TILE = 512
ROTATION_SEED = 20240613


def rotation(dim: int, seed: int = ROTATION_SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    m, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return m * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated unit vectors, packed, and the correction factor <code, vector> of each."""
    rotated = unit @ rotation(unit.shape[1])
    return np.packbits(rotated >= 0, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(unit.shape[1])


def candidates(codes, factors, queries, dim: int, threshold: float, epsilon: float | None):
    """(query, code) positions whose cosine may reach the threshold.

    The estimate <code, q'> / factor of <o, q> is unbiased over rotations. Its error is sqrt(1 - factor^2) / factor times
    the sine between o and q times the cosine of an angle in dim - 1 dimensions. epsilon / sqrt(dim - 1) bounds that cosine
    with high probability; None takes the bound that always holds, so that no pair is lost.
    """
    share = 1.0 if epsilon is None or dim < 3 else min(1.0, epsilon / np.sqrt(dim - 1))
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = (queries @ rotation(dim)).astype(np.float32) @ signs.T / np.sqrt(np.float32(dim)) / factors.astype(np.float32)
    error = np.sqrt(np.maximum(0.0, 1 - factors**2)) / factors * np.sqrt(1 - threshold**2) * share
    return np.nonzero(estimate >= (threshold - error - 1e-4)[None, :])


def link_block(left, right, codes, factors, threshold, same, epsilon=None):
    """Positions (i in left, j in right) with cosine >= threshold; each pair once if both are the same block."""
    nl, nr = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    unit = left / nl[:, None]
    found = []
    for at in range(0, len(left), TILE):
        i, j = candidates(codes, factors, unit[at : at + TILE], left.shape[1], threshold, epsilon)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, i.size, 65536):
            a, b = i[k : k + 65536], j[k : k + 65536]
            ok = np.einsum("pd,pd->p", left[a], right[b]) / (nl[a] * nr[b]) >= threshold
            found.append((a[ok], b[ok]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    block: int = BLOCK,
    epsilon: float | None = None,
) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, they have the same length, and their cosine in double precision
    is at least the threshold. Vectors that are null, empty, all zero, or hold null or non-finite components link with
    nothing, nor do rows with a null id, whose component is null and which are not kept. Equal vectors of a label are worked on
    once, with their number as weight. Rows that repeat an id are vectors of their own, which link like any others.
    Each label is dealt into blocks of bounded size, and every pair of blocks of a label meets in one task, which returns
    counts and a spanning star of its links rather than pairs. The first block's vectors are the exact side; the second
    is represented by its codes and correction factors until a pair survives the confidence bound.
    """
    one = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    live = one.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vec") & F.exists("vec", lambda x: x != 0))

    def index(batches):
        for b in batches:
            dims = pa.compute.list_value_length(b.column("vec")).to_numpy()
            codes, factors = np.empty(len(dims), object), np.empty(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = matrix(b.column("vec").take(pa.array(at)))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                c, factors[at] = encode(x / np.linalg.norm(x, axis=1, keepdims=True))
                for i, row in zip(at, c):
                    codes[i] = row.tobytes()
            cols = [b.column(n) for n in ("label", "vec", "first", "weight")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(codes, pa.binary()), pa.array(factors)], names=["label", "vec", "first", "weight", "code", "factor"])

    label_type = one.schema["label"].dataType.simpleString()
    reps = live.groupBy("label", "vec").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    reps = reps.mapInArrow(index, f"label {label_type}, vec array<double>, first long, weight long, code binary, factor double")
    # numbered before they are stored, as ids may repeat
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    sizes = reps.groupBy("label", F.size("vec").alias("dim")).agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = reps.withColumn("dim", F.size("vec")).join(sizes, ["label", "dim"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    left = dealt.withColumn("j", F.explode(F.expr("sequence(b, blocks - 1)"))).withColumn("i", F.col("b")).withColumn("side", F.lit(0))
    right = dealt.withColumn("i", F.explode(F.expr("sequence(cast(0 as bigint), b)"))).where("i < b").withColumn("j", F.col("b")).withColumn("side", F.lit(1))
    cols = ["label", "dim", "i", "j", "side", "rep", "weight", "vec", "code", "factor"]

    def link(tab: pa.Table) -> pa.Table:
        side = tab.column("side").to_numpy()
        ids, weight, factors = (tab.column(n).to_numpy() for n in ("rep", "weight", "factor"))
        x = matrix(tab.column("vec"))
        x = x / np.abs(x).max(axis=1, keepdims=True)
        codes = np.frombuffer(b"".join(tab.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        same = tab.column("i")[0].as_py() == tab.column("j")[0].as_py()
        a = np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        if not b.size or not a.size:
            return pa.table({"rep": ids[:0], "links": weight[:0], "root": ids[:0]})
        i, j = link_block(x[a], x[b], codes[b], factors[b], threshold, same, epsilon)
        i, j = a[i], b[j]
        links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(order.size)
        root = ids[order[local_roots(place[i], place[j], len(ids))]][place]
        has = links > 0
        return pa.table({"rep": ids[has], "links": links[has].astype(np.int64), "root": root[has]})

    found = cut(left.select(cols).unionByName(right.select(cols)).groupBy("label", "dim", "i", "j").applyInArrow(link, "rep long, links long, root long"))
    count = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select("rep", "root"))
    known = reps.select("label", "vec", "rep", "first", "weight").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(least, "component").join(count, "rep", "left")
    known = known.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    return one.join(known, ["label", "vec"], "left").select(
        F.col("id").alias("vec_id"),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
