"""Exact top-k search by multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import matrix, usable

QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 8192
QUERY_TILE = 256
CANDIDATE_TILE = 2048
LEVELS = (4, 16)
DENSE = 0.02
MOST = 0.5
EXACT = float(2**53)


def segment_profile(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations of the segments of every row.

    With p = profile(x), r = profile(y): p.r >= x.y, so |x|^2 + |y|^2 - 2 p.r is a lower bound of the squared distance.
    """
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    width = np.diff(edges).astype(float)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / width
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    spread = np.sqrt(np.maximum(square - width * mean * mean, 0.0))
    return np.hstack([mean * np.sqrt(width), spread])


def _best(rows, scores, ids, k):
    """Positions of the k best of every row, by score from high to low, then id."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    start = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]]) if order.size else np.empty(0, int)
    place = np.arange(order.size) - np.repeat(start, np.diff(np.r_[start, order.size]))
    return order[place < k]


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """(query ids, candidate ids, scores) of the k best candidates of every query within one block of candidates.

    q and c are integer matrices; c_ids has no repeats. Tile by tile, bounds go from coarse to fine, and exact scores are
    taken where the bound reaches the k-th best score known so far: pair by pair if few survive, by one product if many
    do; a level that leaves most of a tile is not refined. Bounds are widened by a slack, so rounding loses no candidate.
    """
    top = float(max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)))
    if top * top * max(1, q.shape[1]) < EXACT:
        qx, cx = q.astype(float), c.astype(float)
    else:
        qx, cx = q, c
    qf, cf = q.astype(float), c.astype(float)
    levels = [(segment_profile(qf, s), segment_profile(cf, s)) for s in LEVELS if s < q.shape[1]]
    slack = 1e-9 * (1.0 + np.linalg.norm(qf, axis=1) * np.linalg.norm(cf, axis=1).max(initial=0.0))
    out = []
    for at in range(0, len(q_ids), QUERY_TILE):
        sel = slice(at, min(at + QUERY_TILE, len(q_ids)))
        n = sel.stop - sel.start
        # one more than k is held, as the query's own row is taken out only at the end
        floor = np.full(n, -np.inf)
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        for ct in range(0, len(c_ids), CANDIDATE_TILE):
            tile = slice(ct, ct + CANDIDATE_TILE)
            alive, share = None, 1.0
            if ct:
                for qp, cp in levels:
                    ok = qp[sel] @ cp[tile].T + slack[sel, None] >= floor[:, None]
                    alive = ok if alive is None else alive & ok
                    share = alive.mean()
                    if share > MOST or not share:
                        break
            if not share:
                continue
            if share <= DENSE:
                rows, cols = np.nonzero(alive)
                scores = np.concatenate([np.einsum("pd,pd->p", qx[sel][rows[i : i + 65536]], cx[tile][cols[i : i + 65536]]) for i in range(0, rows.size, 65536)])
                good = scores >= floor[rows]
                rows, cols, scores = rows[good], cols[good], scores[good]
            else:
                full = qx[sel] @ cx[tile].T
                if not ct and full.shape[1] > k + 1:
                    floor = np.partition(full, -k - 1, axis=1)[:, -k - 1].astype(float)
                rows, cols = np.nonzero(full >= floor[:, None])
                scores = full[rows, cols]
            held = tuple(np.concatenate(x) for x in zip(held, (rows, c_ids[tile][cols], scores.astype(np.int64))))
            pick = _best(*(held[i] for i in (0, 2, 1)), k + 1)
            held = tuple(x[pick] for x in held)
            counts = np.bincount(held[0], minlength=n)
            last = np.cumsum(counts) - 1
            floor = np.where(counts > k, held[2][np.maximum(last, 0)] if held[2].size else -np.inf, -np.inf).astype(float)
        rows, ids, scores = held
        other = ids != q_ids[sel][rows]
        rows, ids, scores = rows[other], ids[other], scores[other]
        pick = _best(rows, scores, ids, k)
        out.append((q_ids[sel][rows[pick]], ids[pick], scores[pick]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def top_k_inner_product(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """The k candidates of highest integer inner product for every query: query_id, rank, vec_id, score.

    Components become floor(scale * x). Rows with a null id, or a vector that is null, empty or holds null or
    non-finite components, take no part; vectors are compared only with others of their length; a candidate with the
    query's own id is left out. Of rows that repeat an id, the smallest vector counts. Ties go to the smaller id.
    Queries and candidates are dealt into blocks of bounded size by a hash of the id, and every block of queries meets
    every block of candidates in one task; each such task returns at most k rows a query. Empty input gives no rows.
    """
    def prepared(df):
        one = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return one.where(F.col("id").isNotNull() & usable("vec")).groupBy("id").agg(F.min("vec").alias("vec"))

    q, c = prepared(queries), prepared(candidates)
    n_q = max(1, -(-queries.count() // query_block))
    n_c = max(1, -(-candidates.count() // candidate_block))
    q = q.select(F.lit(True).alias("is_query"), "id", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n_q)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))).alias("cb"))
    c = c.select(F.lit(False).alias("is_query"), "id", "vec", F.size("vec").alias("dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(n_c)).alias("cb"))

    def block(tab: pa.Table) -> pa.Table:
        is_query = tab.column("is_query").to_numpy()
        ids = tab.column("id").to_numpy()
        x = np.floor(scale * matrix(tab.column("vec"))).astype(np.int64)
        got = search_block(ids[is_query], x[is_query], ids[~is_query], x[~is_query], k)
        return pa.table({"query_id": got[0], "vec_id": got[1], "score": got[2]})

    found = q.unionByName(c).groupBy("dim", "qb", "cb").applyInArrow(block, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
