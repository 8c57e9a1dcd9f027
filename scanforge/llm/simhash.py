"""SimHash fingerprints, and exact linking of them through a vantage-point tree over Hamming distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, cut, local_roots, slices

SHINGLE = 3
SEED = 42
RADIUS = 2
LEAF_SIZE = 1024
SAMPLE = 65536
PART = 65536
HOME_CHUNK = 16384
_DIGEST = xxhash.xxh64_intdigest


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; zero if it has no words."""
    # bytes.lower() changes A-Z alone, and bytes.split() splits at 0x20 and 0x09-0x0D alone
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        got = np.array([_DIGEST(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(n, at + PART))], "<u8")
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle):
    def run(batches):
        for batch in slices(batches):
            got = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return run


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """Splits of the space of fingerprints by distance to vantage points; its leaves are the shards.

    node i: points within radius[i] of vantage[i] go to inner[i], others to outer[i]; a child below zero is leaf -child - 1.
    """

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.vantage, self.radius, self.inner, self.outer, self.leaves = [], [], [], [], 0
        self.random = np.random.default_rng(seed)
        depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        self.root = self._grow(np.unique(sample), depth)
        del self.random

    def _grow(self, points: np.ndarray, depth: int) -> int:
        if depth and points.size >= 8:
            best = None
            for v in points[self.random.integers(0, points.size, 8)]:
                d = hamming(points, v)
                r = int(np.median(d))
                if 0 < (d <= r).sum() < points.size:
                    # the fewer points near the boundary, the fewer visits of both sides
                    share = ((d > r - RADIUS) & (d <= r + RADIUS)).mean() + abs((d <= r).mean() - 0.5)
                    best = min(best or (2.0,), (share, int(v), r))
            if best and len(best) == 3:
                _, v, r = best
                at = len(self.vantage)
                self.vantage.append(v)
                self.radius.append(r)
                self.inner.append(0)
                self.outer.append(0)
                near = hamming(points, np.uint64(v)) <= r
                self.inner[at] = self._grow(points[near], depth - 1)
                self.outer[at] = self._grow(points[~near], depth - 1)
                return at
        self.leaves += 1
        return -self.leaves

    def route(self, fps: np.ndarray, radius: int):
        """(leaf, positions, at home) for every leaf whose region lies within radius of a fingerprint."""
        todo = [(self.root, np.arange(fps.size), np.ones(fps.size, bool))]
        while todo:
            node, at, home = todo.pop()
            if not at.size:
                continue
            if node < 0:
                yield -node - 1, at, home
                continue
            d, r = hamming(fps[at], np.uint64(self.vantage[node])).astype(np.int64), self.radius[node]
            # triangle bound: a point inside is at distance <= r, so one within `radius` of it is at <= r + radius
            go = d <= r + radius
            todo.append((self.inner[node], at[go], home[go] & (d[go] <= r)))
            go = d > r - radius
            todo.append((self.outer[node], at[go], home[go] & (d[go] > r)))

    def route_few(self, fps: np.ndarray, radius: int, most: int):
        """leaves, positions, at home: as route, but of the leaves within radius of a fingerprint the `most` that are likeliest to hold
        what is near to it: those of the least sum of squared bits by which the way there crosses borders. Its own is the first.
        """
        vantage, border = np.array(self.vantage, np.uint64), np.array(self.radius, np.int64)
        inner, outer = np.array(self.inner, np.int64), np.array(self.outer, np.int64)
        node, at, cost = np.full(fps.size, self.root), np.arange(fps.size), np.zeros(fps.size, np.int64)
        while (fork := node >= 0).any():
            k, a, c = node[fork], at[fork], cost[fork]
            over = hamming(fps[a], vantage[k]).astype(np.int64) - border[k]
            parts = [(node[~fork], at[~fork], cost[~fork])]
            for child, bits in ((inner, np.maximum(over, 0)), (outer, np.maximum(1 - over, 0))):
                go = bits <= radius
                parts.append((child[k[go]], a[go], c[go] + bits[go] ** 2))
            node, at, cost = (np.concatenate(x) for x in zip(*parts))
            # a cost never falls on the way down, and one child of each node has that of the node: the first leaves come from the first nodes
            order = np.lexsort((cost, at))
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            nth = np.arange(order.size) - np.repeat(first, np.diff(first, append=order.size))
            order = order[nth < most]
            node, at, cost = node[order], at[order], cost[order]
        return -node - 1, at, cost == 0


def close_pairs(home: np.ndarray, visit: np.ndarray, radius: int, brute: int = 1 << 20):
    """Positions (i, j) with hamming(home[i], visit[j]) <= radius, by vantage points down to small blocks."""
    todo, found = [(np.arange(home.size), np.arange(visit.size))], []
    while todo:
        h, v = todo.pop()
        if not h.size or not v.size:
            continue
        if h.size * v.size > brute and h.size > 64:
            pivot = home[h[h.size // 2]]
            dh, dv = hamming(home[h], pivot).astype(np.int64), hamming(visit[v], pivot).astype(np.int64)
            r = int(np.median(dh))
            if (dh > r).any():
                parts = [(h[dh <= r], v[dv <= r + radius]), (h[dh > r], v[dv > r - radius])]
                if sum(a.size * b.size for a, b in parts) < 0.9 * h.size * v.size:
                    todo += parts
                    continue
        step = max(1, brute // max(1, v.size))
        for at in range(0, h.size, step):
            i, j = np.nonzero(hamming(home[h[at : at + step], None], visit[v][None, :]) <= radius)
            found.append((h[at + i], v[j]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))


def _sampled(fps: DataFrame, n: int, sample: int) -> np.ndarray:
    # a share of the hash range holds about 1.5 * sample of them, so that tasks send the driver no more than that in all
    share = min(1 << 20, -(-int(1.5 * sample * (1 << 20)) // max(1, n)))
    got = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < share).orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()
    return got["fp"].to_numpy(np.int64).view(np.uint64)


def _meetings(fps: DataFrame, tree, radius: int, visit_chunk: int | None = None, most: int | None = None) -> DataFrame:
    """leaf, part, against, fp, home, visits: every fingerprint in its own shard and in those that its ball of the radius overlaps.

    With `most`, it is in so many shards at most, by route_few, so that rows grow with fingerprints alone. Shards with more than HOME_CHUNK points of their own are split, visitors as well (into parts of visit_chunk, if that is
    given), and each part of the one meets each part of the other.
    """
    spark = fps.sparkSession

    def route(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if most:
                visits = [tree.value.route_few(fp, radius, most)]
            else:
                visits = ((np.full(at.size, leaf, np.int64), at, home) for leaf, at, home in tree.value.route(fp, radius))
            for leaf, at, home in visits:
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fp[at].view(np.int64)), pa.array(home)], names=["leaf", "fp", "home"])

    routed = fps.mapInArrow(route, "leaf long, fp long, home boolean")
    if visit_chunk:
        sizes = routed.groupBy("leaf").agg(F.count_if("home").alias("own"), F.count("*").alias("all")).where((F.col("own") > HOME_CHUNK) | (F.col("all") > visit_chunk))
        parts = [(r["leaf"], max(1, -(-r["own"] // HOME_CHUNK)), -(-r["all"] // visit_chunk)) for r in sizes.collect()]  # at most one row a leaf
    else:
        big = routed.where("home").groupBy("leaf").count().where(F.col("count") > HOME_CHUNK)
        parts = [(r["leaf"], n, n) for r in big.collect() for n in [-(-r["count"] // HOME_CHUNK)]]  # at most one row a leaf, so at most sample / 16 rows
    if parts:
        split = spark.createDataFrame(parts, "leaf long, parts long, others long")
        routed = routed.join(F.broadcast(split), "leaf", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("parts", "others")})
        own = lambda c: F.pmod(F.xxhash64("fp"), F.col(c))
        every = lambda c: F.explode(F.expr(f"sequence(cast(0 as bigint), {c} - 1)"))
        # every part of the points at home meets every part of the visitors in a task of its own
        routed = routed.withColumn("own", own("parts")).withColumn("one", own("others")).withColumn("part", every("parts")).withColumn("against", every("others"))
        routed = routed.withColumn("visits", F.col("against") == F.col("one")).withColumn("home", F.col("home") & (F.col("part") == F.col("own"))).where("home or visits")
    else:
        zero = F.lit(0).cast("long")
        routed = routed.withColumns({"part": zero, "against": zero, "visits": F.lit(True)})
    return routed.select("leaf", "part", "against", "fp", "home", "visits")


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, leaf_size: int = LEAF_SIZE, sample: int = SAMPLE) -> DataFrame:
    """(fp, root) for every distinct fingerprint that links with another; fps has one long column, without repeats.

    The tree is fitted on at most `sample` fingerprints; every fingerprint is then sent to the shard it lies in and visits
    each shard that its ball of the radius overlaps, so that the pairs found are exact.
    """
    n = fps.count()
    tree = fps.sparkSession.sparkContext.broadcast(VantageTree(_sampled(fps, n, sample), min(-(-n // leaf_size), sample // 16)))

    def link(tab: pa.Table) -> pa.Table:
        fp, home, visits = tab.column("fp").to_numpy().view(np.uint64), tab.column("home").to_numpy(), tab.column("visits").to_numpy()
        mine, there = np.flatnonzero(home), np.flatnonzero(visits)
        i, j = close_pairs(fp[mine], fp[there], radius)
        i, j = mine[i], there[j]
        i, j = i[i != j], j[i != j]
        root = local_roots(i, j, fp.size)
        has = root != np.arange(fp.size)
        return pa.table({"a": fp[has].view(np.int64), "b": fp[root[has]].view(np.int64)})

    pairs = _meetings(fps, tree, radius).groupBy("leaf", "part", "against").applyInArrow(link, "a long, b long")
    return connected_components(pairs).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def affordable_radius(tree: VantageTree, some: np.ndarray, n: int, widest: int, work: int) -> int:
    """The largest radius from RADIUS to `widest` at which one of n fingerprints meets at most `work` others, by a sample of them."""
    sizes = np.zeros(tree.leaves)
    for leaf, _, home in tree.route(some, 0):
        sizes[leaf] += home.sum() * n / some.size
    asked = some[:2048]
    for radius in range(widest, RADIUS, -1):
        if sum(sizes[leaf] * at.size for leaf, at, _ in tree.route(asked, radius)) <= work * asked.size:
            return radius
    return RADIUS


def nearest(home: np.ndarray, visit: np.ndarray, radius: int, brute: int = 1 << 17):
    """Positions (i, j): for each visitor j that has another fingerprint within the radius at home, the nearest one i, the smaller of equals."""
    found = []
    step = max(1, brute // max(1, home.size))
    for at in range(0, visit.size if home.size else 0, step):
        d = hamming(visit[at : at + step, None], home[None, :]).ravel()
        near = np.flatnonzero(d <= radius)
        if near.size:
            (j, i), far = np.divmod(near, home.size), d[near]
            j, i, far = j[far > 0], i[far > 0], far[far > 0]
            order = np.lexsort((home[i], far, j))
            j, i = j[order], i[order]
            first = np.flatnonzero(np.diff(j, prepend=-1))
            found.append((i[first], at + j[first]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))


def near_fingerprints(fps: DataFrame, widest: int, work: int, leaf_size: int = HOME_CHUNK, sample: int = SAMPLE, visit_chunk: int = 1 << 20) -> DataFrame:
    """(a, b) of distinct fingerprints: each with the nearest other one, within `widest` bits, of every shard of the tree that it visits.

    A wide ball overlaps nearly every shard, so that visits to all of them would grow with the square of the number of fingerprints. Each
    therefore visits work / leaf_size shards at most, which are all that its ball overlaps where there are no more, and the likeliest
    ones otherwise; up to sample / 16 shards it then meets about `work` others, whatever their number. Pairs are candidates: what
    they leave out is for the caller to find. A large group has no square of them.
    """
    n = fps.count()
    if n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    tree = fps.sparkSession.sparkContext.broadcast(VantageTree(_sampled(fps, n, sample), min(-(-n // leaf_size), sample // 16)))

    def meet(tab: pa.Table) -> pa.Table:
        fp, home, visits = tab.column("fp").to_numpy().view(np.uint64), tab.column("home").to_numpy(), tab.column("visits").to_numpy()
        mine, there = fp[home], fp[visits]
        i, j = nearest(mine, there, widest)
        return pa.table({"a": there[j].view(np.int64), "b": mine[i].view(np.int64)})

    return _meetings(fps, tree, widest, visit_chunk, max(1, work // leaf_size)).groupBy("leaf", "part", "against").applyInArrow(meet, "a long, b long")


def near_duplicate_texts(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of <= radius bits.

    Words are runs without space or 0x09-0x0D, after lowering A-Z; a text of fewer words than a shingle is one shingle;
    null, empty and wordless texts have fingerprint zero, which links like any other. One row is returned for every row
    of docs, repeated ids included; a row with a null id takes part and gets the smallest id it reaches, null if there is none.
    Equal fingerprints are worked on once, by partial aggregation, so that large groups of copies cost one entry.
    """
    prints, named = _named(docs, shingle, radius, id_col, text_col)
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(docs, shingle, radius, id_col, text_col):
    """(doc_id, fp) of every row, and (fp, component_id) of every fingerprint."""
    bound_batches(docs.sparkSession)
    prints = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")
    prints = cut(prints)
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = link_fingerprints(distinct.select("fp"), radius)
    rooted = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints, rooted.join(least, "root").select("fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with its columns, for every group of near_duplicate_texts: the one of the smallest doc_id.

    Of rows that repeat that id within the group, one stays, chosen by a hash of its text.
    """
    prints, named = _named(docs, shingle, radius, id_col, text_col)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    chosen = prints.join(named, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(_id("doc_id").alias("k"), "fp", "root").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), _id(id_col).alias("k"), fp(text_col).alias("fp")).join(chosen, ["k", "fp"])
    nth = F.row_number().over(Window.partitionBy("k", "root").orderBy(F.xxhash64(F.col("row")[text_col]), F.col("row")[text_col]))
    return keyed.withColumn("nth", nth).where("nth = 1").select("row.*")


def _id(name: str):
    return F.coalesce(F.col(name).cast("long"), F.lit(-(2**63)))
