"""Near duplicates by exact Jaccard similarity of word shingles, found by fingerprints in a tree, and the rest by prefix filtering."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, cut, shuffles_freed, slices, stored
from .simhash import near_fingerprints

SHINGLE = 5
#: Similarity of 4 / 5, in whole numbers so that the border is exact.
OVER, UNDER = 4, 5
SEED = 42
#: One text in so many is looked at for common shingles: a fixed share, so that shingles of the same number of texts are found
#: common in a corpus of any size.
ONE_IN = 8
COMMON = 3
#: So many of them (4 MB), the most frequent, are sent to every task.
MOST_COMMON = 1 << 18
STARS = 2
#: Up to so many keys (8 MB) are sent to where the texts are; more meet the texts in a shuffle.
SENT_KEYS = 1 << 20
#: Similar sets are rarely further apart: of 1,591 pairs of 20,000 texts of check_s, 94 in a hundred are within so many bits.
WIDEST = 12
#: So many others a fingerprint meets in the tree, about: those of its own shard and of the three likeliest others. The prefix filter
#: finds the links that lie beyond.
WORK = 1 << 16
_DIGEST = xxhash.xxh64_intdigest


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Ordered distinct 64-bit hashes of the shingles of a text; a text of fewer words is one shingle, one without words none.

    Words are those of simhash.fingerprint: runs without space or 0x09-0x0D, after lowering A-Z.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    k = min(shingle, len(words))
    w = np.fromiter((_DIGEST(x, SEED) for x in words), np.uint64, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
        h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def _signature(h: np.ndarray) -> int:
    return _DIGEST(h.tobytes(), SEED)


def set_fingerprint(h: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of a set of hashes; zero if it is empty."""
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > h.size, bitorder="little").view("<u8")[0])


def sketch(h: np.ndarray) -> bytes:
    """Counts, up to 255, of hashes by their upper bits, in about half as many places as there are hashes, a power of two."""
    bits = max(0, h.size.bit_length() - 2)
    at = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(h.size, np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of hashes that one of two sketched sets has and the other has not."""
    p, q = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    m = min(p.size, q.size)
    return int(np.abs(p.reshape(m, -1).sum(axis=1) - q.reshape(m, -1).sum(axis=1)).sum())


def known(name: str):
    return F.coalesce(F.col(name).cast("long"), F.lit(-(2**63)))


def _longs(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sets(shingle):
    def run(batches):
        for batch in slices(batches, 128):
            got = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([_longs([_signature(h) for h in got]), pa.array([h.tobytes() for h in got], pa.binary())], names=["sig", "shingles"])

    return run


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordered hashes of shingles that COMMON or more of one in ONE_IN distinct texts have, and the rank of each by that number.

    They only set the order in which shingles are looked at, so that what is missed costs time and no pair.
    """
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(ONE_IN)) == 0).select("text").distinct()

    def run(batches):
        for batch in slices(batches, 128):
            got = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([_longs(np.concatenate(got))] if got else [pa.array([], pa.int64())], names=["token"])

    top = some.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(MOST_COMMON)
    found = top.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(found)
    # the most frequent one is the last
    return found[at], -at


def _prefixes(shingle, common):
    def prefix(h):
        tokens, rank = common.value
        need = h.size - (OVER * h.size + UNDER - 1) // UNDER + 1
        if tokens.size and h.size:
            at = np.minimum(np.searchsorted(tokens, h), tokens.size - 1)
            hit = tokens[at] == h
            h = np.concatenate([h[~hit], h[hit][np.argsort(rank[at[hit]])]])
        return h[:need]

    def run(batches):
        for batch in slices(batches, 128):
            got = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            first = [prefix(h) for h in got]
            ends = np.cumsum([0, *[p.size for p in first]])
            # 40 bits tell shingles apart well enough for candidates, and are shorter to shuffle
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _longs(np.concatenate(first) >> np.uint64(24)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), _longs([_signature(h) for h in got]), pa.array([h.size for h in got], pa.int32()), lists, pa.array([sketch(h) for h in got], pa.binary()), _longs([set_fingerprint(h) for h in got])], names=["doc_id", "key", "sig", "n", "prefix", "sketch", "fp"])

    return run


def _similar(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = np.intersect1d(p, q, assume_unique=True).size
            keep.append(UNDER * both >= OVER * (p.size + q.size - both))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])


def _perhaps(batches):
    for batch in batches:
        keep = []
        for total, x, y in zip(batch.column("total").to_pylist(), batch.column("sa"), batch.column("sb")):
            # similar sets share OVER / (OVER + UNDER) of their sizes' sum at least
            keep.append((OVER + UNDER) * apart(x.as_py(), y.as_py()) <= (UNDER - OVER) * total)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])


def similar_links(base: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, component) of the signatures that some pair of similarity OVER / UNDER or more links with another.

    First each set is compared with those of its own fingerprint and of the nearest ones in the shards of the vantage-point tree that it
    visits. These don't hold all similar pairs, so that the links that are left are then found by prefix filtering, whatever the tree has found: two sets of that similarity share one of the first n - ceil(0.8 n) + 1 shingles in any common order (prefix filter), so
    that every such pair meets at a shingle. Pairs that can't reach the similarity by their sizes, places and sketches are dropped, all
    others are compared exactly. Each shingle's members are first compared with STARS of them, and what that links is not
    compared again, so that a large group of copies costs no square of its size.
    """
    rows = base.select("sig", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = rows.groupBy("token").count().where("count > 1").select("token")
    # shingles of one text alone can't be shared: `rank` counts those before this one that can
    rank = F.row_number().over(Window.partitionBy("sig").orderBy("pos")) - 1
    members = stored(rows.join(shared, "token").dropDuplicates(["sig", "pos"]).withColumn("rank", rank))
    entries = stored(base.groupBy("sig").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"), F.min(F.struct(known("doc_id").alias("k"), "key")).alias("at")))

    def possible(a, b):
        na, nb, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
        most = F.least(na - i, nb - j) + F.least(F.col(f"{a}.rank"), F.col(f"{b}.rank"))
        return (F.col(f"{a}.comp") != F.col(f"{b}.comp")) & ((OVER + UNDER) * most >= OVER * (na + nb)) & (UNDER * F.least(na, nb) >= OVER * F.greatest(na, nb))

    def compared(pairs):
        side = lambda c: entries.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        sketched = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", (F.col("na") + F.col("nb")).alias("total"))
        pairs = cut(sketched.mapInArrow(_perhaps, "a long, b long"))
        needed = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        keys = stored(entries.join(needed, "sig", "left_semi").select("at.*"))
        if keys.count() <= SENT_KEYS:
            keys = F.broadcast(keys)
        texts = docs.select("text", known("doc_id").alias("k"), F.xxhash64("text").alias("key")).join(keys, ["k", "key"], "left_semi").select("text")
        # a text that is there twice under one id only repeats links
        sets = stored(texts.mapInArrow(_sets(shingle), "sig long, shingles binary"))
        with_sets = pairs.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("sb")), "b")
        return cut(with_sets.select("a", "b", "sa", "sb").mapInArrow(_similar, "a long, b long"))

    def met(a, b, on):
        both = a.alias("p").join(b.alias("q"), "token").where(on & possible("p", "q"))
        return both.select(F.least("p.sig", "q.sig").alias("a"), F.greatest("p.sig", "q.sig").alias("b"))

    by_print = entries.groupBy("fp").agg(F.min("sig").alias("first"))
    near = near_fingerprints(by_print.select("fp"), WIDEST, WORK)
    sig_of = lambda c: by_print.select(F.col("fp").alias(c), F.col("first").alias(f"sig_{c}"))
    by_tree = near.join(sig_of("a"), "a").join(sig_of("b"), "b").select(F.col("sig_a").alias("p"), F.col("sig_b").alias("q"))
    equal = entries.join(by_print, "fp").where("sig != first").select(F.col("sig").alias("p"), F.col("first").alias("q"))
    tried = cut(by_tree.union(equal).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    found = compared(tried)

    alone, stars = members.withColumn("comp", F.col("sig")), []
    for turn in range(STARS):
        # first the member with the fewest shingles of its own before this one, which is the nearest to what a group has in common
        first = [F.col("pos") - F.col("rank")] if turn == 0 else []
        pivot = F.min(F.struct(*first, F.xxhash64("sig", F.lit(turn)).alias("h"), "sig", "n", "pos", "rank", "comp"))
        stars.append(met(alone, alone.groupBy("token").agg(pivot.alias("m")).select("token", *[f"m.{c}" for c in ("sig", "n", "pos", "rank", "comp")]), F.lit(True)))
    done = cut(reduce(DataFrame.union, stars).distinct().join(tried, ["a", "b"], "left_anti"))
    links = found.union(compared(done))
    comp = connected_components(links).select(F.col("node").alias("sig"), "component")
    now = members.join(comp, "sig", "left").withColumn("comp", F.coalesce("component", "sig")).drop("component")
    mixed = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    now = cut(now.join(mixed, "token", "left_semi"))
    rest = met(now, now, F.col("p.sig") < F.col("q.sig")).distinct()
    return connected_components(links.union(compared(cut(rest.join(done.union(tried), ["a", "b"], "left_anti")))))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with its columns, for every group of texts linked by shingle Jaccard >= 0.8: that of the smallest id.

    Texts without words are one group. A null id counts only where the group has no other. Of rows that repeat the id within
    the group, one stays, chosen by a hash of its text.
    """
    bound_batches(docs.sparkSession)
    # what is shuffled to find the groups is gone before the texts are
    with shuffles_freed(docs.sparkSession):
        chosen = stored(_chosen(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), shingle))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), known(id_col).alias("k"), F.xxhash64(text_col).alias("key")).join(chosen, ["k", "key"])
    # rows of an id and a text lie together after the join, so that texts are shuffled once
    nth = F.row_number().over(Window.partitionBy("k", "key").orderBy(F.col("row")[text_col]))
    return keyed.withColumn("nth", nth).where("nth = 1").select("row.*")


def _chosen(named: DataFrame, shingle: int) -> DataFrame:
    """(k, key): id and hash of the text that stays of each group; of several texts under its smallest id that of the smallest hash."""
    common = named.sparkSession.sparkContext.broadcast(common_shingles(named, shingle))
    base = stored(named.withColumn("key", F.xxhash64("text")).mapInArrow(_prefixes(shingle, common), "doc_id long, key long, sig long, n int, prefix array<long>, sketch binary, fp long"))
    links = similar_links(base, named, shingle).select(F.col("node").alias("sig"), "component")
    firsts = base.groupBy("sig").agg(F.min("doc_id").alias("first")).join(links, "sig", "left").withColumn("root", F.coalesce("component", "sig"))
    least = firsts.groupBy("root").agg(F.min("first").alias("least"))
    rooted = firsts.join(least, "root").select("sig", "root", "least")
    at_least = base.select("doc_id", "key", "sig").join(rooted, "sig").where(F.col("doc_id").eqNullSafe(F.col("least")))
    return at_least.groupBy("root").agg(F.min(known("doc_id")).alias("k"), F.min("key").alias("key")).select("k", "key")
