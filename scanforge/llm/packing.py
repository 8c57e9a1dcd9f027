"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
SHARD = 20_000


def count_words(text: Column | str = "text") -> Column:
    """Number of runs of non-space characters in the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


class _Left:
    """Lengths not packed yet: how many of each, and the largest one up to a limit."""

    def __init__(self, lengths: np.ndarray, top: int):
        self.count = np.bincount(lengths, minlength=top + 1).tolist()
        self.down = list(range(top + 1))

    def largest(self, limit: int) -> int:
        """The largest length <= limit of which some are left; 0 if there is none."""
        root = limit
        while root and not self.count[root]:
            root = self.down[root] if self.down[root] != root else root - 1
        while limit > root and self.down[limit] > root:
            self.down[limit], limit = root, self.down[limit] if self.down[limit] != limit else limit - 1
        return root

    def fill(self, room: int) -> int:
        """Tokens that the largest fitting lengths, taken greedily, would put into the room."""
        used: dict[int, int] = {}
        total, at = 0, self.largest(room)
        while at:
            if self.count[at] > used.get(at, 0):
                used[at] = used.get(at, 0) + 1
                total += at
                at = self.largest(min(at, room - total))
            else:
                at = self.largest(at - 1)
        return total


def pack(lengths: np.ndarray, capacities=CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, capacity of that bin, offset within it) of every length; lengths are 1 to max(capacities).

    Lengths go from long to short into the open bin with the least room that suffices, of such bins the one filled last. If there
    is none, a bin is opened with the capacity of least cost a token, cost being capacity + overhead and tokens being what the
    lengths still to come would fill. In the end each bin gets the smallest permitted capacity that holds its contents.
    """
    sizes = sorted(set(capacities))
    left = _Left(lengths, sizes[-1])
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    used: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    have = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        left.count[n] -= 1
        fits = have >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                have &= ~(1 << r)
        else:
            c = min((c for c in sizes if c >= n), key=lambda c: ((c + overhead) / (n + left.fill(c - n)), c))
            b, r = len(room), c
            room.append(c)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        room[b] = r = r - n
        if r:
            by_room[r].append(b)
            have |= 1 << r
    final = np.array([next(c for c in sizes if c >= u) for u in used], np.int64)
    return bins, final[bins] if len(lengths) else bins, offsets


def pack_documents(docs: DataFrame, length: Column, capacities=CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD, id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, capacity, offset: one row for each piece of each row of docs.

    A document longer than the largest capacity falls into pieces of that capacity and a rest; nothing is dropped. A document
    of no tokens, a null text among them, gets one row with null bin_id, capacity and offset. Pieces are dealt by a hash into
    shards of about `shard` pieces, each packed in one task. A bin_id occurs in one shard only.

    Rows of one id and length are told apart by a number only, so that the result follows from the rows and not from how they
    lie in files; a null id, or any other that many rows share, is spread over all shards. Other columns are not read.
    """
    top = max(capacities)
    # rows of one id and length are counted rather than shuffled one by one
    items = docs.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n")).groupBy("doc_id", "n").count()
    items = cut(items.withColumn("last", F.greatest(F.lit(0), F.floor((F.col("n") - 1) / top)).cast("long")))
    shards = max(1, -(-(items.agg(F.sum(F.col("count") * (F.col("last") + 1))).first()[0] or 0) // shard))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    pieces = items.withColumn("copy", F.explode(F.sequence(one, "count"))).withColumn("piece", F.explode(F.sequence(zero, "last")))
    pieces = pieces.withColumn("start", F.col("piece") * top).withColumn("n_tokens", F.least(F.col("n") - F.col("start"), F.lit(top)))
    none = pieces.where("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", *(F.lit(None).cast("long").alias(c) for c in ("bin_id", "capacity", "offset")))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by([("n_tokens", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "n", "copy"))])
        bins, capacity, offset = pack(tab.column("n_tokens").to_numpy(), capacities, overhead)
        return pa.table({c: tab.column(c) for c in ("doc_id", "piece", "start", "n_tokens")} | {"bin_id": bins + (tab.column("shard")[0].as_py() << 32), "capacity": capacity, "offset": offset})

    key = F.pmod(F.xxhash64("doc_id", "n", "piece", "copy"), F.lit(shards)).cast("long")
    dealt = pieces.where("n_tokens > 0").select(key.alias("shard"), "doc_id", "piece", "start", "n_tokens", "n", "copy")
    packed = dealt.groupBy("shard").applyInArrow(run, f"doc_id {id_type}, piece long, start long, n_tokens long, bin_id long, capacity long, offset long")
    return packed.union(none)
