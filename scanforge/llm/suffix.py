"""Removal of byte strings that occur more than once, by depth-limited most-significant-digit radix passes over suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices, stored
from .windows import Rolling, anchors, pieces

WINDOW = 400
GRAM = 128
DIGIT = 100
WIDE = 2000
FLUSH = 500_000
NO_ID = -(2**63)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _anchor_rows(window: int, gram: int, whole: bool):
    def run(batches):
        for batch in slices(batches):
            texts = _bytes(batch.column("text"))
            if whole:
                k, th = batch.column("k").to_numpy(), batch.column("th").to_numpy()
            for part in pieces(texts, window):
                grams, context, doc, lo, hi, mid = anchors(*part, window, gram)
                if whole:
                    cols = [grams, context, k[doc], th[doc], lo.astype(np.int32), hi.astype(np.int32), mid.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "ctx", "k", "th", "lo", "hi", "mid"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(grams)], names=["gram"])

    return run


def _contexts(window: int):
    """The bytes around each listed anchor."""

    def run(batches):
        for batch in slices(batches):
            texts = _bytes(batch.column("text"))
            lists = batch.column("spots")
            spots = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy())
            col = {n: spots.field(n).to_numpy(zero_copy_only=False) for n in ("gram", "lo", "hi", "mid", "n", "wide")}
            k, th = batch.column("k").to_numpy(), batch.column("th").to_numpy()
            step = 8192
            for at in range(0, owner.size, step):
                o = owner[at : at + step]
                lo, hi = col["lo"][at : at + step], col["hi"][at : at + step]
                held = [texts[d][a : b + window] for d, a, b in zip(o.tolist(), lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (col["gram"][at : at + step], col["mid"][at : at + step] - lo, lo, col["n"][at : at + step], col["wide"][at : at + step], k[o], th[o])] + [pa.array(held, pa.binary())],
                    names=["gram", "off", "lo", "n", "wide", "k", "th", "held"],
                )

    return run


_CONTEXT = "gram long, off int, lo int, n long, wide boolean, k long, th long, held binary"


def _windows(held: list[bytes], window: int, digit: int):
    """(row, start within it, digits) of every window of every string; digits[i] is the 64-bit rank of the i-th digit."""
    rows, starts, digits = [], [], []
    ends = [*range(digit, window, digit), window]
    for data, doc, at, base, take in pieces(held, window):
        hashes = (Rolling(data, 0), Rolling(data, 1))
        part = np.repeat(np.arange(base.size), take)
        inner = np.arange(part.size) - np.repeat(np.cumsum(take) - take, take)
        p = inner + base[part]
        rows.append(doc[part])
        starts.append(inner + at[part])
        # two independent hashes stand for the bytes of a digit
        digits.append([np.stack([h.of(p + a, p + b) for h in hashes]) for a, b in zip([0, *ends[:-1]], ends)])
    if not rows:
        return np.empty(0, int), np.empty(0, int), []
    return np.concatenate(rows), np.concatenate(starts), [np.concatenate(d, axis=1) for d in zip(*digits)]


def repeated_windows(gram, off, weight, held: list[bytes], window: int, digit: int = DIGIT):
    """(row, start) of every window that another window of the rows equals; a row of weight 2 stands for several.

    Windows begin in groups of equal gram and equal offset of the gram. Every pass splits the groups by the next digit, and
    groups left with a single window are dropped before the following pass. What is left at full depth is repeated.
    """
    row, start, digits = _windows(held, window, digit)
    alive = np.arange(row.size)
    group = np.unique(np.stack([gram[row], off[row] - start]), axis=1, return_inverse=True)[1].ravel() if row.size else row
    for d in range(-1, len(digits)):
        if d < 0:
            order = np.argsort(group, kind="stable")
            keys = [group[order]]
        else:
            one, two = digits[d][:, alive]
            order = np.lexsort((two, one, group))
            keys = [group[order], one[order], two[order]]
        if not order.size:
            break
        new = np.zeros(order.size, bool)
        new[0] = True
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        number = np.cumsum(new) - 1
        many = (np.bincount(number, weight[row[alive[order]]]) > 1)[number]
        alive, group = alive[order[many]], number[many]
    return row[alive], start[alive]


def _runs(row, start):
    """Maximal runs of consecutive starts: (row, first, last)."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    if not row.size:
        return row, start, start
    edge = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)])
    return row[edge], start[edge], start[np.r_[edge[1:], row.size] - 1]


def _sort_groups(window: int):
    """Radix passes over rows that come ordered by gram; rows of a gram are kept together."""

    def flush(tab: pa.Table):
        col = {n: tab.column(n).to_numpy() for n in ("gram", "off", "lo", "n", "k", "th")}
        row, start = repeated_windows(col["gram"], col["off"].astype(np.int64), np.minimum(col["n"], 2), tab.column("held").to_pylist(), window)
        row, first, last = _runs(row, start)
        lo = col["lo"][row]
        return pa.RecordBatch.from_arrays([pa.array(col["k"][row]), pa.array(col["th"][row]), pa.array((lo + first).astype(np.int32)), pa.array((lo + last).astype(np.int32))], names=["k", "th", "lo", "hi"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("held").nbytes
            if size >= FLUSH:
                tab = pa.Table.from_batches(held)
                gram = tab.column("gram").to_numpy()
                edge = int(np.searchsorted(gram, gram[-1], "left"))  # rows of the last gram may go on in the next batch
                if edge:
                    yield flush(tab.slice(0, edge))
                held = tab.slice(edge).to_batches()
                size = sum(b.column("held").nbytes for b in held) if edge else size
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _explode_windows(window: int):
    """One row for every window: for grams with more contexts than one task should hold."""

    def run(batches):
        for batch in slices(batches):
            col = {n: batch.column(n).to_numpy() for n in ("gram", "off", "lo", "n", "k", "th")}
            row, start, digits = _windows(batch.column("held").to_pylist(), window, window)
            if row.size:
                cols = [col["gram"][row], digits[0][0].view(np.int64), digits[0][1].view(np.int64), np.minimum(col["n"], 2)[row], col["k"][row], col["th"][row], (col["lo"][row] + start).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "h1", "h2", "n", "k", "th", "p"])

    return run


def _cut_out(window: int):
    def run(batches):
        for batch in slices(batches):
            kept, removed, spans = [], [], []
            for text, runs in zip(_bytes(batch.column("text")), batch.column("runs").to_pylist()):
                out, at, gone, found = [], 0, 0, []
                for r in sorted((r["lo"], r["hi"] + window) for r in runs or ()):
                    if found and r[0] <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], r[1])
                    else:
                        found.append([*r])
                for a, b in found:
                    out.append(text[at:a])
                    at, gone = b, gone + b - a
                out.append(text[at:])
                kept.append(b"".join(out))
                removed.append(gone)
                spans.append([{"start": a, "end": b} for a, b in found])
            names = [n for n in batch.schema.names if n not in ("text", "runs")]
            strings = pa.array([b.decode("utf-8", "ignore") for b in kept], pa.string())
            span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, span_type), strings], names=[*names, "kept", "n_removed", "spans", "text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", wide: int = WIDE, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of start, end), kept (binary), text: one row for every row of docs.

    `text` is the kept bytes as a string, without characters that are left in part only. With `carry`, one more column
    `rest`, a struct of those columns of docs.

    A byte is removed if it lies in a string of `window` UTF-8 bytes that also starts elsewhere, in the same document or
    another; matches do not cross documents and are judged on the input. Null texts are empty; texts shorter than a window
    keep everything; rows that repeat an id and text count as documents of their own, so both lose what they share. Texts under
    one id are told apart by 64 bits of hash.

    Passes, each dropping what is left alone: (1) the anchor gram of each run of window starts, (2) the whole context of the
    run, where equal contexts settle all their windows at once, (3) for the rest, one context of each kind, digit by digit
    to the full depth within groups of one gram. A gram with more than `wide` contexts is spread over window hashes instead
    of meeting in one task. Copies are merged by partial aggregation before they are shuffled.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*carry).alias("rest")] if carry else []))
    again = base.select("text").mapInArrow(_anchor_rows(window, gram, False), "gram long").groupBy("gram").count().where("count > 1").select("gram")
    again = stored(again)  # as a table, the join below exchanges both sides, and Spark can split a gram that is in many places
    rows = base.mapInArrow(_anchor_rows(window, gram, True), "gram long, ctx long, k long, th long, lo int, hi int, mid int")
    shared = stored(rows.join(again, "gram", "left_semi"))
    kinds = stored(shared.groupBy("gram", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("k", "th", "lo", "hi", "mid")).alias("r")))
    settled = shared.join(kinds.where("n > 1").select("gram", "ctx"), ["gram", "ctx"], "left_semi").select("k", "th", "lo", "hi")
    several = kinds.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1")
    spots = kinds.join(several, "gram").select("r.k", "r.th", F.struct("gram", "r.lo", "r.hi", "r.mid", "n", (F.col("contexts") > wide).alias("wide")).alias("s"))
    spots = spots.groupBy("k", "th").agg(F.collect_list("s").alias("spots"))
    # the small sides are hashed, so that the texts are not sorted
    found = stored(base.select("k", "th", "text").join(spots.hint("shuffle_hash"), ["k", "th"]).mapInArrow(_contexts(window), _CONTEXT))
    narrow = found.where("not wide").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort_groups(window), "k long, th long, lo int, hi int")
    single = found.where("wide").mapInArrow(_explode_windows(window), "gram long, h1 long, h2 long, n long, k long, th long, p int")
    double = single.groupBy("gram", "h1", "h2").agg(F.sum("n").alias("m")).where("m > 1").select("gram", "h1", "h2")
    spread = single.join(double, ["gram", "h1", "h2"], "left_semi").select("k", "th", F.col("p").alias("lo"), F.col("p").alias("hi"))
    runs = settled.union(narrow).union(spread).distinct().groupBy("k", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    cut = base.join(runs.hint("shuffle_hash"), ["k", "th"], "left").select("k", "text", "runs", *(["rest"] if carry else []))
    rest = f", rest {base.schema['rest'].dataType.simpleString()}" if carry else ""
    cut = cut.mapInArrow(_cut_out(window), f"k long{rest}, kept binary, n_removed long, spans array<struct<start: long, end: long>>, text string")
    return cut.select(F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", "spans", "kept", "text", *(["rest"] if carry else []))
