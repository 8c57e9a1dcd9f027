"""Scans as a stream: scripts, statistics by event time, and paths, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.script import parse


def run_script_live(stream: DataFrame, text: str) -> DataFrame:
    """A filter script over a stream. Decimate counts rows in arrival order, which a stream does not have, and raises ValueError."""
    if any(line.split()[:1] and line.split()[0].upper() == "DECIMATE" for line in text.splitlines()):
        raise ValueError("Decimate needs an order of all rows")
    for operator in parse(text):
        stream = stream.transform(operator)
    return stream


def cell_statistics(stream: DataFrame, time: str, res: float, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Count and height range of plan cells by window of event time; a window is final when rows are `late` behind."""
    cells = stream.withWatermark(time, late).groupBy(F.window(time, window), F.floor(F.col("x") / res).alias("i0"), F.floor(F.col("y") / res).alias("i1"))
    return cells.agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


def path_lengths(stream: DataFrame, key: str, time: str, axes: list[str]) -> DataFrame:
    """Running length of each path: the last position and the length so far are the state; rows of a batch are taken in time order.

    Rows older than the last one seen of their path are left out, so that positions are never joined backwards.
    """
    state = "t double, length double, " + ", ".join(f"p{i} double" for i in range(len(axes)))
    kind = stream.schema[key].dataType.simpleString()

    def run(group, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get if held.exists else None
        rows = pd.concat(list(batches)).sort_values("__t", kind="stable")
        for t, *p in rows[["__t", *axes]].itertuples(index=False):
            if last is None:
                last = (t, 0.0, *p)
            elif t >= last[0]:
                last = (t, last[1] + sum((a - b) ** 2 for a, b in zip(p, last[2:])) ** 0.5, *p)
        held.update(tuple(float(v) for v in last))
        yield pd.DataFrame({key: [group[0]], "length": [last[1]]})

    rows = stream.select(key, F.col(time).cast("double").alias("__t"), *axes)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, length double", state, "update", GroupStateTimeout.NoTimeout)
