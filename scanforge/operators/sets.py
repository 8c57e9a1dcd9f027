"""Interval sets, set operations, and components of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .windows import running_count


def coalesce_intervals(df: DataFrame, start: str, end: str, by: list[str] | None = None) -> DataFrame:
    """Disjoint closed intervals that cover the same; those that touch merge, and reversed ends are exchanged."""
    by = by or []
    rows = df.select(*by, F.least(start, end).alias("t0"), F.greatest(start, end).alias("t1"))
    w = Window.partitionBy(*by).orderBy("t0", "t1")
    reach = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("t0") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("reach", reach).withColumn("island", island).groupBy(*by, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("island")


def integer_intervals(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Coalesced intervals of integers, each widened by 0.51 so that neighbours merge."""
    return coalesce_intervals(df.select(*(by or []), (F.col(value) - 0.51).alias("a"), (F.col(value) + 0.51).alias("b")), "a", "b", by)


def parse_ranges(text: Column) -> Column:
    """array<struct<t0, t1>> from `[a,b];c;...`; a token that is no number gives the range of 1 alone."""
    def one(token):
        parts = F.split(F.regexp_replace(F.trim(token), r"^\[|\]$", ""), ",")
        a = F.get(parts, 0).try_cast("double")
        b = F.when(F.size(parts) > 1, F.get(parts, 1).try_cast("double")).otherwise(a)
        bad = a.isNull() | b.isNull()
        return F.struct(F.when(bad, 1.0).otherwise(F.least(a, b)).alias("t0"), F.when(bad, 1.0).otherwise(F.greatest(a, b)).alias("t1"))

    return F.transform(F.filter(F.split(text, ";"), lambda t: F.length(F.trim(t)) > 0), one)


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)


def covered_integers(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each integer in a closed interval."""
    return df.where(F.ceil(start) <= F.floor(end)).withColumn("n", F.explode(F.sequence(F.ceil(start), F.floor(end))))


def components_of(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, component, number): components of all nodes, single ones too; numbered from 0 by their smallest node."""
    found = connected_components(edges)
    out = nodes.select(F.col(node).cast("long").alias("node")).distinct().join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = running_count(out.select("component").distinct(), ["component"], "number")
    return out.join(roots, "component").select("node", "component", "number")


def components_of_size(components: DataFrame, least: float, size: Column | None = None) -> DataFrame:
    """Rows of components whose number of nodes, or sum of `size`, reaches `least`."""
    total = components.groupBy("component").agg((F.count("*") if size is None else F.sum(size)).alias("__n")).where(F.col("__n") >= least)
    return components.join(total.select("component"), "component", "left_semi")


def same_label_edges(edges: DataFrame, nodes: DataFrame, labels: list[str], node: str = "node") -> DataFrame:
    """Edges (u, v) whose ends agree in the labels."""
    side = lambda end: nodes.select(F.col(node).alias(end), *[F.col(c).alias(f"{end}_{c}") for c in labels])
    on = edges.join(side("u"), "u").join(side("v"), "v")
    for c in labels:
        on = on.where(F.col(f"u_{c}").eqNullSafe(F.col(f"v_{c}")))
    return on.select("u", "v")


def triangle_edges(triangles: DataFrame) -> DataFrame:
    """Directed edges (t, a, b) of triangles (t, i, j, k)."""
    return triangles.select("t", F.explode(F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in (("i", "j"), ("j", "k"), ("k", "i"))])).alias("e")).select("t", "e.a", "e.b")


def boundary_edges(triangles: DataFrame) -> DataFrame:
    """Directed edges whose reverse no triangle has."""
    edges = triangle_edges(triangles)
    return edges.join(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti").select("a", "b")


def chain_loops(edges: DataFrame) -> DataFrame:
    """(loop, position, vertex) of directed boundary edges; a loop is named by its smallest vertex and starts there.

    Loops are found as connected components; the edges of one loop, a boundary of one surface, are then chained in one task.
    Where several edges leave a vertex, the smallest unused end is taken.
    """
    import pandas as pd

    comp = connected_components(edges.select("a", "b")).withColumnRenamed("node", "a").withColumnRenamed("component", "__loop")
    # an edge from a vertex to itself joins nothing: a vertex without other edges is a loop of its own
    named = edges.join(comp, "a", "left").select("a", "b", F.coalesce("__loop", "a").alias("loop"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ways: dict[int, list[int]] = {}
        for a, b in sorted(zip(pdf["a"], pdf["b"]), reverse=True):
            ways.setdefault(a, []).append(b)
        at, out = int(pdf["loop"].iloc[0]), []
        while ways.get(at):
            out.append(at)
            at = ways[at].pop()
        return pd.DataFrame({"loop": pdf["loop"].iloc[0], "position": range(len(out)), "vertex": out})

    return named.groupBy("loop").applyInPandas(run, "loop long, position long, vertex long")


def neighbour_triangles(triangles: DataFrame) -> DataFrame:
    """Pairs (t, other) of triangles that share an edge, whatever its direction."""
    edges = triangle_edges(triangles).select("t", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    other = edges.select(F.col("t").alias("other"), "u", "v")
    return edges.join(other, ["u", "v"]).where("t <> other").select("t", "other").distinct()


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: of the rows of a key the last in the given order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def triangles_of_graph(edges: DataFrame) -> DataFrame:
    """Triples a < b < c of nodes that are all linked."""
    e = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b").distinct()
    two = e.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b")
    return two.join(e.select("a", F.col("b").alias("c")), ["a", "c"], "left_semi").select("a", "b", "c")
