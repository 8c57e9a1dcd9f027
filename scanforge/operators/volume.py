"""Operators on cells, voxels, leaves and meshes."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, stored

#: The order of faces in a voxel's state is y-, x+, y+, x-, z-, z+.
FACES = [(0, -1, 0), (1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, 0, -1), (0, 0, 1)]
OPPOSITE = [2, 3, 0, 1, 5, 4]


def shifted(cells: DataFrame, axes: list[str], offsets: list[tuple]) -> DataFrame:
    """Each cell once for each offset: the neighbour's key, with the number of the offset as side."""
    moves = F.array(*[F.struct(F.lit(k).alias("side"), *[F.lit(int(o)).alias(a) for a, o in zip(axes, move)]) for k, move in enumerate(offsets)])
    return cells.withColumn("__m", F.explode(moves)).withColumns({a: F.col(a) + F.col(f"__m.{a}") for a in axes}).withColumn("side", F.col("__m.side")).drop("__m")


def boundary_voxels(interior: DataFrame) -> DataFrame:
    """Voxels around a distinct interior set (ix, iy, iz), with a bit of `state` for each face that an interior voxel shares."""
    axes = ["ix", "iy", "iz"]
    here = interior.select(*axes)
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in OPPOSITE]), F.col("side") + 1)
    return shifted(here, axes, FACES).groupBy(*axes).agg(F.bit_or(bit).alias("state")).join(here, axes, "left_anti")


def open_sides(interior: DataFrame) -> DataFrame:
    """Each interior voxel with the number of its faces that look out of the set."""
    axes = ["ix", "iy", "iz"]
    here = interior.select(*axes)
    touching = shifted(here, axes, FACES).groupBy(*axes).agg(F.count("*").alias("n"))
    return here.join(touching, axes, "left").select(*axes, (6 - F.coalesce("n", F.lit(0))).cast("int").alias("open_sides"))


def leaf_voxels(leaves: DataFrame, depth: int) -> DataFrame:
    """Voxels of one depth that leaves (depth, ix, iy, iz) of smaller or equal depth consist of."""
    out = leaves.withColumn("n", F.pow(F.lit(2.0), F.lit(depth) - F.col("depth")).cast("long"))
    for a in ("ix", "iy", "iz"):
        out = out.withColumn(a, F.explode(F.sequence((F.col(a) * F.col("n")).cast("long"), (F.col(a) * F.col("n") + F.col("n") - 1).cast("long"))))
    return out.drop("n").withColumn("depth", F.lit(depth))


def boundary_faces(leaves: DataFrame, neighbours: DataFrame, key: str = "leaf", inside: str = "interior") -> DataFrame:
    """(interior, exterior, axis, sign, area) of leaf faces between interior and exterior leaves."""
    side = lambda n: leaves.select(F.col(key).alias(n), F.col(inside).alias(f"{n}_in"))
    pairs = neighbours.join(side("a"), "a").join(side("b"), "b").where("a_in <> b_in")
    return pairs.select(F.when(F.col("a_in"), F.col("a")).otherwise(F.col("b")).alias("interior"), F.when(F.col("a_in"), F.col("b")).otherwise(F.col("a")).alias("exterior"), "axis", F.when(F.col("a_in"), 1).otherwise(-1).alias("sign"), "area")


def corners(leaves: DataFrame, key: str = "leaf") -> DataFrame:
    """(x, y, z, leaves): corners of leaf cubes with the ordered set of leaves that meet there."""
    signs = F.array(*[F.struct(*[F.lit(float(s)).alias(a) for s, a in zip(c, "abc")]) for c in [(x, y, z) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)]])
    out = leaves.withColumn("s", F.explode(signs))
    return out.groupBy(*[F.round(F.col(f"c{a}") + F.col(f"s.{b}") * F.col("hw"), 9).alias(a) for a, b in zip("xyz", "abc")]).agg(F.array_sort(F.collect_set(key)).alias("leaves"))


def majority_flip(leaves: DataFrame, neighbours: DataFrame, threshold: float = 0.75, key: str = "leaf", inside: str = "interior") -> DataFrame:
    """Leaves change sides while more than `threshold` of their face area looks to the other side.

    Interior leaves are judged first in every round, then exterior ones; all leaves of a kind change at once, and rounds end
    when none does: each change leaves less area between the sides, as no two leaves that change at once vote against each other. Thresholds of 0.5 or less, or above 1, change nothing.
    """
    if not 0.5 < threshold <= 1:
        return leaves
    links = stored(neighbours.select("a", "b", "area").union(neighbours.select(F.col("b"), F.col("a"), "area")))
    while True:
        changed = 0
        for kind in (True, False):
            state = leaves.select(F.col(key).alias("b"), F.col(inside).alias("other"))
            vote = links.join(state, "b").groupBy(F.col("a").alias(key)).agg(F.sum(F.when(F.col("other") != F.lit(kind), F.col("area")).otherwise(0.0)).alias("against"), F.sum("area").alias("total"))
            flips = leaves.where(F.col(inside) == F.lit(kind)).join(vote, key).where(F.col("against") > threshold * F.col("total")).select(key, F.lit(True).alias("__flip"))
            leaves = stored(leaves.join(flips, key, "left").withColumn(inside, F.col(inside) != F.coalesce("__flip", F.lit(False))).withColumn("__flip", F.coalesce("__flip", F.lit(False))))
            changed += leaves.where("__flip").count()
            leaves = leaves.drop("__flip")
        if not changed:
            return leaves


def remove_thin_voxels(interior: DataFrame, most_open: int = 3) -> DataFrame:
    """Take out voxels with more than `most_open` open sides, and put in those with more than `most_open` interior neighbours.

    In every round all of the first kind go at once, then all of the second come, until there is neither. With `most_open` of 3
    or more each change leaves fewer faces between inside and outside, so that this ends.
    """
    if most_open < 3:
        raise ValueError("most_open must be 3 or more")
    axes = ["ix", "iy", "iz"]
    interior = stored(interior.select(*axes))
    while True:
        thin = stored(open_sides(interior).where(F.col("open_sides") > most_open).select(*axes))
        some_go = not thin.isEmpty()
        if some_go:
            interior = stored(interior.join(thin, axes, "left_anti"))
        notches = stored(boundary_voxels(interior).where(F.bit_count("state") > most_open).select(*axes))
        if not notches.isEmpty():
            interior = stored(interior.unionByName(notches))
        elif not some_go:
            return interior


def watershed(cells: DataFrame, seeds: DataFrame, value: str = "open_height", by: list[str] | None = None) -> DataFrame:
    """Room label of each cell (i0, i1): the seed reached at least cost over 4-neighbours, leaving a cell costing 1 / value.

    Cells of no height are not left. Groups of `by` (storeys, say) are worked on in parallel, each in one task; without `by`
    the connected components of cells are the groups, as no path leaves one.
    """
    keys = by or ["__group"]
    if not by:
        at = cells.select("i0", "i1", F.xxhash64("i0", "i1").alias("id"))
        near = shifted(at, ["i0", "i1"], [(1, 0), (0, 1)]).withColumnRenamed("id", "other").join(at, ["i0", "i1"])
        comp = connected_components(near.select("id", "other"))
        group = at.join(comp.withColumnRenamed("node", "id"), "id", "left").select("i0", "i1", F.coalesce("component", "id").alias("__group"))
        cells = cells.join(group, ["i0", "i1"])
    rows = cells.join(seeds.select(*(by or []), "i0", "i1", "seed"), [*(by or []), "i0", "i1"], "left").select(*keys, "i0", "i1", F.col(value).alias("v"), "seed")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        height = {(a, b): v for a, b, v in zip(pdf["i0"], pdf["i1"], pdf["v"])}
        heap = [(0.0, int(s), a, b) for a, b, s in zip(pdf["i0"], pdf["i1"], pdf["seed"]) if s == s and s is not None]
        heapq.heapify(heap)
        room: dict[tuple, int] = {}
        while heap:
            cost, seed, a, b = heapq.heappop(heap)
            if (a, b) in room:
                continue
            room[a, b] = seed
            if height[a, b] > 0:
                step = cost + 1 / height[a, b]
                for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if (c, d) in height and (c, d) not in room:
                        heapq.heappush(heap, (step, seed, c, d))
        out = pdf[[*keys, "i0", "i1"]].copy()
        out["room"] = [room.get((a, b), -1) for a, b in zip(out["i0"], out["i1"])]
        return out

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, "i0", "i1"])
    labelled = rows.groupBy(*keys).applyInPandas(run, f"{kinds}, room long")
    return labelled.select(*(by or []), "i0", "i1", "room")


def laplace_smooth(vertices: DataFrame, triangles: DataFrame, own: float = 2.0) -> DataFrame:
    """Average of a vertex (v, x, y, z) of weight `own` and its neighbours, once for each triangle that they share with it."""
    pairs = F.array(*[F.struct(F.col(p).alias("v"), F.col(q).alias("n")) for p, q in (("i", "j"), ("i", "k"), ("j", "i"), ("j", "k"), ("k", "i"), ("k", "j"))])
    near = triangles.select(F.explode(pairs).alias("e")).select("e.v", "e.n")
    around = near.join(vertices.select(F.col("v").alias("n"), *[F.col(a).alias(f"n{a}") for a in "xyz"]), "n")
    sums = around.groupBy("v").agg(F.count("*").alias("m"), *[F.sum(f"n{a}").alias(f"s{a}") for a in "xyz"])
    return vertices.join(sums, "v", "left").select("v", *[((F.col(a) * own + F.coalesce(f"s{a}", F.lit(0.0))) / (own + F.coalesce("m", F.lit(0)))).alias(a) for a in "xyz"])


def cube_masks(voxels: DataFrame) -> DataFrame:
    """8-bit corner mask of each dual cube that has a voxel at a corner; bit x + 2 y + 4 z."""
    axes = ["ix", "iy", "iz"]
    moves = [(-x, -y, -z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
    return shifted(voxels.select(*axes), axes, moves).groupBy(*axes).agg(F.bit_or(F.expr("shiftleft(1, side)")).alias("mask"))


def opposing_triangles(triangles: DataFrame, most: float = -0.9) -> DataFrame:
    """Triangles (t, i, j, k, nx, ny, nz) without those that share an edge with one of nearly opposite normal, and without repeats."""
    edge = F.explode(F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("w")) for p, q in (("i", "j"), ("j", "k"), ("k", "i"))]))
    sides = triangles.select("t", "nx", "ny", "nz", edge.alias("e")).select("t", "nx", "ny", "nz", "e.u", "e.w")
    other = sides.select(*[F.col(c).alias(f"o{c}") for c in ("t", "nx", "ny", "nz")], "u", "w")
    bad = sides.join(other, ["u", "w"]).where((F.col("t") != F.col("ot")) & (F.col("nx") * F.col("onx") + F.col("ny") * F.col("ony") + F.col("nz") * F.col("onz") <= most)).select("t").distinct()
    corner = F.array_sort(F.array("i", "j", "k"))
    first = triangles.groupBy(corner.alias("c")).agg(F.min("t").alias("t")).select("t")
    return triangles.join(first, "t", "left_semi").join(bad, "t", "left_anti")


def offset_search(walls: DataFrame, offsets: list[float], cost: Column, key: str = "wall") -> DataFrame:
    """(key, shift, cost) of the least cost over a list of offsets; the column `shift` may be used in cost."""
    tried = walls.withColumn("shift", F.explode(F.array(*[F.lit(float(o)) for o in offsets]))).withColumn("cost", cost)
    best = tried.groupBy(key).agg(F.min(F.struct("cost", F.abs("shift").alias("size"), "shift")).alias("m"))
    return best.select(key, F.col("m.shift").alias("shift"), F.col("m.cost").alias("cost"))


def missing_children(leaves: DataFrame) -> DataFrame:
    """Empty siblings (depth, ix, iy, iz) that complete each parent which has some children."""
    axes = ["ix", "iy", "iz"]
    parents = leaves.select("depth", *[F.shiftright(a, 1).alias(a) for a in axes]).distinct()
    octants = F.array(*[F.struct(*[F.lit(v).alias(f"o{a}") for a, v in zip("xyz", o)]) for o in [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]])
    full = parents.withColumn("o", F.explode(octants)).select("depth", *[(F.shiftleft(F.col(a), 1) + F.col(f"o.o{a[1]}")).alias(a) for a in axes])
    return full.join(leaves.select("depth", *axes), ["depth", *axes], "left_anti")


def refine_chunks(cells: DataFrame, objects: DataFrame, factor: int) -> DataFrame:
    """The cells (i0, i1, i2) to carve anew, `factor` times finer, where objects lie."""
    axes = ["i0", "i1", "i2"]
    out = cells.join(objects.select(*axes).distinct(), axes, "left_semi")
    for a in axes:
        out = out.withColumn(a, F.explode(F.sequence(F.col(a) * factor, F.col(a) * factor + factor - 1)))
    return out


def straight_corners(loops: DataFrame, error: float = 1e-9) -> DataFrame:
    """Vertices (loop, position, x, y) of closed loops without those on the straight line between their neighbours."""
    w = Window.partitionBy("loop").orderBy("position")
    ends = Window.partitionBy("loop")
    first, last = F.min(F.struct("position", "x", "y")).over(ends), F.max(F.struct("position", "x", "y")).over(ends)
    near = {f"{s}{a}": F.coalesce(f(a).over(w), wrap[a]) for s, f, wrap in (("p", F.lag, last), ("n", F.lead, first)) for a in ("x", "y")}
    turn = (F.col("x") - F.col("px")) * (F.col("ny") - F.col("py")) - (F.col("y") - F.col("py")) * (F.col("nx") - F.col("px"))
    return loops.withColumns(near).where(F.abs(turn) > error).drop("px", "py", "nx", "ny")


def flood_rooms(triangles: DataFrame, borders: DataFrame, seeds: DataFrame, by: str) -> DataFrame:
    """(by, t, room): rooms grow from seed triangles over the longest shared edge first, each triangle taking the first to come.

    triangles: by, t; borders: by, u, v, length; seeds: by, t, room. The order of growth is the definition, so each storey is one task.
    """
    kind = triangles.schema[by].dataType.simpleString()
    none = lambda c, k: F.lit(None).cast(k).alias(c)
    rows = triangles.select(by, F.col("t").cast("long").alias("t"), none("v", "long"), none("length", "double"), none("room", "long"))
    rows = rows.unionByName(borders.select(by, F.col("u").cast("long").alias("t"), F.col("v").cast("long").alias("v"), F.col("length").cast("double").alias("length"), none("room", "long")))
    rows = rows.unionByName(seeds.select(by, F.col("t").cast("long").alias("t"), none("v", "long"), none("length", "double"), F.col("room").cast("long").alias("room")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        link, seed = pdf[pdf["v"].notna()], pdf[pdf["room"].notna()]
        near: dict[int, list] = {}
        for a, b, n in zip(link["t"], link["v"], link["length"]):
            near.setdefault(int(a), []).append((n, int(b)))
            near.setdefault(int(b), []).append((n, int(a)))
        heap = [(-float("inf"), int(r), int(t)) for t, r in zip(seed["t"], seed["room"])]
        heapq.heapify(heap)
        room: dict[int, int] = {}
        while heap:
            _, r, t = heapq.heappop(heap)
            if t not in room:
                room[t] = r
                for n, o in near.get(t, ()):
                    if o not in room:
                        heapq.heappush(heap, (-n, r, o))
        own = sorted(pdf[pdf["v"].isna() & pdf["room"].isna()]["t"].unique())
        return pd.DataFrame({by: pdf[by].iloc[0], "t": own, "room": [room.get(int(t), -1) for t in own]})

    return rows.groupBy(by).applyInPandas(run, f"{by} {kind}, t long, room long")
