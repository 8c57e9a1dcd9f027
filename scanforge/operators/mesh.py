"""Surfaces: marching cubes by rule, ray hits, polygons, triangulation and region growing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes as G
from .joins import box_cells, met_first, segment_cells
from .volume import cube_masks


def cube_triangles(mask: int) -> list[tuple[tuple[float, float, float], ...]]:
    """Triangles, with corners at middles of cube edges, between the set and the clear corners of a cube.

    Corner x + 2 y + 4 z is set by its bit. On each face, every run of set corners is cut off by one segment from where the
    walk round the face leaves it to where it enters it, so that set corners never join across a face; the faces on both
    sides of a plane agree on that. Segments chain into loops, which are cut into fans. Normals point to clear corners.
    """
    bit = lambda c: mask >> (c[0] + 2 * c[1] + 4 * c[2]) & 1
    nxt = {}
    for axis in range(3):
        for side in (0, 1):
            u, v = (axis + 1) % 3, (axis + 2) % 3
            ring = []
            for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)):
                c = [0, 0, 0]
                c[axis], c[u], c[v] = side, a, b
                ring.append(tuple(c))
            if not side:
                ring.reverse()  # anticlockwise as seen from outside
            for k in range(4):
                if bit(ring[k]) and not bit(ring[(k + 1) % 4]):
                    j = k
                    while bit(ring[(j - 1) % 4]):
                        j -= 1
                    nxt[frozenset((ring[k], ring[(k + 1) % 4]))] = frozenset((ring[j % 4], ring[(j - 1) % 4]))
    middle = lambda e: tuple(sum(c[i] for c in e) / 2 for i in range(3))
    out = []
    while nxt:
        start = min(nxt, key=sorted)
        loop = [start]
        while (n := nxt.pop(loop[-1])) != start:
            loop.append(n)
        points = [middle(e) for e in loop]
        out += [(points[0], points[k + 1], points[k]) for k in range(1, len(points) - 1)]
    return out


def marching_cubes(voxels: DataFrame) -> DataFrame:
    """Triangles (ix, iy, iz, t, and corners ax .. cz in units of voxels) around a set of voxels, which lie at cube corners."""
    point = "struct<x: double, y: double, z: double>"
    rows = [(m, [tuple(tuple(map(float, p)) for p in t) for t in cube_triangles(m)]) for m in range(256)]
    lookup = voxels.sparkSession.createDataFrame(rows, f"mask int, triangles array<struct<a: {point}, b: {point}, c: {point}>>")
    cubes = cube_masks(voxels).join(F.broadcast(lookup), "mask")  # always 256 rows
    cubes = cubes.select("ix", "iy", "iz", F.posexplode("triangles").alias("t", "v"))
    return cubes.select("ix", "iy", "iz", "t", *[(F.col(f"i{a}") + F.col(f"v.{c}.{a}")).alias(f"{c}{a}") for c in "abc" for a in "xyz"])


def ray_hits(rays: DataFrame, triangles: DataFrame, width: float, ray_key: list[str]) -> DataFrame:
    """For each ray, a segment from (ox, oy, oz) to (ex, ey, ez), the first triangle (t, ax .. cz) that it hits: t, distance.

    Rays and triangles meet in grid cells, once each; of hits at one distance the smaller triangle number counts. Rays without a hit
    are left out. Rays, and triangles, of the same numbers are tested as one.
    """
    low, high, ends = ["lox", "loy", "loz"], ["hix", "hiy", "hiz"], [f"{c}{a}" for c in "oe" for a in "xyz"]
    one = triangles.groupBy(*[f"{c}{a}" for c in "abc" for a in "xyz"]).agg(F.min("t").alias("t"))
    box = one.select("*", *[f(*[F.col(f"{c}{a}") for c in "abc"]).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.least), ("hi", F.greatest))])
    cells = segment_cells(rays.select(*ends).distinct(), ["ox", "oy", "oz"], ["ex", "ey", "ez"], width, "p")
    met = cells.join(box_cells(box, low, high, width), ["i0", "i1", "i2"]).where(met_first("p", low, high, width))
    # step by step, so that no number is worked out twice; a filter would take all of them into the join, so that an explode picks the hits
    named = lambda n, v: {f"__{n}{k}": c for k, c in enumerate(v)}
    of = lambda n: G.vec(*(f"__{n}{k}" for k in range(3)))
    a, b, c, o, e = (G.vec(*(f"{n}{x}" for x in "xyz")) for n in "abcoe")
    met = met.select(*ends, "t", *[v.alias(n) for k, w in (("d", G.sub(e, o)), ("u", G.sub(b, a)), ("v", G.sub(c, a)), ("s", G.sub(o, a))) for n, v in named(k, w).items()])
    met = met.withColumns(named("h", G.cross(of("d"), of("v"))) | named("q", G.cross(of("s"), of("u"))))
    met = met.withColumn("__det", G.dot(of("u"), of("h")))
    met = met.withColumns(named("f", [F.try_divide(G.dot(of(m), of(n)), F.col("__det")) for m, n in ("sh", "dq", "vq")]))
    at = F.when((F.col("__f0") >= 0) & (F.col("__f1") >= 0) & (F.col("__f0") + F.col("__f1") <= 1) & (F.col("__f2") > 0) & (F.col("__f2") <= 1), F.col("__f2") * G.norm(of("d")))
    hit = met.select(*ends, "t", F.explode(F.filter(F.array(at), lambda v: v.isNotNull())).alias("__d"))
    first = hit.groupBy(*ends).agg(F.min(F.struct("__d", "t")).alias("m"))
    best = rays.join(first, ends).groupBy(*ray_key).agg(F.min("m").alias("m"))
    return best.select(*ray_key, F.col("m.t").alias("t"), F.col("m.__d").alias("distance"))


def _ring(value) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in value], float).reshape(-1, 2)


def simplify_ring(points: np.ndarray, error: float) -> np.ndarray:
    """Douglas-Peucker on an open line: points further than error from the chord of their neighbours stay."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        off = points[a + 1 : b] - points[a]
        n = float(d @ d)
        t = np.clip(off @ d / n, 0, 1) if n else np.zeros(len(off))
        far = np.hypot(*(off - t[:, None] * d).T)
        k = int(np.argmax(far))
        if far[k] > error:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def simplify_polygon(polygon: Column, error: float) -> Column:
    """An array of struct<x, y> without the points that lie within error of the rest."""

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def run(rings: pd.Series) -> pd.Series:
        def one(r):
            if r is None or len(r) < 3:
                return None if r is None else list(r)
            p = _ring(r)
            return [{"x": x, "y": y} for x, y in simplify_ring(np.vstack([p, p[:1]]), error)[:-1]]

        return rings.map(one)

    return run(polygon)


def clip_ring(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """The part of a ring within a convex anticlockwise ring, side by side."""
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, axis=0)):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        new = []
        for k in range(len(out)):
            s, t, p, q = side[k], side[(k + 1) % len(out)], out[k], out[(k + 1) % len(out)]
            if s >= 0:
                new.append(p)
            if s * t < 0:
                new.append(p + (q - p) * (s / (s - t)))
        out = np.array(new).reshape(-1, 2)
    return out


def clip_polygon(subject: Column, convex: Column) -> Column:
    """Part of a polygon within a convex anticlockwise one; empty if they don't overlap."""

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or c is None else [{"x": x, "y": y} for x, y in clip_ring(_ring(s), _ring(c))] for s, c in zip(a, b)], dtype=object)

    return run(subject, convex)


def delaunay(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Anticlockwise triangles of distinct points, inserted one by one into a triangle around them all."""
    n = len(points)
    if n < 3:
        return []
    mid, size = points.mean(0), 20 * max(np.ptp(points, axis=0).max(), 1e-9)
    p = np.vstack([points, mid + size * np.array([[-1.7, -1], [1.7, -1], [0, 2]])])
    tris = {(n, n + 1, n + 2)}

    def inside(t, q):
        m = p[list(t)] - q
        return np.linalg.det(np.c_[m, (m * m).sum(1)]) > 1e-12

    for i in range(n):
        bad = [t for t in tris if inside(t, p[i])]
        edges = {(t[k], t[(k + 1) % 3]) for t in bad for k in range(3)}
        tris -= set(bad)
        tris |= {(a, b, i) for a, b in edges if (b, a) not in edges}
    return sorted(tuple(t[(k + j) % 3] for j in range(3)) for t in tris if max(t) < n for k in [t.index(min(t))])


def triangulate(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Delaunay triangles (by, i, j, k) of the points (key, x, y) of each group, such as the cells of a storey; one task a group."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).drop_duplicates(["x", "y"])
        ids = pdf[key].to_numpy()
        got = [tuple(ids[v] for v in t) for t in delaunay(pdf[["x", "y"]].to_numpy(float))]
        out = pd.DataFrame(got, columns=["i", "j", "k"])
        for c in reversed(by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return df.select(*by, key, "x", "y").groupBy(*by).applyInPandas(run, f"{kinds}, i {kind}, j {kind}, k {kind}")


def merge_regions(size: dict, mean: dict, links: set, most: float) -> dict:
    """Region of each node after merging the pair of neighbouring regions of nearest means, over and over, while they differ by at most `most`."""
    region = {n: n for n in size}
    near: dict = {n: set() for n in size}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    heap = [(abs(mean[a] - mean[b]), min(a, b), max(a, b), 0, 0) for a, b in links]
    heapq.heapify(heap)
    stamp = dict.fromkeys(size, 0)
    while heap:
        d, a, b, sa, sb = heapq.heappop(heap)
        if d > most:
            break
        if a not in near or b not in near or (stamp[a], stamp[b]) != (sa, sb):
            continue  # one of them has changed since
        total = size[a] + size[b]
        mean[a] = (mean[a] * size[a] + mean[b] * size[b]) / total
        size[a] = total
        stamp[a] += 1
        region[b] = a
        for c in near.pop(b):
            near[c].discard(b)
            if c != a:
                near[c].add(a)
                near[a].add(c)
        for c in near[a]:
            heapq.heappush(heap, (abs(mean[a] - mean[c]), min(a, c), max(a, c), stamp[min(a, c)], stamp[max(a, c)]))

    def top(n):
        while region[n] != n:
            n = region[n]
        return n

    return {n: top(n) for n in region}


def coalesce_regions(nodes: DataFrame, edges: DataFrame, by: str, most: float) -> DataFrame:
    """(by, node, region): best-first merging within each group, for example a connected component, in one task each.

    nodes: by, node, size, value; edges: by, u, v. The order of merging matters, so a group can't be split.
    """
    rows = nodes.select(by, F.col("node"), F.col("size").cast("double").alias("size"), F.col("value").cast("double").alias("value"), F.lit(None).cast("long").alias("v")).unionByName(edges.select(by, F.col("u").alias("node"), F.lit(None).cast("double").alias("size"), F.lit(None).cast("double").alias("value"), "v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, link = pdf[pdf["v"].isna()], pdf[pdf["v"].notna()]
        got = merge_regions(dict(zip(own["node"], own["size"])), dict(zip(own["node"], own["value"])), {(a, int(b)) for a, b in zip(link["node"], link["v"]) if a != b}, most)
        return pd.DataFrame({by: pdf[by].iloc[0], "node": list(got), "region": list(got.values())})

    return rows.groupBy(by).applyInPandas(run, f"{by} {nodes.schema[by].dataType.simpleString()}, node long, region long")


def keep_spaced(df: DataFrame, by: list[str], order: list[str], axes: list[str], least: float) -> DataFrame:
    """Rows of each group, in order, that lie at least `least` from all kept before: first come, first served."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        kept, rows = [], []
        for i, p in enumerate(pdf[axes].to_numpy(float)):
            if all(((p - q) ** 2).sum() >= least * least for q in kept):
                kept.append(p)
                rows.append(i)
        return pdf.iloc[rows]

    return df.groupBy(*by).applyInPandas(run, df.schema)


def drop_small_rooms(rooms: DataFrame, borders: DataFrame, by: str, most: float) -> DataFrame:
    """Rooms (by, room, area) that stay when, from the smallest up, each one with a border over `most` to a room that still stays is taken out."""
    rows = rooms.select(by, "room", "area", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("length")).unionByName(borders.select(by, F.col("room_a").alias("room"), F.lit(None).cast(rooms.schema["area"].dataType).alias("area"), F.col("room_b").alias("other"), F.col("length").cast("double").alias("length")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, link = pdf[pdf["other"].isna()].sort_values(["area", "room"]), pdf[pdf["other"].notna()]
        near: dict = {}
        for a, b, n in zip(link["room"], link["other"], link["length"]):
            near.setdefault(a, []).append((int(b), n))
            near.setdefault(int(b), []).append((a, n))
        stays = set(own["room"])
        for r in own["room"]:
            if any(o in stays and n > most for o, n in near.get(r, ())):
                stays.discard(r)
        return own[own["room"].isin(stays)][[by, "room", "area"]]

    return rows.groupBy(by).applyInPandas(run, f"{by} {rooms.schema[by].dataType.simpleString()}, room {rooms.schema['room'].dataType.simpleString()}, area {rooms.schema['area'].dataType.simpleString()}")


def fill_ring(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a simple polygon that runs anticlockwise, by cutting ears: of all ears that with the shortest diagonal, then the first.

    Where repeated or straight points leave no proper ear, the corner that turns most to the left is cut, so that n points always
    give n - 2 triangles.
    """
    left, out = list(range(len(points))), []

    def turn(a, b, c):
        return (points[b][0] - points[a][0]) * (points[c][1] - points[a][1]) - (points[b][1] - points[a][1]) * (points[c][0] - points[a][0])

    while len(left) >= 3:
        best = None
        for n in range(len(left)):
            a, b, c = left[n - 1], left[n], left[(n + 1) % len(left)]
            area = turn(a, b, c)
            ear = area > 0 and not any(min(turn(a, b, v), turn(b, c, v), turn(c, a, v)) >= 0 for v in left if v not in (a, b, c))
            diagonal = float(((points[a] - points[c]) ** 2).sum())
            key = (0, diagonal, n) if ear else (1, -area, n)
            if best is None or key < best[0]:
                best = (key, n, (a, b, c))
        out.append(best[2])
        left.pop(best[1])
    return out


def fill_loops(df: DataFrame, loop: str, order: str, key: str) -> DataFrame:
    """(loop, i, j, k): triangles that fill each loop of points (key, x, y), which run anticlockwise in their order. A loop is one task."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        ids = pdf[key].to_numpy()
        got = [tuple(ids[v] for v in t) for t in fill_ring(pdf[["x", "y"]].to_numpy(float))]
        out = pd.DataFrame(got, columns=["i", "j", "k"])
        out.insert(0, loop, pdf[loop].iloc[0])
        return out

    return df.select(loop, order, *([key] if key != order else []), "x", "y").groupBy(loop).applyInPandas(run, f"{loop} {df.schema[loop].dataType.simpleString()}, i {kind}, j {kind}, k {kind}")


def largest_circles(triangles: DataFrame, neighbours: DataFrame, by: str, least: float) -> DataFrame:
    """(by, t): triangles of radius `least` or more whose circumcircle no larger one meets among those that a walk leads to.

    triangles: by, t, x, y, r, the circle; neighbours: by, u, v. The walk goes from triangle to neighbour over circles that meet the
    first one. Each triangle is judged by itself, so that their order does not matter; a storey is one task.
    """
    none = lambda c, k: F.lit(None).cast(k).alias(c)
    rows = triangles.select(by, F.col("t").cast("long").alias("t"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "r")], none("v", "long"))
    rows = rows.unionByName(neighbours.select(by, F.col("u").cast("long").alias("t"), none("x", "double"), none("y", "double"), none("r", "double"), F.col("v").cast("long").alias("v")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, link = pdf[pdf["v"].isna()], pdf[pdf["v"].notna()]
        circle = {int(t): (x, y, r) for t, x, y, r in zip(own["t"], own["x"], own["y"], own["r"])}
        near: dict[int, list[int]] = {}
        for a, b in zip(link["t"], link["v"]):
            near.setdefault(int(a), []).append(int(b))
            near.setdefault(int(b), []).append(int(a))
        top = []
        for t, (x, y, r) in circle.items():
            if not r >= least:
                continue
            seen, todo, beaten = {t}, [t], False
            while todo and not beaten:
                for n in near.get(todo.pop(), ()):
                    if n not in seen and n in circle:
                        seen.add(n)
                        nx, ny, nr = circle[n]
                        if (nx - x) ** 2 + (ny - y) ** 2 <= (r + nr) ** 2:
                            beaten = beaten or nr > r
                            todo.append(n)
            if not beaten:
                top.append(t)
        return pd.DataFrame({by: pdf[by].iloc[0], "t": pd.Series(sorted(top), dtype="int64")})

    return rows.groupBy(by).applyInPandas(run, f"{by} {triangles.schema[by].dataType.simpleString()}, t long")
