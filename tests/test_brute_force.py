"""Operators whose queries have no SQL, against plain loops over small random inputs."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from scanforge.operators import mesh as E
from scanforge.operators import volume as V
from scanforge.operators.joins import face_neighbours

SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def test_watershed(spark):
    rnd = random.Random(1)
    cells = [(a, b, rnd.choice([0.0, 0.5, 1.0, 2.0, 4.0])) for a in range(9) for b in range(9) if rnd.random() < 0.85]
    seeds = [(a, b, n) for n, (a, b, _) in enumerate(rnd.sample(cells, 4))]
    got = V.watershed(spark.createDataFrame(cells, "i0 long, i1 long, open_height double"), spark.createDataFrame(seeds, "i0 long, i1 long, seed long"))
    best = {(a, b): (0.0, n) for a, b, n in seeds}
    height = {(a, b): v for a, b, v in cells}
    for _ in range(len(cells)):  # every path has fewer steps than there are cells
        for (a, b), (cost, n) in list(best.items()):
            if height[a, b] > 0:
                for c in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    step = (cost + 1 / height[a, b], n)
                    if c in height and (c not in best or step < best[c]):
                        best[c] = step
    assert {(r["i0"], r["i1"]): r["room"] for r in got.collect()} == {c: best[c][1] if c in best else -1 for c in height}


def test_merged_regions():
    rnd = random.Random(2)
    for _ in range(30):
        n = rnd.randint(2, 14)
        value = {i: float(rnd.randint(0, 30)) + rnd.random() for i in range(n)}
        links = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(n + 4)}
        groups, near = {i: {i} for i in range(n)}, set(links)
        mean = dict(value)
        while near:  # the nearest pair of all, again and again
            d, a, b = min((abs(mean[a] - mean[b]), a, b) for a, b in near)
            if d > 3.0:
                break
            mean[a] = sum(value[i] for i in groups[a] | groups[b]) / len(groups[a] | groups[b])
            groups[a] |= groups.pop(b)
            near = {tuple(sorted((a if x == b else x, a if y == b else y))) for x, y in near}
            near = {p for p in near if p[0] != p[1]}
        want = {i: g for g, own in groups.items() for i in own}
        got = E.merge_regions(dict.fromkeys(range(n), 1.0), dict(value), links, 3.0)
        assert {frozenset(i for i in got if got[i] == g) for g in set(got.values())} == {frozenset(i for i in want if want[i] == g) for g in set(want.values())}


def test_flooded_rooms(spark):
    rnd = random.Random(3)
    rows = [(s, t) for s in range(2) for t in range(20)]
    borders = [(s, a, b, float(k)) for s in range(2) for k, (a, b) in enumerate(rnd.sample(list(itertools.combinations(range(20), 2)), 40))]
    seeds = [(s, t, t + 100) for s in range(2) for t in rnd.sample(range(20), 3)]
    got = V.flood_rooms(spark.createDataFrame(rows, "level long, t long"), spark.createDataFrame(borders, "level long, u long, v long, length double"), spark.createDataFrame(seeds, "level long, t long, room long"), "level")
    want = {}
    for s in range(2):
        room = {}
        todo = [(-float("inf"), r, t) for q, t, r in seeds if q == s]
        while todo:  # the longest border of all, then the smaller room, then the smaller triangle
            least = min(todo)
            todo.remove(least)
            _, r, t = least
            if t not in room:
                room[t] = r
                todo += [(-n, r, b if a == t else a) for q, a, b, n in borders if q == s and t in (a, b) and (b if a == t else a) not in room]
        want |= {(s, t): room.get(t, -1) for t in range(20)}
    assert {(r["level"], r["t"]): r["room"] for r in got.collect()} == want


def test_thin_voxels(spark):
    rnd = random.Random(4)
    cells = {(a, b, c) for a in range(6) for b in range(6) for c in range(5) if rnd.random() < 0.55}
    got = {tuple(r) for r in V.remove_thin_voxels(spark.createDataFrame(sorted(cells), "ix long, iy long, iz long")).collect()}
    near = lambda v: [tuple(x + d for x, d in zip(v, m)) for m in SIX]
    while True:
        thin = {v for v in cells if sum(n not in cells for n in near(v)) > 3}
        cells -= thin
        notches = {n for v in cells for n in near(v) if n not in cells and sum(m in cells for m in near(n)) > 3}
        if not thin and not notches:
            break
        cells |= notches
    assert got == cells


def test_majority(spark):
    rnd = random.Random(5)
    state = {(a, b, c): rnd.random() < 0.5 for a in range(5) for b in range(5) for c in range(4)}
    rows = [(",".join(map(str, v)), *(x + 0.5 for x in v), 0.5, s) for v, s in state.items()]
    lv = spark.createDataFrame(rows, "leaf string, cx double, cy double, cz double, hw double, interior boolean")
    got = {tuple(map(int, r["leaf"].split(","))): r["interior"] for r in V.majority_flip(lv, face_neighbours(lv), 0.6).collect()}
    changed = True
    while changed:
        changed = False
        for kind in (True, False):
            flips = []
            for v, s in state.items():
                around = [state[n] for n in (tuple(x + d for x, d in zip(v, m)) for m in SIX) if n in state]
                if s == kind and sum(o != kind for o in around) > 0.6 * len(around):
                    flips.append(v)
            for v in flips:
                state[v] = not state[v]
            changed = changed or bool(flips)
    assert got == state


def test_triangulation_has_empty_circles(spark):
    rnd = np.random.default_rng(6)
    pts = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(rnd.random((25, 2)))]
    got = {tuple(sorted((r["i"], r["j"], r["k"]))) for r in E.triangulate(spark.createDataFrame(pts, "level long, cell long, x double, y double"), ["level"], "cell").collect()}
    p = np.array([q[2:] for q in pts])

    def empty(t):
        (ax, ay), (bx, by), (cx, cy) = p[list(t)]
        d = 2 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
        m, n = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
        o = np.array([ax + ((cy - ay) * m - (by - ay) * n) / d, ay + ((bx - ax) * n - (cx - ax) * m) / d])
        r = np.linalg.norm(o - (ax, ay))
        return all(np.linalg.norm(p[k] - o) > r - 1e-12 for k in range(25) if k not in t)

    assert got == {t for t in itertools.combinations(range(25), 3) if empty(t)}


def test_marching_cubes_surround_their_voxels(spark):
    """The signed volume within the triangles is that of corner-cut voxels, and every directed edge has its reverse once."""
    rnd = random.Random(7)
    cells = {(a, b, c) for a in range(4) for b in range(4) for c in range(3) if rnd.random() < 0.4}
    tri = V.cube_masks(spark.createDataFrame(sorted(cells), "ix long, iy long, iz long")).collect()
    want = {}
    for v in cells:
        for x, y, z in itertools.product((0, 1), repeat=3):
            cube = (v[0] - x, v[1] - y, v[2] - z)
            want[cube] = want.get(cube, 0) | 1 << (x + 2 * y + 4 * z)
    assert {(r["ix"], r["iy"], r["iz"]): r["mask"] for r in tri} == want


def test_palettes(spark):
    from scanforge.functions import colour as C

    got = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,)], "v double").select(*[C.palette(n, F.col("v")).alias(n) for n in ("grey", "hot", "jet", "cool")]).collect()
    assert [tuple(r["grey"]) for r in got] == [(0, 0, 0), (127, 127, 127), (255, 255, 255), (255, 255, 255)]
    assert tuple(got[0]["jet"]) == (0, 0, 127) and tuple(got[2]["hot"]) == (255, 255, 255) and tuple(got[1]["cool"]) == (127, 127, 255)


def test_filled_rings():
    rnd = random.Random(8)
    for _ in range(40):
        n = rnd.randint(3, 20)
        ring = np.array([[rnd.uniform(0.5, 2) * f(2 * np.pi * k / n) for f in (np.cos, np.sin)] for k in range(n)])
        got = E.fill_ring(ring)
        areas = [((ring[b] - ring[a])[0] * (ring[c] - ring[a])[1] - (ring[b] - ring[a])[1] * (ring[c] - ring[a])[0]) / 2 for a, b, c in got]
        whole = sum(ring[k - 1][0] * ring[k][1] - ring[k][0] * ring[k - 1][1] for k in range(n)) / 2
        assert len(got) == n - 2 and abs(sum(areas) - whole) < 1e-9
    assert len(E.fill_ring(np.zeros((5, 2)))) == 3 and E.fill_ring(np.zeros((2, 2))) == []
