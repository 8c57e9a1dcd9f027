from __future__ import annotations

import random

import numpy as np
import pytest

from scanforge.llm.rabitq import candidates, encode, near_duplicate_vectors
from scanforge.llm.topk import search_block, segment_profile, top_k_inner_product

SCHEMA = "vec_id long, embedding array<float>, label int, score string"
NAN = float("nan")
ODD = [(901, None, 1, "x"), (902, [], 1, "x"), (903, [0.0, 0.0, 0.0, 0.0], 1, "x"), (904, [NAN, 1.0, 0.0, 0.0], 1, "x"), (905, [None, 1.0, 0.0, 0.0], 1, "x"), (906, [float("inf"), 1.0, 0.0, 0.0], 1, "x"), (907, [1.0, 2.0, 3.0], 1, "x"), (None, [1.0, 0.0, 0.0, 0.0], 1, "x"), (908, [1.0, 0.0, 0.0, 0.0], None, "x")]


def rows(n, dim=4, seed=1):
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((n // 3, dim))
    x = np.concatenate([base, base + 0.05 * rnd.standard_normal(base.shape), rnd.standard_normal((n - 2 * len(base), dim))]).astype(np.float32)
    return [(i, v.tolist(), int(i % 2), "x") for i, v in enumerate(x)]


def brute_top(data, k):
    live = {}
    for i, v, *_ in data:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            live[i] = min(live.get(i, tuple(map(float, v))), tuple(map(float, v)))
    q = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v in live.items()}
    out = []
    for i in q:
        if i % 20 == 0:
            found = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def test_top_k_with_odd_rows(spark):
    data = rows(120) + rows(120)[:30] + ODD
    random.Random(0).shuffle(data)
    df = spark.createDataFrame(data, SCHEMA)
    got = top_k_inner_product(df.where("vec_id % 20 = 0"), df, 5, query_block=3, candidate_block=17)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(data, 5)
    assert top_k_inner_product(df.limit(0), df, 5).count() == 0
    assert top_k_inner_product(df.where("vec_id = 20"), df.limit(0), 5).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0], 0, "x") for i in range(50)], SCHEMA)
    got = top_k_inner_product(df.where("vec_id = 20"), df, 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2]


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_pruning_keeps_the_exact_result(spread):
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-60, 60, (40, 64))
    c = (centres[rnd.integers(0, 40, 6000)] + spread * rnd.integers(-9, 9, (6000, 64))).astype(np.int64)
    ids = rnd.permutation(6000)
    got = search_block(ids[:70], c[:70], ids, c, 20)
    score = c[:70] @ c.T
    for n in range(70):
        want = sorted((-int(s), int(j)) for s, j in zip(score[n], ids) if j != ids[n])[:20]
        own = got[0] == ids[n]
        assert sorted(zip((-got[2][own]).tolist(), got[1][own].tolist())) == want
    assert len(search_block(ids[:0], c[:0], ids, c, 5)[0]) == 0


def test_profiles_bound_the_product():
    rnd = np.random.default_rng(2)
    x, y = rnd.standard_normal((50, 37)), rnd.standard_normal((60, 37))
    for s in (1, 4, 16, 37):
        assert (segment_profile(x, s) @ segment_profile(y, s).T >= x @ y.T - 1e-9).all()


def test_codes_estimate_without_bias_and_bounds_lose_nothing():
    rnd = np.random.default_rng(3)
    o = rnd.standard_normal((400, 64))
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    q = o + 0.04 * rnd.standard_normal(o.shape)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    codes, factors = encode(o)
    i, j = candidates(codes, factors, q, 64, 0.93, None)
    assert {(a, b) for a, b in zip(*np.nonzero(q @ o.T >= 0.93))} <= set(zip(i.tolist(), j.tolist()))
    assert len(i) < 0.05 * 400 * 400


def brute_links(data, threshold):
    """Over the places of rows, as ids may repeat."""
    live = {k: np.array(v, float) for k, (i, v, label, _) in enumerate(data) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = {k: {m for m in live if m != k and data[k][2] == data[m][2] and len(live[k]) == len(live[m]) and live[k] @ live[m] / np.linalg.norm(live[k]) / np.linalg.norm(live[m]) >= threshold} for k in live}
    out = []
    for k, (i, *_) in enumerate(data):
        seen, todo = {k}, [k]
        while todo:
            for m in near.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        least = None if i is None else min(data[m][0] for m in seen)
        out.append((i, len(near.get(k, ())), least, i is not None and least == i))
    return sorted(out, key=str)


def test_near_duplicates_with_odd_rows(spark):
    data = rows(150, 6) + [(500 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1, "x") for i in range(40)] + ODD + rows(150, 6)[:20]
    got = near_duplicate_vectors(spark.createDataFrame(data, SCHEMA), 0.93, block=16).collect()
    assert sorted(map(tuple, got), key=str) == brute_links(data, 0.93)


def test_no_vectors(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_queries(spark):
    from compare import same
    from conftest import SMALL

    from scanforge.llm.queries import ORACLES, QUERIES

    for name in ("op1_topk_search", "op2_embedding_near_dedup"):
        same(spark, name, QUERIES, ORACLES, SMALL)
