from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n):
    return ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(3, 9))) for _ in range(n)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(data):
    """Ids that stay: the smallest of each group linked by Jaccard >= 0.8; and the number of links."""
    sets, root, links = [shingles(t) for _, t in data], list(range(len(data))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                links += 1
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(data):
        groups.setdefault(find(i), []).append(k)
    return [min((k for k in g if k is not None), default=None) for g in groups.values()], links


def corpus(rnd):
    out = [(None, "one two three four five six"), (1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "ONE"), (6, "One two")]
    line, passage = " ".join(words(rnd, 12)), words(rnd, 60)
    for n in range(40):
        t = words(rnd, rnd.choice([30, 110, 220]))
        out.append((100 + n, line + " " + " ".join(t)))
        # near copies on both sides of the border
        for m in range(6):
            w = list(t)
            for _ in range(rnd.randint(1, 6)):
                w[rnd.randrange(len(w))] = words(rnd, 1)[0]
            out.append((1000 + 10 * n + m, line + " " + " ".join(w)))
        out.append((3000 + n, " ".join(words(rnd, 40) + passage)))
    # a group too large to share a shingle with few, and a chain whose ends are not alike
    t = words(rnd, 100)
    for n in range(60):
        w = list(t)
        w[rnd.randrange(100)] = words(rnd, 1)[0]
        out.append((5000 + n, " ".join(w)))
    for n in range(10):
        t[10 * n] = words(rnd, 1)[0]
        out.append((6000 + n, " ".join(t)))
    out += [(7000, out[10][1].upper().replace("É", "é")), (100, out[10][1]), (None, out[30][1])]
    rnd.shuffle(out)
    return out


def test_stage_against_brute_force(spark, tmp_path):
    data = corpus(random.Random(8))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], DOCS).repartition(5)
    want, links = brute(data)
    got = corpus_pipeline.near_duplicates(spark, df, str(tmp_path))
    assert got.columns == df.columns and links > 1000
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted(want, key=str)


def test_stage_asks_the_tree_of_fingerprints(spark, tmp_path, monkeypatch):
    """Links come from fingerprints and an exact check, where the ball holds them, and all of them with any radius."""
    from scanforge.llm import shingles as S

    data = corpus(random.Random(9))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], DOCS).repartition(5)
    real, seen = S.near_fingerprints, []

    def kept(fps, widest, work):
        out = real(fps, widest, work).persist()
        seen.append((fps.count(), out.count()))
        return out

    monkeypatch.setattr(S, "near_fingerprints", kept)
    want, _ = brute(data)
    for widest in (12, 2):
        monkeypatch.setattr(S, "WIDEST", widest)
        got = corpus_pipeline.near_duplicates(spark, df, str(tmp_path))
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted(want, key=str)
    (fps, wide), (_, narrow) = seen
    assert 200 < wide <= fps and narrow < wide


def test_nearest_fingerprints_in_parts_of_shards(spark, monkeypatch):
    import numpy as np
    from scanforge.llm import simhash as H

    rnd = random.Random(4)
    fps = [rnd.getrandbits(64) for _ in range(300)]
    fps += [f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in fps[:150] for _ in range(3)]
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(v,) for v in fps.view(np.int64).tolist()], "fp long")
    d = H.hamming(fps[:, None], fps[None, :]).astype(int)
    np.fill_diagonal(d, 99)
    for size, chunk in ((1 << 14, 1 << 20), (64, 1 << 20), (64, 40)):
        monkeypatch.setattr(H, "HOME_CHUNK", size)
        got = H.near_fingerprints(df, 9, 1 << 18, leaf_size=64, visit_chunk=chunk).distinct().collect()
        at = {v: k for k, v in enumerate(fps.view(np.int64).tolist())}
        pairs = [(at[r["a"]], at[r["b"]]) for r in got]
        assert all(d[a, b] <= 9 for a, b in pairs)
        best = {}
        for a, b in pairs:
            best[a] = min(best.get(a, 99), d[a, b])
        assert best == {a: m for a, m in enumerate(d.min(1)) if m <= 9}
    assert H.affordable_radius(H.VantageTree(fps, 8), fps, fps.size, 12, fps.size) == 12
    assert H.affordable_radius(H.VantageTree(fps, 8), fps, fps.size, 12, 1) == H.RADIUS


def test_visits_grow_with_fingerprints_alone(spark, monkeypatch):
    """Eight times the fingerprints are in no more shards each, while nearest ones are still found."""
    import numpy as np
    from scanforge.llm import simhash as H

    real, rows = H._meetings, []
    monkeypatch.setattr(H, "_meetings", lambda *a, **k: rows.append((out := real(*a, **k).persist()).count()) or out)
    rnd = np.random.default_rng(5)
    for n in (512, 4096):
        half = rnd.integers(0, 1 << 64, n // 2, np.uint64)
        fps = np.unique(np.concatenate([half, half ^ np.uint64(3) ^ (np.uint64(1) << rnd.integers(2, 64, n // 2, np.uint64))]))
        df = spark.createDataFrame([(v,) for v in fps.view(np.int64).tolist()], "fp long")
        got = H.near_fingerprints(df, 12, 256, leaf_size=64).collect()
        a, b = (np.array([r[c] for r in got], np.int64).view(np.uint64) for c in ("a", "b"))
        assert fps.size == n <= rows[-1] <= 4 * n
        assert np.unique(a[H.hamming(a, b) == 3]).size >= 0.7 * n


def test_likeliest_shards():
    import numpy as np
    from scanforge.llm import simhash as H

    fps = np.random.default_rng(6).integers(0, 1 << 64, 3000, np.uint64)
    tree = H.VantageTree(fps, 32)
    every = {(a, leaf): h for leaf, at, home in tree.route(fps, 9) for a, h in zip(at.tolist(), home.tolist())}
    leaf, at, home = tree.route_few(fps, 9, tree.leaves)
    assert {(a, k): h for a, k, h in zip(at.tolist(), leaf.tolist(), home.tolist())} == every

    def ways(node, cost, fp):
        if node < 0:
            return [(cost, -node - 1)]
        over = int(H.hamming(fp, np.uint64(tree.vantage[node]))) - tree.radius[node]
        sides = [(tree.inner[node], max(over, 0)), (tree.outer[node], max(1 - over, 0))]
        return [w for child, bits in sides if bits <= 9 for w in ways(child, cost + bits**2, fp)]

    leaf, at, home = tree.route_few(fps, 9, 3)
    assert at.size < len(every) and np.bincount(at).max() == 3 and home.sum() == fps.size
    for k in range(0, fps.size, 50):
        cost = dict((b, a) for a, b in ways(tree.root, 0, fps[k]))
        assert [cost[x] for x in leaf[at == k].tolist()] == sorted(cost.values())[:3]
        assert home[at == k].tolist() == [True, *[False] * ((at == k).sum() - 1)]


def test_stage_loses_no_link_where_visits_are_few(spark, tmp_path, monkeypatch):
    """One visit a text, to its own shard of about 16: what the tree leaves out is found by prefix filtering."""
    from scanforge.llm import shingles as S

    data = corpus(random.Random(10))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], DOCS).repartition(5)
    real = S.near_fingerprints
    monkeypatch.setattr(S, "near_fingerprints", lambda fps, widest, work: real(fps, widest, 16, leaf_size=16))
    want, _ = brute(data)
    got = corpus_pipeline.near_duplicates(spark, df, str(tmp_path))
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted(want, key=str)


def test_stage_leaves_no_shuffle_files_and_shuffles_texts_once(spark, tmp_path):
    """What finds the groups is freed without the driver's garbage collection; the rows are exchanged for the join alone."""
    import time

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        blocks = disk.getAllBlocks()
        names = (blocks.apply(i).name() for i in range(blocks.size()))
        return {int(n.split("_")[1]) for n in names if n.startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    data = [(i, t) for i, t in corpus(random.Random(12)) if i is None or i < 2000]
    near = data[9][1] + " again"
    data += [(100, near), (100, near), (100, near + " once")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], DOCS).write.parquet(str(tmp_path / "documents"))
    df = spark.read.parquet(str(tmp_path / "documents"))
    probe = spark.range(100).repartition(3)
    probe.collect()
    last = max(shuffles())
    before = spark.conf.get(key)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = corpus_pipeline.near_duplicates(spark, df, str(tmp_path))
        for _ in range(20):  # files are removed in the background
            if not (left := {n for n in shuffles() if n > last}):
                break
            time.sleep(0.25)
        assert not left and spark.conf.get(key) == before
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 2
        want, _ = brute(data)
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted(want, key=str)
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_freed_setting_is_put_back(spark):
    from scanforge.llm.common import shuffles_freed

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), shuffles_freed(spark):
        assert spark.conf.get(key) == "true"
        raise ValueError
    assert spark.conf.get(key) == before
