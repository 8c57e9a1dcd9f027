from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import xxhash

from scanforge.llm.simhash import VantageTree, close_pairs, near_duplicate_texts, one_of_each
from scanforge.llm.suffix import remove_repeats
from scanforge.llm.windows import minimum_places

DOCS = "doc_id long, text string, fp string, k int, source string"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(n))


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {g: min((v for v in own if v is not None), default=None) for g, own in groups.items()}
    return [least[find(i)] for i in range(len(ids))], list(least.values())


def corpus(rnd):
    out = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "ONE"), (6, "One two"), (7, "one two three")]
    base = [words(rnd, 60) for _ in range(30)]
    for n, t in enumerate(base):
        out.append((100 + n, t))
        w = t.split()
        w[rnd.randrange(60)] = "zzz"
        out.append((200 + n, " ".join(w)))
        out.append((300 + n, t.upper().replace("É", "é") + " "))
    out += [(400, words(rnd, 30000)), (100, base[0]), (101, base[5]), (None, base[3])]
    rnd.shuffle(out)
    return out


def test_simhash_against_brute_force(spark):
    data = corpus(random.Random(4))
    df = spark.createDataFrame([(i, t, "f", 1, "s") for i, t in data], DOCS).repartition(5)
    got = sorted(map(tuple, near_duplicate_texts(df).collect()), key=str)
    prints = [slow_fingerprint(t) for _, t in data]
    comp, groups = brute_components([i for i, _ in data], prints, 2)
    assert got == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(data, prints, comp)), key=str)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(groups, key=str)


def test_split_shards_link_the_same(spark, monkeypatch):
    import scanforge.llm.simhash as H

    rnd = random.Random(5)
    fps = {rnd.getrandbits(62) for _ in range(200)} | {7 ^ (1 << rnd.randrange(60)) ^ (1 << rnd.randrange(60)) for _ in range(60)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole = sorted(map(tuple, H.link_fingerprints(df, 2, leaf_size=64).collect()))
    monkeypatch.setattr(H, "HOME_CHUNK", 10)
    assert sorted(map(tuple, H.link_fingerprints(df, 2, leaf_size=64).collect())) == whole and whole


def test_simhash_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_duplicate_texts(empty).count() == 0 and one_of_each(empty).count() == 0


def test_vantage_shards_find_all_pairs():
    rnd = np.random.default_rng(0)
    fps = np.unique(np.concatenate([rnd.integers(0, 2**63, 3000).astype(np.uint64), np.uint64(12345) ^ (np.uint64(1) << rnd.integers(0, 60, 200).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 60, 200).astype(np.uint64))]))
    tree = VantageTree(fps[::3], 32)
    found, homes = set(), np.zeros(fps.size, int)
    for _, at, home in tree.route(fps, 2):
        homes[at[home]] += 1
        i, j = close_pairs(fps[at[home]], fps[at], 2, 256)
        found |= {tuple(sorted(p)) for p in zip(at[home][i].tolist(), at[j].tolist()) if p[0] != p[1]}
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert found == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b} and (homes == 1).all()


def test_minimum_places():
    h = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64) << np.uint64(40)
    for width in (1, 7, 200, 201):
        want = [p + int(np.argmin(h[p : p + width])) for p in range(len(h) - width + 1)]
        assert minimum_places(h, width).tolist() == want


def brute_cut(data, window):
    seen = {}
    texts = [(t or "").encode() for _, t in data]
    for b in texts:
        for p in range(len(b) - window + 1):
            seen[b[p : p + window]] = seen.get(b[p : p + window], 0) + 1
    out = []
    for (i, _), b in zip(data, texts):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check_cut(spark, data, window, gram, **options):
    df = spark.createDataFrame([(i, t, "f", 1, "s") for i, t in data], DOCS).repartition(4)
    rows = remove_repeats(df, window=window, gram=gram, **options).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows), key=str)
    assert got == brute_cut(data, window)


def repeats(rnd):
    passage, other = words(rnd, 40), words(rnd, 25)
    data = [(None, None), (1, None), (2, ""), (3, "short"), (4, "a" * 500), (5, "ab" * 90), (6, words(rnd, 50) + passage), (7, passage + words(rnd, 10)), (8, passage[:90] + "X" + passage[91:]), (9, other + words(rnd, 30) + other), (10, words(rnd, 3000)), (10, words(rnd, 20)), (11, passage), (11, passage), (None, other)]
    near = words(rnd, 60).split()
    for i in range(30):
        w = list(near)
        w[rnd.randrange(60)] = "q"
        data.append((100 + i, " ".join(w)))
    return data


def test_repeats_against_brute_force(spark):
    data = repeats(random.Random(8))
    check_cut(spark, data, 100, 32)
    # the way of grams with many contexts must give the same
    check_cut(spark, data, 100, 32, wide=2)
    check_cut(spark, data, 40, 16)


def test_long_text_in_parts(spark, monkeypatch):
    import scanforge.llm.windows as W

    rnd = random.Random(9)
    monkeypatch.setattr(W, "SEGMENT", 4096)
    texts = [words(rnd, 4000).encode()]
    texts.append(words(rnd, 100).encode() + texts[0][9000:9400] + words(rnd, 1500).encode())
    rows = []
    for part in W.pieces(texts, 100):
        assert part[0].size <= 4096
        g, c, d, lo, hi, mid = W.anchors(*part, 100, 32)
        rows += list(zip(d.tolist(), lo.tolist(), hi.tolist(), mid.tolist(), g.tolist()))
    for d, t in enumerate(texts):
        starts = sorted(s for dd, lo, hi, *_ in rows if dd == d for s in range(lo, hi + 1))
        assert starts == list(range(len(t) - 99))
    shared = {g for d, *_, g in rows if d == 0} & {g for d, *_, g in rows if d == 1}
    assert shared


def test_carried_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "é" * 60, "f", 1, "s"), (2, "xé" + "é" * 60, "g", 2, None)], DOCS)
    got = {r["doc_id"]: (r["rest"]["fp"], r["rest"]["source"], r["text"]) for r in remove_repeats(df, 50, 16, carry=["doc_id", "fp", "source"]).collect()}
    assert got[1] == ("f", "s", "") and got[2][:2] == ("g", None) and got[2][2] == "x"
    assert remove_repeats(df.limit(0)).count() == 0
