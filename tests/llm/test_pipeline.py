from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n):
    return " ".join("".join(rnd.choice(["the", "ing", "and", "ed", "sh", "ea", "on", "er", "re"]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def folder(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(11)
    docs, labels = [], []
    for i in range(300):
        w = words(rnd, 70).split()
        if i % 6 == 0:
            for _ in range(5):
                w[rnd.randrange(70)] = rnd.choice(["blockhead", "nincompoop"])
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    passage = words(rnd, 60)
    docs += [(500, words(rnd, 40) + " " + passage, "en", "s", 0), (501, passage + " " + words(rnd, 40), "en", "s", 0)]
    docs += [(600, docs[1][1], "en", "s", 0), (601, docs[1][1].upper(), "en", "s", 0)]
    docs += [(700, "12345 !!", "en", "s", 0), (701, None, None, None, None), (None, words(rnd, 70), "en", None, 0)]
    return [(a, b, c, d, len(b) if b else None) for a, b, c, d, _ in docs], labels, passage


def test_stages(spark, tmp_path, case):
    docs, labels, passage = case
    sf = folder(spark, tmp_path, docs, labels)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
        if name != "packing":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            df.write.parquet(str(tmp_path / name))
            df = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in df.collect()}
    toxic = set(range(0, 300, 6))
    assert len(toxic & set(seen["toxicity"])) <= 0.1 * len(toxic)
    assert len((set(range(300)) - toxic) - set(seen["toxicity"])) <= 5
    assert not {700, 701} & set(seen["language"]) and {500, 501, 600} <= set(seen["language"]) and None in seen["language"]
    assert not {600, 601} & set(seen["near_duplicates"]) and 1 in seen["near_duplicates"]
    kept = seen["repeated_passages"]
    assert set(kept) == set(seen["near_duplicates"])
    assert passage[5:-5] not in kept[500]["text"] and len(kept[500]["text"]) > 50 and kept[500]["n_chars"] == len(kept[500]["text"])
    untouched = [i for i in kept if i is not None and i < 300]
    assert all(kept[i]["text"] == seen["near_duplicates"][i]["text"] for i in untouched)
    rows = df.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {i: len(r["text"].split()) for i, r in kept.items()}
    whole = {(r["doc_id"], r["piece"]): r["n_tokens"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {(r["doc_id"], r["piece"]): r["n_tokens"] for r in df.collect()}


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], [])).count() == 0


def test_entry_without_this_subpackage():
    """The other queries must not need these folders."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = "import sys; sys.modules['x']=1; import importlib.util as u; f=u.find_spec; u.find_spec=lambda n,*a: None if n.startswith(('scanforge.llm','corpus_pipeline')) else f(n,*a); import __spark_entry__ as e; q=e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert not any('scanforge.llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def alike(a, b):
    """Whether texts have a Jaccard similarity of 0.8 or more by distinct 5-word shingles; texts without words are alike."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def test_run_against_loops(spark, tmp_path, case):
    """Every stage once more by plain loops over rows, with the fitted models as the only thing in common."""
    from scanforge.llm import langid, toxicity

    docs, labels, _ = case
    sf = folder(spark, tmp_path, docs, labels)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = toxicity.fit(df, spark.read.parquet(f"{sf}/labels.parquet"))
    left = [d for d in docs if toxic.scores([d[1]])[0] < corpus_pipeline.TOXIC_SCORE]
    lang = langid.fit(spark.createDataFrame(left, COLUMNS))
    left = [d for d in left if lang.predict([d[1]])[1][0] >= corpus_pipeline.LANGUAGE_SCORE]

    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if alike(left[i][1], left[j][1]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    first = {}
    for r, d in zip(root, left):
        if r not in first or first[r][0] is None or d[0] is not None and d[0] < first[r][0]:
            first[r] = d
    left = list(first.values())

    size, where = corpus_pipeline.PASSAGE_BYTES, {}
    data = [(d[1] or "").encode() for d in left]
    for k, b in enumerate(data):
        for p in range(len(b) - size + 1):
            where.setdefault(b[p : p + size], []).append((k, p))
    gone = [set() for _ in data]
    for places in where.values():
        if len(places) > 1:
            for k, p in places:
                gone[k].update(range(p, p + size))
    kept = [bytes(v for i, v in enumerate(b) if i not in g).decode(errors="ignore") for b, g in zip(data, gone)]
    assert any(gone)

    got = corpus_pipeline.run(spark, sf).collect()
    tokens = {}
    for r in got:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
    assert tokens == {d[0]: len(t.split()) for d, t in zip(left, kept)}
    bins = {}
    for r in got:
        if r["n_tokens"]:
            bins.setdefault((r["bin_id"], r["capacity"]), []).append((r["offset"], r["n_tokens"]))
    assert all(sum(n for _, n in own) <= c for (_, c), own in bins.items())
