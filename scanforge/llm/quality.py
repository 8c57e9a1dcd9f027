"""Text quality without labels: expectation-maximisation over overlapping heuristics, then a hashed linear scorer."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .hashing import hashed_ngrams

SAMPLE = 3000
CHUNK = 1 << 20
BITS = 12
THRESHOLD = 0.5
GOOD, BAD, ABSTAIN = 1, 0, -1
_SYMBOLS = re.compile(r"[#$%&*@^~|<>{}\\=_+]")


def votes(text: str | None) -> list[int]:
    """One vote of each heuristic labeller on the whole text.

    Most labellers know one defect and abstain without it: that a text lacks one defect is no sign that it lacks others.
    """
    text = text or ""
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    n, chars = max(1, len(words)), max(1, len(text))
    letters = sum(len(w) for w in re.findall(r"[^\W\d_]+", text)) / chars
    stops = sum(w[-1] in ".?!" for w in words) / n
    bad = lambda found: BAD if found else ABSTAIN
    return [
        bad(not words),
        BAD if letters < 0.7 else GOOD if letters >= 0.78 else ABSTAIN,
        bad(len(_SYMBOLS.findall(text)) / n >= 0.2),
        bad(sum(w.isupper() and len(w) > 1 for w in words) / n >= 0.4),
        bad(text.count("!") / n >= 0.4),
        BAD if stops > 0.6 or n >= 50 and stops < 0.004 else GOOD if 0.03 <= stops <= 0.35 else ABSTAIN,
        bad(sum(a == b for a, b in zip(words, words[1:])) / n >= 0.2),
        bad(n >= 50 and len(set(words)) / n < 0.1),
        bad(len(lines) > 3 and len(set(lines)) / len(lines) < 0.5),
        bad(not 2.5 <= chars / n <= 25),
    ]


LABELLERS = 10


@dataclass
class LabelModel:
    """accuracy[j, c, v]: probability that labeller j votes v - 1 on a text of class c; prior: share of good texts."""

    accuracy: np.ndarray
    prior: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of a good text by votes; an abstention says nothing."""
        logs = np.log([1 - self.prior, self.prior])
        table = np.log(self.accuracy)
        table[:, :, 0] = 0
        score = logs + sum(table[j][:, patterns[:, j] + 1].T for j in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -40, 40)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and their counts.

    It starts from the share of bad votes, so class 1 is the one that the labellers call good; accuracies are smoothed.
    """
    m = patterns.shape[1]
    model = LabelModel(np.tile(np.array([[0.6, 0.3, 0.1], [0.3, 0.05, 0.65]]), (m, 1, 1)), 0.8)
    for _ in range(rounds):
        p = model.posterior(patterns)
        weight = np.stack([counts * (1 - p), counts * p])
        accuracy = np.stack([np.stack([np.bincount(patterns[:, j] + 1, weight[c], 3) for c in range(2)]) for j in range(m)]) + 1.0
        accuracy /= accuracy.sum(2, keepdims=True)
        prior = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
        moved = np.abs(accuracy - model.accuracy).max() + abs(prior - model.prior)
        model = LabelModel(accuracy, prior)
        if moved < 1e-7:
            break
    return model


def features(text: str | None) -> np.ndarray:
    """Square roots of hashed byte n-gram counts of the whole text, case and symbols kept, scaled to length 1."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(1 << BITS)
    for at in range(0, len(data), CHUNK):
        out += hashed_ngrams(data[at : at + CHUNK], bits=BITS)
    out = np.sqrt(out)
    return out / (np.linalg.norm(out) or 1.0)


def fit_scorer(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Logistic regression on posterior labels by accelerated gradient steps; classes are weighted alike."""
    # products stay in the type of x, so that no wider copy of it is made
    w = look = np.zeros(x.shape[1] + 1)
    good, bad = max(p.sum(), 1e-9), max((1 - p).sum(), 1e-9)
    weight = len(p) / 2 * (p / good + (1 - p) / bad)
    keep = np.r_[np.full(x.shape[1], ridge), 0.0]
    rate = 1 / (0.25 * (weight * (np.einsum("nd,nd->n", x, x) + 1)).sum() + ridge)
    for t in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ look[:-1].astype(x.dtype) + look[-1], -40, 40)))
        g = weight * (s - p)
        nxt = look - rate * (np.r_[x.T @ g.astype(x.dtype), g.sum()] + keep * look)
        look = nxt + t / (t + 3) * (nxt - w)
        w = nxt
    return w


def _vote_column(text):
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bytes(v + 1 for v in votes(t)))

    return run(text)


def classify_quality(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, posterior, score, keep for every row of docs; repeated rows get a row each, other columns are not read.

    The label model is fitted on the votes over all documents, counted by pattern (3 ** LABELLERS patterns at most reach the
    driver); the scorer on the posteriors of at most `sample` documents, the first by hash of the id. Null texts are empty.
    """
    bound_batches(docs.sparkSession)
    counted = docs.select(_vote_column(F.col("text")).alias("v")).groupBy("v").count().collect()
    if not counted:
        return docs.select("doc_id", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("keep"))
    unpack = lambda rows: np.frombuffer(b"".join(rows), np.uint8).reshape(-1, LABELLERS).astype(int) - 1
    model = fit_label_model(unpack([r["v"] for r in counted]), np.array([r["count"] for r in counted], float))

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).astype(np.float32).tobytes())

    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the broadcast side has at most `sample` ids; of rows that repeat one, the smallest votes and vector count
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", _vote_column(F.col("text")).alias("v"), vector("text").alias("x"))
    rows = picked.groupBy("doc_id").agg(F.min(F.struct("v", "x")).alias("r")).select("doc_id", "r.v", "r.x").collect()
    rows.sort(key=lambda r: r["doc_id"])
    if rows:
        p = model.posterior(unpack([r["v"] for r in rows]))
        x = np.frombuffer(b"".join([r["x"] for r in rows]), np.float32).reshape(len(rows), -1)
        del rows
        w = fit_scorer(x, p)
    else:
        w = np.zeros((1 << BITS) + 1)

    @F.pandas_udf("posterior double, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        x = texts.tolist()
        score = np.array([features(t) @ w[:-1] + w[-1] for t in x])
        return pd.DataFrame({"posterior": model.posterior(unpack([bytes(v + 1 for v in votes(t)) for t in x])), "score": 1 / (1 + np.exp(-np.clip(score, -40, 40)))})

    out = docs.select("doc_id", run.asNondeterministic()("text").alias("q")).select("doc_id", "q.posterior", "q.score")
    return out.withColumn("keep", F.col("score") >= threshold)
