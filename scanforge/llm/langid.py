"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held_out
from .hashing import hashed_ngrams

BITS = 12
SAMPLE = 2000
CHUNK = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
#: Families of languages by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi ur bn pa gu mr ne",
    "turkic": "tr az kk uz ky tk tt",
    "uralic": "fi et hu",
}


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes.split()), lang)


def features(text: str | None) -> np.ndarray:
    """Hashed counts of byte n-grams of the lower-cased letters of the whole text: square roots, scaled to length 1."""
    out = np.zeros(1 << BITS)
    text = text or ""
    for at in range(0, len(text), CHUNK):
        letters = " ".join(re.findall(r"[^\W\d_]+", text[at : at + CHUNK].lower()))
        out += hashed_ngrams(f" {letters} ".encode("utf-8", "surrogatepass"), bits=BITS)
    out = np.sqrt(out)
    return out / (np.linalg.norm(out) or 1.0)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge, dual coordinate descent); y is -1 or 1; the last weight is the bias."""
    w, alpha = np.zeros(x.shape[1] + 1), np.zeros(len(x))
    q = np.einsum("nd,nd->n", x, x) + 1 + 0.5 / c
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(x)):
            g = y[i] * (x[i] @ w[:-1] + w[-1]) - 1 + 0.5 / c * alpha[i]
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                worst = max(worst, abs(new - alpha[i]))
                step = (new - alpha[i]) * y[i]
                w[:-1] += step * x[i]
                w[-1] += step
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def _platt(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve through zero that fits the margins best."""
    slopes = np.geomspace(0.5, 64, 40)
    return float(slopes[np.argmin([np.log1p(np.exp(-np.clip(s * margin * y, -50, 50))).mean() for s in slopes])])


@dataclass
class LanguageModel:
    """machines: by pair of classes, (weights, slope); a positive margin speaks for the first of the pair."""

    families: dict[str, list[str]]
    machines: dict[tuple[str, str], tuple[np.ndarray, float]]

    def _choose(self, x: np.ndarray, classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class with the most one-versus-one votes, ties by summed probability, and the mean probability against the others."""
        if len(classes) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        prob, votes = np.zeros((len(x), len(classes))), np.zeros((len(x), len(classes)))
        for i, j in combinations(range(len(classes)), 2):
            w, slope = self.machines[classes[i], classes[j]]
            p = 1 / (1 + np.exp(-np.clip(slope * (x @ w[:-1] + w[-1]), -40, 40)))
            prob[:, i] += p
            prob[:, j] += 1 - p
            votes[:, i] += p >= 0.5
            votes[:, j] += p < 0.5
        prob /= len(classes) - 1
        best = np.argmax(votes + prob / 2, axis=1)
        return best, prob[np.arange(len(x)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts), 512):
            part = [i for i in range(at, min(at + 512, len(texts))) if texts[i] and _LETTER.search(texts[i])]
            if not part or not self.families:
                continue
            x = np.stack([features(texts[i]) for i in part])
            names = sorted(self.families)
            f, p = self._choose(x, [f"family {n}" for n in names])
            for k in np.unique(f):
                rows = np.flatnonzero(f == k)
                members = self.families[names[k]]
                m, pm = self._choose(x[rows], members)
                for r, best, q in zip(rows, m, pm):
                    lang[part[r]], score[part[r]] = members[best], p[r] * q
        return lang, score


def train(x: np.ndarray, langs: list[str]) -> LanguageModel:
    """Machines for each pair of families, and for each pair of languages within one family."""
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family(lang), []).append(lang)
    lang, fam, machines = np.array(langs), np.array([f"family {family(s)}" for s in langs]), {}
    for of, groups in ((fam, [[f"family {n}" for n in sorted(families)]]), (lang, families.values())):
        for a, b in (pair for classes in groups for pair in combinations(classes, 2)):
            rows = np.flatnonzero((of == a) | (of == b))
            y = np.where(of[rows] == a, 1.0, -1.0)
            w = linear_svm(x[rows], y)
            machines[a, b] = (w, _platt(x[rows] @ w[:-1] + w[-1], y))
    return LanguageModel(families, machines)


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Train on at most `sample` documents with a language that are not held out, the first by hash of the id.

    Features are taken on the executors; the driver gets `sample` vectors of 2 ** BITS numbers at most. Of rows that repeat an id
    the smallest language and vector count. Without any labelled document the model knows no language and predicts `und`.
    """
    bound_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    ids = known.groupBy("doc_id").agg(F.min("lang").alias("only")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).astype(np.float32).tobytes())

    # the broadcast side has at most `sample` ids
    rows = known.join(F.broadcast(ids), "doc_id").where("lang = only").select("doc_id", "lang", vector("text").alias("x"))
    rows = rows.groupBy("doc_id", "lang").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return LanguageModel({}, {})
    langs = [r["lang"] for r in rows]
    x = np.frombuffer(b"".join([r["x"] for r in rows]), np.float32).reshape(len(rows), -1)
    del rows
    return train(x, langs)


def predict(model: LanguageModel, text: Column | str = "text") -> Column:
    """struct<lang, score> of the whole text; `und` with score 0 if the text is null or has no letter."""

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score = model.predict(texts.tolist())
        return pd.DataFrame({"lang": lang, "score": score})

    return run(text)


def identify_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; repeated rows get a row each, other columns are not read."""
    model = fit(docs, sample)
    out = docs.select("doc_id", held_out().alias("held_out"), predict(model).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
