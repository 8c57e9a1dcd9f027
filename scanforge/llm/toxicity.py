"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text, compared window by window."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held_out

WINDOW = 32
ORDINARY_DICTIONARY = 8192
#: Sizes of the toxic dictionary to try: the larger it is, the more words it holds, and the more ordinary text it codes by chance.
TOXIC_DICTIONARIES = (512, 1024, 2048, 4096)
TOXIC_SAMPLE = 1500
ORDINARY_SAMPLE = 3000
SAMPLE_BYTES = 100_000
THRESHOLD = 0.7
#: A window counts as toxic from so many bytes saved.
SAVED = 3
TOP = 5
GRAM = 6
BUCKETS = 1 << 22
#: Fixed value of the dictionary format: the three offsets that end the tables before a trained dictionary's content.
_OFFSETS = bytes((1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0))
_BLANK = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    """Lower-case words with one space around each."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()) + b" "


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """All of data in windows of about `size` bytes, cut at spaces where there are any; neighbours share that space."""
    out, at, n = [], 0, len(data)
    while at < n - 1:
        end = min(n, at + size)
        if end < n:
            space = data.find(b" ", end, end + 24)
            end = space + 1 if space >= 0 else end
        out.append(data[at:end])
        at = end - 1 if end < n and data[end - 1] == 32 else end
    return out


def both_windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """The windows of data, and once more those from half a window on, so that no word lies at the edge of all that hold it."""
    half = data.find(b" ", size // 2)
    return windows(data, size) + (windows(data[half:], size) if half > 0 and len(data) > size else [])


def _buckets(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    h = np.zeros(max(0, a.size - GRAM + 1), np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x100000001B3) + a[k : k + h.size]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def content(dictionary: bytes) -> bytes:
    """A trained dictionary without its head: magic number, id, entropy tables and first offsets."""
    return dictionary[dictionary.index(_OFFSETS, 8) + len(_OFFSETS) :]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """The content of a dictionary trained on samples; the samples themselves where they are too few to train on.

    Entropy tables are left out, so that both dictionaries code what they do not hold in the same way.
    """
    try:
        return content(zstandard.train_dictionary(size, samples).as_bytes())
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


@dataclass
class ToxicityModel:
    """Dictionaries, and the calibration of the differences in compressed length."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _compressor(self, content: bytes):
        p = zstandard.ZstdCompressionParameters(window_log=18, hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        return zstandard.ZstdCompressor(compression_params=p, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None)

    def lengths(self, texts: list[str | None], toxic: bool):
        """Compressed lengths of the windows of each text, by the ordinary dictionary or by the toxic one followed by it."""
        # the toxic dictionary ends in the ordinary one, so that ordinary text is coded alike by both
        compress = self._compressor(self.toxic + self.ordinary if toxic else self.ordinary).compress
        for text in texts:
            yield np.array([len(compress(w)) for w in both_windows(normal(text))], float)

    def features(self, texts: list[str | None], plain=None) -> np.ndarray:
        both = zip(self.lengths(texts, False) if plain is None else plain, self.lengths(texts, True))
        return np.stack([_summary(p - q) for p, q in both]) if texts else np.zeros((0, TOP + 4))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights.size:
            return np.zeros(len(texts))
        x = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))


def _summary(saved: np.ndarray) -> np.ndarray:
    """Of the bytes that a text's windows save: the TOP largest, the mean, and how many windows there are and reach SAVED."""
    out = np.zeros(TOP + 4)
    if saved.size:
        top, many = np.sort(saved)[::-1][:TOP], (saved >= SAVED).sum()
        out[: top.size] = top
        out[TOP:] = saved.mean(), np.log(saved.size), many / np.sqrt(saved.size), many
    return out


def _calibrate(model: ToxicityModel, texts: list[str], toxic: np.ndarray, plain: list[np.ndarray]) -> float:
    """Fit the logistic calibration; its mean loss."""
    x = model.features(texts, plain)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 0.1 * np.eye(w.size), a.T @ (toxic - p) - 0.1 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    margin = np.clip(a @ w, -40, 40)
    return float((np.log1p(np.exp(-np.abs(margin))) + np.maximum(margin, 0) - toxic * margin).mean())


def _spans(data: bytes, marked: np.ndarray) -> list[bytes]:
    at = np.flatnonzero(marked[_buckets(data)])
    if not at.size:
        return []
    cover = np.zeros(len(data) + 2, np.int8)
    for k in range(GRAM):
        cover[at + k + 1] = 1
    edge = np.flatnonzero(np.diff(cover))
    return [data[a:b] for a, b in zip(edge[::2], edge[1::2])]


def train(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Fit dictionaries and calibration. Without both kinds of text the model scores everything 0.

    The toxic dictionary is trained on the stretches of toxic texts whose byte 6-grams are over-represented there.
    Dictionaries and calibration come from different halves, so that windows learned by heart don't mislead the latter. Of
    TOXIC_DICTIONARIES that size is kept whose calibration fits best.
    """
    if len(toxic) < 2 or len(ordinary) < 2:
        return ToxicityModel(b"", b"")
    halves = [([normal(t) for t in toxic[h::2]], [normal(t) for t in ordinary[h::2]]) for h in range(2)]
    p, n = halves[0] if len(toxic) >= 400 else ([*map(normal, toxic)], [*map(normal, ordinary)])
    seen = np.zeros((2, BUCKETS), np.int32)
    for kind, texts in enumerate((n, p)):
        for t in texts:
            seen[kind, np.unique(_buckets(t))] += 1
    often = np.flatnonzero(seen[1] >= max(3, len(p) // 200))
    in_toxic, in_ordinary = seen[1, often] / len(p), seen[0, often] / len(n)
    pooled = (seen[0, often] + seen[1, often]) / (len(p) + len(n))
    z = (in_toxic - in_ordinary) / np.sqrt(pooled * (1 - pooled) * (1 / len(p) + 1 / len(n)) + 1e-12)
    chosen = often[(in_toxic >= 10 * in_ordinary) & (z >= 6)]
    if not chosen.size:
        chosen = np.flatnonzero((seen[1] >= 2) & (seen[1] / len(p) >= 10 * seen[0] / len(n)))
    marked = np.zeros(BUCKETS, bool)
    marked[chosen] = True
    del seen
    spans = [s for t in p for s in _spans(t, marked)]
    plain = [w for t in n for w in windows(t)]
    plain = [plain[i] for i in np.random.default_rng(0).permutation(len(plain))[:30000]]
    ordinary_content = _trained(ORDINARY_DICTIONARY, plain)
    rest = slice(1, None, 2) if len(toxic) >= 400 else slice(None)
    held, truth = [*toxic[rest], *ordinary[rest]], np.r_[np.ones(len(toxic[rest])), np.zeros(len(ordinary[rest]))]
    samples = [b" ".join(spans[i : i + 3]) for i in range(0, len(spans), 3)]
    tried = [ToxicityModel(ordinary_content, _trained(size, samples)) for size in TOXIC_DICTIONARIES]
    lengths = list(tried[0].lengths(held, False))
    losses = [_calibrate(m, held, truth, lengths) for m in tried]
    return tried[int(np.argmin(losses))]


def fit(docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, ordinary_sample: int = ORDINARY_SAMPLE) -> ToxicityModel:
    """Train on at most toxic_sample + ordinary_sample labelled documents that are not held out, the first by hash of the id.

    Texts over SAMPLE_BYTES bytes and null texts are not trained on. Of repeated labels the highest counts.
    """
    bound_batches(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    ids = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(toxic_sample).union(known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(ordinary_sample))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    # the broadcast side has at most toxic_sample + ordinary_sample rows of two numbers
    rows = texts.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").limit(2 * (toxic_sample + ordinary_sample)).collect()
    return train([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0])


def score(model: ToxicityModel, text: Column | str = "text") -> Column:
    """The probability that a text is toxic, from the whole of it; null and empty texts have the score of no windows."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return run(text)


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; repeated rows get a row each, other columns are not read."""
    model = fit(docs, labels)
    out = docs.select("doc_id", held_out().alias("held_out"), score(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
