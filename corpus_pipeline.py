"""The corpus pipeline: five stages over documents, each a function (spark, docs, sf_dir) -> DataFrame.

Stages work on every row that their predecessor kept. All but the last return the columns of documents; the last returns the
packing: doc_id, piece, start, n_tokens, bin_id, capacity, offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm import langid, toxicity
from scanforge.llm.common import stored, table
from scanforge.llm.packing import count_words, pack_documents
from scanforge.llm.shingles import one_of_each
from scanforge.llm.suffix import remove_repeats

TOXIC_SCORE = 0.7
LANGUAGE_SCORE = 0.5
#: A passage of over 50 words is seldom shorter than this many bytes.
PASSAGE_BYTES = 240
PASSAGE_GRAM = 96


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above TOXIC_SCORE go; null and empty texts are scored like any other."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model, "text") < TOXIC_SCORE)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is predicted with a score below LANGUAGE_SCORE, go.

    Where no document has a language to learn from, only null texts and those without a letter go.
    """
    model = langid.fit(docs)
    if not model.families:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(model, "text")
    return docs.where(found["score"] >= LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by a Jaccard similarity of 5-word shingles >= 0.8 that with the smallest doc_id stays.

    Null texts and those without words are one group; a null doc_id stays only where its group has no other, and of rows that
    repeat the smallest doc_id one, chosen by a hash of its text. Links are found by fingerprints in a vantage-point tree and an exact check,
    and those that lie beyond what it visits by prefix filtering and the same check: see README.
    """
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a passage of PASSAGE_BYTES bytes that occurs again is cut out of its text; n_chars follows the text.

    Characters of which only some bytes are left are left out. Every document stays, if only with an empty text; a null text
    becomes an empty one of 0 characters. Repeated rows are documents of their own, of which none keeps what they share.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = remove_repeats(docs, window=PASSAGE_BYTES, gram=PASSAGE_GRAM, carry=others)
    out = cut.select("rest.*", "text").withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the words of all documents; null and empty texts have a row without a bin. See pack_documents for ties."""
    return pack_documents(docs, count_words("text"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("language", language_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: Classifiers, connected components and packing have no SQL equivalent; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's rows are stored before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
