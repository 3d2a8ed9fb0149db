"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character n-grams (1 to 3 code points of the case-folded letters, runs of anything else
read as one space) are hashed into ``buckets``. Training counts them per language in
one pass over all labelled rows: each batch adds into dense per-language arrays and a
task emits one row per (language, bucket) seen, which Spark sums. The smoothed
log-probability matrix is languages x buckets, so its size does not grow with the
corpus; it is checked against MODEL_BYTES before it is broadcast. Scoring turns a batch
into sparse (document, bucket, count) entries and sums count times log-probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.llm.common import short_batches, table

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Largest matrix that is broadcast: over 2,000 languages at the default bucket count.
MODEL_BYTES = 256 << 20
#: Code points that are handled at once, so that a batch of long texts stays small.
CHUNK_CHARS = 200_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _letters(text: str) -> str:
    """Case-folded letters with one space for each run of other characters; empty if no letter."""
    folded = text.lower()
    if not folded.isascii() or not folded.isalpha():
        folded = " ".join("".join(c if c.isalpha() else " " for c in folded).split())
    return f" {folded} " if folded else ""


def _ascii_table() -> dict[int, str]:
    return {i: chr(i).lower() if chr(i).isalpha() else " " for i in range(0x250)}


def normalise(texts: list[str | None]) -> list[str]:
    """Texts as the n-grams see them; empty where there is no letter."""
    latin = _ascii_table()
    out = []
    for text in texts:
        if not text:
            out.append("")
            continue
        t = text.translate(latin)
        if max(t, default="") >= "ɐ":  # beyond the table: ask character by character
            out.append(_letters(text))
        else:
            t = " ".join(t.split())
            out.append(f" {t} " if t else "")
    return out


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) runs of bounded total length; a longer single text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text) > most or i - start >= 256):
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]


def bucket_ids(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of the texts; n-grams never cross two texts."""
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), size)
    shift = np.uint64(64 - (buckets - 1).bit_length())
    rows, ids = [], []
    key = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        key = (key[:len(points) - n + 1] * _MIX[0]) ^ (points[n - 1:] + _MIX[n - 1])
        whole = row[:len(points) - n + 1] == row[n - 1:]
        if n in ORDERS:
            rows.append(row[:len(points) - n + 1][whole])
            ids.append(((key * _MIX[1])[whole] >> shift).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(ids)) if rows else (row, row)


def train(labelled: DataFrame, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Learn from every row of ``labelled(text, lang)`` with a non-null lang.

    Returns the languages in order and the float32 matrix [buckets, languages] of
    log-probabilities; no labelled row with a letter gives no languages.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang", sort=False):
                sums = total.setdefault(lang, np.zeros(buckets, np.int64))
                for _, run in chunks([t for t in normalise(part["text"].tolist()) if t]):
                    sums += np.bincount(bucket_ids(run, buckets)[1], minlength=buckets)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": sums[at]})

    counts = (short_batches(labelled).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
              .mapInPandas(count, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
              .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("row")))
    counts = counts.persist()
    try:
        langs = counts.count()
        if langs * buckets * 4 > MODEL_BYTES:
            raise ValueError(f"{langs} languages: the matrix would exceed {MODEL_BYTES} bytes")
        rows = sorted(counts.select("lang", F.col("row.bucket").alias("b"), F.col("row.n").alias("n")).collect())
    finally:
        counts.unpersist()
    matrix = np.zeros((buckets, len(rows)), np.float64)
    for k, r in enumerate(rows):
        matrix[np.asarray(r["b"], np.int64), k] = r["n"]
    matrix += SMOOTHING
    return [r["lang"] for r in rows], np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def classify(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Best language of each text and its posterior under equal priors."""
    buckets = len(matrix)
    clean = normalise(texts)
    best, score = [UNDETERMINED] * len(clean), np.zeros(len(clean))
    if not langs:
        return best, score
    for start, run in chunks(clean):
        row, ids = bucket_ids(run, buckets)
        if not len(ids):
            continue
        count = np.bincount(row * buckets + ids, minlength=len(run) * buckets)
        at = np.flatnonzero(count)
        doc = at // buckets
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        like = np.add.reduceat(count[at][:, None] * matrix[at % buckets].astype(np.float64), starts, axis=0)
        odds = np.exp(like - like.max(axis=1, keepdims=True))
        pick = odds.argmax(axis=1)
        for i, k, p in zip(doc[starts], pick, 1 / odds.sum(axis=1)):
            best[start + i], score[start + i] = langs[k], p
    return best, score


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray, *keep: str | Column) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score`` from ``docs.text`` alone."""
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))  # at most MODEL_BYTES

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        best, score = classify(texts.tolist(), *model.value)
        return pd.DataFrame({"lang_pred": best, "score": score})

    return short_batches(docs).select(*keep, predict("text").alias("p")).select("*", "p.*").drop("p")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the held-out third: crc32 of the id as text, modulo 3, is 1. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """Train on the rows of ``docs(doc_id, text, lang)`` that are not held out; predict all.

    ``und`` with score 0 where the text is null or has no letter, or nothing could be
    learned. A null lang is not learned from. Repeated rows count as often as they
    appear and come back as often. Ties go to the first language by code point.
    """
    langs, matrix = train(docs.where(~held_out()).select("text", "lang"))
    return identify(docs, langs, matrix, *keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: predicted language of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language_id(docs, "doc_id", held_out().alias("held_out"))
