"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into three parts of 23, 23 and 18 bits; the last is
padded with zeros to 23. The anchors are the direct product of three perfect binary
Golay codes (length 23, covering radius 3), about 2**36 anchors in all. Every
fingerprint has one home anchor: its nearest codeword in each part. It also visits
every anchor whose summed excess over the covering radius is within the threshold.
If two fingerprints differ in at most ``threshold`` bits, one visits the home anchor
of the other, so comparing visitors with residents per anchor loses no link.

Only distinct fingerprints are placed, so exact copies never meet at an anchor. An
anchor with more than ``crowded`` residents (a large group of near copies) is not
compared pair by pair: its fingerprints are keyed by the words at distance one or
less. Two fingerprints share such a word exactly if they differ in two bits or fewer,
a word has at most 65 fingerprints, and the star of each word has the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from evalspark.llm.common import connected_components, short_batches, table
from evalspark.session import cut_lineage, measured_broadcasts

SHINGLE_WORDS = 3
MAX_BITS = 2
CROWDED = 256
SEED = 42


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of one text; 0 for null and for texts without a word."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    n = max(1, len(words) - shingle_words + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, *keep: str) -> DataFrame:
    """``(doc_id, fp)`` and the columns ``keep`` for each row of ``docs(doc_id, text)``; ``fp`` is the signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).astype(np.int64))

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), fp("text").alias("fp"), *keep)


# --- anchors -----------------------------------------------------------------------

PARTS = (23, 23, 18)
GOLAY_GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, fixed value


def golay_syndromes() -> np.ndarray:
    """Syndrome (remainder by the generator polynomial) of every single-bit word."""
    out = []
    for bit in range(23):
        word = 1 << bit
        for shift in range(11, -1, -1):
            if word >> (shift + 11) & 1:
                word ^= GOLAY_GENERATOR << shift
        out.append(word)
    return np.array(out, np.int64)


def error_patterns(max_excess: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per excess e: error words that lead to a codeword of excess e, sorted by syndrome.

    Excess 0 holds the coset leaders (weight up to 3), excess e the weight 3 + e words.
    Returned as (first index per syndrome, words), at most C(23, 5) words.
    """
    from itertools import combinations

    single = golay_syndromes()
    out = []
    for e in range(max_excess + 1):
        words, marks = [], []
        for weight in range(4) if e == 0 else (3 + e,):
            picks = [list(p) for p in combinations(range(23), weight)]
            words.append(np.array([sum(1 << b for b in p) for p in picks], np.int64))
            marks.append(np.array([np.bitwise_xor.reduce(single[p]) if p else 0 for p in picks], np.int64))
        words, marks = np.concatenate(words), np.concatenate(marks)
        order = np.argsort(marks, kind="stable")
        out.append((np.searchsorted(marks[order], np.arange(2049)), words[order]))
    return out


def _syndrome(words: np.ndarray, single: np.ndarray) -> np.ndarray:
    out = np.zeros_like(words)
    for bit in range(23):
        out ^= (words >> bit & 1) * single[bit]
    return out


def _codewords(words: np.ndarray, single, patterns, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """All (row, codeword) with the given excess, for a column of 23-bit words."""
    first, errors = patterns[excess]
    mark = _syndrome(words, single)
    n = first[mark + 1] - first[mark]
    row = np.repeat(np.arange(len(words)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, words[row] ^ errors[first[mark][row] + inner]


def _anchors(fps: np.ndarray, excess: int, single, patterns) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor whose summed excess is exactly ``excess``."""
    bits = fps.view(np.uint64)
    parts, at = [], 0
    for width in PARTS:
        parts.append((bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    # An anchor is named by its message: the codeword is fixed by its top 12 bits.
    rows, anchors = [], []
    for split in np.ndindex(*(excess + 1,) * len(parts)):
        if sum(split) != excess:
            continue
        row, name = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for part, e in zip(parts, split):
            inner, code = _codewords(part[row], single, patterns, e)
            row, name = row[inner], name[inner] << 12 | code >> 11
        rows.append(row)
        anchors.append(name)
    return np.concatenate(rows), np.concatenate(anchors)


def anchor_rows(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(anchor, fp, excess)`` for each anchor that a fingerprint lives at or visits."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single, patterns = golay_syndromes(), error_patterns(max_bits)
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                fp = pdf["fp"].to_numpy(np.int64)[at:at + 2000]
                for excess in range(max_bits + 1):
                    row, anchor = _anchors(fp, excess, single, patterns)
                    yield pd.DataFrame({"anchor": anchor, "fp": fp[row], "excess": np.int32(excess)})

    return fps.mapInPandas(place, "anchor long, fp long, excess int")


def links(fps: DataFrame, max_bits: int = MAX_BITS, crowded: int = CROWDED) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints with the components of all links.

    Crowded anchors are resolved through shared words, which needs ``max_bits`` of 1 or 2.
    """
    if max_bits not in (1, 2):
        raise ValueError("the anchor cover is laid out for 1 or 2 differing bits")
    # Placing makes about a hundred rows of one: spread the few bytes that go in over all
    # tasks (a stated number is not coalesced to the small input's size, but Spark leaves
    # out a repartition by a column that an aggregate has just dealt by: hence the hash).
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    homes = anchor_rows(fps, 0).select("anchor", "fp")
    residents = homes.groupBy("anchor").agg(F.count(F.lit(1)).alias("residents"))
    # Spark sizes the hundred rows made of one as if they were one: only what a shuffle measured is broadcast.
    with measured_broadcasts(fps.sparkSession):
        visits = cut_lineage(
            anchor_rows(fps, max_bits).join(residents, "anchor")
            .where((F.col("excess") > 0) | (F.col("residents") > 1)))
    near = (visits.where(F.col("residents") <= crowded)
            .join(homes.withColumnRenamed("fp", "home"), "anchor")
            .where(F.col("fp") != F.col("home"))
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("home"))) <= max_bits)
            .select(F.least("fp", "home").alias("a"), F.greatest("fp", "home").alias("b")))
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)),
                        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    word = (visits.where(F.col("residents") > crowded).select("fp").distinct()
            .select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("word")))
    if max_bits == 1:  # one flip apart: one of the two is the shared word itself
        stars = (word.where(F.col("fp") != F.col("word"))
                 .join(fps.select(F.col("fp").alias("word")), "word")
                 .select(F.col("fp").alias("a"), F.col("word").alias("b")))
    else:
        stars = (word.groupBy("word").agg(F.collect_list("fp").alias("fps"))  # at most 65
                 .where(F.size("fps") > 1)
                 .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
                 .where(F.col("a") != F.col("b")))
    return near.unionByName(stars).distinct()


def grouped(docs: DataFrame, shingle_words: int, max_bits: int, crowded: int, *keep: str) -> DataFrame:
    """doc_id, fp, component (a fingerprint of it), component_id and the columns ``keep`` per row of ``docs``."""
    prints = cut_lineage(with_fingerprints(docs, shingle_words, *keep))
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    with measured_broadcasts(docs.sparkSession):
        parts = connected_components(links(fps.select("fp"), max_bits, crowded))
    named = fps.join(parts, fps["fp"] == parts["node"], "left").select(
        fps["fp"], "first_doc", F.coalesce("component", fps["fp"]).alias("component"))
    smallest = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    return prints.join(named.select("fp", "component").join(smallest, "component"), "fp")


def simhash_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                   crowded: int = CROWDED) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint, component_id.

    Null and word-free texts have fingerprint zero and link like any other. A repeated
    row comes back as often. A null doc_id takes part in linking but never names a
    component; a component of null ids only has a null component_id. An empty table
    gives an empty result.
    """
    return (grouped(docs, shingle_words, max_bits, crowded)
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def one_per_group(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                  crowded: int = CROWDED) -> DataFrame:
    """One row of each SimHash group of ``docs(doc_id, text, ...)``, with all its columns.

    The row with the smallest doc_id stays; rows without one come last. Of several texts
    under that doc_id, or without any, the one with the least hash of the whole row stays,
    so reruns agree. Rows that agree in every column count as one.
    """
    row = F.xxhash64(F.to_json(F.struct(*docs.columns)))
    keyed = docs.withColumn("row_hash", row)
    rows = grouped(keyed.select("doc_id", "text", "row_hash"), shingle_words, max_bits, crowded, "row_hash")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_hash")).alias("at"))
    first = first.select(F.col("at.doc_id").alias("first_id"), F.col("at.row_hash").alias("first_hash"))
    return (keyed.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("first_id")) & (F.col("row_hash") == F.col("first_hash")), "left_semi")
            .dropDuplicates(["doc_id", "row_hash"]).select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: near-duplicate groups of all documents."""
    return simhash_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
