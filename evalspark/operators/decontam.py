"""Benchmark decontamination by shared word n-grams (JN-10).

Tasks declare ``should_decontaminate`` with a query text; the check itself
follows Brown et al. (2020), App. C: lower-cased letter/digit tokens,
13-grams, a document overlaps a benchmark item when they share an n-gram.

Plan, in three steps so that no n-gram string is shuffled for most positions and no
n-gram is one task's:

1. Candidates: every token is hashed once (``xxhash64``); an n-gram key is the
   hash of its window of token hashes -- 8 bytes per position instead of an
   ~80-byte string. What is left are the (document, key) pairs that the benchmark has, too.
2. Exact: only documents with such a pair build n-gram strings, and only those of their
   pairs go on, joined by (document, key), which no frequent n-gram can crowd.
3. Documents and items meet on the text itself, so a hash collision can never create
   or change a result. An n-gram that holds more than 1 / HEAVY_SHARE of these rows (a licence
   line in every document) is dealt over as many salts as it has such shares: the
   documents' rows by their id, the benchmark's rows copied to each. There are at
   most HEAVY_SHARE such n-grams, so their table is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalspark.functions.text import decontam_tokens, ngrams
from evalspark.session import cut_lineage

HEAVY_SHARE = 1000
LEAST_HEAVY = 10_000


def item_ngrams(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    # tokens are projected first: a lambda must see a column, not the
    # tokenizer expression (which would be re-evaluated per n-gram position)
    toks = df.select(F.col(id_col), decontam_tokens(F.col(text_col)).alias("_tok"))
    grams = F.array_distinct(ngrams(F.col("_tok"), n))
    return toks.select(F.col(id_col), F.explode(grams).alias("ngram"))


def _keyed(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, token array, key array): a key per window of n tokens."""
    toks = df.select(F.col(id_col), decontam_tokens(F.col(text_col)).alias("_tok"))
    hashed = toks.select(F.col(id_col), "_tok", F.transform("_tok", lambda x: F.xxhash64(x)).alias("_th"))
    size = F.size("_th")
    keys = F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1),
                                         lambda i: F.xxhash64(F.slice("_th", i, n))))
    return hashed.select(F.col(id_col), "_tok", keys.alias("_keys"))


def _ngram_keys(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    return _keyed(df, id_col, text_col, n).select(F.col(id_col), F.explode(F.array_distinct("_keys")).alias("_key"))


def shared_ngrams(docs: DataFrame, bench: DataFrame, n: int, doc_id: str, item_id: str, text: str) -> DataFrame:
    """``(doc, ngram)``: the distinct n-grams of documents whose keys the benchmark has (cut)."""
    # Cut, so that the join stands between plain shuffles and a frequent key's rows can be split.
    bench_keys = cut_lineage(_ngram_keys(bench, item_id, text, n).select("_key").distinct())
    pairs = cut_lineage(_ngram_keys(docs, doc_id, text, n).join(bench_keys, "_key", "left_semi").distinct())
    keyed = _keyed(docs.join(pairs.select(doc_id).distinct(), doc_id, "left_semi"), doc_id, text, n)
    windows = keyed.select(doc_id, F.explode(F.arrays_zip(F.col("_keys").alias("_key"), ngrams(F.col("_tok"), n).alias("ngram"))).alias("_w"))
    return cut_lineage(windows.select(doc_id, "_w._key", "_w.ngram").join(pairs, [doc_id, "_key"], "left_semi")
                       .select(doc_id, "ngram").distinct())


def salted(shared: DataFrame, items: DataFrame, doc_id: str, share: int = HEAVY_SHARE, least: int = LEAST_HEAVY) -> tuple[DataFrame, DataFrame]:
    """``shared(doc, ngram)`` and ``items(item, ngram)`` with a ``_salt``; equal (ngram, _salt) meet.

    No (ngram, _salt) holds many more of the documents' rows than one ``share``-th of all, or ``least``.
    """
    limit = max(shared.count() / share, least)
    heavy = cut_lineage(shared.groupBy("ngram").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
                        .select("ngram", F.ceil(F.col("_n") / limit).cast("int").alias("_salts")))  # fewer than ``share`` rows
    salts = F.coalesce("_salts", F.lit(1))
    left = shared.join(F.broadcast(heavy), "ngram", "left").withColumn("_salt", F.pmod(F.xxhash64(doc_id), salts).cast("int")).drop("_salts")
    right = items.join(F.broadcast(heavy), "ngram", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left, right


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 13, doc_id: str = "doc_id",
                  item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per (document, benchmark item) sharing at least one n-gram:
    ``n_overlap`` shared distinct n-grams, ``n_item_ngrams``, ``overlap`` share
    of the item's n-grams, and ``verbatim`` (every item n-gram occurs)."""
    docs, bench = docs.select(doc_id, text), bench.select(item_id, text)
    b = item_ngrams(bench, item_id, text, n)
    sizes = b.groupBy(item_id).agg(F.count(F.lit(1)).alias("n_item_ngrams"))
    left, right = salted(shared_ngrams(docs, bench, n, doc_id, item_id, text), b, doc_id)
    hits = (left.join(right, ["ngram", "_salt"])
            .groupBy(doc_id, item_id).agg(F.count(F.lit(1)).alias("n_overlap")))
    res = hits.join(sizes, item_id)
    return res.select(doc_id, item_id, "n_overlap", "n_item_ngrams",
                      (F.col("n_overlap") / F.col("n_item_ngrams")).alias("overlap"),
                      (F.col("n_overlap") == F.col("n_item_ngrams")).alias("verbatim"))
