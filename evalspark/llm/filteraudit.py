"""Filter interaction audit: what each filter removes, by itself and in every order.

Every filter has, per part of the corpus and range of ids, a posting list: the sorted ids
of the documents that fail it. Documents are numbered in the order of (part, doc_id), so
a range of ids is a stretch of one part, and a part of any size is many ranges. The audit
of a range is a k-way merge of its lists: one walks along a list, the others are
searched by galloping (steps double until the id is passed, then a binary search between
the last two), so a long list is passed over in few steps. The merge gives, for each
filter, the sizes of its list cut by which other lists hold an id; these sizes, summed
over ranges, hold the size of every difference "fails f, and none of the filters S":

    removed by f after the filters S = sum of the sizes of all cuts that touch no filter of S,

so that all orders follow from k * 2^(k-1) differences a part. Quality marks are posting
lists like any other.

The flags of a document follow from its text alone, except that a text is a copy: the
first document of a text is its least doc_id (a partial aggregate), and a document is
joined with the firsts by text and doc_id, a key that no group of copies shares. Texts are
told apart by SHA-256.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evalspark.llm.common import short_batches, table
from evalspark.session import cut_lineage

FILTERS = "ABCDE"
MARKS = ("good", "toxic")
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
SIGNS = "#$%&*|"
UPPER = bytes(range(65, 91))
#: Ids of the walked list that are searched together.
STRIDE = 128


# --- posting lists and their merge ---------------------------------------------------

def leap(ids: np.ndarray, at: int, x: int) -> int:
    """First place from ``at`` on whose id is ``x`` or more, by steps that double."""
    step, n = 1, len(ids)
    low = at
    while at < n and ids[at] < x:
        low, at = at + 1, at + step
        step *= 2
    return low + int(ids[low:min(at, n)].searchsorted(x))


def gallop(needles: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each id of the sorted list ``needles`` its place in the sorted list ``ids``, or -1."""
    out = np.full(len(needles), -1, np.int64)
    at = 0
    for a in range(0, len(needles), STRIDE):
        some = needles[a:a + STRIDE]
        at = leap(ids, at, some[0])
        if at == len(ids):
            break
        end = leap(ids, at, some[-1]) + 1
        part = ids[at:end]
        place = part.searchsorted(some)
        held = part[np.minimum(place, len(part) - 1)] == some
        out[a:a + STRIDE][held] = at + place[held]
    return out


def holds(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the sorted ``ids`` the sorted list ``other`` has, too; the shorter list is walked."""
    if len(ids) <= len(other):
        return gallop(ids, other) >= 0
    out = np.zeros(len(ids), bool)
    place = gallop(other, ids)
    out[place[place >= 0]] = True
    return out


def merge(lists: list[np.ndarray], walked: int) -> np.ndarray:
    """Sizes of the cuts of list ``walked``: entry c counts its ids that exactly the other lists of bit set c hold."""
    own = lists[walked]
    cut = np.zeros(len(own), np.int64)
    for k, other in enumerate(lists):
        if k != walked and len(own) and len(other):
            cut |= holds(own, other).astype(np.int64) << k
    return np.bincount(cut, minlength=1 << len(lists))


def posting_lists(judged: DataFrame, names: list[str]) -> DataFrame:
    """``(part, documents, lists)`` per range of ids: the ids for which each boolean column of ``names`` is true.

    Ids number the documents by (part, doc_id); repeated rows have ids of their own.
    """
    rows = (judged.withColumn("row", F.monotonically_increasing_id())
            .repartitionByRange("part", "doc_id", "row").sortWithinPartitions("part", "doc_id", "row")
            .select("part", *names, F.monotonically_increasing_id().alias("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").dictionary_encode()
            code, ids = part.indices.to_numpy(), batch.column("id").to_numpy()
            edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            flags = [batch.column(n).to_numpy(zero_copy_only=False).astype(bool) for n in names]
            out = [(part.dictionary[int(code[a])].as_py(), b - a, [ids[a:b][f[a:b]] for f in flags])
                   for a, b in zip(edge, np.r_[edge[1:], len(code)])]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in out]), pa.array([int(n) for _, n, _ in out], pa.int64()),
                                              pa.array([x for _, _, x in out], pa.list_(pa.list_(pa.int64())))], ["part", "documents", "lists"])

    return rows.mapInArrow(run, "part string, documents long, lists array<array<long>>")


def cuts(postings: DataFrame, filters: int) -> DataFrame:
    """``(part, filter, cut, n)``: sizes of the cuts of the first ``filters`` lists; filter -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int, int]] = []
            for part, n, lists in zip(batch.column("part").to_pylist(), batch.column("documents").to_pylist(), batch.column("lists")):
                held = [x.values.to_numpy() for x in lists]
                out.append((part, -1, 0, n))
                for k in range(filters):
                    size = merge(held, k)
                    some = np.flatnonzero(size)
                    out += zip([part] * len(some), [k] * len(some), some.tolist(), size[some].tolist())
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()))],
                                             ["part", "filter", "cut", "n"])

    rows = postings.mapInArrow(run, "part string, filter int, cut int, n long")
    return rows.groupBy("part", "filter", "cut").agg(F.sum("n").alias("n"))


def differences(sizes: DataFrame, filters: int, marks: tuple[str, ...]) -> DataFrame:
    """``(part, filter, before, removed, <mark>_lost...)`` per filter and set of filters before it, zeros included."""
    sets = [(k, sum(1 << g for g in some)) for k in range(filters) for n in range(filters)
            for some in combinations([g for g in range(filters) if g != k], n)]
    every = F.array(*(F.struct(F.lit(k).alias("filter"), F.lit(s).alias("before")) for k, s in sets))
    grid = sizes.where("filter < 0").select("part", F.inline(every))
    spark = sizes.sparkSession
    wanted = F.broadcast(spark.createDataFrame(sets, "filter int, before int"))  # k * 2^(k-1) rows
    here = (sizes.join(wanted, "filter").where(F.col("cut").bitwiseAND(F.col("before")) == 0)
            .groupBy("part", "filter", "before")
            .agg(F.sum("n").alias("removed"),
                 *(F.sum(F.when(F.col("cut").bitwiseAND(1 << filters + j) != 0, F.col("n")).otherwise(0)).alias(f"{m}_lost")
                   for j, m in enumerate(marks))))
    return grid.join(here, ["part", "filter", "before"], "left").na.fill(0)


def interaction_audit(judged: DataFrame, filters: list[str], marks: tuple[str, ...] = ()) -> DataFrame:
    """One row per part, order of all filters and step, from ``judged(part, doc_id, <filter>..., <mark>...)``.

    The filter and mark columns are boolean, not null; names of filters have one letter.
    Columns: part, filter_order, step (from 1), kept, removed, redundant, unique_fails,
    ``<mark>_lost`` per mark, shapley (the filter's removed, summed over all orders).
    A null part counts as the empty string. Without documents there are no rows.
    """
    n = len(filters)
    judged = judged.select(F.coalesce("part", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), *filters, *marks)
    sizes = cut_lineage(cuts(posting_lists(judged, [*filters, *marks]), n))
    lost = [f"{m}_lost" for m in marks]
    sets = differences(sizes, n, marks)
    among = Window.partitionBy("part", "filter")
    at_first, at_last = (F.max(F.when(F.col("before") == s, F.col("removed"))).over(among)
                         for s in (F.lit(0), F.lit((1 << n) - 1).bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.col("filter")))))
    # A set of s filters stands before a filter in s! (n - 1 - s)! orders.
    weight = F.element_at(F.array(*(F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n))), F.bit_count("before") + 1)
    sets = (sets.withColumns({"fails": at_first, "unique_fails": at_last, "shapley": F.sum(F.col("removed") * weight).over(among)}))
    orders = []
    for order in permutations(range(n)):
        name = "".join(filters[k] for k in order)
        orders += [(k, sum(1 << g for g in order[:s]), name, s + 1) for s, k in enumerate(order)]
    steps = sets.join(F.broadcast(sets.sparkSession.createDataFrame(orders, "filter int, before int, filter_order string, step int")),
                      ["filter", "before"])  # n * n! rows
    total = sizes.where("filter < 0").select("part", F.col("n").alias("documents"))
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return (steps.join(total, "part")
            .select("part", "filter_order", "step", (F.col("documents") - F.sum("removed").over(so_far)).alias("kept"), "removed",
                    (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley"))


# --- the five filters ------------------------------------------------------------------

def judge_texts(docs: DataFrame) -> DataFrame:
    """``(part, doc_id, A, B, C, D, digest)`` of ``docs(doc_id, text, source)``; a null text is empty."""
    signs = re.compile(f"[{re.escape(SIGNS)}]".encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = pc.utf8_length(batch.column("text")).to_pylist()
            flags: list[list[bool]] = [[], [], [], []]
            digest = []
            for text, n in zip(batch.column("text").cast(pa.binary()), points):
                raw = text.as_py()
                words = raw.split()  # bytes are split at \x20 and \x09-\x0D exactly
                for f, fails in zip(flags, (len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words),
                                            100 * (len(raw) - len(raw.translate(None, UPPER))) > UPPER_PERCENT * n,
                                            signs.search(raw) is not None)):
                    f.append(fails)
                digest.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), *(pa.array(f, pa.bool_()) for f in flags),
                                              pa.array(digest, pa.binary())], ["part", "doc_id", *"ABCD", "digest"])

    rows = short_batches(docs).select(F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"),
                                      F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "part string, doc_id long, A boolean, B boolean, C boolean, D boolean, digest binary")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, doc_id, A, B, C, D, E, good, toxic)`` per row of ``docs(doc_id, text, source)``.

    E: the same text stands under a smaller doc_id. A row without a doc_id neither fails
    E nor makes another fail. ``labels(doc_id, quality, toxic)``: a document is good or
    toxic if any of its label rows says so; without a row it is neither.
    """
    judged = cut_lineage(judge_texts(docs))
    firsts = (judged.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull())
              .withColumn("first", F.lit(True)))
    marked = (labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))

    def truth(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    named, rest = judged.where(F.col("doc_id").isNotNull()), judged.where(F.col("doc_id").isNull())
    named = (named.join(firsts, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
             .select("part", "doc_id", *"ABCD", F.col("first").isNull().alias("E"), *(truth(F.col(m)).alias(m) for m in MARKS)))
    return named.unionByName(rest.select("part", "doc_id", *"ABCD", *(F.lit(False).alias(c) for c in ("E", *MARKS))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the five filters on all documents, in all 120 orders."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return interaction_audit(judge(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")), list(FILTERS), MARKS)


def oracle_sql() -> str:
    """The same audit in DuckDB SQL, by bit sets of the filters that each document fails."""
    return f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < {LEAST_WORDS} THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[{SIGNS}]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS fails
  FROM words LEFT JOIN marks USING (doc_id)),
counted AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY ALL),
letters AS (SELECT unnest(range(5)) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT array_to_string(list_transform(o, lambda x: substr('{FILTERS}', x::INTEGER + 1, 1)), '') AS filter_order, s AS step, 1 << o[s]::INTEGER AS bit,
         coalesce(list_sum(list_transform(o[1:s - 1], lambda x: 1 << x::INTEGER)), 0)::INTEGER AS before
  FROM (SELECT o, unnest(range(1, 6))::INTEGER AS s FROM orders)),
done AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER (fails & (before | bit) = 0) AS kept, sum(n) FILTER (fails & before = 0 AND fails & bit != 0) AS removed,
         sum(n) FILTER (fails & before != 0 AND fails & bit != 0) AS redundant, sum(n) FILTER (fails = bit) AS unique_fails,
         sum(good) FILTER (fails & before = 0 AND fails & bit != 0) AS good_lost,
         sum(toxic) FILTER (fails & before = 0 AND fails & bit != 0) AS toxic_lost
  FROM counted, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM done
"""
