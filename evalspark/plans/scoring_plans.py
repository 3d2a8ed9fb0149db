"""Sample scoring bound to driver tables: grounding metrics, rounds, guard, means, MCQ."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators.grounding import completeness, expected_turns, grounding_metrics, per_round_metrics
from evalspark.operators.scoring import mcq_picks, mcq_scores, mean_score
from evalspark.operators.sequence import number_within
from evalspark.operators.extensions import MergeableMetric, compute_mergeable
from evalspark.plans.catalog import query, r6, t


# a total order of lineitem rows within an order (the first four columns alone
# repeat at the smallest scale)
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
               "l_discount", "l_shipdate"]


def lineitem_samples(spark, sf):
    """lineitem rows as region samples: intersection, union and bbox IoU by role."""
    li = t(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        "l_quantity", "l_extendedprice", "l_discount", "l_shipdate",
        F.greatest(F.col("l_quantity") * (1 - F.col("l_discount") * 8), F.lit(0.0)).alias("intersection"),
        F.col("l_quantity").alias("union"),
        (F.col("l_discount") * 10).alias("bbox_iou"))


_GROUNDING_SQL = """
WITH s AS (
  SELECT l_returnflag,
         greatest(l_quantity * (1 - l_discount * 8), 0.0) AS i,
         l_quantity AS u,
         l_discount * 10 AS b
  FROM lineitem),
m AS (SELECT *, CASE WHEN u <= 0 THEN 0.0 ELSE i / u END AS iou FROM s)
SELECT l_returnflag,
       count(*) AS n_samples,
       round(avg(iou), 6)::DOUBLE AS giou,
       round(CASE WHEN sum(u) <= 0 THEN 0.0 ELSE sum(i) / sum(u) END, 6)::DOUBLE AS ciou,
       round(avg(CASE WHEN b > 0.5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS bbox_ap,
       round(avg(CASE WHEN iou > 0.3 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS pass_rate_0_3,
       round(avg(CASE WHEN iou > 0.5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS pass_rate_0_5,
       round(avg(CASE WHEN iou > 0.7 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS pass_rate_0_7,
       round(avg(CASE WHEN iou > 0.9 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS pass_rate_0_9
FROM m GROUP BY l_returnflag
"""


@query("grounding_metrics", _GROUNDING_SQL)
def q_grounding_metrics(spark, sf):
    res = grounding_metrics(lineitem_samples(spark, sf), by=["l_returnflag"])
    return res.select("l_returnflag", "n_samples",
                      *[r6(F.col(c)).alias(c) for c in res.columns[2:]])


@query("per_round_metrics", """
WITH r AS (
  SELECT row_number() OVER (PARTITION BY CAST(l_orderkey AS VARCHAR)
                            ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                                     l_discount, l_shipdate) AS round,
         greatest(l_quantity * (1 - l_discount * 8), 0.0) AS i,
         l_quantity AS u, l_discount * 10 AS b
  FROM lineitem)
SELECT round, count(*) AS n_samples,
       round(avg(CASE WHEN u <= 0 THEN 0.0 ELSE i / u END), 6)::DOUBLE AS giou,
       round(avg(CASE WHEN b > 0.5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS bbox_ap
FROM r GROUP BY round
""")
def q_per_round_metrics(spark, sf):
    res = per_round_metrics(lineitem_samples(spark, sf), "l_orderkey", _LINE_ORDER)
    return res.select("round", "n_samples", r6(F.col("giou")).alias("giou"),
                      r6(F.col("bbox_ap")).alias("bbox_ap"))


@query("completeness_guard", """
SELECT conv_id, max(turn) + 1 AS expected_turns, count(*) AS n_records,
       (max(turn) + 1 = count(*)) AS complete
FROM conversations GROUP BY conv_id
""")
def q_completeness_guard(spark, sf):
    conv = t(spark, sf, "conversations")
    # the items are conversations with one expected turn list each
    items = conv.groupBy("conv_id").agg((F.max("turn") + 1).alias("n")).select(
        "conv_id", F.array_repeat(F.lit("t"), F.col("n").cast("int")).alias("conversational_turns"))
    expected = items.groupBy("conv_id").agg(expected_turns(items).alias("expected_turns"))
    return completeness(conv, expected, ["conv_id"])


@query("mean_scores", """
SELECT d.lang, d.source, count(l.quality) AS n,
       round(avg(l.quality), 6)::DOUBLE AS mean,
       round(stddev_samp(l.quality) / sqrt(count(l.quality)), 6)::DOUBLE AS stderr
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
GROUP BY d.lang, d.source
""")
def q_mean_scores(spark, sf):
    labels = t(spark, sf, "labels")
    docs = t(spark, sf, "documents").select("doc_id", "lang", "source")
    res = mean_score(labels.join(docs, "doc_id"), ["lang", "source"], "quality")
    return res.select("lang", "source", "n", r6(F.col("mean")).alias("mean"),
                      r6(F.col("stderr")).alias("stderr"))


@query("mcq_scores", """
WITH c AS (
  SELECT l_orderkey AS doc,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_quantity, l_extendedprice, l_discount, l_shipdate) - 1 AS idx,
         -l_extendedprice AS ll, length(p_name) AS nchar, strlen(p_name) AS nbyte
  FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (
  SELECT doc,
         first(idx ORDER BY ll DESC, idx) AS pick_acc,
         first(idx ORDER BY ll / nchar DESC, idx) AS pick_norm,
         first(idx ORDER BY ll / nbyte DESC, idx) AS pick_bytes
  FROM c GROUP BY doc)
SELECT count(*) AS n_docs,
       round(avg(CASE WHEN pick_acc = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS acc,
       round(avg(CASE WHEN pick_norm = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS acc_norm,
       round(avg(CASE WHEN pick_bytes = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS acc_bytes
FROM p
""")
def q_mcq_scores(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", *_LINE_ORDER)
    part = t(spark, sf, "part").select("p_partkey", "p_name")
    rows = li.join(part, li.l_partkey == part.p_partkey)
    numbered = number_within(rows, ["l_orderkey"], _LINE_ORDER, out="choice")
    samples = numbered.select(F.col("l_orderkey").alias("doc"),
                              (F.col("choice") - 1).alias("choice"),
                              (-F.col("l_extendedprice")).alias("loglik"),
                              F.col("p_name").alias("choice_text"), F.lit(1).alias("gold"))
    picks = mcq_picks(samples, ["doc"], "choice", "loglik", "choice_text", "gold")
    res = mcq_scores(picks)
    return res.select("n_docs", *[r6(F.col(c)).alias(c) for c in ("acc", "acc_norm", "acc_bytes")])


def calibration_error(bins: int = 10) -> MergeableMetric:
    """Expected calibration error: mean over the samples of |accuracy - confidence| of their confidence bin.

    State: samples, correct ones and summed confidence of each bin. Samples without a confidence are left out.
    """
    def partial(rows):
        import numpy as np

        rows = rows[rows["confidence"].notna()]
        at = np.minimum((rows["confidence"].to_numpy(float) * bins).astype(int), bins - 1)
        return [x for weights in (None, rows["correct"].to_numpy(float), rows["confidence"].to_numpy(float))
                for x in np.bincount(at, weights, minlength=bins)]

    def finish(state):
        if not state or not sum(state[:bins]):
            return 0.0
        n, correct, confidence = state[:bins], state[bins:2 * bins], state[2 * bins:]
        return sum(abs(c - f) for c, f in zip(correct, confidence)) / sum(n)

    return MergeableMetric("calibration_error", partial, lambda a, b: [x + y for x, y in zip(a, b)], finish)


@query("mergeable_metrics", """
WITH s AS (
  SELECT l_linestatus, CASE WHEN l_linenumber <> 7 THEN l_discount * 8 + l_tax * 2 END::DOUBLE AS confidence, (l_quantity > 25)::INTEGER AS correct FROM lineitem),
b AS (
  SELECT l_linestatus, least(9, floor(confidence * 10)) AS bin, count(*) AS n, abs(sum(correct) - sum(confidence)) AS gap
  FROM s WHERE confidence IS NOT NULL GROUP BY ALL)
SELECT l_linestatus, 'calibration_error' AS metric, round(sum(gap) / sum(n), 6) AS value FROM b GROUP BY l_linestatus
""")
def q_mergeable_metrics(spark, sf):
    li = t(spark, sf, "lineitem")
    samples = li.select("l_linestatus", F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 8 + F.col("l_tax") * 2).cast("double").alias("confidence"),
                        (F.col("l_quantity") > 25).cast("int").alias("correct"))
    got = compute_mergeable(samples, [calibration_error()], ["confidence", "correct"], ["l_linestatus"])
    return got.select("l_linestatus", "metric", r6(F.col("value")).alias("value"))
