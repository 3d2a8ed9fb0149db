"""Per-task score aggregation (AG-10) and multiple-choice accuracy (AG-11)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from evalspark.functions.answers import answer_match, first_boxed


def mean_score(df: DataFrame, by: Sequence[str], score: str, prefix: str = "") -> DataFrame:
    """``aggregation: mean`` of per-sample scores with count and standard error.

    Standard error is ``stddev_samp / sqrt(n)``; NULL for a single sample.
    """
    s = F.col(score).cast("double")
    return df.groupBy(*by).agg(
        F.count(s).alias(f"{prefix}n"),
        F.avg(s).alias(f"{prefix}mean"),
        (F.stddev_samp(s) / F.sqrt(F.count(s))).alias(f"{prefix}stderr"))


def mcq_picks(df: DataFrame, doc: Sequence[str], choice: str, loglik: str,
              choice_text: str, gold: str) -> DataFrame:
    """Per document: the chosen index under raw, per-character and per-byte
    log-likelihood, and 0/1 correctness against the gold index.

    Ties go to the lowest choice index. ``max_by`` is an aggregate with partial
    (map-side) aggregation, so a document with very many choices is not one task.
    """
    ll = F.col(loglik).cast("double")
    idx = F.col(choice)
    nchar = F.length(F.col(choice_text)).cast("double")
    nbyte = F.octet_length(F.col(choice_text)).cast("double")
    picks = df.groupBy(*doc).agg(
        F.max_by(idx, F.struct(ll, -idx)).alias("pick_acc"),
        F.max_by(idx, F.struct(ll / nchar, -idx)).alias("pick_acc_norm"),
        F.max_by(idx, F.struct(ll / nbyte, -idx)).alias("pick_acc_bytes"),
        F.first(F.col(gold), ignorenulls=True).alias("gold"))
    return picks.select(
        *doc, "gold", "pick_acc", "pick_acc_norm", "pick_acc_bytes",
        *[F.when(F.col(f"pick_{m}") == F.col("gold"), 1.0).otherwise(0.0).alias(m)
          for m in ("acc", "acc_norm", "acc_bytes")])


def mcq_scores(picks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean acc / acc_norm / acc_bytes over documents."""
    aggs = [F.count(F.lit(1)).alias("n_docs"), F.avg("acc").alias("acc"),
            F.avg("acc_norm").alias("acc_norm"), F.avg("acc_bytes").alias("acc_bytes")]
    return picks.groupBy(*by).agg(*aggs) if by else picks.agg(*aggs)


def grade_answers(predictions: DataFrame, gold: DataFrame, extractor: Callable = first_boxed, keys: Sequence[str] = ("task", "doc"),
                  response: str = "response", answer: str = "answer") -> DataFrame:
    """SC-8: ``(*keys, pred, answer, exact_match)`` for every gold answer.

    ``extractor`` maps the response column to the prediction. A gold row without a
    response, or a response without an extractable answer, scores 0.
    """
    pred = predictions.select(*keys, extractor(F.col(response)).alias("pred"))
    both = gold.select(*keys, F.col(answer).alias("answer")).join(pred, list(keys), "left")
    graded = answer_match(both, "pred", "answer", out="_eq")
    return graded.select(*keys, "pred", "answer", F.col("_eq").cast("int").alias("exact_match"))
