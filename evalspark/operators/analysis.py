"""Analysis over the fact table: coverage, run comparison, leaderboard, summaries
(JN-4, JN-5, PV-1, AG-15, AG-16, AG-21, AG-22, ST-2, ST-4, WN-3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.functions.projections import score_label, score_value
from evalspark.operators.dedup import last_wins
from evalspark.operators.resolve import canonical_shot
from evalspark.operators.sequence import number_within
from evalspark.session import cut_lineage


def result_summary(rows: DataFrame) -> DataFrame:
    """AG-16: distinct models, distinct tasks, row count, sorted distinct shots."""
    return rows.agg(
        F.count_distinct("model_name").alias("n_models"),
        F.count_distinct("task").alias("n_tasks"),
        F.count(F.lit(1)).alias("n_results"),
        F.array_join(F.array_sort(F.collect_set(F.col("n_shot").cast("string"))), ",").alias("n_shots"))


def superseded(df: DataFrame, key: Sequence[str], order: Sequence, id_col: str,
               value_col: str) -> DataFrame:
    """AG-22: rows that replaced an earlier row of the same key with a different
    value (both values reported). Consecutive rows are paired by an equi join on
    (key, position), so a hot key is spread over many tasks."""
    key = list(key)
    n = number_within(df.select(*key, id_col, value_col, *[c for c in order if isinstance(c, str) and c not in key + [id_col, value_col]]),
                      key, order, out="_rn")
    cur = n.alias("cur")
    prev = n.select(*[F.col(k).alias(f"_p_{k}") for k in key], (F.col("_rn") + 1).alias("_p_rn"),
                    F.col(id_col).alias(f"prev_{id_col}"), F.col(value_col).alias(f"prev_{value_col}"))
    cond = [F.col(f"cur.{k}").eqNullSafe(F.col(f"_p_{k}")) for k in key] + \
        [F.col("cur._rn") == F.col("_p_rn")]
    j = cur.join(prev, cond)
    return (j.filter(F.col(f"prev_{value_col}") != F.col(f"cur.{value_col}"))
            .select(*[F.col(f"cur.{k}").alias(k) for k in key], F.col(f"cur.{id_col}").alias(id_col),
                    f"prev_{id_col}", f"prev_{value_col}", F.col(f"cur.{value_col}").alias(value_col)))


def path_suffixes(path: Column) -> Column:
    """The path itself plus every text after a ``/`` (whole-component suffixes)."""
    positions = F.filter(F.sequence(F.lit(1), F.greatest(F.length(path), F.lit(1))),
                         lambda i: F.substring(path, i, 1) == F.lit("/"))
    tails = F.transform(positions, lambda i: F.substring(path, i + 1, F.length(path)))
    return F.array_distinct(F.concat(F.array(path), tails))


def missing_jobs(jobs: DataFrame, completed: DataFrame,
                 job_cols: Sequence[str] = ("model_path", "task_path", "n_shot")) -> DataFrame:
    """JN-4: scheduled jobs with no matching result.

    A result matches when task and shot are equal (shots compared in canonical form on
    both sides, so ``5.0`` is ``5``, and ``unknown`` matches no number) and the model paths are equal or one is
    a whole-component suffix of the other (``a/b/m`` vs ``m``; a bare substring
    such as ``m-deduped`` does not match). Both suffix directions become equi
    joins on exploded suffixes -- no nested-loop join.
    ``completed`` has ``model, task, n_shot``.
    """
    m, tk, s = job_cols
    c = completed.select(F.col("model").cast("string").alias("_cm"),
                         F.col("task").cast("string").alias("_ct"),
                         canonical_shot(F.col("n_shot")).alias("_cs")).distinct()
    j = jobs.withColumn("_jm", F.col(m).cast("string")) \
        .withColumn("_jt", F.col(tk).cast("string")).withColumn("_js", canonical_shot(F.col(s)))
    # completed path equals the job path or is a suffix of it
    c_sfx = c.select("_ct", "_cs", F.explode(path_suffixes(F.col("_cm"))).alias("_sfx")).distinct()
    step1 = j.join(c_sfx, (j["_jt"] == c_sfx["_ct"]) & (j["_js"] == c_sfx["_cs"]) &
                   (j["_jm"] == c_sfx["_sfx"]), "left_anti")
    # job path is a suffix of the completed path
    j_sfx = step1.select("_jm", "_jt", "_js", F.explode(path_suffixes(F.col("_jm"))).alias("_sfx")).distinct()
    hit = (j_sfx.join(c, (j_sfx["_jt"] == c["_ct"]) & (j_sfx["_js"] == c["_cs"]) &
                      (j_sfx["_sfx"] == c["_cm"]), "left_semi")
           .select("_jm", "_jt", "_js").distinct())
    out = step1.join(hit, ["_jm", "_jt", "_js"], "left_anti")
    return out.drop("_jm", "_jt", "_js")


def coverage(jobs: DataFrame, missing: DataFrame, by: Sequence[str] = ("model_path", "task_path")) -> DataFrame:
    """AG-15: scheduled / completed / missing counts with a roll-up over ``by``."""
    by = list(by)
    flagged = (jobs.select(*by, F.lit(0).alias("_miss"))
               .unionByName(missing.select(*by, F.lit(1).alias("_miss"))))
    # scheduled = jobs rows; missing rows were counted once more with _miss = 1
    agg = flagged.rollup(*by).agg(
        F.sum(F.when(F.col("_miss") == 0, 1).otherwise(0)).cast("long").alias("scheduled"),
        F.sum("_miss").cast("long").alias("missing"))
    return agg.withColumn("completed", F.col("scheduled") - F.col("missing"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """JN-5: full outer join of two result sets on (model, task, n_shot, metric).

    Missing key parts default to ``""`` / ``0`` (T9); duplicates inside one
    side: the last (highest ``pos``) wins; ``delta = B - A`` only when both
    exist. Inputs: ``model, task, n_shot, metric, performance, pos``.
    """
    def prep(df: DataFrame, tag: str) -> DataFrame:
        d = df.select(F.coalesce(F.col("model").cast("string"), F.lit("")).alias("model"),
                      F.coalesce(F.col("task").cast("string"), F.lit("")).alias("task"),
                      F.coalesce(F.col("n_shot").cast("string"), F.lit("0")).alias("n_shot"),
                      F.coalesce(F.col("metric").cast("string"), F.lit("")).alias("metric"),
                      F.col("performance").cast("double").alias(tag), "pos")
        return last_wins(d, ["model", "task", "n_shot", "metric"], ["pos"]).drop("pos")

    j = prep(a, "a").join(prep(b, "b"), ["model", "task", "n_shot", "metric"], "full_outer")
    return j.withColumn("delta", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(),
                                        F.col("b") - F.col("a")))


def sorted_comparison(cmp: DataFrame) -> DataFrame:
    """ST-2: comparison rows ordered by the text form of every key part
    (mixed int / ``unknown`` shots sort safely)."""
    return cmp.orderBy(*[F.col(c).cast("string") for c in ("model", "task", "n_shot", "metric")])


def leaderboard_long(df: DataFrame) -> DataFrame:
    """PRJ-13 + WN-3: ``(model_name, label, value, normalized)`` cells, last input
    row wins per (model, label). Input: fact rows plus an order column ``pos``."""
    cells = df.select("model_name",
                      score_label("task", "n_shot", "metric_name", "performance_normalized").alias("label"),
                      score_value("performance", "performance_normalized").alias("value"),
                      F.col("performance_normalized").isNotNull().alias("normalized"), "pos")
    return last_wins(cells, ["model_name", "label"], ["pos"]).drop("pos")


def leaderboard(df: DataFrame, average: bool = False, labels: Sequence[str] | None = None,
                average_decimals: int | None = None) -> DataFrame:
    """PV-1 (+ AG-21): rows = models, columns = labels in sorted order.

    The average is taken in long form over normalized cells only (labels without
    ``, raw``), skipping missing cells, before the pivot. With
    ``average_decimals`` the cells are rounded first and summed as decimals, so
    the mean does not depend on summation order.
    """
    cells = leaderboard_long(df)
    # Without given labels Spark finds and sorts them, under its own limit for columns.
    wide = cells.groupBy("model_name").pivot("label", None if labels is None else list(labels)).agg(F.first("value"))
    if average:
        v = F.col("value")
        mean = F.avg(v)
        if average_decimals is not None:
            d = F.round(v, average_decimals).cast(f"decimal(38,{average_decimals})")
            mean = F.sum(d).cast("double") / F.count(v)
        avg = (cells.filter(~F.col("label").contains(", raw"))
               .groupBy("model_name").agg(mean.alias("average (normalized cols)")))
        wide = wide.join(avg, "model_name", "left")
    return wide


def top_k(df: DataFrame, order: Sequence, k: int = 5) -> DataFrame:
    """ST-4: first ``k`` rows by ``order`` plus the total count of ``df``."""
    df = cut_lineage(df)  # counted and sorted from one evaluation
    total = df.agg(F.count(F.lit(1)).alias("n_total"))
    return df.orderBy(*order).limit(k).crossJoin(total)


def cap_per_task(df: DataFrame, task: str, order: Sequence[str], n: int, out: str = "rn") -> DataFrame:
    """ST-3: the first ``n`` rows of every task by ``order``, numbered from 1 in ``out``.

    Spark plans a partial ``WindowGroupLimit`` before the shuffle, so a hot task ships
    at most ``n`` rows per map task.
    """
    w = Window.partitionBy(task).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= n)
