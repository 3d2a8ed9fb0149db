"""Job-table operators (JN-1, JN-2, JN-8, FLT-4, FLT-5, SO-3, SO-5, WN-6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evalspark.constants import JUDGE_REQUIRED_TASKS
from evalspark.functions.projections import lower_suite_only
from evalspark.operators.sequence import global_index

UNSAFE_PATTERN = r'[,"\n\r]'


def job_grid(models: DataFrame, tasks: DataFrame, shots: Sequence[int] | None = None) -> DataFrame:
    """JN-1: every model with every (task[, shot]) -- the product is the feature.

    ``tasks`` is the registry side (hundreds of rows); Spark's planner
    broadcasts it when its estimated size is under the broadcast threshold and
    falls back to a distributed cartesian product otherwise.
    """
    t = tasks
    if shots is not None:
        t = t.withColumn("n_shot", F.explode(F.array(*[F.lit(int(s)) for s in shots])))
    return models.crossJoin(t)


def attach_suite(jobs: DataFrame, suite_map: DataFrame, task_col: str = "task_path",
                 default: str = "lm_eval") -> DataFrame:
    """JN-2: engine per task from the registry map ``(task, suite[, position])``;
    missing -> ``lm_eval``. A task registered twice keeps its first engine: the one of
    least position, or, in a two-column map, the first by name."""
    order = F.col(suite_map.columns[2 if len(suite_map.columns) > 2 else 1])
    m = (suite_map.groupBy(F.col(suite_map.columns[0]).alias("_st"))
         .agg(F.min_by(F.col(suite_map.columns[1]), order).alias("_ss")))
    out = jobs.join(m, F.col(task_col) == F.col("_st"), "left")
    return out.withColumn("eval_suite", F.coalesce("_ss", F.lit(default))).drop("_st", "_ss")


def normalize_job_suites(jobs: DataFrame) -> DataFrame:
    """SRC-4 defaults: missing/NULL ``eval_suite`` -> ``lm_eval``; engine name lower-cased."""
    if "eval_suite" not in jobs.columns:
        jobs = jobs.withColumn("eval_suite", F.lit("lm_eval"))
    return jobs.withColumn("eval_suite", lower_suite_only(F.coalesce("eval_suite", F.lit("lm_eval"))))


def reject_unsafe(jobs: DataFrame, fields: Sequence[str] = ("model_path", "task_path", "eval_suite"),
                  id_cols: Sequence[str] = ()) -> DataFrame:
    """FLT-4: rows with a comma, quote, CR or LF in a field; the first offending
    field (in ``fields`` order) is reported in ``bad_field``."""
    expr = None
    for f in fields:
        cond = F.col(f).cast("string").rlike(UNSAFE_PATTERN)
        expr = F.when(cond, F.lit(f)) if expr is None else expr.when(cond, F.lit(f))
    return jobs.select(*id_cols, *fields, expr.alias("bad_field")).filter(F.col("bad_field").isNotNull())


def needs_judge(jobs: DataFrame, task_col: str = "task_path",
                judge_tasks: Sequence[str] = JUDGE_REQUIRED_TASKS) -> DataFrame:
    """FLT-5: distinct scheduled tasks graded by an LLM judge, sorted."""
    return (jobs.select(F.col(task_col).alias("task")).filter(F.col("task").isin(*judge_tasks))
            .distinct().orderBy("task"))


def unmapped_tasks(jobs: DataFrame, policy: DataFrame, task_col: str = "task_path",
                   show: int = 10) -> DataFrame:
    """JN-8: scheduled tasks with no headline-metric entry: the first ``show``
    (sorted) plus the total count, as ``(task, n_unmapped)``."""
    p = policy.select(F.col(policy.columns[0]).alias("task"))
    missing = (jobs.select(F.col(task_col).alias("task")).distinct()
               .join(p, "task", "left_anti"))
    total = missing.agg(F.count(F.lit(1)).alias("n_unmapped"))
    return missing.orderBy("task").limit(show).crossJoin(total)


def unknown_names(requested: DataFrame, known: DataFrame) -> DataFrame:
    """SO-3: requested names that are not known, distinct and sorted."""
    r = requested.select(F.col(requested.columns[0]).alias("name")).distinct()
    k = known.select(F.col(known.columns[0]).alias("name"))
    return r.join(k, "name", "left_anti").orderBy("name")


def suites_without(jobs: DataFrame, supporting: DataFrame) -> DataFrame:
    """SO-5: engines present in the job table that are not in ``supporting``."""
    j = jobs.select(F.substring_index(F.col("eval_suite"), ":", 1).alias("suite")).distinct()
    s = supporting.select(F.col(supporting.columns[0]).alias("suite"))
    return j.join(s, "suite", "left_anti")


def assign_slices(jobs: DataFrame, key: Sequence[str], capacity: int, seed: int = 42) -> DataFrame:
    """WN-6: deterministic shuffle, then equal contiguous slices.

    ``slices = max(1, min(capacity, n))``, ``per = max(1, ceil(n / slices))``,
    slice of row ``i`` = ``i // per``. The shuffle order is the MD5 of
    ``key1:key2:...:seed`` (ties by key), which any SQL engine can repeat; the global index comes from range partitions plus
    per-partition offsets, never a single-partition window.
    """
    k = [F.col(c) for c in key]
    shuffled = jobs.withColumn("_h", F.md5(F.concat_ws(":", *[c.cast("string") for c in k], F.lit(str(seed)))))
    idx = global_index(shuffled, ["_h", *key], out="_i")
    n = jobs.count()
    slices = max(1, min(capacity, n))
    per = max(1, -(-n // slices))
    return idx.withColumn("slice", (F.col("_i") / F.lit(per)).cast("long")).drop("_h", "_i")
