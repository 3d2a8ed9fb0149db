"""User extension points (UD-1, UD-3, UD-4; UD-2 is ``plans.collect.ResultParser``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.constants import MODEL_FAMILY_RULES
from evalspark.functions.language import task_languages
from evalspark.operators import grounding


@dataclass(frozen=True)
class MetricSpec:
    """UD-1: a custom metric = a name and an aggregate Column over sample rows.

    ``agg`` must return 0.0 for an empty group when used globally (wrap in
    ``coalesce``) and must state how failed samples (NULL record) count.
    """
    name: str
    agg: Callable[[], Column]
    failed_samples: str = "zero"  # "zero" or "excluded"


def region_metrics(record: str = "record", thresholds: Sequence[float] = grounding.DEFAULT_THRESHOLDS):
    """The built-in region-grounding metrics as specs."""
    specs = [MetricSpec("gIoU", lambda: grounding.giou(record)),
             MetricSpec("cIoU", lambda: grounding.ciou(record), "excluded"),
             MetricSpec("bbox_AP", lambda: grounding.bbox_ap(record))]
    for t in thresholds:
        specs.append(MetricSpec(grounding.pass_rate_name(t), lambda t=t: grounding.pass_rate(t, record)))
    return specs


def compute_metrics(df: DataFrame, specs: Sequence[MetricSpec], by: Sequence[str] = ()) -> DataFrame:
    """Evaluate every spec in one aggregation pass; long form ``(*by, metric, value)``."""
    aggs = [s.agg().alias(f"_m{i}") for i, s in enumerate(specs)]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(s.name).alias("metric"), F.col(f"_m{i}").cast("double").alias("value"))
                                for i, s in enumerate(specs)]))
    return wide.select(*by, stack.alias("_s")).select(*by, "_s.metric", "_s.value")


@dataclass(frozen=True)
class MergeableMetric:
    """UD-1 for metrics that no aggregate Column can say: partial states that merge.

    ``partial`` turns sample rows (a pandas frame of one group, at most a batch) into a state,
    ``merge`` joins two states, ``finish`` turns a state into the score. A state is a
    list of numbers of any length. ``partial`` must say how failed samples count; it is
    given them (NULL records) like all others. An empty table has the score ``finish(None)``
    when there are no groups.
    """
    name: str
    partial: Callable[[pd.DataFrame], Sequence[float]]
    merge: Callable[[Sequence[float], Sequence[float]], Sequence[float]]
    finish: Callable[[Sequence[float] | None], float]


#: Groups whose states a task holds before it hands them on.
GROUPS_HELD = 10_000


def compute_mergeable(df: DataFrame, metrics: Sequence[MergeableMetric], columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Every metric over the sample ``columns``, per ``by`` group; long form ``(*by, metric, value)``.

    Two phases, like a built-in aggregate: a task turns its batches into one state per
    group and metric, only states are shuffled, and a group's states (one a task at
    most, or a few where a task has more than GROUPS_HELD groups) are merged by key. A hot group is as many states as tasks.
    """
    by = list(by)
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)
    metrics = list(metrics)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(*key, k, list(map(float, state))) for key, states in held.items() for k, state in enumerate(states)],
                               columns=[*by, "_metric", "_state"])
            held.clear()
            return out

        for batch in batches:
            groups = batch.groupby(by, dropna=False, sort=False) if by else [((), batch)]
            for key, part in groups:
                key = tuple(None if pd.isna(k) else k for k in key)
                new = [m.partial(part) for m in metrics]
                old = held.get(key)
                held[key] = new if old is None else [m.merge(a, b) for m, a, b in zip(metrics, old, new)]
            if len(held) > GROUPS_HELD:
                yield rows()
        if held:
            yield rows()

    def finish(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
        m = metrics[int(key[-1])]
        state = reduce(m.merge, map(list, states["_state"]))
        return pd.DataFrame([(*(None if pd.isna(k) else k for k in key[:-1]), m.name, float(m.finish(state)))], columns=[*by, "metric", "value"])

    schema = f"{keys}, " if keys else ""
    states = df.select(*by, *columns).mapInPandas(partial, f"{schema}_metric int, _state array<double>")
    out = states.groupBy(*by, "_metric").applyInPandas(finish, f"{schema}metric string, value double")
    if by:
        return out
    empty = df.sparkSession.createDataFrame([(m.name, float(m.finish(None))) for m in metrics], "metric string, value double")
    return out.unionByName(empty.join(out.select("metric"), "metric", "left_anti"))


@dataclass
class TaskSpec:
    """UD-3: a custom task, appended to the registry tables.

    ``dataset_files``: files of a dataset repository that the task reads itself, as
    ``{"repo_id": ..., "patterns": [...], "revision": ...}`` (revision optional).
    """
    name: str
    suite: str
    group: str | None = None  # default: the name with dashes
    n_shots: list[int] = field(default_factory=lambda: [0])
    engine_task: str | None = None
    primary_metric: str | None = None
    dataset: str | None = None
    subset: str | None = None
    aux_repos: list[str] = field(default_factory=list)
    dataset_files: list[dict] = field(default_factory=list)
    description: str | None = None


def task_spec_rows(spark: SparkSession, specs: Sequence[TaskSpec],
                   registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Registry rows ``(tasks, task_metrics)`` for custom tasks, placed after every group of ``registry``.

    The rows have the registry's columns, so ``registry.unionByName(tasks)`` holds for what ``load_registry`` gives.
    """
    last = registry.agg(F.max("group_pos")).first()[0] if registry is not None else None
    after = 0 if last is None else last + 1
    rows = [(s.group or s.name.replace("_", "-"), after + i, s.engine_task or s.name, 0, s.suite, s.n_shots, s.dataset, s.subset, ["main"],
             s.aux_repos, s.description, [(f.get("repo_id"), f.get("revision"), f.get("patterns") or []) for f in s.dataset_files], None)
            for i, s in enumerate(specs)]
    tasks = spark.createDataFrame(
        rows, "group string, group_pos int, task string, task_pos int, suite string, n_shots array<int>, dataset string, subset string, "
              "revisions array<string>, hf_models array<string>, description string, "
              "hf_dataset_files array<struct<repo_id:string,revision:string,patterns:array<string>>>, lang_pos int")
    tasks = tasks.withColumn("languages", task_languages("task", "subset"))
    metrics = spark.createDataFrame([(s.engine_task or s.name, s.primary_metric) for s in specs
                                     if s.primary_metric], "task string, metric string")
    return tasks, metrics


def routing_rules(extra: Sequence[tuple[Sequence[str], str]] = ()) -> list:
    """UD-4: extra (patterns, family) rules are consulted before the built-in ones."""
    return list(extra) + list(MODEL_FAMILY_RULES)
