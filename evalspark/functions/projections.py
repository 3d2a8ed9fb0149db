"""Column expressions for result rows (PRJ-1..3, PRJ-6, PRJ-7, PRJ-10, PRJ-11, PRJ-13).

All are built from Spark built-ins so they stay inside whole-stage codegen. Small
fixed lookup tables become ``create_map`` literals (no join, no shuffle).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from evalspark.constants import (
    ENGINE_ALIASES,
    METRIC_NATIVE_SCALE,
    MODEL_FAMILY_RULES,
    TASK_METRIC_SCALE_OVERRIDES,
)

_SEP = "\u0001"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(d: Mapping) -> Column:
    """A ``MAP`` literal from a small Python dict (order kept)."""
    if not d:
        return F.create_map().cast("map<string,double>")
    args = []
    for k, v in d.items():
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


def nonempty(c) -> Column:
    """NULL for NULL or empty text (the source tool treats both as absent)."""
    c = _c(c)
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(c)


def model_identity(top: Column) -> Column:
    """PRJ-1: first non-empty of the model fields of a result object.

    ``top`` is the top-level object as ``MAP<STRING,STRING>`` (nested objects as
    raw JSON text).
    """
    def sub(obj: str, key: str) -> Column:
        return nonempty(F.get_json_object(top.getItem(obj), f"$.{key}"))

    return F.coalesce(
        nonempty(top.getItem("model_name_or_path")),
        nonempty(top.getItem("model_name")),
        sub("config_general", "model_name"),
        sub("config_general", "model"),
        sub("config_general", "model_path"),
        sub("summary_general", "model"),
        nonempty(top.getItem("model")),
        F.lit("unknown"))


def unscope_key(c) -> Column:
    """PRJ-2: drop text up to and including the first ``/`` (``task/metric``)."""
    return F.regexp_replace(_c(c), r"^[^/]*/", "")


def split_task_nshot(c) -> tuple[Column, Column]:
    """PRJ-3: ``base|N`` -> (base, N) when N is all digits, else (name, NULL)."""
    c = _c(c)
    m = c.rlike(r"^(?s)(.*)\|([0-9]+)$")
    base = F.when(m, F.regexp_extract(c, r"^(?s)(.*)\|([0-9]+)$", 1)).otherwise(c)
    n = F.when(m, F.regexp_extract(c, r"^(?s)(.*)\|([0-9]+)$", 2).cast("long"))
    return base, n


def metric_base(metric) -> Column:
    """Metric name before the first comma (``acc,none`` -> ``acc``)."""
    return F.substring_index(_c(metric), ",", 1)


def normalize_to_100(value, metric, task=None,
                     scales: Mapping[str, float] | None = None,
                     overrides: Mapping[tuple[str, str], float] | None = None) -> Column:
    """PRJ-6: ``value * 100 / scale``; the scale is looked up by (task, metric
    name) override first, then by metric name; NULL when unknown."""
    scales = METRIC_NATIVE_SCALE if scales is None else scales
    overrides = TASK_METRIC_SCALE_OVERRIDES if overrides is None else overrides
    base = metric_base(metric)
    scale = literal_map({k: float(v) for k, v in scales.items()})[base]
    if task is not None and overrides:
        omap = literal_map({f"{t}{_SEP}{m}": float(v) for (t, m), v in overrides.items()})
        scale = F.coalesce(omap[F.concat(_c(task), F.lit(_SEP), base)], scale)
    v = _c(value).cast("double")
    return F.when(v.isNull() | _c(metric).isNull(), F.lit(None).cast("double")) \
        .otherwise(v * (F.lit(100.0) / scale))


def is_lower_better(metric, exact: bool = False) -> Column:
    """PRJ-7: lower-cased metric contains ``wer``, ``mer`` or ``cer``.

    Plain substring test, as in the source tool (so ``answer_acc`` fires too);
    ``exact=True`` compares the metric name before the comma instead.
    """
    low = F.lower(_c(metric))
    if exact:
        return F.lower(metric_base(metric)).isin("wer", "mer", "cer")
    return low.contains("wer") | low.contains("mer") | low.contains("cer")


def score_label(task, n_shot, metric, normalized) -> Column:
    """PRJ-13: ``task (N-shot, metric[, raw])``; an empty metric prints ``metric``."""
    m = F.coalesce(metric_base(metric), F.lit(""))
    m = F.when(m == "", F.lit("metric")).otherwise(m)
    raw = F.when(_c(normalized).isNull() | F.isnan(_c(normalized)), F.lit(", raw")).otherwise(F.lit(""))
    return F.concat(_c(task).cast("string"), F.lit(" ("), _c(n_shot).cast("string"),
                    F.lit("-shot, "), m, raw, F.lit(")"))


def score_value(performance, normalized) -> Column:
    """Leaderboard cell: normalized value, else the raw value."""
    n = _c(normalized)
    return F.when(n.isNull() | F.isnan(n), _c(performance)).otherwise(n)


def canonical_suite(c) -> Column:
    """PRJ-10: engine name before ``:`` folded through the alias table (trimmed,
    lower-cased); the ``:suffix`` is kept verbatim; unknown names pass through."""
    c = _c(c)
    s = F.trim(c)
    has_tail = F.instr(s, ":") > 0
    head = F.lower(F.trim(F.substring_index(s, ":", 1)))
    alias = {}
    for name, aliases in ENGINE_ALIASES.items():
        alias[name] = name
        for a in aliases:
            alias[a] = name
    canon = literal_map(alias)[head]
    tail = F.substring(s, F.instr(s, ":") + 1, F.length(s))
    return F.when(canon.isNull(), s).otherwise(
        F.when(has_tail, F.concat(canon, F.lit(":"), tail)).otherwise(canon))


def lower_suite_only(c) -> Column:
    """Lower-case the engine name, keep any ``:suffix`` verbatim."""
    c = _c(c)
    has_tail = F.instr(c, ":") > 0
    return F.when(has_tail, F.concat(F.lower(F.substring_index(c, ":", 1)), F.lit(":"),
                                     F.substring(c, F.instr(c, ":") + 1, F.length(c)))) \
        .otherwise(F.lower(c))


def route_model(c, rules: Sequence[tuple[Sequence[str], str]] | None = None,
                basename_only: bool = False, default: str | None = None, strict: bool = False) -> Column:
    """PRJ-11: first rule whose substrings occur in the lower-cased path wins.

    The rule table is small configuration, so it becomes one ``CASE WHEN``
    chain evaluated in generated code. No match -> ``default`` (NULL), or an error
    that names the model if ``strict`` (the audio suite has no generic loader).
    """
    rules = MODEL_FAMILY_RULES if rules is None else rules
    name = F.lower(_c(c).cast("string"))
    if basename_only:
        name = F.regexp_extract(name, r"([^/]*)/*$", 1)
    expr = None
    for patterns, family in rules:
        cond = None
        for p in patterns:
            t = name.contains(p.lower())
            cond = t if cond is None else (cond | t)
        expr = F.when(cond, F.lit(family)) if expr is None else expr.when(cond, F.lit(family))
    last = F.lit(default).cast("string")
    if strict:
        last = F.raise_error(F.concat(F.lit("no routing rule matches model "), F.coalesce(name, F.lit("NULL")))).cast("string")
    return last if expr is None else expr.otherwise(last)
