"""Headline-metric choice and per-file roll-up rules over exploded result rows.

Input shape: a *metric bag* is exploded into rows
``(*by, name, key, pos, value DOUBLE, numeric BOOLEAN)`` where ``pos`` is the
key's position in the JSON document (order matters: "first" means document
order). Every rule is a set operation keyed by the file, so nothing depends on
how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.constants import METRIC_FALLBACK_KEYS, PLACEHOLDER_KEYS
from evalspark.functions.projections import literal_map, unscope_key
from evalspark.session import cut_lineage

_INF_TIER = 1_000_000


def collapse_scoped_keys(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """PRJ-2 + T4: un-scope ``task/metric`` keys; when two keys collide, the later
    value wins at the earlier key's position (dict-update semantics)."""
    m = metrics.withColumn("key", unscope_key("key"))
    return (m.groupBy(*by, "key")
            .agg(F.min("pos").alias("pos"),
                 F.max_by(F.struct("value", "numeric"), "pos").alias("_v"))
            .select(*by, "key", "pos", "_v.value", "_v.numeric"))


def metric_tier(key: Column, pref: Column, fallback: Sequence[str] = METRIC_FALLBACK_KEYS) -> Column:
    """Priority of a numeric key (lower wins, ties by document position).

    With a configured metric ``pref``: exact ``pref,none`` (0), exact ``pref`` (1),
    then the first key equal to ``pref`` or starting ``pref,`` (2); nothing else.
    Without: for each fallback name in order, exact (2i) then prefix on the
    name before the comma (2i+1); finally any key without ``stderr`` that is not
    a placeholder key.
    """
    policy = (F.when(key == F.concat(pref, F.lit(",none")), 0)
              .when(key == pref, 1)
              .when(key.startswith(F.concat(pref, F.lit(","))), 2))
    tiers = []
    for i, m in enumerate(fallback):
        base = m.split(",")[0]
        tiers.append(F.when(key == m, 2 * i))
        tiers.append(F.when((key == base) | key.startswith(base + ","), 2 * i + 1))
    tiers.append(F.when(~key.contains("stderr") & ~key.isin(*PLACEHOLDER_KEYS), _INF_TIER))
    fb = F.least(*tiers)
    return F.when(pref.isNotNull(), policy).otherwise(fb)


def attach_policy(df: DataFrame, name_col: str, policy) -> DataFrame:
    """Add ``_pref`` = configured headline metric for ``name_col``.

    ``policy`` is a dict (-> map literal) or a two-column DataFrame
    ``(task, metric)``.
    """
    if policy is None:
        return df.withColumn("_pref", F.lit(None).cast("string"))
    if isinstance(policy, Mapping):
        return df.withColumn("_pref", literal_map(dict(policy))[F.col(name_col)]
                             if policy else F.lit(None).cast("string"))
    p = policy.select(F.col(policy.columns[0]).alias("_ptask"),
                      F.col(policy.columns[1]).alias("_pref"))
    return df.join(p, F.col(name_col) == F.col("_ptask"), "left").drop("_ptask")


def resolve_metric(metrics: DataFrame, by: Sequence[str], name_col: str, policy=None,
                   fallback: Sequence[str] = METRIC_FALLBACK_KEYS) -> DataFrame:
    """PRJ-4: one ``(performance, metric_name)`` per ``by`` group, or no row.

    ``metrics`` has ``*by, name_col, key, pos, value, numeric``. The choice is a
    ``min_by`` aggregate on ``(tier, pos)`` -- partial aggregation, no window.
    """
    by = list(by)
    grp = by if name_col in by else by + [name_col]
    m = attach_policy(metrics.filter(F.col("numeric")), name_col, policy)
    m = m.withColumn("_tier", metric_tier(F.col("key"), F.col("_pref"), fallback))
    m = m.filter(F.col("_tier").isNotNull())
    return (m.groupBy(*grp)
            .agg(F.min_by(F.struct(F.col("value").alias("performance"),
                                   F.col("key").alias("metric_name")),
                          F.struct("_tier", "pos")).alias("_r"))
            .select(*grp, "_r.performance", "_r.metric_name"))


def shot_as_int(text: Column) -> Column:
    """Shot value text -> integer when it is a JSON number or a digit string."""
    num = text.rlike(r"^-?[0-9]+(\.[0-9]*)?([eE][-+]?[0-9]+)?$")
    return F.when(num, text.cast("double").cast("long"))


def global_n_shot(shots: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """AG-3: per file, the single distinct integer shot value, else NULL."""
    v = shot_as_int(F.col(value).cast("string"))
    return (shots.groupBy(*by)
            .agg(F.when(F.count_distinct(v) == 1, F.max(v)).alias("global_n_shot")))


def canonical_shot(c: Column) -> Column:
    """Shot text in canonical form (``5``, not ``5.0``); non-numbers kept as text."""
    s = c.cast("string")
    as_int = shot_as_int(s)
    return F.when(as_int.isNotNull() & (s.cast("double") == as_int.cast("double")),
                  as_int.cast("string")).otherwise(s)


def prefix_candidates(name: Column, min_prefix: str) -> Column:
    """All prefixes of ``name`` that end just before an ``_`` and start with
    ``min_prefix`` (used to turn "X starts with Y_" into an equi join on Y)."""
    positions = F.filter(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))),
                         lambda i: F.substring(name, i, 1) == F.lit("_"))
    prefixes = F.transform(positions, lambda i: F.substring(name, F.lit(1), i - 1))
    return F.filter(prefixes, lambda p: p.startswith(min_prefix) & (F.length(p) > len(min_prefix) - 1))


def drop_prefix_subtasks(tasks: DataFrame, file_col: str, task_col: str,
                         aggregates: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """FLT-2 and FLT-3 within one file.

    * ``mmlu_*`` is dropped when the same file has ``mmlu`` among its tasks or
      its ``aggregates`` (group names); a lone ``mmlu_pro`` survives.
    * ``global_mmlu_X`` is dropped when another ``global_mmlu_Y`` of the same
      file satisfies ``X startswith Y_``. Candidate prefixes are generated per
      name, so this is an equi semi join on (file, prefix), not a theta join.

    Both rules look in ``known``, all results of the file (default: ``tasks``), so a
    prefix counts even if another rule has already dropped its own row.
    """
    names = (tasks if known is None else known).select(F.col(file_col).alias("_f"), F.col(task_col).alias("_t"))
    has_mmlu = names.filter(F.col("_t") == "mmlu").select("_f")
    if aggregates is not None:
        has_mmlu = has_mmlu.unionByName(
            aggregates.filter(F.col(aggregates.columns[1]) == "mmlu")
            .select(F.col(aggregates.columns[0]).alias("_f")))
    has_mmlu = has_mmlu.distinct().withColumn("_mm", F.lit(True))
    t = F.col(task_col)
    out = (tasks.join(has_mmlu, F.col(file_col) == F.col("_f"), "left").drop("_f")
           .filter(~(t.startswith("mmlu_") & (t != "mmlu") & F.col("_mm").isNotNull()))
           .drop("_mm"))
    gm = names.filter(F.col("_t").startswith("global_mmlu_"))
    cands = (gm.select("_f", "_t", F.explode(prefix_candidates(F.col("_t"), "global_mmlu_")).alias("_p"))
             .filter(F.col("_p") != F.col("_t")))
    hit = cands.join(gm.select("_f", F.col("_t").alias("_p")), ["_f", "_p"], "left_semi") \
        .select("_f", "_t").distinct()
    return out.join(hit, (F.col(file_col) == F.col("_f")) & (t == F.col("_t")), "left_anti")


def descend_groups(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """AG-1: which groups of a file emit a headline row, in breadth-first order.

    ``groups``: ``(file_id, group, group_pos, has_metric)``;
    ``edges``: ``(file_id, parent, child, child_pos)``.
    The walk starts at groups that are nobody's subtask (all groups when that set is empty,
    i.e. cyclic metadata), in document order; a group with a metric is emitted; a
    metric-less group is replaced by its child *groups* in their order, behind
    everything that waits already; each group is visited once, at its first turn. Returns
    ``(file_id, group, level, group_pos, visit)`` of emitted groups; ``visit`` counts
    the file's visited groups from 0.

    Files never interact and a file's metadata comes from one row, so the walk is a fold
    over one file's levels inside one plan: no job and no checkpoint a level, any depth,
    and a group that many paths lead to is still one entry (paths are never listed).
    """
    names = groups.select("file_id", F.col("group").alias("child"))
    bare = groups.where(~F.col("has_metric")).select("file_id", F.col("group").alias("parent"))
    kids = (edges.join(bare, ["file_id", "parent"], "left_semi").join(names, ["file_id", "child"], "left_semi")
            .groupBy("file_id", "parent").agg(F.sort_array(F.collect_list(F.struct("child_pos", "child"))).alias("kids"))
            .groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("parent", F.col("kids.child").alias("kids")))).alias("kids")))
    under = edges.groupBy("file_id").agg(F.collect_set("child").alias("under"))
    files = (groups.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("group_pos", "group"))).alias("g"))
             .join(under, "file_id", "left").join(kids, "file_id", "left")
             .withColumn("roots", F.array_except(F.col("g.group"), F.coalesce("under", F.array().cast("array<string>"))))
             .withColumn("roots", F.when(F.size("roots") > 0, F.col("roots")).otherwise(F.array_distinct("g.group"))))
    no_names = F.array().cast("array<string>")
    start = F.struct(F.col("roots").alias("front"), F.col("roots").alias("seen"),
                     F.array_repeat(F.lit(0), F.size("roots")).alias("levels"))

    def level(walk: Column, n: Column) -> Column:
        below = F.flatten(F.transform(walk["front"], lambda name: F.coalesce(F.try_element_at("kids", name), no_names)))
        front = F.array_except(below, walk["seen"])  # keeps the first of each, in order
        return F.struct(front.alias("front"), F.concat(walk["seen"], front).alias("seen"),
                        F.concat(walk["levels"], F.array_repeat(n, F.size(front))).alias("levels"))

    # No walk has more levels than the file has metric-less parents, and one for what is below the last.
    steps = F.when(F.col("kids").isNotNull(), F.sequence(F.lit(1), F.size("kids"))).otherwise(F.array().cast("array<int>"))
    walked = files.select("file_id", F.aggregate(steps, start, level).alias("w"))
    visits = (walked.select("file_id", F.posexplode(F.arrays_zip(F.col("w.seen").alias("group"), F.col("w.levels").alias("level"))).alias("visit", "v"))
              .select("file_id", "v.group", "v.level", "visit"))
    return (visits.join(groups.where("has_metric").select("file_id", "group", "group_pos"), ["file_id", "group"])
            .select("file_id", "group", "level", "group_pos", "visit"))


def mean_of_children(parents: DataFrame, edges: DataFrame, child_metrics: DataFrame,
                     policy=None) -> DataFrame:
    """AG-2: headline of an empty placeholder parent = mean of its children.

    ``parents``: ``(file_id, parent, policy_name)``; ``edges``:
    ``(file_id, parent, child, child_pos)``; ``child_metrics``: exploded bags
    ``(file_id, child, key, pos, value, numeric)``. Children are resolved under
    the *parent's* metric policy; the metric name is the first resolving
    child's. Returns ``(file_id, parent, performance, metric_name, n_present,
    n_expected)``; a parent without any resolving child gives no row.
    """
    expected = edges.groupBy("file_id", "parent").agg(F.count(F.lit(1)).alias("n_expected"))
    kids = (parents.join(edges, ["file_id", "parent"])
            .join(child_metrics, ["file_id", "child"]))
    resolved = resolve_metric(kids, ["file_id", "parent", "child", "child_pos"], "policy_name", policy)
    return (resolved.groupBy("file_id", "parent")
            .agg(F.avg("performance").alias("performance"),
                 F.min_by("metric_name", "child_pos").alias("metric_name"),
                 F.count(F.lit(1)).alias("n_present"))
            .join(expected, ["file_id", "parent"]))
