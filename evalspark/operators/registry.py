"""Task-registry operators (SC-1, SC-2, JN-6, JN-7, AG-14, AG-17..AG-19, WN-4).

The registry is configuration (hundreds of rows), read on the driver from YAML
and turned into small tables by :mod:`evalspark.sources.registry`; these
operators are plain joins and aggregates over those tables, so they also work
when a registry is generated at scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evalspark.constants import SNAPSHOT_SUITES
from evalspark.functions.language import canonical_language, flores_subsets


def ordered_distinct(df: DataFrame, key: Sequence[str], value: str, pos: str,
                     out: str = "values") -> DataFrame:
    """Per key: distinct values in order of first appearance (``pos``).

    Distinct ``(key, value)`` pairs are reduced with ``min(pos)`` first (partial
    aggregation), so the per-key array holds only distinct values -- a key with
    a huge number of rows never becomes one big list.
    """
    key = list(key)
    firsts = df.groupBy(*key, value).agg(F.min(pos).alias("_pos"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_pos"), F.col(value)))),
                      lambda s: s[value])
    return firsts.groupBy(*key).agg(arr.alias(out))


def registry_summary(tasks: DataFrame, supers: DataFrame | None = None) -> DataFrame:
    """AG-14: per group: engine, task count, sorted distinct shots joined by
    ``", "``, description; super groups: ``mixed``, summed task count, no shots.

    ``tasks``: ``(group, suite, description, task, n_shots ARRAY<INT>)``;
    ``supers``: ``(super, group, description)``.
    """
    shots = (tasks.select("group", F.explode_outer("n_shots").alias("s")).filter(F.col("s").isNotNull())
             .distinct().groupBy("group")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x.cast("string")),
                               ", ").alias("n_shots")))
    groups = (tasks.groupBy("group")
              .agg(F.first("suite", ignorenulls=True).alias("suite"),
                   F.count("task").alias("n_tasks"),
                   F.first("description", ignorenulls=True).alias("description"))
              .join(shots, "group", "left")
              .select(F.col("group").alias("name"), "suite", "n_tasks",
                      F.coalesce("n_shots", F.lit("")).alias("n_shots"), "description"))
    if supers is None:
        return groups
    sizes = groups.select(F.col("name").alias("group"), "n_tasks")
    sup = (supers.join(sizes, "group", "left")
           .groupBy("super").agg(F.sum(F.coalesce("n_tasks", F.lit(0))).cast("long").alias("n_tasks"),
                                 F.first("description", ignorenulls=True).alias("description"))
           .select(F.col("super").alias("name"), F.lit("mixed").alias("suite"), "n_tasks",
                   F.lit("").alias("n_shots"), "description"))
    return groups.unionByName(sup)


def expand_lang_templates(tasks: DataFrame, valid_langs: DataFrame) -> DataFrame:
    """SC-1: a task whose name or subset contains ``{lang}`` becomes one row per
    language of its group (``valid_langs``: ``(group, lang, lang_pos)``);
    other rows are unchanged."""
    templ = F.col("task").contains("{lang}") | F.coalesce(F.col("subset").contains("{lang}"), F.lit(False))
    plain = tasks.filter(~templ).withColumn("lang_pos", F.lit(None).cast("int"))
    exp = (tasks.filter(templ).join(valid_langs, "group")
           .withColumn("task", F.replace("task", F.lit("{lang}"), F.col("lang")))
           .withColumn("subset", F.replace("subset", F.lit("{lang}"), F.col("lang")))
           .drop("lang"))
    return plain.unionByName(exp)


def validate_selection(selection: DataFrame, known_codes: DataFrame) -> DataFrame:
    """SC-2: per requested ``(group, language, pos)``: ``ok`` when the code is a
    known canonical code; otherwise ``hint`` = the canonical code an alias
    folds to (e.g. ``de`` -> ``deu_Latn``), or NULL for an unknown code."""
    known = known_codes.select(F.col(known_codes.columns[0]).alias("language")).distinct() \
        .withColumn("_known", F.lit(True))
    sel = selection.dropDuplicates(["group", "language"])
    out = sel.join(known, "language", "left")
    return out.select("group", "language", F.coalesce("_known", F.lit(False)).alias("ok"),
                      F.when(F.col("_known").isNull(), canonical_language("language")).alias("hint"))


def requested_languages(requested: Sequence[str], known_codes: DataFrame) -> list[str]:
    """SC-2 for one request: its codes trimmed, each once, in request order.

    Blank ones are passed over. Codes that are not among ``known_codes`` (one column) raise
    ValueError, each with the canonical code that it is an alias of, and the sorted list of valid codes.
    """
    asked = list(dict.fromkeys(c for c in (str(r).strip() for r in requested) if c))
    if not asked:
        return []
    spark = known_codes.sparkSession
    rows = spark.createDataFrame([("", c, i) for i, c in enumerate(asked)], "group string, language string, pos int")
    known = known_codes.select(F.col(known_codes.columns[0]).alias("code")).distinct()
    judged = validate_selection(rows, known).where(~F.col("ok"))
    bad = {r["language"]: r["hint"] for r in judged.join(known, F.col("hint") == F.col("code"), "left")
           .select("language", F.col("code").alias("hint")).collect()}  # codes of one request
    if bad:
        names = ", ".join(f"{c} (use {bad[c]})" if bad[c] and bad[c] != c else c for c in asked if c in bad)
        valid = ", ".join(r["code"] for r in known.orderBy("code").collect())  # configuration
        raise ValueError(f"unknown language codes: {names}; valid codes: {valid}")
    return asked


def select_tasks(tasks: DataFrame, selection: DataFrame) -> DataFrame:
    """JN-6: expand a selection of groups (optionally scoped to languages) into
    ``(task, n_shot, suite)`` rows; first registration wins per (suite, task, shot).

    ``tasks``: ``(group, group_pos, task, task_pos, suite, n_shots, languages)``;
    ``selection``: ``(group, languages ARRAY<STRING> or NULL)``.
    """
    sel = selection.select("group", F.col("languages").alias("_want"))
    j = tasks.join(sel, "group")
    keep = F.col("_want").isNull() | F.arrays_overlap(F.col("languages"), F.col("_want"))
    rows = j.filter(keep).select("group", "group_pos", "task", "task_pos", "suite",
                                 F.explode("n_shots").alias("n_shot"))
    first = rows.groupBy("suite", "task", "n_shot").agg(
        F.min(F.struct("group_pos", "task_pos")).alias("_o"))
    return first.select("task", "n_shot", "suite", F.col("_o.group_pos").alias("group_pos"),
                        F.col("_o.task_pos").alias("task_pos"))


def requirements_for(task_names: DataFrame, datasets: DataFrame) -> DataFrame:
    """JN-7: dataset requirements for bare task names (trimmed); first
    registration wins; unknown names give nothing.

    ``datasets``: ``(task, reg_pos, repo_id, subset, suite)``.
    """
    names = task_names.select(F.trim(F.col(task_names.columns[0])).alias("task")).distinct()
    first = datasets.groupBy("task").agg(F.min_by(F.struct("repo_id", "subset", "suite"), "reg_pos").alias("_d"))
    return names.join(first, "task").select("task", "_d.repo_id", "_d.subset", "_d.suite")


def merge_dataset_specs(reqs: DataFrame) -> DataFrame:
    """AG-17: per (repo, subset): ordered distinct revisions (default
    ``["main"]``) and whether any engine needs a raw snapshot.

    ``reqs``: ``(repo_id, subset, revision, pos, suite)``.
    """
    r = reqs.withColumn("revision", F.coalesce("revision", F.lit("main"))) \
        .withColumn("subset", F.coalesce("subset", F.lit("")))
    revs = ordered_distinct(r, ["repo_id", "subset"], "revision", "pos", out="revisions")
    flag = r.groupBy("repo_id", "subset").agg(F.bool_or(F.col("suite").isin(*SNAPSHOT_SUITES))
                                              .alias("needs_snapshot"))
    return revs.join(flag, ["repo_id", "subset"]) \
        .withColumn("subset", F.when(F.col("subset") == "", F.lit(None)).otherwise(F.col("subset")))


def merge_file_patterns(files: DataFrame) -> DataFrame:
    """AG-18: per (repo, revision): ordered distinct patterns; blank repos skipped.

    ``files``: ``(repo_id, revision, pattern, pos)``.
    """
    f = files.filter(F.length(F.trim(F.coalesce("repo_id", F.lit("")))) > 0) \
        .withColumn("revision", F.coalesce("revision", F.lit("main")))
    return ordered_distinct(f, ["repo_id", "revision"], "pattern", "pos", out="patterns")


def first_seen(df: DataFrame, value: str, pos: str) -> DataFrame:
    """AG-19: distinct values in first-seen order, with that order as ``pos``."""
    return df.groupBy(value).agg(F.min(pos).alias("pos")).orderBy("pos")


def language_matches(selection: DataFrame, available: DataFrame) -> DataFrame:
    """SO-4: ``(language, matched)`` per requested code; ``available`` holds the codes that data exist for."""
    have = available.select(F.col(available.columns[0]).alias("language")).distinct().withColumn("_have", F.lit(True))
    wanted = selection.select(F.col(selection.columns[0]).alias("language")).distinct()
    return wanted.join(have, "language", "left").select("language", F.coalesce("_have", F.lit(False)).alias("matched"))


def expand_selection(requested: DataFrame, tasks: DataFrame, supers: DataFrame | None = None) -> DataFrame:
    """JN-6: ``(name, group, languages)`` for requested ``(name, languages)``: groups, super groups, and ``all``.

    ``all`` stands for every group unless the registry defines it. Unknown names raise.
    The request is configuration; it is the only side that is looked at on the driver.
    """
    groups = tasks.select("group").distinct()
    members = groups.select(F.col("group").alias("name"), "group")
    if supers is not None:
        members = members.unionByName(supers.select(F.col("super").alias("name"), "group").distinct())
    if members.where(F.col("name") == "all").isEmpty():
        members = members.unionByName(groups.select(F.lit("all").alias("name"), "group"))
    out = requested.join(members, "name", "left").select("name", "group", "languages")
    unknown = sorted(r["name"] for r in out.where(F.col("group").isNull()).select("name").distinct().collect())
    if unknown:
        raise ValueError(f"not in the registry: {', '.join(unknown)}")
    return out


def unmatched_languages(tasks: DataFrame, expanded: DataFrame) -> DataFrame:
    """JN-6: ``(name, language)`` asked for that no task of the name has; a name left without any task raises."""
    want = expanded.where(F.col("languages").isNotNull()).select("name", "group", F.explode("languages").alias("language"))
    have = tasks.select("group", F.explode("languages").alias("language")).distinct()
    hit = want.join(have, ["group", "language"], "left_semi").select("name", "language").distinct()
    empty = want.select("name").distinct().join(hit.select("name").distinct(), "name", "left_anti")
    names = sorted(r["name"] for r in empty.collect())  # at most the requested names
    if names:
        raise ValueError(f"no task of the requested languages in: {', '.join(names)}")
    return want.select("name", "language").distinct().join(hit, ["name", "language"], "left_anti")


def aux_requirements(task_names: DataFrame, aux: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-7: auxiliary models ``(repo_id, pos)`` and files ``(repo_id, revision, patterns)`` of scheduled tasks.

    ``task_names``: ``(task, pos)``, trimmed here; ``aux``: ``(task, reg_pos, hf_models
    ARRAY<STRING>, files ARRAY<STRUCT<repo_id, revision, patterns ARRAY<STRING>>>)``. The
    first registration that lists any counts. Repeats keep their first position.
    """
    names = task_names.select(F.trim(F.col("task")).alias("task"), "pos").groupBy("task").agg(F.min("pos").alias("pos"))
    some = (F.coalesce(F.size("hf_models"), F.lit(0)) > 0) | (F.coalesce(F.size("files"), F.lit(0)) > 0)
    first = aux.where(some).groupBy("task").agg(F.min_by(F.struct("hf_models", "files"), "reg_pos").alias("a"))
    need = names.join(first, "task").select("pos", "a.*")
    models = first_seen(need.select(F.posexplode("hf_models").alias("k", "repo_id"), "pos")
                        .select("repo_id", F.struct("pos", "k").alias("pos")), "repo_id", "pos")
    files = (need.select("pos", F.posexplode("files").alias("k", "f"))
             .select("pos", "k", "f.repo_id", "f.revision", F.posexplode("f.patterns").alias("j", "pattern"))
             .select("repo_id", "revision", "pattern", F.struct("pos", "k", "j").alias("pos")))
    return models, merge_file_patterns(files)


def fan_out_pairs(reqs: DataFrame, repo: str, name: str = "task") -> DataFrame:
    """AG-17: requirements on ``repo`` without a subset become one row per translation pair and language of the task name."""
    pairs = flores_subsets(F.col(name))
    bare = (F.col("repo_id") == repo) & F.coalesce(F.length("subset") == 0, F.lit(True))
    return (reqs.withColumn("_s", F.when(bare, pairs).otherwise(F.array("subset")))
            .withColumn("subset", F.explode("_s")).drop("_s"))
