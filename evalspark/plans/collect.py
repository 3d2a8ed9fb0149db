"""The collect job: result files -> resolved, normalized, newest-wins fact table.

Stages (all keyed by file path, so files never interact before the dedup):
SRC-1/2 scan + tolerant parse -> PRJ-12 plugin claims -> AG-1 group pass ->
FLT-1..3 roll-up exclusion -> PRJ-5 shot resolution -> AG-2 placeholder means ->
PRJ-4 headline metric -> PRJ-6 normalization -> SO-1 union -> WN-1 newest wins.
Shuffles happen at the per-file groupings and at the final dedup aggregate.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.constants import PLACEHOLDER_KEYS
from evalspark.functions.projections import nonempty, normalize_to_100, split_task_nshot
from evalspark.operators.dedup import newest_wins
from evalspark.session import cut_lineage, measured_broadcasts
from evalspark.operators.resolve import (
    canonical_shot,
    collapse_scoped_keys,
    descend_groups,
    drop_prefix_subtasks,
    global_n_shot,
    mean_of_children,
    prefix_candidates,
    resolve_metric,
)
from evalspark.sources.results import (
    config_shot,
    group_entries,
    metric_rows,
    parse_results,
    scan_provenance,
    scan_result_files,
    shot_entries,
    subtask_edges,
    task_entries,
)

FACT_COLUMNS = ["model_name", "task", "n_shot", "performance", "performance_normalized", "metric_name"]


def src_pos(step: int, pos: Column) -> Column:
    """Order of a row in its file: groups in the order of their visits, then tasks in document order."""
    return F.struct(F.lit(step).alias("step"), pos.cast("long").alias("pos")).alias("src_pos")


@dataclass(frozen=True)
class ResultParser:
    """UD-2: a plugin's first-chance claim on a result file.

    A file is claimed when one of its ``results`` keys starts with ``prefix``
    (and, if given, that task's metrics contain ``required_key``); the first
    such task (document order) becomes the file's single row. Non-numeric
    metrics are dropped; the shot comes from ``configs.<task>.num_fewshot``
    (default 0). Parsers are tried in list order.
    """
    name: str
    prefix: str
    required_key: str | None = None


@dataclass(frozen=True)
class PythonParser:
    """UD-2: a user's own parser of a whole result file.

    ``parse`` gets the file's JSON object as a dict and returns ``(model, task, n_shot,
    {metric: value})``, or None if the file is not its own. A parser that raises (or
    returns something else) loses its claim on that one file, which goes on to the next
    parser and the generic rules; the error is a row of ``Collected.parser_errors``.
    Metrics that are no numbers are dropped.
    """
    name: str
    parse: Callable[[dict], tuple | None]


# Plugin parsers shipped with the source tool, in its discovery order.
DEFAULT_PARSERS = (
    ResultParser("audiobench", "audiobench_"),
    ResultParser("regiondial_bench", "regiondial_", "gIoU"),
)


@dataclass
class Collected:
    facts: DataFrame       # newest-wins fact table (+ src_* lineage columns)
    rows: DataFrame        # every resolved row before the dedup
    completed: DataFrame   # (model, task, n_shot) of every row, taken before dedup (T11)
    rejects: DataFrame     # (path, reason)
    provenance: DataFrame  # (_path, raw, record)
    placeholder_audit: DataFrame  # parents with only some children present
    zero_row_files: DataFrame     # (path): result files that gave no row (AG-22)
    parser_errors: DataFrame      # (path, parser, error): user parsers that raised (UD-2)
    metricless_tasks: DataFrame   # (path, task): entries that should give a row but have no numeric metric (AG-22)

    def findings(self) -> DataFrame:
        """AG-22 in one table: ``(finding, path, task, n_present, n_expected)``."""
        def rows(finding: str, found: DataFrame) -> DataFrame:
            kept = [F.col(c) if c in found.columns else F.lit(None).cast(kind).alias(c)
                    for c, kind in (("path", "string"), ("task", "string"), ("n_present", "long"), ("n_expected", "long"))]
            return found.select(F.lit(finding).alias("finding"), *kept)

        with measured_broadcasts(self.rows.sparkSession):
            return cut_lineage(rows("zero rows", self.zero_row_files).unionByName(rows("no metric", self.metricless_tasks))
                               .unionByName(rows("children absent", self.placeholder_audit)))


def _shot_lookup(shots: DataFrame) -> DataFrame:
    """Last entry wins per (path, name), like a dict."""
    return (shots.groupBy("path", "name")
            .agg(F.max_by("value", "shot_pos").alias("shot"), F.min("shot_pos").alias("shot_pos")))


PARSED = ("path string, rank int, parser string, model string, task string, n_shot string, "
          "metrics array<struct<key:string,value:double>>, error string")


def _python_claims(ok: DataFrame, parsers) -> DataFrame:
    """Outcomes of the user parsers, one row per file and parser that claims it or raises; a file's first claim ends its parsers."""
    ranked = [(rank, p) for rank, p in enumerate(parsers) if isinstance(p, PythonParser)]

    def outcome(p: PythonParser, text: str) -> tuple | None:
        try:
            found = p.parse(json.loads(text))
            if not found:
                return None
            model, task, n_shot, metrics = found
            bag = [(str(k), float(v)) for k, v in metrics.items() if isinstance(v, (int, float))]
            return str(model), str(task), None if n_shot is None else str(n_shot), bag, None
        except Exception as e:  # noqa: BLE001 - a user's code: its failure is this file's and this parser's
            return None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(),
                 pa.list_(pa.struct([("key", pa.string()), ("value", pa.float64())])), pa.string()]
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                for rank, p in ranked:
                    found = outcome(p, text)
                    if found:
                        bag = found[3] and [{"key": k, "value": v} for k, v in found[3]]
                        rows.append((path, rank, p.name, *found[:3], bag, found[4]))
                        if found[4] is None:
                            break
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PARSED.split(", ")])

    return ok.select("path", "text").mapInArrow(run, PARSED)


def _python_rows(ok: DataFrame, claims: DataFrame, policy) -> DataFrame:
    """The row of each file that a user parser claims."""
    bags = claims.select("path", "task", F.posexplode("metrics").alias("pos", "m")).select(
        "path", "task", "m.key", F.col("pos").cast("long").alias("pos"), "m.value", F.lit(True).alias("numeric"))
    res = resolve_metric(collapse_scoped_keys(bags, ["path", "task"]), ["path"], "task", policy)
    j = res.join(claims.select("path", "model", "n_shot"), "path").join(ok.select("path", "mtime"), "path")
    return j.select(F.col("model").alias("model_name"), "task", F.coalesce(canonical_shot(F.col("n_shot")), F.lit("unknown")).alias("n_shot"),
                    "performance", "metric_name", F.col("path").alias("src_path"), F.col("mtime").alias("src_mtime"), src_pos(0, F.lit(0)))


def _claims(tasks: DataFrame, parsers) -> DataFrame:
    parts = []
    for rank, p in enumerate(parsers):
        if not isinstance(p, ResultParser):
            continue
        cand = tasks.filter(F.col("task").startswith(p.prefix) &
                            F.from_json("task_json", "map<string,string>").isNotNull())
        if p.required_key is not None:
            cand = cand.filter(F.map_contains_key(F.from_json("task_json", "map<string,string>"),
                                                  p.required_key))
        parts.append(cand.select("path", "task", "task_pos", F.lit(rank).alias("rank")))
    if not parts:
        return tasks.sparkSession.createDataFrame([], "path string, rank int, task string, task_pos int")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    first = u.groupBy("path").agg(F.min_by(F.struct("rank", "task", "task_pos"), F.struct("rank", "task_pos")).alias("_c"))
    return first.select("path", "_c.rank", "_c.task", "_c.task_pos")


def _plugin_rows(ok: DataFrame, claimed: DataFrame, bags: DataFrame, policy) -> DataFrame:
    m = bags.join(claimed.select("path", "task"), ["path", "task"])
    res = resolve_metric(m, ["path"], "task", policy)
    meta = ok.select("path", "mtime", "top",
                     F.coalesce(nonempty(F.col("top")["model_name_or_path"]),
                                nonempty(F.col("top")["model_name"]), F.lit("unknown")).alias("model_name"))
    j = res.join(meta, "path")
    shot = canonical_shot(config_shot(j, F.col("task")).try_cast("double").cast("long"))
    return j.select("model_name", "task", shot.alias("n_shot"), "performance", "metric_name",
                    F.col("path").alias("src_path"), F.col("mtime").alias("src_mtime"),
                    src_pos(0, F.lit(0)))


def _first_child_shot(names: DataFrame, name_col: str, edges: DataFrame, shots: DataFrame) -> DataFrame:
    """Shot of the first listed subtask of ``name_col`` that has a shot entry."""
    e = names.select("path", F.col(name_col).alias("parent")).distinct().join(edges, ["path", "parent"])
    e = e.join(shots.select("path", F.col("name").alias("child"), "shot"), ["path", "child"])
    return e.groupBy("path", "parent").agg(F.min_by("shot", "child_pos").alias("sub_shot"))


def _group_rows(groups: DataFrame, shots: DataFrame, glob: DataFrame, edges: DataFrame, policy) -> DataFrame:
    gclean, gparsed = split_task_nshot(F.col("group"))
    bags = collapse_scoped_keys(metric_rows(groups, "group"), ["path", "group"])
    bags = bags.withColumn("gname", split_task_nshot(F.col("group"))[0])
    resolved = resolve_metric(bags, ["path", "group"], "gname", policy)
    flagged = (groups.join(resolved.select("path", "group", F.lit(True).alias("has_metric")),
                           ["path", "group"], "left")
               .select(F.col("path").alias("file_id"), "group", F.col("group_pos").cast("long").alias("group_pos"),
                       F.coalesce("has_metric", F.lit(False)).alias("has_metric")))
    emitted = descend_groups(flagged, edges.withColumnRenamed("path", "file_id")) \
        .withColumnRenamed("file_id", "path")
    rows = emitted.join(resolved, ["path", "group"])
    own = shots.select("path", F.col("name").alias("group"), F.col("shot").alias("own"))
    sub = _first_child_shot(rows, "group", edges, shots).withColumnRenamed("parent", "group")
    rows = rows.join(own, ["path", "group"], "left").join(sub, ["path", "group"], "left") \
        .join(glob, "path", "left")
    n_shot = F.coalesce(canonical_shot(F.col("own")), canonical_shot(F.col("sub_shot")),
                        F.col("global_n_shot").cast("string"), gparsed.cast("string"), F.lit("unknown"))
    return rows.select("path", gclean.alias("task"), n_shot.alias("n_shot"), "performance", "metric_name",
                       src_pos(0, F.col("visit")))


def _task_rows(groups: DataFrame, tasks: DataFrame, bags: DataFrame, shots: DataFrame, glob: DataFrame,
               edges: DataFrame, policy, linked: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, incomplete placeholder parents, entries without a numeric metric).

    ``linked``: whether any file names groups or subtasks; without any, what depends on them is left out of the plan.
    """
    groups = groups.select("path", "group")
    has_groups = groups.select("path").distinct()
    agg_names = groups.select("path", F.col("group").alias("task")) \
        .unionByName(edges.select("path", F.col("parent").alias("task"))).distinct()
    sub_names = edges.select("path", F.col("child").alias("task")).distinct()

    t = tasks.filter(F.col("task") != "all")
    if linked:
        t = t.join(agg_names.join(has_groups, "path"), ["path", "task"], "left_anti")
        t = t.join(sub_names, ["path", "task"], "left_anti")
    t = drop_prefix_subtasks(t, "path", "task", aggregates=groups if linked else None, known=tasks)
    clean, parsed = split_task_nshot(F.col("task"))
    t = t.withColumn("clean", clean).withColumn("parsed", parsed)

    # regular tasks: headline metric under the task's own (clean) name
    reg = t.filter(~F.col("placeholder")).select("path", "task", "task_pos", "clean", "parsed")
    reg_res = resolve_metric(bags.join(reg, ["path", "task"]), ["path", "task", "task_pos", "parsed"],
                             "clean", policy)
    bare = reg.select("path", "task").join(reg_res.select("path", "task"), ["path", "task"], "left_anti")

    # placeholder parents: mean of children resolved under the parent's policy
    ph = t.filter(F.col("placeholder")).select("path", "task", "task_pos", "clean", "parsed")
    parents = ph.select(F.col("path").alias("file_id"), F.col("clean").alias("parent"),
                        F.col("clean").alias("policy_name"))
    child_metrics = bags.select(F.col("path").alias("file_id"), F.col("task").alias("child"),
                                "key", "pos", "value", "numeric")
    means = mean_of_children(parents, edges.withColumnRenamed("path", "file_id"), child_metrics, policy)
    ph_res = ph.join(means.withColumnRenamed("file_id", "path").withColumnRenamed("parent", "clean"),
                     ["path", "clean"])
    audit = ph_res.filter(F.col("n_present") < F.col("n_expected")) \
        .select("path", F.col("clean").alias("task"), "n_present", "n_expected")

    cols = ["path", "task", "task_pos", "clean", "parsed", "performance", "metric_name"]
    rows = reg_res.select(*cols)
    if linked:
        rows = rows.unionByName(ph_res.select(*cols))

    # PRJ-5 shot resolution
    own = shots.select("path", F.col("name").alias("clean"), F.col("shot").alias("own"))
    agg_clean = rows.join(agg_names.withColumnRenamed("task", "clean"), ["path", "clean"], "left_semi")
    sub = _first_child_shot(agg_clean, "clean", edges, shots).withColumnRenamed("parent", "clean")
    if not linked:
        sub = sub.limit(0)
    mmlu = (shots.filter(F.col("name").startswith("mmlu_")).groupBy("path")
            .agg(F.min_by("shot", "shot_pos").alias("mmlu_shot")).withColumn("clean", F.lit("mmlu")))
    gm = (shots.filter(F.col("name").startswith("global_mmlu_"))
          .select("path", "shot", "shot_pos",
                  F.explode(prefix_candidates(F.col("name"), "global_mmlu_")).alias("clean"))
          .groupBy("path", "clean").agg(F.min_by("shot", "shot_pos").alias("gm_shot")))
    rows = (rows.join(own, ["path", "clean"], "left").join(sub, ["path", "clean"], "left")
            .join(glob, "path", "left").join(mmlu, ["path", "clean"], "left")
            .join(gm, ["path", "clean"], "left"))
    n_shot = F.coalesce(canonical_shot(F.col("own")), canonical_shot(F.col("sub_shot")),
                        F.col("global_n_shot").cast("string"), canonical_shot(F.col("mmlu_shot")),
                        canonical_shot(F.col("gm_shot")), F.col("parsed").cast("string"), F.lit("unknown"))
    out = rows.select("path", F.col("clean").alias("task"), n_shot.alias("n_shot"), "performance",
                      "metric_name", src_pos(1, F.col("task_pos")))
    return out, audit, bare


def collect_results(spark: SparkSession, root: str, policy=None, parsers=DEFAULT_PARSERS,
                    scales=None, overrides=None) -> Collected:
    """Collect every result file below ``root`` into one fact table.

    ``policy``: headline metric per task (dict or ``(task, metric)`` table).
    """
    files = scan_result_files(spark, root)
    return collect_from_files(files, policy, parsers, scales, overrides,
                              provenance=scan_provenance(spark, root))


def collect_from_files(files: DataFrame, policy=None, parsers=DEFAULT_PARSERS, scales=None,
                       overrides=None, provenance: DataFrame | None = None) -> Collected:
    """The collect job over an already-scanned ``(path, mtime, text)`` table
    (a directory scan, a compacted file table, or one streaming micro-batch)."""
    with measured_broadcasts(files.sparkSession):
        return _collected(files, policy, parsers, scales, overrides, provenance)


def _collected(files: DataFrame, policy, parsers, scales, overrides, provenance: DataFrame | None) -> Collected:
    spark = files.sparkSession
    ok, rejects = parse_results(files)
    # Parse once: every later branch reads this reliable checkpoint (shared
    # folder named by spark.checkpoint.dir) instead of re-parsing the JSON.
    ok = cut_lineage(ok if any(isinstance(p, PythonParser) for p in parsers) else ok.withColumn("text", F.lit(None).cast("string")))
    # What the files' maps hold is exploded once, too; the many joins below read these narrow tables.
    keys = F.map_keys(F.from_json("task_json", "map<string,string>"))
    no_metric = F.coalesce(F.forall(keys, lambda k: k.isin(*PLACEHOLDER_KEYS)), F.lit(True))
    tasks = cut_lineage(task_entries(ok).withColumn("placeholder", no_metric))
    claimed = cut_lineage(_claims(tasks, parsers))
    bags = cut_lineage(collapse_scoped_keys(metric_rows(tasks, "task"), ["path", "task"]))
    tasks = tasks.drop("task_json")
    own = errors = None
    if any(isinstance(p, PythonParser) for p in parsers):
        outcomes = cut_lineage(_python_claims(ok, parsers))
        own = outcomes.where(F.col("error").isNull())
        errors = outcomes.where(F.col("error").isNotNull()).select("path", "parser", "error")
        # Of a prefix claim and a user parser's claim on one file, the first listed holds.
        first = claimed.select("path", F.col("rank").alias("r"))
        late = own.join(first, "path").where(F.col("r") < F.col("rank")).select("path")
        own = cut_lineage(own.join(late, "path", "left_anti"))
        claimed = cut_lineage(claimed.join(own.select("path"), "path", "left_anti"))
    taken = claimed.select("path") if own is None else claimed.select("path").unionByName(own.select("path"))
    ok = ok.drop("text")
    ok_g, tasks_g = ok, tasks
    if not taken.isEmpty():
        ok_g, tasks_g = (df.join(taken, "path", "left_anti") for df in (ok, tasks))
    shots_raw = cut_lineage(shot_entries(ok_g))
    shots = _shot_lookup(shots_raw)
    glob = global_n_shot(shots_raw, ["path"])
    edges, groups = cut_lineage(subtask_edges(ok_g)), cut_lineage(group_entries(ok_g))

    plugin = _plugin_rows(ok, claimed, bags, policy)
    linked = not (groups.isEmpty() and edges.isEmpty())
    trows, audit, bare = _task_rows(groups, tasks_g, bags, shots, glob, edges, policy, linked)
    generic = trows
    if linked:
        generic = _group_rows(groups, shots, glob, edges, policy).unionByName(trows)
    meta = ok_g.select("path", F.col("model").alias("model_name"), F.col("mtime").alias("src_mtime"))
    generic = generic.join(meta, "path").select(
        "model_name", "task", "n_shot", "performance", "metric_name",
        F.col("path").alias("src_path"), "src_mtime", "src_pos")
    if own is not None:
        plugin = plugin.unionByName(_python_rows(ok, own, policy))
        claimed = claimed.select("path", "task").unionByName(own.select("path", "task"))
    rows = plugin.unionByName(generic)
    rows = rows.withColumn("metric_name", F.coalesce("metric_name", F.lit(""))) \
        .withColumn("performance_normalized",
                    normalize_to_100("performance", "metric_name", "task", scales, overrides))
    # the resolved rows feed the dedup, the completed set and the audits
    rows = cut_lineage(rows)
    facts = newest_wins(rows.select(*FACT_COLUMNS, "src_path", "src_mtime", "src_pos"))
    zero = ok_g.select("path").join(rows.select(F.col("src_path").alias("path")), "path", "left_anti")
    unclear = claimed.select("path", "task").join(plugin.select(F.col("src_path").alias("path")), "path", "left_anti")
    completed = rows.select(F.col("model_name").alias("model"), "task", "n_shot")
    if errors is None:
        errors = spark.createDataFrame([], "path string, parser string, error string")
    if provenance is None:
        provenance = spark.createDataFrame([], "_path string, raw string, record map<string,string>")
    return Collected(facts=facts, rows=rows, completed=completed, rejects=rejects,
                     provenance=provenance, placeholder_audit=audit, zero_row_files=zero, parser_errors=errors,
                     metricless_tasks=bare.unionByName(unclear))


def check_missing(collected: Collected, jobs: DataFrame) -> DataFrame:
    """JN-4 over the collected (pre-dedup) completed set."""
    from evalspark.operators.analysis import missing_jobs
    return missing_jobs(jobs, collected.completed)
