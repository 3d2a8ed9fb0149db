"""Result-file sources (SRC-1, SRC-2, SRC-5) and the per-file tables they feed.

Each JSON file becomes one row (``wholetext``) carrying its path and mtime.
Parsing is two-stage so one odd value cannot null a whole file (T2): the top
level and ``results`` are parsed as ``MAP<STRING,STRING>`` (raw JSON per entry,
document order kept, T1), then each task's metric bag as
``MAP<STRING,VARIANT>`` so numbers, booleans and strings stay distinguishable
(T3). Everything downstream is keyed by the file path.

Many small files: set ``spark.sql.files.maxPartitionBytes`` /
``openCostInBytes`` so a task reads many files; for millions of files compact
them once into a (path, mtime, text) table and start from that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.functions.jsonpath import is_variant_number, json_kind
from evalspark.functions.projections import model_identity


_NONFINITE = "non-finite:"


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def _read_whole(spark: SparkSession, root: str, glob: str) -> DataFrame:
    df = (spark.read.option("recursiveFileLookup", True)
          .option("pathGlobFilter", glob).text(root, wholetext=True))
    return df.select(F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_modification_time").alias("mtime"),
                     F.col("value").alias("text"))


def scan_result_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC-1: every ``*.json`` below ``root/results`` (if that directory exists)
    else below ``root``, at any depth, except files named ``provenance.json``.
    Columns: ``path, mtime, text``."""
    if not _is_dir(spark, root):
        raise ValueError(f"Results directory does not exist: {root}")
    search = root.rstrip("/") + "/results"
    if not _is_dir(spark, search):
        search = root
    files = _read_whole(spark, search, "*.json")
    return files.filter(~F.col("path").endswith("/provenance.json"))


def scan_provenance(spark: SparkSession, root: str) -> DataFrame:
    """SRC-5: every ``provenance.json`` below ``root``; unreadable or non-object
    files are skipped. Columns: ``_path, raw, record MAP<STRING,STRING>``."""
    files = _read_whole(spark, root, "provenance.json")
    ok = files.filter(json_kind(F.col("text")) == "ok")
    return ok.select(F.col("path").alias("_path"), F.col("text").alias("raw"),
                     F.from_json("text", "map<string,string>").alias("record")).orderBy("_path")


def name_nonfinite(text: Column) -> Column:
    """Bare ``NaN`` and ``Infinity`` values as marked strings, which JSON parsers keep (T5).

    A value follows an unescaped quote and a colon, so text inside strings never matches.
    """
    marked = F.regexp_replace(text, r'(?<!\\)("\s*:\s*)(NaN|-?Infinity)(?=\s*[,}])', f'$1"{_NONFINITE}$2"')
    return F.when(text.contains("NaN") | text.contains("Infinity"), marked).otherwise(text)


def parse_results(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-2: ``(ok, rejects)``.

    ``ok``: ``path, mtime, text, top MAP<STRING,STRING>, model`` for result objects
    whose ``results`` (if present) is an object. ``rejects``: ``path, reason``
    with ``unreadable``, ``not_object`` (e.g. a bare per-sample array) or
    ``results_not_object`` (e.g. this engine's own envelope).
    """
    files = files.withColumn("raw", F.col("text")).withColumn("text", name_nonfinite(F.col("text")))
    kind = json_kind(F.col("text"))
    top = F.from_json(F.col("text"), "map<string,string>")
    with_kind = files.select("path", "mtime", "raw", kind.alias("kind"), top.alias("top"))
    res = F.col("top").getItem("results")
    res_ok = res.isNull() | F.from_json(res, "map<string,string>").isNotNull()
    classified = with_kind.withColumn(
        "reason", F.when(F.col("kind") != "ok", F.col("kind"))
        .when(~res_ok, F.lit("results_not_object")))
    ok = (classified.filter(F.col("reason").isNull())
          .select("path", "mtime", F.col("raw").alias("text"), "top", model_identity(F.col("top")).alias("model")))
    rejects = classified.filter(F.col("reason").isNotNull()).select("path", "reason")
    return ok, rejects


def _entries(ok: DataFrame, field: str, prefix: str) -> DataFrame:
    m = F.from_json(F.col("top").getItem(field), "map<string,string>")
    return ok.select("path", F.posexplode(m).alias(f"{prefix}_pos", prefix, f"{prefix}_json"))


def task_entries(ok: DataFrame) -> DataFrame:
    """``(path, task_pos, task, task_json)`` from ``results`` in document order."""
    return _entries(ok, "results", "task")


def group_entries(ok: DataFrame) -> DataFrame:
    """``(path, group_pos, group, group_json)`` from ``groups``."""
    return _entries(ok, "groups", "group")


def subtask_edges(ok: DataFrame) -> DataFrame:
    """``(path, parent, child, child_pos)`` from ``group_subtasks``."""
    m = F.from_json(F.col("top").getItem("group_subtasks"), "map<string,array<string>>")
    g = ok.select("path", F.explode(m).alias("parent", "children"))
    return g.select("path", "parent", F.posexplode("children").alias("child_pos", "child"))


def metric_rows(entries: DataFrame, name: str) -> DataFrame:
    """Explode each entry's metric bag: ``(path, name, key, pos, value, numeric)``.

    A value is numeric when it is a JSON number or boolean; numeric strings
    are not (T3). Booleans count as 1.0 / 0.0; NaN and infinities are numeric (T5).
    """
    bag = F.from_json(F.col(f"{name}_json"), "map<string,variant>")
    e = entries.select("path", name, F.posexplode(bag).alias("pos", "key", "v"))
    text = F.try_variant_get("v", "$", "string")
    nonfinite = F.when(text.startswith(_NONFINITE), F.substring(text, len(_NONFINITE) + 1, 9).cast("double"))
    numeric = F.coalesce(is_variant_number(F.col("v")), F.lit(False)) | nonfinite.isNotNull()
    value = F.when(numeric, F.coalesce(nonfinite, F.try_variant_get("v", "$", "double"),
                                       F.try_variant_get("v", "$", "boolean").cast("double")))
    return e.select("path", name, "key", F.col("pos").cast("long").alias("pos"),
                    value.alias("value"), numeric.alias("numeric"))


def shot_entries(ok: DataFrame) -> DataFrame:
    """``(path, shot_pos, name, value)``: ``n-shot`` entries, or -- when that map
    is missing or empty -- ``configs.<task>.num_fewshot`` where not null."""
    nshot = F.from_json(F.col("top").getItem("n-shot"), "map<string,string>")
    base = ok.select("path", nshot.alias("_n"),
                     F.from_json(F.col("top").getItem("configs"), "map<string,string>").alias("_c"))
    has = F.coalesce(F.size("_n") > 0, F.lit(False))
    direct = base.filter(has).select("path", F.posexplode("_n").alias("shot_pos", "name", "value"))
    cfg = (base.filter(~has).select("path", F.posexplode("_c").alias("shot_pos", "name", "_cfg"))
           .select("path", "shot_pos", "name",
                   F.get_json_object("_cfg", "$.num_fewshot").alias("value"))
           .filter(F.col("value").isNotNull()))
    return direct.unionByName(cfg)


def config_shot(ok: DataFrame, task: Column) -> Column:
    """``configs.<task>.num_fewshot`` for a plugin-claimed task (default 0)."""
    return F.coalesce(F.get_json_object(F.from_json(F.col("top").getItem("configs"),
                                                    "map<string,string>")[task], "$.num_fewshot"),
                      F.lit("0"))
