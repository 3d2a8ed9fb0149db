"""Table sources: job CSVs (SRC-3, SRC-4), registry YAML (SRC-6), per-sample
shards (SRC-7), result envelopes (SRC-8), score CSVs (SRC-9), parallel corpora
(SRC-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evalspark.operators.dedup import last_wins
from evalspark.operators.jobs import normalize_job_suites
from evalspark.operators.registry import expand_lang_templates
from evalspark.session import cut_lineage
from evalspark.sources.json_array import MOST_RANGES, read_json_array
from evalspark.sources.results import _is_dir

JOB_COLUMNS = ("model_path", "task_path", "n_shot")


def read_jobs_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: a job CSV; requires ``model_path, task_path, n_shot``; a missing or
    NULL ``eval_suite`` becomes ``lm_eval`` (engine name lower-cased)."""
    df = spark.read.option("header", True).csv(path)
    missing = [c for c in JOB_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"CSV file must contain the columns: {', '.join(JOB_COLUMNS)}")
    return normalize_job_suites(df)


def scan_jobs(spark: SparkSession, root: str) -> DataFrame:
    """SRC-3 + WN-2: every ``jobs.csv`` below ``root``; on duplicate
    (model_path, task_path, n_shot) the later-sorted file / later row wins. Columns
    go by each file's own header; a tree without a file gives an empty table."""
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "jobs.csv").text(root)
             .select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"), "value"))
    heads = lines.groupBy("_file").agg(F.min_by("value", "_row").alias("head"), F.min("_row").alias("first"))
    frames = []
    # Files of one header are read together by that header, so columns go by name.
    for (head,) in heads.select("head").distinct().collect():  # distinct headers, not files
        names = [n.strip().strip('"') for n in head.lstrip("\ufeff").split(",")]
        own = heads.where(F.col("head") == head).select("_file", "first")
        row = F.from_csv(F.col("value"), F.lit(", ".join(f"`{n}` string" for n in names)))
        frames.append(lines.join(own, "_file").where(F.col("_row") > F.col("first")).where(F.trim("value") != "")
                      .select(row.alias("r"), "_file", "_row").select("r.*", "_file", "_row"))
    if not frames:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in (*JOB_COLUMNS, "eval_suite")))
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    key = [c for c in JOB_COLUMNS if c in df.columns]
    out = last_wins(df, key, ["_file", "_row"]) if key else df
    return out.drop("_file", "_row")


def load_registry(spark: SparkSession, paths: Sequence[str]) -> dict[str, DataFrame]:
    """SRC-6: registry YAML files (core first, plugins after; a later file wins
    per key) as small tables: ``tasks`` (templates expanded), ``groups``,
    ``supers`` and ``task_metrics``. The YAML is configuration (kilobytes) and
    is read on the driver; everything after is DataFrame work."""
    import yaml

    merged: dict = {"task_metrics": {}, "task_groups": {}, "super_groups": {}}
    for p in paths:
        with open(p) as f:
            data = yaml.safe_load(f) or {}
        for k in merged:
            merged[k].update(data.get(k) or {})
    task_rows, lang_rows, group_rows = [], [], []
    for gpos, (gname, g) in enumerate(merged["task_groups"].items()):
        group_rows.append((gname, gpos, g.get("suite"), g.get("description")))
        for lpos, lang in enumerate(g.get("valid_langs") or []):
            lang_rows.append((gname, lang, lpos))
        for tpos, tk in enumerate(g.get("tasks") or []):
            task_rows.append((gname, gpos, tk.get("task"), tpos, tk.get("suite") or g.get("suite"),
                              tk.get("n_shots") or g.get("n_shots") or [], tk.get("dataset") or g.get("dataset"),
                              tk.get("subset"), tk.get("revisions") or ["main"], tk.get("hf_models") or [],
                              g.get("description"),
                              [(f.get("repo_id"), f.get("revision"), f.get("patterns") or [])
                               for f in tk.get("hf_dataset_files") or []]))
    tasks = spark.createDataFrame(task_rows, "group string, group_pos int, task string, task_pos int, "
                                             "suite string, n_shots array<int>, dataset string, subset string, "
                                             "revisions array<string>, hf_models array<string>, description string, "
                                             "hf_dataset_files array<struct<repo_id:string,revision:string,patterns:array<string>>>")
    langs = spark.createDataFrame(lang_rows, "group string, lang string, lang_pos int")
    tasks = expand_lang_templates(tasks, langs)
    from evalspark.functions.language import task_languages
    tasks = tasks.withColumn("languages", task_languages("task", "subset"))
    supers = spark.createDataFrame(
        [(s, g_["task"], i, sd.get("description")) for s, sd in merged["super_groups"].items()
         for i, g_ in enumerate(sd.get("task_groups") or [])],
        "super string, group string, pos int, description string")
    if "all" not in merged["super_groups"] and "all" not in merged["task_groups"]:  # spans every group
        supers = supers.unionByName(groups_of(group_rows, spark))
    metrics = spark.createDataFrame(list(merged["task_metrics"].items()), "task string, metric string")
    groups = spark.createDataFrame(group_rows, "group string, group_pos int, suite string, description string")
    return {"tasks": tasks, "groups": groups, "supers": supers, "task_metrics": metrics}


def groups_of(group_rows: list[tuple], spark: SparkSession) -> DataFrame:
    """The generated super group ``all``."""
    return spark.createDataFrame([("all", r[0], r[1], "Every task group") for r in group_rows],
                                 "super string, group string, pos int, description string")


SAMPLE_SCHEMA = ("array<struct<image_id:string,intersection:double,union:double,bbox_iou:double>>")


def read_sample_shards(spark: SparkSession, root: str, schema: str = SAMPLE_SCHEMA) -> DataFrame:
    """SRC-7: every ``output_*.json`` below ``root`` (a JSON array of per-turn
    records per file), with ``(shard_path, pos)`` as the output order (T14). A
    record that is not an object stays a row with a NULL ``record`` (failed
    sample). Raises when there is no file. A shard is one value of one task; use
    :func:`read_sample_array` for shards of many gigabytes."""
    if not _any_file(spark, root, "output_*.json"):
        raise FileNotFoundError(f"no output_*.json below {root}")
    files = (spark.read.option("recursiveFileLookup", True)
             .option("pathGlobFilter", "output_*.json").text(root, wholetext=True)
             .select(F.col("_metadata.file_path").alias("shard_path"), "value"))
    items = files.select("shard_path", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "raw"))
    return items.select("shard_path", F.col("pos").cast("long").alias("pos"), _record("raw", schema).alias("record"))


def _record(raw: str, schema: str) -> Column:
    """A sample record of JSON text, NULL where the text is no object."""
    return F.when(F.from_json(raw, "map<string,string>").isNotNull(), F.from_json(raw, schema[len("array<"):-1]))


def read_sample_array(spark: SparkSession, root: str, schema: str = SAMPLE_SCHEMA, glob: str = "output_*.json") -> DataFrame:
    """SRC-7 for arrays of any size: as :func:`read_sample_shards`, but one file is read by many tasks.

    See :func:`evalspark.sources.json_array.read_json_array` for what is refused and when it is read.
    """
    return read_json_array(spark, root, glob).select("shard_path", "pos", _record("raw", schema).alias("record"))


def read_sample_lines(spark: SparkSession, root: str, schema: str = SAMPLE_SCHEMA, glob: str = "output_*.jsonl") -> DataFrame:
    """SRC-7 for one record per line, splittable within a file; the same columns.

    ``pos`` is the number of the line in its file, from 0; blank lines count but give no
    row. A byte range's lines are numbered by Spark's row ids, its offset follows from one row a range.
    """
    if not _any_file(spark, root, glob):
        raise FileNotFoundError(f"no {glob} below {root}")
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
             .select(F.col("_metadata.file_path").alias("shard_path"), F.col("_metadata.file_block_start").alias("_at"),
                     F.monotonically_increasing_id().alias("_row"), "value"))
    before = Window.partitionBy("shard_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut_lineage(lines.groupBy("shard_path", "_at").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
                         .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    if ranges.count() > MOST_RANGES:  # the bound of the broadcast below
        raise ValueError(f"more than {MOST_RANGES} byte ranges: read the files in several calls")
    place = F.col("_row") - F.col("_first")
    moved = F.raise_error(F.lit("the byte ranges of the files changed between two passes: set spark.sql.files.minPartitionNum"))
    pos = F.when((place >= 0) & (place < F.col("_n")), place + F.col("_offset")).otherwise(moved.cast("long"))
    return (lines.join(F.broadcast(ranges), ["shard_path", "_at"], "left").select("shard_path", pos.alias("pos"), "value")
            .where(F.trim("value") != "").select("shard_path", "pos", _record("value", schema).alias("record")))


def _in_parts(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder that Spark wrote, whose parts are its content."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/part-*")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def _any_file(spark: SparkSession, root: str, glob: str) -> bool:
    """Whether a file of that name pattern lies below ``root``; a listing, no data is read."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).format("binaryFile").load(root)
    return not files.select("path").isEmpty()


ENVELOPE_ROW = ("struct<model:string,task:string,n_shot:string,metric:string,"
                "performance:double,performance_normalized:double>")


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: result rows of an envelope file (or folder of parts, see SNK-2), or of ``eval_results.json`` (else
    legacy ``results.json``) in a directory; missing -> FileNotFoundError.
    ``n_shot`` is text (int or ``unknown``)."""
    p = path
    if _is_dir(spark, path) and not _in_parts(spark, path):
        cand = path.rstrip("/") + "/eval_results.json"
        jvm = spark._jvm
        hp = jvm.org.apache.hadoop.fs.Path(cand)
        fs = hp.getFileSystem(spark._jsc.hadoopConfiguration())
        p = cand if fs.exists(hp) else path.rstrip("/") + "/results.json"
    jvm = spark._jvm
    hp = jvm.org.apache.hadoop.fs.Path(p)
    if not hp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hp):
        raise FileNotFoundError(f"Results file not found: {p}")
    if _in_parts(spark, p):  # a document in parts: every result is a line of its own
        lines = spark.read.text(p).select(F.regexp_replace("value", "^,", "").alias("value"), F.monotonically_increasing_id().alias("pos"))
        row = F.from_json("value", ENVELOPE_ROW)
        return lines.where(F.col("value").startswith('{"model"')).select("pos", row.alias("r")).select("pos", "r.*")
    doc = spark.read.text(p, wholetext=True)
    rows = F.from_json(F.get_json_object("value", "$.results"), f"array<{ENVELOPE_ROW}>")
    return doc.select(F.posexplode(rows).alias("pos", "r")).select("pos", "r.*")


def read_score_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """SRC-9: union of result CSVs (input order kept in ``input_no``, row order
    in ``pos``); unreadable files are skipped; ``metric_name`` and
    ``performance_normalized`` are optional."""
    frames = []
    for i, p in enumerate(paths):
        try:
            df = spark.read.option("header", True).option("inferSchema", False).csv(p)
            df.isEmpty()  # reads the first rows, so an unreadable file fails here
        except Exception:  # noqa: BLE001
            continue
        frames.append(df.withColumn("input_no", F.lit(i)).withColumn("pos", F.monotonically_increasing_id()))
    if not frames:
        raise ValueError("no valid CSV files provided")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    required = {"model_name", "task", "n_shot", "performance"}
    if not required.issubset(out.columns):
        raise ValueError(f"input CSVs missing columns: {required - set(out.columns)}")
    if "metric_name" not in out.columns:
        out = out.withColumn("metric_name", F.lit(""))
    if "performance_normalized" not in out.columns:
        out = out.withColumn("performance_normalized", F.lit(None).cast("double"))
    return out.withColumn("performance", F.col("performance").cast("double")) \
        .withColumn("performance_normalized", F.col("performance_normalized").cast("double")) \
        .withColumn("pos", F.struct("input_no", "pos"))


def _splits(spark: SparkSession, path: str, corpus: DataFrame) -> DataFrame:
    """The distinct splits as text: from the folder names if the corpus is partitioned by split, else from the column."""
    listing = spark.read.format("binaryFile").load(path)  # content is not selected, so no file is opened
    source = listing if "split" in listing.columns else corpus
    return source.select(F.col("split").cast("string").alias("split")).distinct()


def read_parallel_corpus(spark: SparkSession, path: str, split: str, fmt: str = "parquet") -> DataFrame:
    """SRC-10: the requested split of a corpus partitioned by ``split``; if it
    is absent and exactly one split exists, that one is used; else ValueError with
    the splits there are (the first hundred by name). Any number of splits; over a
    partitioned layout only folders are listed."""
    df = spark.read.format(fmt).load(path)
    splits = _splits(spark, path, df)
    if splits.where(F.col("split") == split).isEmpty():
        names = [r["split"] for r in splits.orderBy("split").limit(101).collect()]
        if len(names) != 1:
            more = ", ..." if len(names) > 100 else ""
            raise ValueError(f"split {split!r} not found; available: {', '.join(map(str, names[:100]))}{more}")
        split = names[0]
    return df.filter(F.col("split") == split)
