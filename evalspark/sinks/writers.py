"""Sinks (SNK-1..SNK-5)."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, functions as F

from evalspark.functions.projections import is_lower_better
from evalspark.operators.grounding import expected_turns
from evalspark.operators.sequence import global_index

SCHEMA_VERSION = "1.2"
ENGINE_VERSION = "0.1.0"


def write_results(facts: DataFrame, path: str, fmt: str = "csv") -> int:
    """SNK-1: the six-column fact table as CSV (with header) or Parquet; returns the number of rows written.

    The rows are counted by the write itself.
    """
    cols = ["model_name", "task", "n_shot", "performance", "performance_normalized", "metric_name"]
    seen = Observation()
    w = facts.select(*cols).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return seen.get["rows"]


def envelope_rows(facts: DataFrame) -> DataFrame:
    """SNK-2 row form: ``model_name -> model``, ``metric_name -> metric``, NULL kept."""
    return facts.select(F.col("model_name").alias("model"), "task", "n_shot",
                        F.col("metric_name").alias("metric"), "performance", "performance_normalized")


def write_envelope_lines(facts: DataFrame, runs: list[dict], path: str, header: dict | None = None) -> None:
    """SNK-2 as JSON lines (splittable): ``header.json`` with version, runs and metadata, ``rows`` with one object a line."""
    spark = facts.sparkSession
    head = json.dumps(_header(runs, header))
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/header.json")
    envelope_rows(facts).write.mode("overwrite").json(f"{path.rstrip('/')}/rows")


def _header(runs: list[dict], extra: dict | None) -> dict:
    return {"version": SCHEMA_VERSION, "generated_at": datetime.now(UTC).isoformat(), "engine_version": ENGINE_VERSION,
            "metadata": {}, "runs": runs or []} | (extra or {})


def write_envelope(facts: DataFrame, runs: list[dict], path: str, header: dict | None = None) -> dict:
    """SNK-2 as one JSON document (schema v1.2), written by the executors at any size.

    ``path`` becomes a folder of text parts whose concatenation, in name order, is the
    document; rows keep their order in the files they came from. ``header`` adds or
    replaces keys of the document's head (a reader that expects another key for the
    engine's version gets it here). Returns the head.
    """
    head = _header(runs, header)
    order = [F.col(c) for c in ("src_mtime", "src_path", "src_pos") if c in facts.columns] or [F.lit(0)]
    text = F.to_json(F.struct(*[F.col(c) for c in ("model", "task", "n_shot", "metric", "performance", "performance_normalized")]),
                     {"ignoreNullFields": "false"})
    rows = (facts.withColumn("model", F.col("model_name")).withColumn("metric", F.col("metric_name"))
            .select(F.lit(1).alias("part"), F.struct(*order).alias("at"), text.alias("value")))
    numbered = global_index(rows, ["at", "value"], out="no")
    body = numbered.select("no", F.concat(F.when(F.col("no") > 0, ",").otherwise(""), "value").alias("value"))
    spark = facts.sparkSession
    ends = spark.createDataFrame([(-1, json.dumps(head)[:-1] + ', "results": ['), (2 ** 62, "]}")], "no long, value string")
    (ends.unionByName(body).repartitionByRange("no").sortWithinPartitions("no").select("value")
     .write.mode("overwrite").text(path))
    return head


def report_lines(facts: DataFrame) -> DataFrame:
    """SNK-3: Markdown report lines: header, one line per row (normalized
    ``%.2f`` else raw ``%.4f*``), and only the footnotes that apply."""
    norm = F.col("performance_normalized")
    cell = F.when(norm.isNotNull(), F.format_string("%.2f", norm)) \
        .otherwise(F.concat(F.format_string("%.4f", "performance"), F.lit("*")))
    body = facts.select(F.concat(F.lit("| "), F.col("model_name"), F.lit(" | "), F.col("task"), F.lit(" | "),
                                 F.col("n_shot").cast("string"), F.lit(" | "), F.col("metric_name"), F.lit(" | "),
                                 cell, F.lit(" |")).alias("line"), F.lit(1).alias("part"))
    flags = facts.agg(F.bool_or(norm.isNull()).alias("raw"), F.bool_or(is_lower_better("metric_name")).alias("low"))
    spark = facts.sparkSession
    # FIXED VALUES: the report's table head, an output format.
    head = spark.createDataFrame([("| Model | Task | N-shot | Metric | Performance (0–100) |", 0),
                                  ("|-------|------|--------|--------|---------------------|", 0)],
                                 "line string, part int")
    foot = flags.select(F.explode(F.array(
        F.when(F.col("raw") | F.col("low"), F.lit("")),
        F.when(F.col("raw"), F.lit("> `*`: not scaled to 0-100, since the native scale of the metric is unknown.")),
        F.when(F.col("low"), F.lit("> For the error rates WER, MER and CER a smaller value is better."))))
        .alias("line")).filter(F.col("line").isNotNull()).withColumn("part", F.lit(2))
    return head.unionByName(body).unionByName(foot)


def missing_path(output_csv: str) -> str:
    """``<stem>_missing<suffix or .csv>`` next to the output."""
    d, base = os.path.split(output_csv)
    stem, ext = os.path.splitext(base)
    return os.path.join(d, f"{stem}_missing{ext or '.csv'}")


def write_missing(missing: DataFrame, output_csv: str) -> str:
    """SNK-4: missing jobs with the original job columns (re-importable by SRC-4)."""
    p = missing_path(output_csv)
    cols = [c for c in ("model_path", "task_path", "n_shot", "eval_suite") if c in missing.columns]
    missing.select(*cols).write.mode("overwrite").option("header", True).csv(p)
    return p


def write_shards(items: DataFrame, path: str, n: int, order_col: str = "item_no",
                 turns_col: str = "conversational_turns") -> int:
    """SNK-5: item ``i`` goes to shard ``i mod n`` (whole conversations stay
    together); returns the total number of turns. ``items`` must carry a global
    item number ``order_col`` (e.g. from :func:`global_index`)."""
    out = items.withColumn("shard", F.pmod(F.col(order_col), F.lit(n)))
    # Counted by the tasks that write (no shuffle follows), so a lost executor's tasks count once.
    seen = Observation()
    out.observe(seen, expected_turns(items, turns_col).alias("turns")).write.mode("overwrite").partitionBy("shard").json(path)
    return seen.get["turns"]
