"""Run provenance joins (JN-9, JN-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- FIXED VALUES: task groups that are only valid on a pinned engine version ---
GROUP_VERSION_PINS: dict[str, tuple[tuple[str, str], ...]] = {
    "dclm-core-22": (("lm_eval", "0.4.9.2"),),
}
# --- end of fixed values ---


def _dirname(c: Column) -> Column:
    return F.regexp_replace(c, r"/[^/]*$", "")


def ancestors(path: Column) -> Column:
    """Every ancestor directory of a file path, nearest first."""
    d = _dirname(path)
    positions = F.filter(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))),
                         lambda i: F.substring(d, i, 1) == F.lit("/"))
    prefixes = F.transform(positions, lambda i: F.substring(d, F.lit(1), i - 1))
    return F.reverse(F.filter(F.concat(prefixes, F.array(d)), lambda p: p != ""))


def attach_runs(rows: DataFrame, provenance: DataFrame, path_col: str = "src_path") -> DataFrame:
    """JN-11: the run that produced each result row: the provenance record in
    the nearest ancestor directory of the result file. Ancestors are exploded
    so the match is an equi join; the nearest one wins (``max_by`` depth)."""
    prov = provenance.select(_dirname(F.col("_path")).alias("_dir"), "_path")
    files = rows.select(F.col(path_col).alias("_src")).distinct()
    anc = files.select("_src", F.posexplode(ancestors(F.col("_src"))).alias("_depth", "_dir"))
    hit = anc.join(prov, "_dir").groupBy("_src").agg(F.min_by("_path", "_depth").alias("run_path"))
    return rows.join(hit, F.col(path_col) == F.col("_src"), "left").drop("_src")


def pin_violations(run_groups: DataFrame, runs: DataFrame, pins: dict | None = None) -> DataFrame:
    """JN-9: runs that used a version-pinned task group on another engine version.

    ``run_groups``: ``(_path, group)``; ``runs``: ``(_path, record MAP<STRING,STRING>)``
    with ``record['engine_versions']`` as recorded at schedule time. A missing
    recorded version is a violation too (the pin cannot be confirmed).
    """
    pins = GROUP_VERSION_PINS if pins is None else pins
    spark = runs.sparkSession
    pin_df = spark.createDataFrame([(g, m, v) for g, lst in pins.items() for m, v in lst],
                                   "group string, module string, required string")
    versions = runs.select("_path", F.from_json(F.col("record")["engine_versions"],
                                                "map<string,string>").alias("_v"))
    j = run_groups.join(F.broadcast(pin_df), "group").join(versions, "_path", "left")
    recorded = F.col("_v")[F.col("module")]
    return (j.select("_path", "group", "module", "required", recorded.alias("recorded"))
            .filter(F.col("recorded").isNull() | (F.col("recorded") != F.col("required"))))
