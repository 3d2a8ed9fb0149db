"""EX-1 (extension, not a source-tool operator): incremental collection.

Result files arriving in a directory are read as a file stream (one row per
whole file). Each micro-batch runs the same collect job as the batch path and
is merged into the fact table with the WN-1 rule (newest file mtime, then
path, then row position wins). The table is written as a new version folder
per batch id, on top of the newest complete version of an earlier batch: a re-run
of a batch rewrites its own folder from the same base, and readers only take
folders that Spark has finished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalspark.operators.dedup import newest_wins
from evalspark.plans.collect import DEFAULT_PARSERS, FACT_COLUMNS, collect_from_files

FACT_SCHEMA = ("model_name string, task string, n_shot string, performance double, "
               "performance_normalized double, metric_name string, src_path string, "
               "src_mtime timestamp, src_pos struct<step:int,pos:long>")


def result_file_stream(spark: SparkSession, root: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming ``(path, mtime, text)`` rows for new ``*.json`` files below ``root``."""
    s = (spark.readStream.format("text").option("wholetext", True)
         .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
         .option("maxFilesPerTrigger", max_files_per_trigger).load(root))
    return (s.select(F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_modification_time").alias("mtime"),
                     F.col("value").alias("text"))
            .filter(~F.col("path").endswith("/provenance.json")))


def latest_version(spark: SparkSession, table_dir: str, below: int | None = None) -> str | None:
    """The newest complete version folder (of a batch before ``below``), on any file system."""
    root = spark._jvm.org.apache.hadoop.fs.Path(table_dir)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    versions = []
    for status in fs.listStatus(root):
        path = status.getPath()
        name = path.getName()
        if name.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            versions.append((int(name[len("batch="):]), path.toString()))
    return max((v for v in versions if below is None or v[0] < below), default=(0, None))[1]


def merge_batch(table_dir: str, policy=None, parsers=DEFAULT_PARSERS):
    """``foreachBatch`` function: collect the batch and upsert by the WN-1 key."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = collect_from_files(batch, policy, parsers).facts.select(*FACT_COLUMNS, "src_path", "src_mtime",
                                                                      "src_pos")
        base = latest_version(spark, table_dir, below=batch_id)
        if base is not None:
            new = spark.read.parquet(base).unionByName(new)
        newest_wins(new).write.mode("overwrite").parquet(f"{table_dir.rstrip('/')}/batch={batch_id}")

    return run


def start_collect_stream(spark: SparkSession, root: str, table_dir: str, checkpoint: str,
                         policy=None, once: bool = False):
    """Start the incremental collect; ``once=True`` processes what is there and stops."""
    w = (result_file_stream(spark, root).writeStream.foreachBatch(merge_batch(table_dir, policy))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()
