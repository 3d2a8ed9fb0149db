"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import gc
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.session import cut_lineage, read_table

#: Texts in one batch between the JVM and a Python worker.
TEXT_ROWS = 1000
# ASCII white space: the separators of a "word" everywhere in this package
# (bytes.split() of Python splits on exactly these).
WORD_CLASS = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table with only the named columns, so extra columns never reach an operator."""
    return read_table(spark, sf_dir, name).select(*columns)


def rows_of(df: DataFrame) -> int:
    """Exact row count of an already materialised frame."""
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, with at most TEXT_ROWS texts a batch from here on in its session.

    A batch of Spark's default 10,000 rows may hold a gigabyte of long texts, several
    times over in a Python worker. A smaller setting of the session is left as it is.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > TEXT_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return df


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more.

    Spark does so when the driver's garbage is collected, which a driver with a large
    heap and little to do may put off until the disks of the executors are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hash_bucket(buckets: Column | int, *cols: Column) -> Column:
    """Deterministic bucket in [0, buckets) of the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(buckets) if isinstance(buckets, int) else buckets)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph given by ``edges(a, b)`` (both long).

    Alternating large-star and small-star steps: every step is one partial
    aggregate (minimum per node) and one equi-join, so hub nodes are combined
    map-side and a hot join key is split by AQE. Each round's edges are cut in the
    shared checkpoint folder. Ends when a round leaves the edge set unchanged.

    Returns ``(node, component)`` for every node of an edge; ``component`` is the
    smallest node of its component. Self loops and null ends are ignored.
    """
    e = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
         .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
         .distinct())
    e = cut_lineage(e)
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or (mark["n"], mark["h"]) == seen:
            break
        seen = (mark["n"], mark["h"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.distinct())
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
            .distinct())
