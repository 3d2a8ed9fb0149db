"""Ordered numbering that stays balanced when one key holds a large share of rows.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task. Here the
rows are range-partitioned on ``(key, order)``, so a hot key is spread over many ranges,
and each row is tagged with its range. Rows are numbered inside (range, key); the only
fact needed across ranges is how many rows of a range's *first* key lie in earlier ranges.
That follows from one row per range (its first key, its last key and the last key's
count) as a running sum. All columns stay in the JVM with their own types.

The operator is eager: the tagged rows are materialized once in the shared checkpoint
folder, so every consumer sees the same ranges (their bounds come from sampling).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.session import cut_lineage

_PID = "_seq_pid"
_RN = "_seq_rn"


def _as_cols(cols: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence,
                  out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row inside its ``keys`` group,
    ordered by ``order`` (ascending, nulls first). ``order`` must break ties
    for a deterministic result. With ``keys=[]`` this is a global row index.
    """
    spark = df.sparkSession
    keys = list(keys)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = _as_cols(order)
    tagged = cut_lineage(df.repartitionByRange(n, *[F.col(k) for k in keys], *order_cols)
                         .withColumn(_PID, F.spark_partition_id()))
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    local = tagged.withColumn(_RN, F.row_number().over(Window.partitionBy(_PID, *keys).orderBy(*order_cols)).cast("long"))

    # One row per range, so at most n: bounded whatever the size of the table.
    ends = tagged.groupBy(_PID).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    last_count = (tagged.join(F.broadcast(ends.select(F.col(_PID).alias("_p"), "_last")),
                              (F.col(_PID) == F.col("_p")) & key.eqNullSafe(F.col("_last")))
                  .groupBy("_p").agg(F.count(F.lit(1)).alias("_count")))
    by_range = Window.orderBy("_p")
    chain = (ends.withColumnRenamed(_PID, "_p").join(last_count, "_p")
             .withColumn("_goes_on", F.coalesce(F.col("_first").eqNullSafe(F.lag("_last").over(by_range))
                                                & F.lag("_p").over(by_range).isNotNull(), F.lit(False)))
             .withColumn("_before", F.when(F.col("_goes_on"), F.lag("_count").over(by_range)).otherwise(0))
             .withColumn("_whole", F.lag(F.col("_first").eqNullSafe(F.col("_last"))).over(by_range))
             .withColumn("_start", F.when(F.col("_goes_on") & F.col("_whole"), 0).otherwise(1))
             .withColumn("_seg", F.sum("_start").over(by_range))
             .withColumn("_off", F.sum("_before").over(Window.partitionBy("_seg").orderBy("_p")))
             .select("_p", "_first", "_off"))
    joined = local.join(F.broadcast(chain), F.col(_PID) == F.col("_p"))
    return joined.select(*df.columns,
                         (F.col(_RN) + F.when(key.eqNullSafe(F.col("_first")), F.col("_off")).otherwise(0)).alias(out))


def global_index(df: DataFrame, order: Sequence, out: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """0-based global position by ``order`` without a single-partition window."""
    res = number_within(df, [], order, out=out, num_partitions=num_partitions)
    return res.withColumn(out, F.col(out) - 1)
