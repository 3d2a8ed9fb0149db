"""Few-shot prompts (WN-7): the first examples of a task's set in front of every question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def fewshot_blocks(examples: DataFrame, shot: Column, k: int, order: Sequence[str], by: Sequence[str] = (), sep: str = "\n\n") -> DataFrame:
    """``(*by, block)``: the first ``k`` examples of each group in ``order``, each written as ``shot``, joined by ``sep``.

    ``order`` must break ties. A group with fewer examples has them all, one without any has no row; with no ``by``
    there is always one row, an empty block if there are no examples. ``k`` rows a group are kept before they
    are sorted, so a group of any size is no single task's.
    """
    by = list(by)
    rows = examples.select(*by, F.struct(*order, shot.alias("_shot")).alias("_row"))
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_row"))  # Spark keeps k rows a group before the shuffle
        first = rows.withColumn("_n", place).where(F.col("_n") <= k).groupBy(*by)
    else:
        first = rows.orderBy("_row").limit(k)
    block = F.array_join(F.transform(F.sort_array(F.collect_list("_row")), lambda r: r["_shot"]), sep)
    return first.agg(block.alias("block"))


def fewshot_prompts(questions: DataFrame, blocks: DataFrame, question: Column, by: Sequence[str] = (), sep: str = "\n\n") -> DataFrame:
    """``questions`` with ``prompt``: its group's block, ``sep`` and the ``question`` text; without examples the question alone."""
    if by:
        rows = questions.join(blocks, list(by), "left")
    else:
        rows = questions.crossJoin(blocks)  # one row
    has = F.coalesce(F.col("block"), F.lit("")) != ""
    return rows.withColumn("prompt", F.when(has, F.concat("block", F.lit(sep), question)).otherwise(question)).drop("block")
