"""Keep-one-row-per-key operators (WN-1..WN-4).

All are ``max_by``/``min_by`` aggregates over a struct of the row, ordered by a
struct of the ordering columns. Unlike ``row_number()`` over a window, the
aggregate is computed partially on the map side, so a key holding a large
share of the rows is reduced before the shuffle and never lands whole in one
task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def keep_one(df: DataFrame, key: Sequence[str], order: Sequence, last: bool = True) -> DataFrame:
    """One row per ``key``: the last (``last=True``) or first row by ``order``.

    ``order`` must be unique within a key for a deterministic survivor; NULL
    key parts form their own group (``groupBy`` semantics).
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    payload = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(True)
    ordering = F.struct(*_cols(order))
    pick = F.max_by(payload, ordering) if last else F.min_by(payload, ordering)
    out = df.groupBy(*key).agg(pick.alias("_row"))
    return out.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def newest_wins(df: DataFrame, key: Sequence[str] = ("model_name", "task", "n_shot", "metric_name"),
                order: Sequence = ("src_mtime", "src_path", "src_pos")) -> DataFrame:
    """WN-1: newest result per key (file mtime, then path, then row position)."""
    return keep_one(df, key, order, last=True)


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """WN-2 / WN-3: later input wins."""
    return keep_one(df, key, order, last=True)


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """WN-4: first registration wins."""
    return keep_one(df, key, order, last=False)
