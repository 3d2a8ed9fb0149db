"""Catalog of operators bound to the driver tables: one Spark plan per key plus
the equivalent DuckDB SQL used as the correctness oracle.

The driver tables hold no evaluation data, so columns are bound by role (e.g.
``lineitem`` rows act as grounding samples). Every plan reads whole tables.
Floating results are rounded to 6 decimals on both sides so the two engines'
different summation orders cannot change the compared value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalspark.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)
