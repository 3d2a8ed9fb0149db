"""Ordered numbering: types survive, hot keys span ranges, against a plain window."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Window, functions as F

from evalspark.operators.sequence import global_index, number_within


def test_values_and_types_survive(spark):
    big, nan = 2 ** 53 + 1, float("nan")
    rows = [(big, nan, Decimal("1.10"), dt.datetime(2024, 1, 1), 1), (None, nan, None, None, 2), (2 ** 60 + 7, None, Decimal("9.99"), None, 3),
            (big, 1.5, None, dt.datetime(2024, 1, 2), 4), (None, None, None, None, 5)]
    df = spark.createDataFrame(rows, "a long, k double, d decimal(10,2), ts timestamp_ntz, i int")
    for parts in (1, 2, 5):
        got = number_within(df, ["k"], ["i"], num_partitions=parts)
        assert got.schema[:-1] == df.schema
        by = {r["i"]: r for r in got.collect()}
        assert [by[i]["rn"] for i in (1, 2, 3, 4, 5)] == [1, 2, 1, 1, 2]
        assert [by[i]["a"] for i in (1, 2, 3, 4, 5)] == [big, None, 2 ** 60 + 7, big, None]
        assert by[1]["k"] != by[1]["k"] and by[3]["k"] is None and by[1]["d"] == Decimal("1.10") and by[4]["ts"] == rows[3][3]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_hot_key_over_many_ranges(spark, parts):
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 37 % 3001).alias("o"))
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("long"))
    assert sorted(map(tuple, number_within(df, ["k"], ["o"], num_partitions=parts).collect())) == sorted(map(tuple, want.collect()))
    idx = {r["o"]: r["idx"] for r in global_index(df, ["o"], num_partitions=parts).collect()}
    assert [idx[o] for o in sorted(idx)] == list(range(3000))


def test_empty(spark):
    assert number_within(spark.createDataFrame([], "k int, o int"), ["k"], ["o"]).collect() == []
