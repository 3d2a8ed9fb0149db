"""Driver contract: entry() runs; every plan matches its oracle SQL on sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "giou" in df.columns


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
    core = E.plans
    assert set(core.QUERIES) == set(core.ORACLE)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.plans.ORACLE))
def test_plan_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, cur.fetchall())


def test_slices_properties(spark):
    df = E.queries()["slices"](spark, SF)
    n = df.count()
    sizes = [r[1] for r in df.groupBy("slice").count().collect()]
    per = max(sizes)
    assert df.select("o_orderkey").distinct().count() == n
    assert sum(sizes) == n and all(per - s < per for s in sizes)
