"""Pivotal mixing: targets, totals, determinism, expectation, edge rows."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import mixing as M

SCHEMA = "doc_id long, source string, text string"


def targets(sizes):
    """Sharing with re-sharing, round by round, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, list(names)
    left = total
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
        left, free = left - sum(out[s] for s in over), [s for s in free if s not in over]
    return out


def check(got, slack=0.01):
    sizes, taken, want = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        want[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    truth = targets(dict(sizes))
    for s in sizes:
        assert want[s] == pytest.approx(truth[s], rel=1e-9, abs=1e-6)
        assert abs(taken[s] - want[s]) <= slack * want[s] + 1, s
    assert all(r["source_size"] == sizes[r["source"]] for r in got)


def test_whole_table_reruns_and_layouts_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = M.query(spark, "/root/testdata/sf0.01").collect()
    check(got)
    sizes = {r["doc_id"]: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    again = M.mix(docs.repartition(7, "text")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_hot_source_and_caps(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 40:02}", "w " * (1 + i * 7919 % 90)) for i in range(6000)]
    got = M.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    check(got)
    assert any(r["target"] == 3 * r["source_size"] for r in got)


def test_expectation_is_kept(spark):
    """A document's copies average its source's ratio: sources are alike, so documents are trials."""
    rows = [(i, f"s{i % 300:03}", "w " * (5 + i % 11)) for i in range(9000)]
    got = M.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    for size, g in got[got["target"] < 3 * got["source_size"]].groupby("size"):
        ratio = (g["target"] / g["source_size"]).mean()
        assert abs(g["copies"].mean() - ratio) < 0.12, size


def test_edge_rows(spark, with_extras):
    rows = [(1, None, "a b c"), (2, None, None), (3, "x", ""), (None, "x", "d e"), (None, "x", "d e"), (4, "é", "f " * 50), (4, "é", "f " * 50),
            (5, "long", "g " * 100_000), (6, "z", "h")]
    got = M.mix(with_extras(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[(r["source"], r["doc_id"])].add(r["taken"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(len(v) == 1 for v in by.values())
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    truth = targets(dict(sizes))
    assert all(r["target"] == pytest.approx(truth[r["source"]]) for r in got)
    assert M.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    blank = M.mix(spark.createDataFrame([(1, "a", " "), (2, "b", None)], SCHEMA)).collect()
    assert {(r["target"], r["taken"]) for r in blank} == {(0.0, 0)}


def test_no_python_on_the_path(spark):
    plan = M.mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
