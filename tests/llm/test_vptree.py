"""Vantage-point search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import vptree

SCHEMA = "vec_id long, embedding array<double>"


def brute(ids, x, asked, k):
    out = {}
    for i, q in zip(ids, x):
        if asked(i):
            score = np.einsum("j,ij->i", q, x)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    x = centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16))
    x[100:160] = x[100]  # ties
    return np.arange(1500) * 2, x


def test_tree_is_exact_at_factor_one_and_relaxed_beyond(cloud):
    ids, x = cloud
    x = x / np.linalg.norm(x, axis=1, keepdims=True)  # clusters on a sphere, where distances can prune
    q = x[::10]
    largest = np.linalg.norm(x, axis=1).max()
    tree = vptree.Tree(x, largest, leaf_rows=32)
    truth = brute(ids, x, lambda i: i % 20 == 0, 10)
    compared, recall = [], []
    for relax in (1.0, 2.0, 50.0):
        i, j, n = tree.search(q, 10, relax, np.arange(0, 1500, 10))
        best = vptree.best_of(i, ids[j], np.einsum("ij,ij->i", q[i], x[j]), 10)
        got = {}
        for a, b in zip(i[best], j[best]):
            got.setdefault(int(ids[a * 10]), []).append(int(ids[b]))
        recall.append(np.mean([len(set(got.get(k, ())) & {t for t, _ in v}) / 10 for k, v in truth.items()]))
        compared.append(n)
    assert recall[0] == 1.0 and recall[1] >= recall[2]
    assert compared[0] < 0.9 * len(q) * len(x) and compared[0] >= compared[1] >= compared[2]


def test_matches_brute_force_over_many_shards_and_groups(spark, cloud, with_extras):
    ids, x = cloud
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], SCHEMA)
    got = vptree.nearest(with_extras(df), F.col("vec_id") % 20 == 0, relax=1.0, shard_rows=300, query_rows=40).collect()
    assert len(got) == 150 * 20
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for i, want in brute(ids, x, lambda i: i % 20 == 0, 20).items():
        assert [by[i][k + 1][0] for k in range(20)] == [v for v, _ in want]
        assert np.allclose([by[i][k + 1][1] for k in range(20)], [s for _, s in want], rtol=0, atol=1e-9)


def test_production_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.toPandas().sort_values("vec_id")
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(np.float64)
    truth = brute(ids, x, lambda i: i % 20 == 0, 20)
    got = vptree.query(spark, "/root/testdata/sf0.01").toPandas()
    hits = sum(len(set(g["vec_id"]) & {v for v, _ in truth[q]}) for q, g in got.groupby("query_id"))
    assert len(got) == 20 * len(truth) and hits >= 0.9 * len(got)


def test_unusable_vectors_repeats_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
        (6, [inf, 1.0]), (7, [1.0, None]), (None, [5.0, 5.0]), (20, [1.0]), (8, [])], SCHEMA)
    got = vptree.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0)]


def test_empty(spark):
    assert vptree.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
