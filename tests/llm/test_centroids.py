"""Centroid clustering: brute force in Python integers, pruning, edge rows, its SQL."""

import hashlib
import math

import numpy as np
import pytest

from evalspark.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, rounds, dim):
    """{row number: (cluster, distance)} and the centroids, all in Python integers."""
    kept = []
    for n, (i, v) in enumerate(rows):
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((n, i, [math.floor(64 * x) for x in v]))
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for _, i, v in kept if i is not None)
    c = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, g in groups.items():
            c[j] = [sum(col) // len(g) for col in zip(*g)]
    return {n: (nearest(v)[1], nearest(v)[0]) for n, _, v in kept}, c


def check(spark, rows, k, rounds, dim):
    found, centroids = C.cluster(spark.createDataFrame(rows, SCHEMA), k, rounds, dim)
    want, c = brute(rows, k, rounds, dim)
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in found.collect())
    assert got == sorted((rows[n][0] is None, rows[n][0] or 0, *cd) for n, cd in want.items())
    assert [r["centroid"] for r in centroids.orderBy("cluster").collect()] == c
    full = C.described(found, centroids).collect()
    assert all(r["inertia"] == sum(d for _, d in want.values()) for r in full)
    for r in full:
        assert r["cluster_inertia"] == sum(d for j, d in want.values() if j == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 5)) * rng.choice([0.01, 1, 1000], size=(300, 1))
    check(spark, [(i, v.tolist()) for i, v in enumerate(x)], 7, 3, 5)


def test_ties_repeated_rows_and_empty_clusters(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-1, 2, size=(400, 3)) / 64
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 30 + [(None, x[1].tolist())] * 3
    check(spark, rows, 40, 3, 3)
    check(spark, [(i, [0.0, 0.0]) for i in range(50)], 4, 3, 2)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, []), (2, [1.0]), (3, [1.0, None])], [(1, [float("nan"), 0.0]), (2, [float("inf"), 0.0])],
                                  [(1, [0.5, -0.01])], [(5, [1.0, 2.0]), (5, [3.0, 4.0]), (None, [9.0, 9.0])], [(1, [2e6, -2e6]), (2, [2e6, -1.9e6]), (3, [0.0, 1e-9])]])
def test_edge_tables(spark, rows, with_extras):
    check(spark, rows, 2, 3, 2)
    found, centroids = C.cluster(with_extras(spark.createDataFrame(rows, SCHEMA)), 2, 3, 2)
    assert C.described(found, centroids).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_too_large_components_take_no_part(spark):
    rows = [(1, [1e30, 0.0]), (2, [0.0, 0.0]), (3, [0.1, 0.1])]
    found, _ = C.cluster(spark.createDataFrame(rows, SCHEMA), 2, 1, 2)
    assert sorted(r["vec_id"] for r in found.collect()) == [2, 3]


def test_other_types_of_components(spark):
    found, _ = C.cluster(spark.sql("SELECT 1 AS vec_id, array(1, 2) AS embedding UNION ALL SELECT 2, array(3, 4)"), 2, 1, 2)
    assert found.count() == 2


def test_both_inequalities_reject(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(2000, 16)) * 64 + rng.normal(size=(2000, 1)) * 300).astype(np.int64)
    x[::2] *= 7
    c = x[:64].copy()
    number, best, compared = C.Centroids(c).search(x)
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
    assert compared < 0.5 * every.size


def test_large_products_are_compared_exactly():
    g = 1 << 31
    assert C._exceeds(np.array([g, g]), 4, np.array([(g * g) // 4, (g * g) // 4 - 1])).tolist() == [False, True]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_matches_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/{sf}/embeddings.parquet')")
    want = con.execute(C.oracle_sql()).fetchall()
    got = C.query(spark, f"/root/testdata/{sf}").collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, got))
