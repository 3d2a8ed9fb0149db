"""Embedding near-duplicates: brute force on whole tables and planted groups, edge rows, shared components."""

import duckdb
import numpy as np
import pytest

from evalspark.llm import vectorgraph as G
from evalspark.llm.common import connected_components

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(ids, x, labels):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= G.THRESHOLD) & (labels[:, None] == labels[None, :])
    comp = ids.copy()
    while True:
        new = np.array([comp[near[i]].min() for i in range(len(ids))])
        if (new == comp).all():
            return near.sum(axis=1) - 1, comp
        comp = new


def compare(got, ids, x, labels):
    links, comp = brute(ids, x, labels)
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(ids)
    assert [by[i]["n_links"] for i in ids.tolist()] == links.tolist()
    assert [by[i]["component_id"] for i in ids.tolist()] == comp.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    compare(G.query(spark, "/root/testdata/sf0.1").collect(), d["vec_id"].to_numpy(), np.stack(d["embedding"]).astype(float),
            d["label"].to_numpy())


def test_planted_groups_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(G, "PER_PIVOT", 60)
    monkeypatch.setattr(G, "QUERY_ROWS", 50)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 24))
    for a in range(0, 300, 10):  # small groups and a chain
        x[a + 1:a + 4] = x[a] + rng.normal(size=(3, 24)) * 0.1
    x[600:800] = x[600] + rng.normal(size=(200, 24)) * 0.12  # one large group
    x[810:813] = x[5]  # exact copies
    labels = rng.integers(0, 3, 900).astype(np.int32)
    labels[600:800] = 1
    df = spark.createDataFrame([(int(i), v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))], SCHEMA)
    compare(G.near_duplicates(df).collect(), np.arange(900), x, labels)


@pytest.mark.parametrize("efforts", [G.EFFORTS, ()])
def test_shards_in_blocks(spark, monkeypatch, efforts):
    """One label whose crowded shard falls into several row blocks, by graph search and by the exact way; labels are strings."""
    monkeypatch.setattr(G, "BLOCK_ROWS", 70)
    monkeypatch.setattr(G, "QUERY_ROWS", 40)
    monkeypatch.setattr(G, "PER_PIVOT", 150)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 24))
    x[:200] = x[0] + rng.normal(size=(200, 24)) * 0.12
    for a in range(200, 320, 3):
        x[a + 1] = x[a] + rng.normal(size=24) * 0.05
    x[400:420] = x[210]
    labels = np.where(np.arange(500) < 450, "news", "web")
    df = spark.createDataFrame([(int(i), v.tolist(), str(k)) for i, (v, k) in enumerate(zip(x, labels))],
                               "vec_id long, embedding array<double>, label string")
    compare(G.near_duplicates(df, efforts=efforts).collect(), np.arange(500), x, labels)


def test_hub_lists_are_thinned():
    rng = np.random.default_rng(2)
    x = G.unit(rng.normal(size=(400, 8)))
    kept = G.thinned(x, 0, np.arange(1, 400))
    nearest = 1 + np.argsort(-(x[1:] @ x[0]), kind="stable")
    assert len(set(kept.tolist())) == G.WIDTH and kept[:G.WIDTH // 2].tolist() == nearest[:G.WIDTH // 2].tolist()
    assert G.thinned(x, 0, np.arange(1, 9)).tolist() == list(range(1, 9))


def test_matches_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    want = duckdb.sql(G.oracle_sql().replace("FROM embeddings", f"FROM '{sf}/embeddings.parquet'")).fetchall()
    assert sorted(map(tuple, G.query(spark, sf).collect())) == sorted(want)


def test_jittered_clumps(spark):
    """Two clumps of nearly equal vectors at cosine 0.985 in one small label, beside a large label with few links."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16))
    a, b = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
    x[:200] = a + rng.normal(size=(200, 16)) * 1e-4
    x[200:400] = 0.985 * a + np.sqrt(1 - 0.985 ** 2) * b + rng.normal(size=(200, 16)) * 1e-4
    x[500:1900:2] = x[501:1901:2] + rng.normal(size=(700, 16)) * 0.01
    labels = np.where(np.arange(2000) < 400, 1, 2).astype(np.int32)
    df = spark.createDataFrame([(int(i), v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))], SCHEMA)
    compare(G.near_duplicates(df).collect(), np.arange(2000), x, labels)


def test_robust_prune_keeps_near_and_diverse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = G.robust_prune(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    assert (links[:, 0] == sims.argmax(axis=1)).all()
    for i in range(200):
        kept = links[i][links[i] >= 0]
        assert len(set(kept)) == len(kept) and i not in kept
        for a in range(len(kept)):
            for b in range(a + 1, len(kept)):  # a later link is not ALPHA times nearer to an earlier one
                assert G.ALPHA * np.linalg.norm(x[kept[a]] - x[kept[b]]) > np.linalg.norm(x[i] - x[kept[b]]) - 1e-9
    assert (G.robust_prune(x[:1]) == -1).all()


def test_edge_rows(spark, with_extras):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [1.0, 0.0], 1), (4, [2.0, 0.0], 1), (7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [1.0, 0.0], None),
            (3, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (8, [inf, 1.0], 1), (10, [None, 1.0], 1), (None, [1.0, 0.0], 1),
            (11, [1.0], 1), (12, [], 1), (13, [1e200, 1e-200], 1)]
    got = G.near_duplicates(with_extras(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by[4] == (4, 4, True) and by[9] == (4, 4, False) and by[7] == (4, 4, False) and by[13] == (4, 4, False)
    for i in (1, 2, 3, 5, 6, 8, 10, 11, 12):
        assert by[i] == (0, i, True)
    assert by[None] == (0, None, False)
    assert G.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)],
                                   [(i, 200 + i % 7) for i in range(100)] + [(300, 301), (301, 300), (300, 301)]])
def test_connected_components(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}
