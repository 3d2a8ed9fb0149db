"""Filter audit: galloping merges, brute force over all orders, the five filters, edge rows, its SQL."""

import random
from itertools import permutations

import numpy as np
import pytest

from evalspark.llm import filteraudit as A

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("seed", range(6))
def test_gallop_and_merge_equal_sets(seed):
    rng = np.random.default_rng(seed)
    lists = [np.sort(rng.choice(5000, size=n, replace=False)).astype(np.int64) for n in rng.integers(0, 3000, size=6)] + [np.zeros(0, np.int64), np.array([4999])]
    for a in lists:
        for b in lists:
            place = A.gallop(a, b)
            assert [x in set(b.tolist()) for x in a.tolist()] == (place >= 0).tolist()
            assert (b[place[place >= 0]] == a[place >= 0]).all()
            assert A.holds(a, b).tolist() == (place >= 0).tolist()
    sets = [set(x.tolist()) for x in lists]
    for k, own in enumerate(sets):
        want = [0] * (1 << len(lists))
        for x in own:
            want[sum(1 << j for j, s in enumerate(sets) if j != k and x in s)] += 1
        assert A.merge(lists, k).tolist() == want


def test_gallop_looks_at_few_ids():
    class Counting(np.ndarray):
        looked = 0

        def __getitem__(self, key):
            if not isinstance(key, slice):
                Counting.looked += 1
            return super().__getitem__(key)

    ids = np.arange(1 << 20).view(Counting)
    assert A.leap(ids, 0, 1 << 19) == 1 << 19 and Counting.looked < 50


def five(text):
    w = text.encode().split()
    return [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text)]


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, source in docs:
        text = text or ""
        e = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        rows.append((source or "", [*five(text), e], i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = [0] * 5
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                out[part, "".join("ABCDE"[k] for k in order), step] = (
                    len(left), len(gone), sum(r[1][f] for r in mine) - len(gone), sum(r[1][f] and sum(r[1]) == 1 for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone), f)
        for k, v in out.items():
            if k[0] == part:
                out[k] = (*v[:6], shapley["ABCDE".index(k[1][k[2] - 1])])
    return out


def check(spark, docs, labels, change=lambda df: df):
    got = A.interaction_audit(A.judge(change(spark.createDataFrame(docs, DOCS)), change(spark.createDataFrame(labels, LABELS))), list("ABCDE"), A.MARKS)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.collect()
    have = {tuple(r[:3]): tuple(r[3:]) for r in rows}
    assert len(have) == len(rows) and have == brute(docs, labels)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["ab", "cd", "Ef", "GH", "x|y", "é", "zz"] + [f"w{k}" for k in range(80)]
    texts = [" ".join(rng.choices(words if rng.random() < 0.7 else words[:6], k=rng.choice([3, 49, 50, 70]))) for _ in range(60)]
    docs = [(i, rng.choice(texts), rng.choice(["a", "a", "b", None, ""])) for i in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.sample(range(250), 120)]
    check(spark, docs, labels + labels[:9] + [(None, 1, 1)])


@pytest.mark.parametrize("docs", [
    [], [(1, None, None)], [(1, "", "s"), (1, "", "s"), (2, None, "s"), (None, "", "s"), (None, None, "s")],
    [(3, "A" * 30, "s"), (3, "b " * 60, "s"), (7, "b " * 60, None), (7, "b " * 60, None)],
    [(i, "one text " * 40, "hot") for i in range(300)], [(1, "w " * 200_000, "x"), (2, "Ü\xa0Z " * 50, "y"), (3, "a\x0bb\x0cc\x1cd" * 30, "y")]])
def test_edge_tables(spark, docs, with_extras):
    check(spark, docs, [], with_extras)
    check(spark, docs, [(1, 1, 0), (1, 0, 1), (3, None, None)])


def test_limits_are_strict(spark):
    texts = [" ".join(f"w{k}" for k in range(50)), " ".join(f"w{k}" for k in range(49)), " ".join([f"w{k}" for k in range(65)] + ["w0"] * 35),
             " ".join([f"w{k}" for k in range(64)] + ["w0"] * 36), "A" + "b" * 19, "AA" + "b" * 37]
    got = A.judge_texts(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)).orderBy("doc_id").collect()
    assert [(r["A"], r["B"], r["C"]) for r in got] == [(False, False, False), (True, False, False), (False, False, False), (False, True, False),
                                                      (True, False, False), (True, False, True)]


def test_ranges_of_a_part_add_up(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, [(i, "x" if i % 3 else "x" * i, "one" if i % 5 else "two") for i in range(100)], [(i, 1, i % 2) for i in range(0, 100, 4)])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/{sf}/{name}.parquet')")
    want = con.execute(A.oracle_sql()).fetchall()
    got = A.query(spark, f"/root/testdata/{sf}").collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, got))
