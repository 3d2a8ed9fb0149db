"""SimHash groups: fingerprints, the Golay cover, links against brute force, edge cases."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evalspark.llm import simhash as S

SCHEMA = "doc_id long, text string"


def naive_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c d e a b c", "É é É x\u00a0y z", "x " * 40000])
def test_fingerprint(text):
    assert S.fingerprint(text) == naive_fingerprint(text)


def test_hash_is_that_of_spark(spark):
    one = spark.sql("SELECT 'a b c' AS t").select(F.xxhash64("t")).first()[0]
    assert one % 2 ** 64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_golay_code_is_perfect():
    patterns = S.error_patterns(2)
    first, words = patterns[0]
    assert len(words) == 2048 and (np.diff(first) == 1).all()  # one coset leader of weight 3 or less each
    assert [len(w) for _, w in patterns[1:]] == [8855, 33649]


def brute_components(fps):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    comp = np.arange(len(fps))
    while True:
        new = np.array([comp[near[i]].min() for i in range(len(fps))])
        if (new == comp).all():
            return comp
        comp = new


@pytest.mark.parametrize("crowded", [0, 256])
def test_links_lose_nothing(spark, crowded):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 60).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    fps = [base, np.array([0, 1, 2 ** 63, 2 ** 64 - 1], np.uint64)]
    for flips in (1, 2, 3, 4):
        for b in base[:30]:
            fps.append(np.array([np.bitwise_xor.reduce([b, *(np.uint64(1) << np.uint64(k) for k in rng.choice(64, flips, False))])], np.uint64))
    centre = base[0]  # one crowd around a fingerprint
    fps.append(np.array([centre ^ (np.uint64(1) << np.uint64(i)) for i in range(64)], np.uint64))
    fps = np.unique(np.concatenate(fps))
    frame = spark.createDataFrame([(int(f),) for f in fps.astype(np.int64)], "fp long")
    got = S.connected_components(S.links(frame, crowded=crowded)).collect()
    label = {int(f): int(f) for f in fps.astype(np.int64)} | {r["node"]: r["component"] for r in got}
    want = brute_components(fps)
    groups = {}
    for f, c in zip(fps.astype(np.int64), want):
        groups.setdefault(int(c), set()).add(label[int(f)])
    assert all(len(v) == 1 for v in groups.values()) and len({min(v) for v in groups.values()}) == len(groups)


def test_whole_table_against_brute_force(spark):
    got = S.query(spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id")
    text = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().sort_values("doc_id")["text"]
    fps = np.array([int(f, 16) for f in got["fingerprint"]], np.uint64)
    assert [int(f) for f in fps[:50]] == [naive_fingerprint(t) for t in text[:50]]
    ids = got["doc_id"].to_numpy()
    assert (ids[brute_components(fps)] == got["component_id"].to_numpy()).all()


def test_edge_rows(spark, with_extras):
    rows = [(5, None), (3, ""), (7, "a b c d"), (9, "A b C d"), (9, "a b c d"), (None, "a b c d"), (None, "q w e r t y")]
    got = S.simhash_groups(with_extras(spark.createDataFrame(rows, SCHEMA))).collect()
    by = sorted(((r["doc_id"], r["component_id"]) for r in got), key=str)
    assert by == sorted([(5, 3), (3, 3), (7, 7), (9, 7), (9, 7), (None, 7), (None, None)], key=str)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (3, 5)} == {"0" * 16}
    assert S.simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_row_of_each_group(spark, with_extras):
    """The smallest id stays, ids that repeat or are null included."""
    a, b, c = "one two three four five six", "quite another text of some words here", "a third one that nobody else has at all"
    rows = [(5, a), (3, a), (None, a), (None, b), (None, b), (7, c), (7, "the same id with a text of its own now"), (7, c), (None, None), (2, "")]
    docs = with_extras(spark.createDataFrame(rows, "doc_id long, text string"))
    got = S.one_per_group(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(
        [(3, a), (None, b), (7, c), (7, "the same id with a text of its own now"), (2, "")], key=str)
    assert S.one_per_group(docs.where("false")).collect() == []


def test_the_rows_placed_at_anchors_are_never_broadcast(spark):
    """600 fingerprints are small, the hundred rows that each is placed in are not."""
    rng, limits = np.random.default_rng(3), {"spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.maxBroadcastTableSize": "4m"}
    rows = [(i, " ".join(f"w{w}" for w in rng.integers(0, 16, 30))) for i in range(600)]
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        assert S.simhash_groups(spark.createDataFrame(rows, SCHEMA)).count() == 600
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
