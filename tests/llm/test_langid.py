"""Language ID: held-out accuracy, a brute-force naive Bayes, edge rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evalspark.llm import langid as L

SCHEMA = "doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_matches_naive_bayes_counted_by_hand(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("The cat. sat!", "en"), ("the DOG ran", "en"), ("der Hund läuft", "de"), ("die Katze", "de"),
                                                   (None, "fr"), ("le chien", None)])]
    langs, matrix = L.train(spark.createDataFrame(rows, SCHEMA).select("text", "lang"), buckets=256)
    assert langs == ["de", "en"]
    counts = {g: Counter() for g in langs}
    for _, t, g in rows:
        if t and g:
            counts[g].update(L.bucket_ids(L.normalise([t]), 256)[1].tolist())
    for k, g in enumerate(langs):
        total = sum(counts[g].values()) + L.SMOOTHING * 256
        want = [math.log((counts[g][b] + L.SMOOTHING) / total) for b in range(256)]
        assert np.allclose(matrix[:, k], want, atol=1e-5)
    texts = ["the cat ran", "der Hund", "12 !?", None, ""]
    best, score = L.classify(texts, langs, matrix)
    assert best == ["en", "de", "und", "und", "und"] and list(score[2:]) == [0, 0, 0]
    like = matrix[L.bucket_ids(L.normalise(texts[:1]), 256)[1]].astype(float).sum(axis=0)
    assert score[0] == pytest.approx(1 / (1 + math.exp(like.min() - like.max())))


def test_grams_do_not_cross_texts_and_follow_letters():
    a, b = L.normalise(["Ab1c", "É-ß"])
    assert (a, b) == (" ab c ", " é ß ")
    row, ids = L.bucket_ids([a, b], 1 << 14)
    alone = [L.bucket_ids([t], 1 << 14)[1] for t in (a, b)]
    assert sorted(ids[row == 0]) == sorted(alone[0]) and sorted(ids[row == 1]) == sorted(alone[1])
    assert L.normalise(["日本 x", "ΑΒΓ.", "1 2", None]) == [" 日本 x ", " αβγ ", "", ""]


def test_edge_rows(spark, with_extras):
    rows = [(0, None, "en"), (1, "", "en"), (2, "12345 ...", "en"), (3, "the and of " * 30_000, "en"), (4, "und der die", "de"), (5, "x", None),
            (None, "the", "en"), (6, "the the", "en"), (6, "the the", "en"), (7, "der die das", "de"), (8, "of the and", "en")]
    got = L.language_id(with_extras(spark.createDataFrame(rows, SCHEMA)), "doc_id", "text").collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r["text"]].add((r["lang_pred"], r["score"]))
        assert (r["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"]))
    assert all(len(v) == 1 for v in by.values())
    blank = L.language_id(spark.createDataFrame([(1, "abc", None)], SCHEMA), "doc_id").collect()
    assert [(r["lang_pred"], r["score"]) for r in blank] == [("und", 0.0)]
    assert L.language_id(spark.createDataFrame([], SCHEMA), "doc_id").collect() == []
