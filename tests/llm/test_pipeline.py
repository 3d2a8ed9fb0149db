"""The pipeline: what each stage keeps, against brute force where it decides, and end to end."""

import corpus_pipeline as C
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from evalspark.llm import bpe, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input of the first stage and result of each, written and reread."""
    sf = "/root/testdata/sf0.001"
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stage_order_and_columns(steps):
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "passage_dedup", "mix_sources", "encode"]
    assert all(df.columns == C.COLUMNS for df in steps[1:-1])


def test_clean_documents_stay(steps):
    docs, spoken, single, cut, mixed, _ = steps
    assert rows(spoken).keys() == {i for i, r in rows(docs).items() if r["text"] and any(c.isalpha() for c in r["text"])}
    groups = rows(simhash.simhash_groups(spoken))
    assert rows(single).keys() == {i for i, r in groups.items() if r["component_id"] == i}
    before, after = rows(single), rows(cut)
    shared, changed = {}, {i for i in before if i not in after or after[i]["text"] != before[i]["text"]}
    for i in sorted(before):
        w = before[i]["text"].encode().lower().split()
        for k in range(len(w) - 4):
            shared.setdefault(tuple(w[k:k + 5]), set()).add(i)
    clean = set(before) - set().union(*(v for v in shared.values() if len(v) > 1), set())
    assert not changed & clean
    assert set(rows(mixed)) <= set(after)


def test_last_stage(steps):
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t},
                                special_tokens={})
    mixed, encoded = rows(steps[-2]), steps[-1].collect()
    assert len(encoded) == steps[-2].count()
    assert all(r["ids"] == library.encode_ordinary(mixed[r["doc_id"]]["text"]) for r in encoded)


def test_run(spark, steps):
    got = C.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, got.collect())) == sorted(map(str, steps[-1].collect()))


@pytest.mark.parametrize("data", [[], [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "a b c", None, None, 5), (2, "a b c", None, None, 5),
                                       (None, "x y z", "en", "a", 5), (3, "the " * 20_000, "en", "a", 80_000), (4, "a b c", "en", "b", 5)]])
def test_edge_tables(spark, data):
    docs = spark.createDataFrame(data, SCHEMA).withColumn("size", F.lit("clash"))
    for name, stage in C.STAGES:
        docs = stage(spark, docs, None)
        assert docs.count() >= 0, name


def test_null_and_repeated_ids(spark):
    """Exact copies without ids are reduced, and texts that share an id are told apart."""
    other = "quite different words stand in this one, none of them shared"
    data = [(None, "x y z w v u", "en", "a", 5), (None, "x y z w v u", "en", "a", 5), (4, "x y z w v u", "en", "b", 5),
            (4, other, "en", "b", 5), (None, "nobody else has this text of mine", "en", "a", 5)]
    kept = C.near_dedup(spark, spark.createDataFrame(data, SCHEMA), None).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted(
        [("4", "x y z w v u"), ("4", other), ("None", "nobody else has this text of mine")])
