"""Token-id files: optimal limited codes, bit packing, exact round trips, edge rows."""

import heapq
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from evalspark.llm import huffman as H

SCHEMA = "doc_id long, text string"
PATH = public_tokenizers.path("word_bpe_49k.json")


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@given(st.lists(st.integers(0, 10 ** 6), min_size=2, max_size=60))
@settings(max_examples=60, deadline=None)
def test_lengths_are_optimal_and_prefix_free(counts):
    counts = np.array(counts)
    lengths = H.code_lengths(counts, 60)
    used = np.flatnonzero(counts)
    assert (lengths[counts == 0] == 0).all()
    if len(used) > 1:
        assert int((lengths * counts).sum()) == huffman_cost(counts.tolist())
        codes = H.canonical_codes(lengths)
        words = sorted(format(codes[i], f"0{lengths[i]}b") for i in used)
        assert not any(b.startswith(a) for a, b in zip(words, words[1:]))


def test_length_limit_holds():
    counts = 2 ** np.arange(40)
    lengths = H.code_lengths(counts, 8)
    assert lengths.max() <= 8 and sum(2.0 ** -lengths) <= 1
    assert H.code_lengths(np.ones(600, int), 4).max() == 10  # more symbols than the limit can name


@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=400), min_size=1, max_size=5), st.integers(1, 64))
@settings(max_examples=40, deadline=None)
def test_blocks_round_trip(blocks, every):
    counts = np.bincount(np.concatenate(blocks), minlength=301)
    lengths = H.code_lengths(counts)
    codes = H.canonical_codes(lengths)
    packed = [H.pack(np.array(b), codes, lengths, every) for b in blocks]
    got = H.unpack([p for p, _ in packed], [c for _, c in packed], [len(b) for b in blocks], H.decoding_table(lengths), every)
    assert got.tolist() == [i for b in blocks for i in b]
    alone = H.unpack([packed[-1][0]], [packed[-1][1]], [len(blocks[-1])], H.decoding_table(lengths), every)
    assert alone.tolist() == blocks[-1]


TEXTS = ["Hello, World. it's 3.14!", "", None, " \t\n", "a\x01b \x01", "ÄÖ İstanbul ﬁ é ́x", "<|endoftext|> x", "<|ENDOFTEXT|> y<|startoftext|>", "a|> <| b***, (c).", "...,, .a. b.c d.",
         "z" * 5000, "word " * 30000, "日本語 テキスト。 한국어", "don't we'll 'S", "a b c", "Ǆ ß ΑΣ ΣΑ."]


def test_words_encode_as_whole_texts():
    tokenizer = Tokenizer.from_file(PATH)
    encoder = H.WordEncoder(open(PATH, encoding="utf-8").read())
    n, ids = encoder.encode(TEXTS, 1)
    got = np.split(ids, np.cumsum(n)[:-1])
    for text, row in zip(TEXTS, got):
        assert row.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [1], text


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    got = H.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_edge_rows(spark, tmp_path, with_extras):
    spec = open(PATH, encoding="utf-8").read()
    rows = [(i * 3 - 7, t) for i, t in enumerate(TEXTS)]
    df = with_extras(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5))
    assert sorted(map(tuple, H.round_trip(df, spec, 1, str(tmp_path / "a")).collect())) == expected(rows)
    twice = spark.createDataFrame([(None, "x y"), (4, "same"), (4, "same"), (4, "same")], SCHEMA)
    got = sorted(map(tuple, H.round_trip(twice, spec, 1, str(tmp_path / "b")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 4, 4, 4] and len({r[2:] for r in got[1:]}) == 1
    assert [r[1] for r in got[1:]] == [got[0][2] + k * got[1][2] for k in range(3)]
    assert H.round_trip(spark.createDataFrame([], SCHEMA), spec, 1, str(tmp_path / "c")).collect() == []


def test_files_hold_no_plain_ids_and_read_by_block(spark, tmp_path):
    spec = open(PATH, encoding="utf-8").read()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    H.write_ids(docs, spec, str(tmp_path / "f"), 1)
    blocks = spark.read.parquet(str(tmp_path / "f/blocks"))
    size = blocks.selectExpr("sum(length(payload)) AS b", "sum(n_ids) AS n").first()
    assert size["b"] < 2 * size["n"]  # less than 16 bits an id
