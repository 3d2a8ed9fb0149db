"""Segment-tree BPE against the tiktoken library; exact decoding."""

import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
import tiktoken

from evalspark.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokens():
    return B.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t},
                             special_tokens={})


def texts():
    rng = random.Random(4)
    out = ["", " ", "a", "aa" * 700, "zq" * 777 + "  " * 500, "It's we'll 12345 \r\n\t x", "🙂é́ 한국어 日本語 ‍", "<|endoftext|>", "\x00\x01"]
    out += ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(400)) for _ in range(5)]
    out += ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    return out + ["x" * 100_000]


def test_encoder_equals_the_library(tokens, library, monkeypatch):
    vocab = B.Vocabulary(tokens)
    for cache in (500_000, 20):  # a cache that overflows changes nothing
        monkeypatch.setattr(B, "CACHE_PIECES", cache)
        encoder = B.Encoder(vocab, public_tokenizers.PATTERN)
        for text in texts():
            n, ids = encoder.encode([text])
            assert ids.tolist() == library.encode_ordinary(text) and n.tolist() == [len(ids)]


def test_both_forms_of_the_tree_agree(tokens):
    vocab = B.Vocabulary(tokens)
    merged = dict(zip(vocab.keys.tolist(), vocab.merged.tolist()))
    rng = random.Random(1)
    pieces = [bytes(rng.choice(b"theanr \xc3\xa9") for _ in range(rng.randrange(2, 60))) for _ in range(200)]
    size, ids = B.merge_many(pieces, vocab)
    at = 0
    for piece, n in zip(pieces, size):
        assert ids[at:at + n].tolist() == B.merge_one(piece, vocab, merged).tolist()
        at += n


def test_learning_takes_little_memory(tokens, library):
    encoder, rng = B.Encoder(B.Vocabulary(tokens), public_tokenizers.PATTERN), random.Random(2)
    many = ["".join(rng.choices("theanrqz", k=16)) for _ in range(32_000)]
    few = ["".join(rng.choices("qzxj", k=9_000)) for _ in range(24)]
    for pieces, most in ((many, 32), (few, 8)):
        tracemalloc.start()
        encoder.learn(pieces)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most << 20
    assert encoder.encode([few[0]])[1].tolist() == library.encode_ordinary(few[0])


def test_digests(spark, library, with_extras):
    rows = [(i, t) for i, t in enumerate(texts())] + [(99, None), (None, "null id"), (3, "aa" * 700)]
    got = B.digests(with_extras(spark.createDataFrame(rows, SCHEMA).repartition(3)), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert B.digests(spark.createDataFrame([], SCHEMA), PATH, public_tokenizers.PATTERN).collect() == []


def test_whole_table(spark, library):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = B.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(text)
    for r in got:
        ids = library.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
