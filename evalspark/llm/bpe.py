"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each match of the split pattern (a piece) starts as single bytes. A minimum segment tree
over the byte positions holds, at each live token's first byte, the rank of the pair it
forms with its right neighbour; its root is therefore the leftmost pair of least rank.
A merge changes three leaves (the token, its left neighbour, the absorbed token), each
with one update per tree level. Many pieces of similar length are merged in lockstep
with numpy, one merge per piece and step; single long pieces walk the same tree in plain
Python, so a piece of n bytes takes O(n log n) either way.

A task encodes each distinct piece once while its piece cache (CACHE_PIECES) lasts.
Vocabulary tables are built from the rank file on the driver and broadcast: their size
is that of the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evalspark.llm.common import short_batches, table

#: Distinct pieces that a task remembers; then it starts afresh.
CACHE_PIECES = 250_000
#: Characters, and ids, that are handled at once: an id takes some hundred bytes while it is decoded.
CHUNK_CHARS = 500_000
CHUNK_IDS = 100_000
#: Below this many pieces of one size class, plain Python is faster than numpy.
FEW = 24
#: Leaves of all trees that are merged in lockstep, of some hundred bytes each.
LEAVES = 1 << 17

NONE = np.int64(1) << 62


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id from a rank file (base64 token and rank per line). Ids may have gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Vocabulary:
    """Lookup tables of one rank file: bytes per id, id per byte, merged id per pair of ids."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        ids = {t: i for i, t in enumerate(tokens) if t}
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                left, right = ids.get(t[:cut]), ids.get(t[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.r_[np.array(keys, np.int64)[order], NONE]
        self.merged = np.r_[np.array(merged, np.int64)[order], -1]
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each merged pair, -1 where the pair is no token or an end (negative id) takes part."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)


def merge_many(pieces: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids per piece, all ids in order) of pieces of 2 bytes or more, merged in lockstep."""
    n = len(pieces)
    size = np.array([len(p) for p in pieces], np.int64)
    leaves = 1 << int(size.max() - 1).bit_length()
    levels = leaves.bit_length() - 1
    token = np.full((n, leaves + 2), -1, np.int64)  # column leaves + 1: before the first; the last byte's successor: an end
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    row = np.repeat(np.arange(n), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    token[row, col] = vocab.byte_id[flat]
    after = np.broadcast_to(np.arange(1, leaves + 3), (n, leaves + 2)).copy()
    before = np.broadcast_to(np.arange(-1, leaves + 1), (n, leaves + 2)).copy()
    before[:, 0] = leaves + 1

    def key(merged: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(merged >= 0, merged * leaves + at, NONE)

    tree = np.full((n, 2 * leaves), NONE, np.int64)
    first = vocab.pair(token[:, :leaves].ravel(), token[:, 1:leaves + 1].ravel()).reshape(n, leaves)
    tree[:, leaves:] = key(first, np.arange(leaves))
    for level in range(levels - 1, -1, -1):
        nodes = np.arange(1 << level, 2 << level)
        tree[:, nodes] = np.minimum(tree[:, 2 * nodes], tree[:, 2 * nodes + 1])
    live = np.flatnonzero(tree[:, 1] < NONE)
    while len(live):
        least = tree[live, 1]
        at, new = least % leaves, least // leaves
        gone = after[live, at]
        right, left = after[live, gone], before[live, at]
        token[live, at], token[live, gone] = new, -1
        after[live, at], before[live, right] = right, at
        tree[live, leaves + gone] = NONE
        tree[live, leaves + at] = key(vocab.pair(new, token[live, right]), at)
        has_left = np.flatnonzero(left < leaves)
        rows, pos = live[has_left], left[has_left]
        tree[rows, leaves + pos] = key(vocab.pair(token[rows, pos], new[has_left]), pos)
        rows, nodes = np.r_[live, live, rows], np.r_[gone, at, pos] + leaves
        for _ in range(levels):
            nodes = nodes >> 1
            tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
        live = live[tree[live, 1] < NONE]
    kept = token[:, :leaves] >= 0
    return kept.sum(axis=1), token[:, :leaves][kept]


def merge_one(piece: bytes, vocab: Vocabulary, merged: dict[int, int]) -> np.ndarray:
    """Ids of one piece of 2 bytes or more; ``merged`` maps a pair key to its id."""
    n, none = len(piece), int(NONE)
    leaves = 1 << (n - 1).bit_length()
    token = vocab.byte_id[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def key(i: int) -> int:
        j = after[i]
        m = merged.get(token[i] << 32 | token[j], -1) if j < n else -1
        return m * leaves + i if m >= 0 else none

    tree = [none] * leaves + [key(i) for i in range(n)] + [none] * (leaves - n)
    for i in range(leaves - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def update(i: int, value: int) -> None:
        i += leaves
        tree[i] = value
        while i > 1:
            i >>= 1
            value = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == value:
                return
            tree[i] = value

    while tree[1] < none:
        new, at = divmod(tree[1], leaves)
        gone = after[at]
        token[at], token[gone] = new, -1
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        update(gone, none)
        update(at, key(at))
        if before[at] >= 0:
            update(before[at], key(before[at]))
    return np.array([t for t in token if t >= 0], np.int32)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[i] .. start[i] + size[i] - 1 for every i, joined."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class Encoder:
    """Encodes texts; remembers the ids of the pieces it has met."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        import regex

        self.vocab = vocab
        self.split = regex.compile(pattern).findall
        self.whole = {t: i for i, t in enumerate(vocab.tokens) if t}
        self.merged = dict(zip(vocab.keys.tolist(), vocab.merged.tolist()))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.size, self.start = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Add pieces that are not yet known."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.fromiter((self.whole.get(r, -1) for r in raw), np.int64, len(raw))
        direct = np.flatnonzero(whole >= 0)
        rows, sizes, ids = [direct], [np.ones(len(direct), np.int64)], [whole[direct]]
        kind = np.frexp((length - 1).astype(np.float64))[1]  # tree levels
        kind[whole >= 0] = -1
        for bits in np.unique(kind[kind >= 0]).tolist():
            members = np.flatnonzero(kind == bits)
            step = max(FEW, LEAVES >> bits)
            for k in range(0, len(members), step):
                part = members[k:k + step]
                rows.append(part)
                if len(part) >= FEW and FEW << bits <= LEAVES:
                    n, got = merge_many([raw[i] for i in part.tolist()], self.vocab)
                else:
                    each = [merge_one(raw[i], self.vocab, self.merged) for i in part.tolist()]
                    n, got = np.array([len(x) for x in each], np.int64), np.concatenate(each)
                sizes.append(n)
                ids.append(got)
        row, size, flat = np.concatenate(rows), np.concatenate(sizes), np.concatenate(ids).astype(np.int32)
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        self.start = np.r_[self.start, np.zeros(len(raw), np.int64)]
        self.size = np.r_[self.size, np.zeros(len(raw), np.int64)]
        first = len(self.size) - len(raw)
        self.size[first + row] = size
        self.start[first + row] = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids per text, all ids in order)."""
        pieces = [self.split(t) for t in texts]
        met = set(chain.from_iterable(pieces))
        new = list(met - self.number.keys())
        if new and len(self.number) + len(new) > CACHE_PIECES:
            self.forget()
            new = list(met)
        if new:
            self.learn(new)
        counts = np.array([len(p) for p in pieces], np.int64)
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(pieces)), np.int64, int(counts.sum()))
        size = self.size[number]
        total = np.r_[0, np.cumsum(size)]
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts], self.ids[ragged(self.start[number], size)]


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes sum to at most ``most``, or of a single larger item."""
    start, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def encode_texts(docs: DataFrame, tokens: list[bytes], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with its ``text`` column replaced by ``ids``, an array of int; null texts give no ids."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokens))  # the vocabulary's size
    keep = [c for c in short_batches(docs).columns if c != text]
    schema = T.StructType([*docs.select(*keep).schema, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab.value, pattern)
        for batch in batches:
            texts = pc.fill_null(batch.column(text), "")
            for a, b in _runs(pc.utf8_length(texts).to_numpy(), CHUNK_CHARS):
                n, got = encoder.encode(texts.slice(a, b - a).to_pylist())
                column = pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.array(got, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in keep] + [column], [*keep, ids])

    return docs.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, tokens: list[bytes], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the binary column ``out``: the bytes of its ids, empty for null."""
    vocab = encoded.sparkSession.sparkContext.broadcast(Vocabulary(tokens))
    schema = T.StructType([*encoded.schema, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            for a, b in _runs(sizes, CHUNK_IDS):
                got = column.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                raw = v.bytes[ragged(v.start[got], v.size[got])]
                total = np.r_[0, np.cumsum(v.size[got])]
                ends = np.r_[0, total[np.cumsum(sizes[a:b])]].astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns] + [made],
                                                 [*batch.schema.names, out])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``docs(doc_id, text)``, one row per row.

    A null or empty text has no ids and the digests of the empty string. Repeated rows
    come back as often; doc_id, null or not, is only carried.
    """
    tokens = read_ranks(path)
    decoded = decode_ids(encode_texts(docs.select("doc_id", "text"), tokens, pattern), tokens)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: token digests of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
