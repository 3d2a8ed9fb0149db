"""Token-id files with canonical, length-limited Huffman codes.

Writing takes four steps, each cut by a table in the shared folder:

1. tokens: every whole text is encoded once; ids are stored as unsigned 16 or 32 bit.
2. counts: ids are counted per task and summed; package-merge gives code lengths of at
   most ``MAX_BITS`` (more if the vocabulary needs it). Lengths alone fix the code.
3. order: documents are range-partitioned by doc_id (equal and null ids are spread by a
   second key) and sorted within their part.
4. blocks: the ids of a part form one stream cut into independent blocks of about
   ``BLOCK_IDS`` ids, never inside a document. A block holds its bits, the bit offset
   of every ``CHECK_IDS``-th id, and its documents' ids and id counts.

Reading decodes all stretches between checkpoints of many blocks in lockstep, one table
look-up per id. A block is read without any other block. Files are Parquet: rows are
blocks, so Spark's commit protocol covers lost tasks and any shared store works.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evalspark.llm.common import short_batches, table
from evalspark.llm.passages import Shingler
from evalspark.session import ensure_checkpoint_dir

MAX_BITS = 16
BLOCK_IDS = 1 << 16
CHECK_IDS = 512
#: Words that a Python worker remembers across its tasks; then it starts afresh.
CACHE_WORDS = 1_000_000
CHUNK_BYTES = 2_000_000
#: A control character between the words of one library call; words that hold it go alone.
MARK = b"\x01"


# --- tokenizing ----------------------------------------------------------------------

def _worker(key: str, make):
    """An object that lives as long as the Python worker, whatever task asks for it."""
    home = sys.modules.setdefault("_token_worker_cache", types.ModuleType("_token_worker_cache"))
    if getattr(home, "key", None) != key:
        home.key, home.value = key, make()
    return home.value


class WordEncoder:
    """Encodes texts with a tokenizer that never joins words across ASCII white space.

    Equal words (ASCII letters in lower case) have equal ids, so the library encodes each
    distinct word once, many words a call. A run of ASCII signs that ends a word after a
    letter a-z is a word of its own: the tokenizer never joins the two. Words are told
    apart by 64-bit hashes of their bytes, for many texts at once with numpy.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.mark = self._ids(MARK.decode())
        if len(self.mark) != 1:
            raise ValueError("the tokenizer has no single id for the mark")
        # Texts that spell an added token, in any case, are left to the library as a whole.
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.hasher = Shingler()
        self.sign = np.zeros(256, bool)
        self.sign[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.ids, self.size, self.start = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _parted(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids per word, ids): many words a call with a mark between; words that hold the mark go alone."""
        mark = MARK.decode()
        for k in range(0, len(words), 2000):
            part = words[k:k + 2000]
            if any(mark in w for w in part):
                each = [np.array(self._ids(w), np.int32) for w in part]
                yield np.array([len(x) for x in each], np.int64), np.concatenate(each)
            else:
                row = np.array(self.tokenizer.encode_batch_fast([f" {mark} ".join(part)], add_special_tokens=False)[0].ids, np.int32)
                at = np.flatnonzero(row == self.mark[0])
                yield np.diff(np.r_[-1, at, len(row)]) - 1, np.delete(row, at)

    def _letters(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``_parted`` for words of letters only: the tokenizer makes one piece of each, which it counts."""
        calls = [words[k:k + 2000] for k in range(0, len(words), 2000)]
        for part, got in zip(calls, self.tokenizer.encode_batch([" ".join(c) for c in calls], add_special_tokens=False)):
            piece = np.array(got.word_ids, np.int64)
            if len(piece) and piece[-1] == len(part) - 1:
                yield np.bincount(piece, minlength=len(part)), np.array(got.ids, np.int32)
            else:  # a letter that becomes several signs in lower case
                yield from self._parted(part)

    def learn(self, words: list[str], keys: list[int]) -> None:
        """Add words that are not yet known, and their hashes."""
        letters = np.array([w.isalpha() for w in words], bool)
        order = np.r_[np.flatnonzero(letters), np.flatnonzero(~letters)].tolist()
        cut = int(letters.sum())
        got = [*self._letters([words[i] for i in order[:cut]]), *self._parted([words[i] for i in order[cut:]])]
        self.number.update(zip((keys[i] for i in order), range(len(self.number), len(self.number) + len(words))))
        size = np.concatenate([n for n, _ in got])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *(ids for _, ids in got)])

    def words(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(joined bytes, first byte and end byte of each word in them, words per text)."""
        joined = b" ".join([*texts, b""])
        buf = np.frombuffer(joined, np.uint8)
        space = (buf == 32) | (buf >= 9) & (buf <= 13)
        edge = np.diff(np.r_[True, space].astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        stem = np.maximum.accumulate(np.where(self.sign[buf], 0, np.arange(1, len(buf) + 1)))[end - 1] if len(end) else end
        last = buf[stem - 1] if len(end) else buf[:0]
        split = (stem > start) & (stem < end) & (last >= 97) & (last <= 122)
        start = np.sort(np.r_[start, stem[split]])
        end = np.sort(np.r_[end, stem[split]])
        ends = np.cumsum([len(t) + 1 for t in texts])
        return joined, start, end, np.diff(np.r_[0, np.searchsorted(start, ends)])

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, all ids in order), with ``end_id`` at the end of each text."""
        raw = [t.encode("utf-8", "replace").lower() if t else b"" for t in texts]
        whole = [i for i, t in enumerate(raw) if any(a in t for a in self.added)]
        if whole:
            rows = {i: np.array(self._ids(texts[i]) + [end_id], np.int32) for i in whole}
            rest = [i for i in range(len(texts)) if i not in rows]
            n, ids = self.encode([texts[i] for i in rest], end_id)
            rows.update(zip(rest, np.split(ids, np.cumsum(n)[:-1])))
            return np.array([len(rows[i]) for i in range(len(texts))], np.int64), np.concatenate([rows[i] for i in range(len(texts))])
        joined, start, end, count = self.words(raw)
        key, first, which = np.unique(self.hasher.spans(np.frombuffer(joined, np.uint8), start, end),
                                      return_index=True, return_inverse=True)
        keys = key.tolist()
        number = np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(number < 0)
        if len(new) and len(self.number) + len(new) > CACHE_WORDS:
            self.forget()
            new = np.arange(len(keys))
        if len(new):
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist())
            self.learn([joined[a:b].decode("utf-8", "replace") for a, b in spans], [keys[i] for i in new.tolist()])
            number = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
        number = number[which]
        size = self.size[number]
        total = np.r_[0, np.cumsum(size)]
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.start[number] - total[:-1], size)]
        ends = total[np.cumsum(count, dtype=np.int64)]
        return np.diff(np.r_[0, ends]) + 1, np.insert(ids, ends, end_id)


def tokenize(docs: DataFrame, spec: str, end_id: int, width: int) -> DataFrame:
    """``(doc_id, tie, ids)`` per row of ``docs(doc_id, text)``: ids as little-endian bytes of ``width``.

    ``spec`` is the tokenizer's JSON, broadcast (the vocabulary's size). Null texts are empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        text = shared.value
        encoder = _worker(hashlib.sha256(text.encode()).hexdigest(), lambda: WordEncoder(text))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            start, size = 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or i > start and size > CHUNK_BYTES:
                    n, ids = encoder.encode(texts[start:i], end_id)
                    ends = np.r_[0, np.cumsum(n) * width].astype(np.int32)
                    made = pa.Array.from_buffers(pa.binary(), i - start, [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(f"<u{width}"))])
                    yield pa.RecordBatch.from_arrays([batch.column(c).slice(start, i - start) for c in ("doc_id", "tie")] + [made],
                                                     ["doc_id", "tie", "ids"])
                    start, size = i, 0
                size += len(texts[i] or "") if i < len(texts) else 0

    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("tie"), "text")
    return rows.mapInArrow(run, "doc_id long, tie long, ids binary")


# --- the code ------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code length per symbol with at most ``max_bits`` bits (package-merge); 0 for unused symbols."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    leaf_marks, items = [], leaves
    for level in range(max_bits):
        if level:
            packages = items[0:len(items) // 2 * 2:2] + items[1::2]
            both = np.r_[leaves, packages]
            by = np.argsort(both, kind="stable")
            items, mark = both[by], by < n
        else:
            mark = np.ones(n, bool)
        leaf_marks.append(mark)
    need, got = 2 * n - 2, np.zeros(n, np.int64)
    for mark in reversed(leaf_marks):
        leaf = int(mark[:need].sum())
        got[:leaf] += 1
        need = 2 * (need - leaf)
    lengths[order] = got
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words in order of (length, symbol), as the lengths alone fix them."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        top = int(lengths[order].max())
        step = np.int64(1) << (top - lengths[order])
        codes[order] = (np.cumsum(step) - step) >> (top - lengths[order])
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, symbol, length) for every possible next ``bits`` bits of a stream."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    top = int(lengths.max()) if len(used) else 1
    n = np.int64(1) << (top - lengths[order])
    symbol, size = np.zeros(1 << top, np.int32), np.ones(1 << top, np.int32)
    symbol[:n.sum()], size[:n.sum()] = np.repeat(order, n), np.repeat(lengths[order], n)
    return top, symbol, size


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, check_ids: int = CHECK_IDS) -> tuple[bytes, np.ndarray]:
    """(bits of the ids, bit offset of every ``check_ids``-th id)."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids]
    offset = np.cumsum(size) - size
    word = offset >> 5
    value = codes[ids].astype(np.uint64) << (64 - (offset & 31) - size).astype(np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    # Codes are shorter than a word, so a code starts in every word.
    out[:-1] += np.add.reduceat(value >> np.uint64(32), first)
    out[1:] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    total = int(offset[-1] + size[-1])
    return out.astype(">u4").tobytes()[:(total + 7) // 8], offset[::check_ids]


def unpack(payloads: list[bytes], checks: list[np.ndarray], sizes: list[int],
           table: tuple[int, np.ndarray, np.ndarray], check_ids: int = CHECK_IDS) -> np.ndarray:
    """All ids of the blocks, in order; each stretch between checkpoints is a lane."""
    top, symbol, length = table
    raw = np.frombuffer(b"".join([*payloads, bytes(8)]), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    base = np.cumsum([0] + [len(p) for p in payloads])[:-1] * 8
    at = np.concatenate([c + b for c, b in zip(checks, base)]) if checks else np.zeros(0, np.int64)
    lane = np.concatenate([np.minimum(check_ids, s - np.arange(0, s, check_ids)) for s in sizes]) if sizes else np.zeros(0, np.int64)
    if not len(lane):
        return np.zeros(0, np.int32)
    by = np.argsort(-lane, kind="stable")  # lanes that end early drop off the end
    at, alive = at[by], len(lane)
    ends = -lane[by]
    out = np.zeros((int(lane.max()), len(lane)), np.int32)
    mask = np.int64((1 << top) - 1)
    for step in range(len(out)):
        alive = int(np.searchsorted(ends, -step, side="left"))
        here = at[:alive]
        bits = (window[here >> 3] >> (32 - top - (here & 7)).astype(np.uint32)) & np.uint32(mask)
        out[step, :alive] = symbol[bits]
        here += length[bits]
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    rows = out.T[back]
    return rows[np.arange(rows.shape[1]) < lane[:, None]]


# --- files ---------------------------------------------------------------------------

BLOCK_SCHEMA = ("part int, block int, first_id long, n_ids long, doc_ids array<long>, doc_sizes array<long>, "
                "checkpoints array<long>, payload binary")


def write_ids(docs: DataFrame, spec: str, path: str, end_id: int, max_bits: int = MAX_BITS) -> None:
    """Tokenize ``docs(doc_id, text)`` and write ``path/blocks`` and ``path/code`` in ascending doc_id order.

    Null doc_ids come first, equal doc_ids in an order that is fixed by the stored tokens.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    symbols = Tokenizer.from_str(spec).get_vocab_size()
    symbols = max(symbols, end_id + 1)
    width = 2 if symbols <= 1 << 16 else 4
    tokenize(docs, spec, end_id, width).write.option("compression", "zstd").parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(symbols, np.int64)
        for pdf in batches:
            for ids in pdf["ids"]:
                total += np.bincount(np.frombuffer(ids, f"<u{width}"), minlength=symbols) if len(ids) > symbols else 0
            short = b"".join(ids for ids in pdf["ids"] if len(ids) <= symbols)
            total += np.bincount(np.frombuffer(short, f"<u{width}"), minlength=symbols)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    counted = tokens.select("ids").mapInPandas(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(symbols, np.int64)
    for r in counted.collect():  # at most one row per vocabulary entry
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max_bits)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pd.DataFrame({"id": used.astype(np.int64), "bits": lengths[used]}),
                          "id long, bits long").coalesce(1).write.parquet(f"{path}/code")
    book = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))  # the vocabulary's size

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lengths, codes = book.value
        part, block, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, sizes, held = [], [], []

        def emit() -> pa.RecordBatch:
            nonlocal block, first
            ids = np.frombuffer(b"".join(held), f"<u{width}")
            payload, checks = pack(ids, codes, lengths)
            row = {"part": [part], "block": [block], "first_id": [first], "n_ids": [len(ids)], "doc_ids": [list(doc_ids)],
                   "doc_sizes": [list(sizes)], "checkpoints": [checks.tolist()], "payload": [payload]}
            block, first = block + 1, first + len(ids)
            doc_ids.clear(), sizes.clear(), held.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
                ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())),
                ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())]))

        total = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                raw = ids.as_py()
                doc_ids.append(doc_id), sizes.append(len(raw) // width), held.append(raw)
                total += sizes[-1]
                if total >= BLOCK_IDS:
                    yield emit()
                    total = 0
        if doc_ids:
            yield emit()

    (tokens.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
     .select("doc_id", "ids").mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{path}/blocks"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` per document of the files; ids are little-endian 32-bit bytes."""
    code = spark.read.parquet(f"{path}/code").collect()  # at most one row per vocabulary entry
    lengths = np.zeros(1 + max((r["id"] for r in code), default=0), np.int64)
    for r in code:
        lengths[r["id"]] = r["bits"]
    shared = spark.sparkContext.broadcast(decoding_table(lengths))  # 2 ** longest code

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            n_ids = cols["n_ids"].to_numpy()
            for a in range(0, len(n_ids), 16):
                b = min(a + 16, len(n_ids))
                ids = unpack([x.as_py() for x in cols["payload"][a:b]],
                             [x.values.to_numpy() for x in cols["checkpoints"][a:b]], n_ids[a:b].tolist(), book)
                raw = ids.astype("<u4").tobytes()
                sizes = np.concatenate([x.values.to_numpy() for x in cols["doc_sizes"][a:b]])
                docs = pa.concat_arrays([x.values for x in cols["doc_ids"][a:b]])
                ends = np.cumsum(sizes)
                blocks = np.repeat(np.arange(a, b), [len(x) for x in cols["doc_sizes"][a:b]])
                before = np.r_[0, np.cumsum(n_ids[a:b])][blocks - a]
                yield pa.RecordBatch.from_arrays([
                    cols["part"].take(pa.array(blocks)), docs,
                    pa.array(cols["first_id"].to_numpy()[blocks] + ends - sizes - before, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([raw[4 * (e - s):4 * e] for s, e in zip(sizes.tolist(), ends.tolist())], pa.binary())],
                    ["part", "doc_id", "place", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One small row per written part, so its size is bounded by the number of tasks.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = blocks.mapInArrow(decode, "part int, doc_id long, place long, n_tokens long, ids binary")
    return (rows.join(F.broadcast(parts), rows["part"] == parts["p"])
            .select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame, spec: str, end_id: int, path: str) -> DataFrame:
    """Write ``docs`` to ``path`` and report what its files hold: doc_id, start, n_tokens, ids_crc32."""
    write_ids(docs, spec, path, end_id)
    return read_ids(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: place, size and checksum of every document in the written files."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return round_trip(docs, spec, 1, scratch(spark, "token-ids"))
