"""Substring near-duplicates over compact windows of min-hashes.

A text is its sequence of 5-word shingles. For a hash function, the Cartesian tree of
the shingles' hashes groups all subsequences by the position of their least hash: a node
(l, c, r) stands for every subsequence that starts in [l, c] and ends in [c, r]. Only
nodes that span at least ``MIN_SHINGLES`` positions (50 words) matter; they are exactly
the positions that are the least of some window of that length, so they are found with
sliding minima in linear time, about 2 / MIN_SHINGLES nodes a shingle. Their extents are
cut to MIN_SHINGLES - 1 on either side; consecutive nodes overlap, so longer passages are
pieced together.

Nodes of different documents with equal least hash under one of ``FUNCTIONS`` functions
are candidates, each of them: passages at Jaccard ``SIMILARITY`` agree under at least one
function with the chance ``RECALL``. They are joined with the first document of their hash,
never all with each other. An inserted or deleted word moves the rest of a passage to
another diagonal, so the extents of two documents may differ by ``SLACK``, and overlapping
ones on diagonals at most SLACK apart, from all functions, become one stretch.
Only the shingles of stretches are fetched and compared: the longest dense intervals are
kept if both sides hold MIN_SHINGLES shingles and their Jaccard similarity is at least
``SIMILARITY``.

The first document of a hash may share that shingle by chance or only a short line, or be
one edit too far away. Nodes of one hash therefore meet all others of it, too, held by a
verified interval or not. Nodes whose extents are equal shingle by shingle are one class: its
first document stands for it, and the others are members, exact repeats of that document. Two
extents can hold an interval only if each has ``SIMILARITY * MIN_SHINGLES`` places with a
shingle of the other, and then one of the rarest shingles of either is common to both. Classes
that share hash and such a shingle are compared, all of them. Two documents thus meet only at
some of their common nodes, those at which one is first of the hash or both are of their
classes: stretches are widened by ``AROUND`` shingles on either side, and joined again, to
compare what lies between.

Hashes of nodes that are then not covered in all their extent are opened: every window of MIN_SHINGLES shingles that a
node of theirs stands for gets the hash of all its shingles as key. Documents that share
such a key share 50 words for certain, so any of them can lead, and no exactly repeated
passage is lost however many documents lead by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evalspark.llm.common import drop_finished_shuffles, hash_bucket, short_batches, table, union_all
from evalspark.session import cut_lineage, drop_folder, measured_broadcasts, scratch_folder

SHINGLE_WORDS = 5
MIN_SHINGLES = 46
SIMILARITY = 0.8
#: Chance that a near-duplicate window at SIMILARITY has its least hash in common under some function.
RECALL = 0.998
FUNCTIONS = int(np.ceil(np.log(1 - RECALL) / np.log(1 - SIMILARITY)))
#: Shingles by which a window of MIN_SHINGLES may differ in length from another at SIMILARITY.
SLACK = int(np.ceil(MIN_SHINGLES * (1 / SIMILARITY - 1)))
#: Shingles on either side of a stretch that are compared with it.
AROUND = 2 * MIN_SHINGLES
FUNCTION_MASK = 7  # low bits of a key that name its function
SEED = 77
#: Text bytes that a task handles at once (a longer text is handled alone).
CHUNK_BYTES = 1 << 20
#: Bits of the map that keeps documents out of a join they have no part in.
FILTER_BITS = 1 << 24
#: Bits of the map of shared hashes (16 megabytes).
KEY_BITS = 1 << 27
#: Parts, by hash, in which nodes are joined with each other: that many times less lies in shuffles at once.
ROUNDS = 4
#: Rows of whole hashes that a task pairs at once, and pairs that it makes of them at once.
MET_ROWS = 1 << 16
PAIRS = 1 << 21
#: Documents in a block of linked ones: the links between two blocks are compared in one place.
TILE = 128
#: Shingles of links that are compared at once.
COMPARED = 1 << 18
#: Stretches of one document that are fetched with one copy of its text.
FETCH = 256

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Shingle hashes of many texts at once, by polynomial word hashes over their bytes."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.letters = mix(np.arange(1, 257, dtype=np.uint64) * U(self.BASE))
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                back = pow(self.BASE, -1, 1 << 64)
                one = np.ones(1, np.uint64)
                self.power = np.cumprod(np.r_[one, np.full(n, self.BASE, np.uint64)])
                self.inverse = np.cumprod(np.r_[one, np.full(n, back, np.uint64)])

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the values of every span."""
        self._grow(len(values))
        total = np.r_[U(0), np.cumsum(values * self.power[:len(values)])]
        return mix((total[end] - total[start]) * self.inverse[start])

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words per text, hash, first byte, end byte of each word); bytes count from the text's start."""
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        space = (buf == 32) | (buf >= 9) & (buf <= 13)
        edge = np.diff(np.r_[True, space].astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        word = self.spans(self.letters[buf], start, end)
        ends = np.cumsum(sizes)
        count = np.diff(np.r_[0, np.searchsorted(start, ends)])
        base = np.repeat(ends - sizes, count)
        return count, word, start - base, end - base

    def shingles(self, texts: list[bytes], width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """(shingles per text, hash of each shingle in order)."""
        count, word, _, _ = self.words(texts)
        if len(word) < width:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint64)
        code = np.zeros(len(word) - width + 1, np.uint64)
        for k in range(width):
            code = code * U(self.BASE) + word[k:len(code) + k]
        text = np.repeat(np.arange(len(texts)), count)
        return np.maximum(0, count - width + 1), mix(code[text[:len(code)] == text[width - 1:]])


def normal(text: str | None) -> bytes:
    """Bytes with A-Z in lower case; byte positions are those of the text's UTF-8."""
    return text.encode("utf-8", "replace").lower() if text else b""


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def compact_windows(code: np.ndarray, text: np.ndarray, function: int, least: int) -> tuple[np.ndarray, ...]:
    """(key, position, left, right) of the tree nodes that span ``least`` positions of one text.

    ``code`` and ``text`` give hash and text number of every shingle of a run of texts;
    left and right are the node's extents from its position, at most least - 1. Of equal
    hashes the first counts as the least.
    """
    n = len(code)
    if n < least:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    key = mix(code ^ mix(np.array([SEED + function], np.uint64)))
    bits = U(max(24, n.bit_length()))
    packed = np.full(-(-n // least) * least, ~U(0))
    packed[:n] = key >> bits << bits | np.arange(n, dtype=np.uint64)
    rows = packed.reshape(-1, least)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.flatnonzero(text[:n - least + 1] == text[least - 1:])
    at = (np.minimum(behind[start], ahead[start + least - 1]) & ((U(1) << bits) - U(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(at)] - 1
    at = at[new]
    return key[at] & ~U(FUNCTION_MASK) | U(function), at, at - start[new], start[last] + least - 1 - at


def windows(docs: DataFrame, least: int = MIN_SHINGLES) -> DataFrame:
    """``(key, doc, place, kind)`` per node of ``docs(doc_id, text)``; place packs position, left and right extent.

    ``kind`` is a hash of both extents and all shingles in them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            texts = [normal(t) for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts):
                count, code = shingler.shingles(texts[a:b])
                text = np.repeat(np.arange(b - a), count)
                first = np.cumsum(count) - count
                for function in range(FUNCTIONS):
                    key, at, left, right = compact_windows(code, text, function, least)
                    own = text[at]
                    extent = left << 12 | right
                    kind = mix(shingler.spans(code, at - left, at + right + 1) ^ extent.view(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(ids[a + own]), pa.array(at - first[own] << 24 | extent), pa.array(kind.view(np.int64))],
                        ["key", "doc", "place", "kind"])

    return docs.mapInArrow(run, "key long, doc long, place long, kind long")


def whole_windows(nodes: DataFrame, docs: DataFrame, least: int = MIN_SHINGLES) -> DataFrame:
    """``(key, doc, place)`` for every window of ``least`` shingles that the nodes ``(doc, place)`` stand for.

    The key is the hash of all shingles of the window; a document's nodes are bounded by its length.
    """
    asked = nodes.groupBy("doc").agg(F.collect_set("place").alias("places"))
    rows = only_listed(docs, asked.select("doc")).join(asked, F.col("doc_id") == F.col("doc")).select("doc", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            texts = [normal(t) for t in batch.column("text").to_pylist()]
            lists = batch.column("places")
            for a, b in chunks(texts):
                count, code = shingler.shingles(texts[a:b])
                if len(code) < least:
                    continue
                key = np.zeros(len(code) - least + 1, np.uint64)
                for k in range(least):
                    key = key * U(Shingler.BASE) + code[k:len(key) + k]
                key = mix(key)
                first = np.cumsum(count) - count
                for k in range(a, b):
                    place = lists[k].values.to_numpy()
                    at, left, right = place >> 24, place >> 12 & 4095, place & 4095
                    n = left + right + 2 - least
                    start = np.unique(np.repeat(at - left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    start = start[start + least <= count[k - a]]  # another text of the same id may be shorter
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[first[k - a] + start].view(np.int64)), pa.array(np.repeat(ids[k:k + 1], len(start))),
                         pa.array(start << 24 | least - 1)], ["key", "doc", "place"])

    return rows.mapInArrow(run, "key long, doc long, place long")


def shared_shingles(rows: DataFrame, tables: Tables) -> DataFrame:
    """``(doc, shared)`` of ``rows(doc, text, nodes)``: the shingles of the nodes' extents that other documents' have too, with their number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, code, nodes in extents(batches):
            edge = np.zeros(len(code) + 1, np.int64)
            np.add.at(edge, nodes["start"], 1)
            np.add.at(edge, nodes["end"], -1)
            kinds = np.unique(code[np.cumsum(edge)[:-1] > 0]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.full(len(kinds), doc))], ["v", "doc"])

    values = tables.keep(rows.mapInArrow(run, "v long, doc long"))
    shared = tables.keep(values.groupBy("v").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("docs"))
                         .where(F.col("first") < F.col("last")).select("v", "docs"))
    lists = tables.keep(values.join(shared, "v").groupBy("doc").agg(F.collect_list(F.struct("v", "docs")).alias("shared")))
    tables.drop(values, shared)
    return lists


def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, dict]]:
    """(doc, shingle hashes, nodes) per row of ``(doc, text, nodes)``; nodes as arrays key, place, open, start, end."""
    shingler = Shingler()
    for batch in batches:
        ids = batch.column("doc").to_pylist()
        texts = [normal(t) for t in batch.column("text").to_pylist()]
        lists = batch.column("nodes")
        for a, b in chunks(texts):
            count, code = shingler.shingles(texts[a:b])
            first = np.cumsum(count) - count
            for k in range(a, b):
                own, rows = code[first[k - a]:first[k - a] + count[k - a]], lists[k].values
                nodes = {f: rows.field(f).to_numpy(zero_copy_only=False) for f in ("key", "place", "open")}
                at, left, right = nodes["place"] >> 24, nodes["place"] >> 12 & 4095, nodes["place"] & 4095
                fits = at + right < len(own)  # another text of the same id may be shorter
                nodes = {f: x[fits] for f, x in (nodes | {"start": at - left, "end": at + right + 1}).items()}
                yield ids[k], own, nodes


def rare_shingles(rows: DataFrame, need: int) -> DataFrame:
    """``(at, key, doc, place, twin, open)`` of ``rows(doc, text, nodes, shared)``: where a node meets those that it may match.

    Of two nodes' extents of which each has ``need`` places with a shingle of the other, the
    rarest common shingle has ``need`` places from it on in either, in the order of (documents,
    hash). So it is among all but the last ``need - 1`` places of both, and ``at`` is a hash of
    key and shingle for each of those. ``twin`` is the place of the document's first node with
    equal key and extent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, out = batch.column("shared"), []
            for (doc, code, nodes), values in zip(extents(iter([batch])), shared):
                kinds, docs = (values.values.field(f).to_numpy() for f in ("v", "docs"))
                order = np.lexsort((kinds, docs))
                number = np.empty(len(kinds), np.int64)
                number[order] = np.arange(len(kinds))
                by_hash, rarest = np.argsort(kinds), kinds[order].view(np.uint64)
                where = np.minimum(np.searchsorted(kinds, code.view(np.int64), sorter=by_hash), len(kinds) - 1)
                common = kinds[by_hash[where]] == code.view(np.int64)
                rank = number[by_hash[where]]  # of a common shingle, the rarest first
                total = np.r_[0, np.cumsum(common)]
                hits = total[nodes["end"]] - total[nodes["start"]]
                twins = {}
                for k in np.flatnonzero(hits >= need).tolist():
                    a, b, key, place = (int(nodes[f][k]) for f in ("start", "end", "key", "place"))
                    near = np.sort(rank[a:b][common[a:b]])
                    rare = rarest[np.unique(near[:len(near) - need + 1])]
                    at = mix(rare ^ mix(nodes["key"][k:k + 1].view(np.uint64)))
                    twin = twins.setdefault((key, place & (1 << 24) - 1, code[a:b].tobytes()), place)
                    out.append((at.view(np.int64), key, doc, place, twin, bool(nodes["open"][k])))
            if out:
                at, *rest = zip(*out)
                size = [len(x) for x in at]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), *(pa.array(np.repeat(np.array(x), size)) for x in rest)],
                                                 ["at", "key", "doc", "place", "twin", "open"])

    return rows.mapInArrow(run, "at long, key long, doc long, place long, twin long, open boolean")


def class_leads(nodes: DataFrame) -> DataFrame:
    """``(key, kind, lead, lead_place)`` of ``nodes(key, doc, place, kind)``: the first document of each class and its first place there."""
    return (nodes.groupBy("key", "kind").agg(F.min(F.struct("doc", "place")).alias("first"))
            .select("key", "kind", F.col("first.doc").alias("lead"), F.col("first.place").alias("lead_place")))


def near_meetings(nodes: DataFrame, pending: DataFrame | None, docs: DataFrame, need: int, tables: Tables) -> DataFrame:
    """``rare_shingles`` of ``nodes(key, doc, place)``; those among ``pending`` are open (None: all)."""
    nodes = nodes.withColumn("open", F.lit(True)) if pending is None else (
        nodes.join(pending.withColumn("open", F.lit(True)), ["key", "doc", "place"], "left").withColumn("open", F.coalesce("open", F.lit(False))))
    asked = tables.keep(nodes.groupBy("doc").agg(F.collect_set(F.struct("key", "place", "open")).alias("nodes")))
    rows = only_listed(docs, asked.select("doc")).join(asked, F.col("doc_id") == F.col("doc")).select("doc", "text", "nodes")
    shared = shared_shingles(rows, tables)
    met = tables.keep(rare_shingles(rows.join(shared, "doc"), need))
    tables.drop(asked, shared)
    return met


def met_pairs(doc: np.ndarray, place: np.ndarray, node: np.ndarray, at: np.ndarray, lead: np.ndarray, open_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``node_pairs`` of rows in the order of ``node``, all rows of their hashes; ``lead`` tells which may lead."""
    _, group = np.unique(at, return_inverse=True)
    leads = np.flatnonzero(lead)
    leads = leads[np.argsort(group[leads], kind="stable")]
    n = np.bincount(group[leads], minlength=group.max() + 1)
    first, n = (np.cumsum(n) - n)[group], n[group]
    total, edge = np.r_[0, np.cumsum(n)], np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
    k = 0
    while k < len(edge) - 1:  # whole nodes, so that a pair is in one part only, however many shingles it shares
        stop = max(k + 1, int(np.searchsorted(total[edge], total[edge[k]] + PAIRS, side="right")) - 1)
        rows = np.arange(edge[k], edge[stop])
        own = np.repeat(rows, n[rows])
        other = leads[np.arange(len(own)) - np.repeat(total[rows] - total[edge[k]] - first[rows], n[rows])]
        fits = (doc[own] > doc[other]) & (open_[own] | open_[other])
        pair = np.unique(node[own[fits]] * np.int64(len(node)) + node[other[fits]])
        here, there = (edge[x] for x in divmod(pair, len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[here], place[here], doc[there], place[there])], ["doc", "place", "lead", "lead_place"])
        k = stop


def node_pairs(met: DataFrame) -> DataFrame:
    """``(doc, place, lead, lead_place)``: nodes that meet in ``at``, which stands for the key too, one of them open, the lead's document before the other's, one of equal ones as lead.

    All rows of a hash are brought together and paired there: two nodes share dozens of rare
    shingles, and a join by shingle would make, sort and shuffle their pair as often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def pairs(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            x = {f: np.concatenate([p.column(f).to_numpy(zero_copy_only=False) for p in parts]) for f in parts[0].schema.names}
            new = np.r_[False, (x["key"][1:] != x["key"][:-1]) | (x["doc"][1:] != x["doc"][:-1]) | (x["place"][1:] != x["place"][:-1])]
            yield from met_pairs(x["doc"], x["place"], np.cumsum(new), x["at"], x["place"] == x["twin"], x["open"])

        for batch in batches:
            key = batch.column("key").to_numpy()
            if rows >= MET_ROWS and (held[-1].column("key")[-1].as_py() != key[0] or key[0] != key[-1]):
                cut = int(np.searchsorted(key != held[-1].column("key")[-1].as_py(), True))  # the rest of the held hash
                yield from pairs([*held, batch.slice(0, cut)])
                held, rows, batch = [], 0, batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        yield from pairs(held)

    rows = met.select("key", "doc", "place", "twin", "at", "open").repartition("key").sortWithinPartitions("key", "doc", "place")
    return rows.mapInArrow(run, "doc long, place long, lead long, lead_place long")


def pairs_of_the_rest(met: DataFrame, held: DataFrame | None, tables: Tables) -> DataFrame:
    """``node_pairs`` of ``near_meetings``, one that has two hashes maybe twice; nodes among ``held(key, doc, place)`` are not open (None: none), equal nodes of a document are open together."""
    if held is not None:
        held = held.withColumn("held", F.lit(True))
        state = (met.select("key", "doc", "place", "twin", "open").distinct().join(held, ["key", "doc", "place"], "left")
                 .groupBy("key", "doc", "twin").agg(F.max(F.col("open") & F.col("held").isNull()).alias("open")))
        met = tables.keep(met.drop("open").join(state, ["key", "doc", "twin"]))
    # Most rare shingles of a node are in no other document's node of its hash: their rows go before the join shuffles them twice.
    shared = tables.keep(met.groupBy("at").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                         .where(F.col("first") < F.col("last")).select("at"))
    listed = key_map(shared, "at")
    tables.drop(shared)
    # All nodes of a hash are in one round, and a round's shuffles are gone before the next one's.
    rounds = [tables.keep(node_pairs(with_keys(met.where(hash_bucket(ROUNDS, F.col("key")) == k), listed, "at"))) for k in range(ROUNDS)]
    return union_all(rounds)


def _part(name: str) -> tuple:
    """(position, left, right) of a packed place."""
    c, low = F.col(name), F.lit(4095).cast("long")
    return F.shiftright(c, 24), F.shiftright(c, 12).bitwiseAND(low), c.bitwiseAND(low)


def bit_map(ids: DataFrame, bits: int) -> np.ndarray:
    """Map of ``bits`` bits, those set on which an id of ``ids(bit)`` falls."""
    words = (ids.select((F.col("bit") / 64).cast("int").alias("w"),
                        F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int")).alias("m"))
             .groupBy("w").agg(F.bit_or("m").alias("m")))
    out = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():  # at most bits / 64 rows of 12 bytes
        out[batch.column("w").to_numpy()] = batch.column("m").to_numpy()
    return out


def key_map(keys: DataFrame, key: str) -> Broadcast:
    """Broadcast map of KEY_BITS bits of the ``key`` of ``keys``."""
    return keys.sparkSession.sparkContext.broadcast(bit_map(keys.select(F.pmod(key, F.lit(KEY_BITS)).alias("bit")), KEY_BITS))


def with_keys(nodes: DataFrame, keys: DataFrame | Broadcast, key: str = "key") -> DataFrame:
    """``nodes`` without most rows whose ``key`` is not among those of ``keys`` (or of their map), before they are shuffled for a join."""
    shared = keys if isinstance(keys, Broadcast) else key_map(keys, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            bit = batch.column(key).to_numpy() & KEY_BITS - 1
            kept = batch.filter(pa.array((bits[bit >> 6] >> (bit & 63) & 1).astype(bool)))
            if kept.num_rows:
                yield kept

    return nodes.mapInArrow(run, nodes.schema)


class Tables:
    """Tables of one run, written as Parquet in the shared folder: a third of a checkpoint's size for rows of numbers."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, scratch_folder(spark, "passages"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, written and read back, so that it is computed once and its lineage ends here."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        drop_finished_shuffles(self.spark)
        return self.spark.read.parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables whose rows nothing reads any more."""
        for t in tables:
            for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:  # the files of one table: few
                drop_folder(self.spark, path)


def meetings(nodes: DataFrame, tables: Tables) -> DataFrame:
    """The nodes whose key another document has too, with ``lead``, the first such document.

    The nodes are kept first: they are made once and read twice. The leads are kept, too,
    so that the join stands between plain shuffles and a frequent key's nodes can be split.
    """
    nodes = tables.keep(nodes)
    leads = tables.keep(nodes.groupBy("key").agg(F.min("doc").alias("lead"), F.max("doc").alias("last"))
                        .where(F.col("lead") < F.col("last")).select("key", "lead"))
    met = tables.keep(with_keys(nodes, leads).join(leads.hint("shuffle_hash"), "key"))
    tables.drop(nodes, leads)
    return met


def meeting_pairs(met: DataFrame, slack: int) -> DataFrame:
    """``(doc, lead, diagonal, s, e, lead_s, lead_e)`` and the rest of ``met``: later documents' nodes, both extents at most ``slack`` apart."""
    (c, left, right), (lead_c, lead_left, lead_right) = _part("place"), _part("lead_place")
    return (met.where(F.col("doc") > F.col("lead"))
            .select(*(x for x in met.columns if x in ("key", "place")), "doc", "lead", (c - lead_c).alias("diagonal"), (c - F.least(left, lead_left + slack)).alias("s"),
                    (c + F.least(right, lead_right + slack) + 1).alias("e"), (lead_c - F.least(lead_left, left + slack)).alias("lead_s"),
                    (lead_c + F.least(lead_right, right + slack) + 1).alias("lead_e")))


def brought_together(met: DataFrame, turn: int) -> DataFrame:
    """The rows of ``met(doc, place, lead, lead_place)`` whose documents have their turn of ROUNDS, dealt by document and lead.

    ``stretches`` then has nothing left to shuffle, and four numbers a pair go there instead of seven, twice.
    """
    return met.where(hash_bucket(ROUNDS, F.col("doc")) == turn).repartition("doc", "lead")


def stretches(pairs: DataFrame, slack: int) -> DataFrame:
    """``(doc, lead, start, lead_start, size, lead_size)``: joined extents of documents and their leads.

    Diagonals of a document and a lead that follow each other by at most ``slack`` are one band.
    """
    pairs = pairs.select("doc", "lead", "diagonal", "s", "e", "lead_s", "lead_e").distinct()
    across = Window.partitionBy("doc", "lead").orderBy("diagonal")
    line = Window.partitionBy("doc", "lead", "band").orderBy("s", "e", "lead_s")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    return (pairs.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(across) <= slack, 0).otherwise(1))
            .withColumn("band", F.sum("new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("new", F.when(F.col("s") <= F.max("e").over(before), 0).otherwise(1))
            .withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc", "lead", "band", "run")
            .agg(F.min("s").alias("start"), F.max("e").alias("end"), F.min("lead_s").alias("lead_start"), F.max("lead_e").alias("lead_end"))
            .select("doc", "lead", "start", "lead_start", (F.col("end") - F.col("start")).alias("size"),
                    (F.col("lead_end") - F.col("lead_start")).alias("lead_size")))


def widened(links: DataFrame, by: int) -> DataFrame:
    """``links`` with ``by`` shingles more on either side, as pairs for ``stretches``."""
    start, lead_start = F.col("start"), F.col("lead_start")
    return links.select("doc", "lead", (start - lead_start).alias("diagonal"),
                        F.greatest(start - by, F.lit(0)).alias("s"), (start + F.col("size") + by).alias("e"),
                        F.greatest(lead_start - by, F.lit(0)).alias("lead_s"), (lead_start + F.col("lead_size") + by).alias("lead_e"))


def only_listed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most rows whose doc_id is not among ``ids(doc)``, before they are shuffled for a join.

    The ids set bits in a map of FILTER_BITS, two megabytes whatever their number; a row
    whose bit is not set cannot join. With more ids than bits it keeps every row.
    """
    bits = bit_map(ids.select(F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS)).alias("bit")), FILTER_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            keep = pa.array((shared.value[bit >> 6] >> (bit & 63) & 1).astype(bool))
            yield batch.select(["doc_id", "text"]).filter(keep)

    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("long").alias("bit"))
    return rows.mapInArrow(run, "doc_id long, text string")


def tiled(links: DataFrame) -> DataFrame:
    """``links`` with the ``tile`` in which each is compared.

    Documents with the same first lead are mostly near copies of each other, each linked with
    all others. They are dealt into blocks of about TILE, and a tile is the links of two blocks.
    """
    first = links.groupBy("doc").agg(F.min("lead").alias("group"))
    blocks = first.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks"))
    block = [hash_bucket(F.col("blocks"), F.col(c)) for c in ("doc", "lead")]
    tile = F.xxhash64("group", F.least(*block), F.greatest(*block))
    return links.join(first, "doc").join(blocks, "group").withColumn("tile", tile).drop("group", "blocks")


def fetch(links: DataFrame, docs: DataFrame) -> DataFrame:
    """``(tile, doc, start, codes)``: the shingle hashes (32 bits each, binary) that the links of a tile ask of a document, once."""
    asked = links.select("tile", F.explode(F.array(
        F.struct(F.col("doc").alias("at"), F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e")),
        F.struct(F.col("lead").alias("at"), F.col("lead_start").alias("s"), (F.col("lead_start") + F.col("lead_size")).alias("e")),
    )).alias("x")).groupBy("tile", F.col("x.at").alias("at")).agg(F.min("x.s").alias("s"), F.max("x.e").alias("e"))
    ask = F.struct("tile", "s", "e")
    turns = asked.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / FETCH).alias("turns"))
    asked = (asked.join(turns, "at").groupBy("at", hash_bucket(F.col("turns"), F.col("tile")).alias("turn"))
             .agg(F.collect_list(ask).alias("asks")))  # about FETCH
    docs = only_listed(docs, links.select(F.explode(F.array("doc", "lead")).alias("doc")))
    rows = docs.join(asked, F.col("doc_id") == F.col("at")).select("at", "text", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            ids = batch.column("at").to_pylist()
            texts = [normal(t) for t in batch.column("text").to_pylist()]
            lists = batch.column("asks")
            for a, b in chunks(texts):
                count, code = shingler.shingles(texts[a:b])
                first = np.cumsum(count) - count
                tile, doc, start, out = [], [], [], []
                for k in range(a, b):
                    own = code[first[k - a]:first[k - a] + count[k - a]]
                    asks = lists[k].values
                    for n, s, e in zip(*(asks.field(f).to_pylist() for f in ("tile", "s", "e"))):
                        tile.append(n), doc.append(ids[k]), start.append(s), out.append(own[s:e].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(out, pa.binary())],
                                                 ["tile", "doc", "start", "codes"])

    return rows.mapInArrow(run, "tile long, doc long, start long, codes binary")


def dense(hit: np.ndarray, share: float, least: int) -> list[tuple[int, int]]:
    """Longest disjoint intervals with at least ``share`` hits, hits at both ends, and ``least`` positions."""
    out, todo = [], [(0, len(hit))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        part = hit[a:b]
        hits = np.count_nonzero(part)
        if hits == b - a:
            out.append((a, b))
            continue
        if hits < share * least - 1e-6:  # an interval has as many
            continue
        total = np.zeros(b - a + 1)
        np.cumsum(np.where(part, 1 - share, -share), out=total[1:])
        low = np.minimum.accumulate(total)
        high = np.maximum.accumulate(total[::-1])[::-1]
        # For each start that sets a new minimum, the last end that does not lie below it.
        starts = np.concatenate(([0], np.flatnonzero(low[1:] < low[:-1]) + 1))
        ends = np.searchsorted(-high, -(low[starts] - 1e-9), side="right") - 1
        best = int((ends - starts).argmax())
        i, j = int(starts[best]), int(ends[best])
        at = np.flatnonzero(part[i:j])
        if j - i < least or not len(at):
            continue
        i, j = i + int(at[0]), i + int(at[-1]) + 1
        if j - i >= least:
            out.append((a + i, a + j))
        todo += [(a, a + i), (a + j, b)]
    return sorted(out)


def trimmed(x: np.ndarray, y: np.ndarray, kinds: int, similarity: float, least: int) -> tuple[int, int, int, int, float] | None:
    """(start, end, start, end, Jaccard) of two sequences of numbers below ``kinds``, ends cut towards the best Jaccard until it is reached.

    A cut takes the outermost run of hits on one end of one side and the misses next to it.
    """
    sides = x, y
    counts = [np.bincount(c, minlength=kinds) for c in sides]
    common, union = (int(np.count_nonzero(f(counts[0] > 0, counts[1] > 0))) for f in (np.logical_and, np.logical_or))
    spans, steps = [[0, len(x)], [0, len(y)]], []
    if union and common < similarity * union:
        for own, other in ((0, 1), (1, 0)):
            hit = np.r_[False, counts[other][sides[own]] > 0, False]
            steps.append((np.flatnonzero(hit[1:-1] & ~hit[:-2]), np.flatnonzero(hit[1:-1] & ~hit[2:]) + 1))  # starts, ends of runs
    while union and common < similarity * union:
        best = None
        for own, other in ((0, 1), (1, 0)):
            a, b = spans[own]
            starts, ends = steps[own]
            i, j = np.searchsorted(starts, a, side="right"), np.searchsorted(ends, b) - 1
            for p, q in ([(int(starts[i]), b)] if i < len(starts) else []) + ([(a, int(ends[j]))] if j >= 0 else []):
                if q - p < least:
                    continue
                n = np.bincount(np.concatenate((sides[own][a:p], sides[own][q:b])), minlength=kinds)
                gone = (n > 0) & (n == counts[own])
                shared = int(np.count_nonzero(gone & (counts[other] > 0)))
                c, u = common - shared, union - (int(np.count_nonzero(gone)) - shared)
                if best is None or c * best[1] > best[0] * u:
                    best = c, u, own, p, q, n
        if best is None or best[0] * union <= common * best[1]:
            return None
        common, union, own, p, q, n = best
        counts[own] -= n
        spans[own] = [p, q]
    return (*spans[0], *spans[1], common / union) if union and min(spans[0][1] - spans[0][0], spans[1][1] - spans[1][0]) >= least else None


def numbered(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """Per pair of shingle sequences (32 bits each): both as numbers of their kinds, the number of kinds, and which are hits on either side."""
    size = np.array([len(s) for p in pairs for s in p], np.int64)
    owner = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    tagged = np.concatenate([s for p in pairs for s in p]).astype(np.uint64) | owner >> U(1) << U(32)
    kinds, number = np.unique(tagged, return_inverse=True)
    first = np.searchsorted(kinds, np.arange(len(pairs) + 1, dtype=np.uint64) << U(32))
    second = (owner & U(1)).astype(bool)
    on = np.zeros((2, len(kinds)), bool)
    on[0, number[~second]] = on[1, number[second]] = True
    hit = on.all(axis=0)[number]
    number -= np.repeat(first[:-1], size.reshape(-1, 2).sum(axis=1))
    edge = np.cumsum(size)[:-1]
    sides, hits = np.split(number, edge), np.split(hit, edge)
    return [(sides[2 * k], sides[2 * k + 1], int(first[k + 1] - first[k]), hits[2 * k], hits[2 * k + 1]) for k in range(len(pairs))]


def may_match(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float, least: int) -> np.ndarray:
    """Which pairs of shingle sequences hold hits for an interval at all: ``similarity * least`` on either side."""
    return np.array([enough(*p[3:], similarity, least) for p in numbered(pairs)], bool)


def enough(x_hit: np.ndarray, y_hit: np.ndarray, similarity: float, least: int) -> bool:
    return min(np.count_nonzero(x_hit), np.count_nonzero(y_hit)) >= similarity * least - 1e-9


def verify(x: np.ndarray, y: np.ndarray, similarity: float, least: int) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start, end, Jaccard) of the near-duplicate intervals of two shingle sequences."""
    kinds, number = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = number[:len(x)], number[len(x):]
    return intervals(x, y, len(kinds), np.isin(x, y), similarity, least)


def intervals(x: np.ndarray, y: np.ndarray, kinds: int, hit: np.ndarray, similarity: float, least: int) -> list[tuple[int, int, int, int, float]]:
    """``verify`` of sequences of numbers below ``kinds``, of which those of x that y has, too, are a ``hit``.

    A Jaccard similarity leaves neither side a smaller share of hits than itself, so
    intervals with that share are tried, and the Jaccard alone decides. What fails is
    tried again by rising shares, up to unbroken runs of hits.
    """
    if len(x) >= least and np.array_equal(x, y):
        return [(0, len(x), 0, len(x), 1.0)]
    out, todo = [], [(0, len(x))]
    for share in (similarity, 2 * similarity / (1 + similarity), 1.0):
        left = []
        for a, b in todo:
            at = a
            for p, q in dense(hit[a:b], share, least):
                p, q = a + p, a + q
                own = np.zeros(kinds, bool)
                own[x[p:q]] = True
                near = [(p + f, p + g, c + h, c + k, jaccard) for c, d in dense(own[y], share, least)
                        for f, g, h, k, jaccard in filter(None, [trimmed(x[p:q], y[c:d], kinds, similarity, least)])]
                out += near
                for f, g in sorted((r[0], r[1]) for r in near):
                    left.append((at, f))
                    at = max(at, g)
            left.append((at, b))
        todo = [(a, b) for a, b in left if b - a >= least]
    return out


def compare(links: DataFrame, docs: DataFrame, similarity: float, least: int, tables: Tables) -> DataFrame:
    """``links`` with the near-duplicate intervals ``[a, b)``, ``[c, d)`` of each and their similarity, a row per interval.

    A document's shingles go to each tile of its links once, however many links it has there.
    """
    own = ["doc", "lead", "start", "lead_start", "size", "lead_size"]
    schema = pa.schema([(c, pa.int64()) for c in [*own, "a", "b", "c", "d"]] + [("similarity", pa.float64())])

    def judged(links: list[tuple], pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows = [(*link, *r) for link, (x, y, kinds, x_hit, y_hit) in zip(links, numbered(pairs)) if enough(x_hit, y_hit, similarity, least)
                for r in intervals(x, y, kinds, x_hit, similarity, least)]
        columns = list(zip(*rows)) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, {}  # of a tile, the documents stand before the links
        links, pairs, size = [], [], 0
        for batch in batches:
            codes = batch.column("codes")
            rows = zip(*(batch.column(c).to_pylist() for c in ("tile", "of", *own)))
            for k, (tile, of, *link) in enumerate(rows):
                if tile != current:
                    current, held = tile, {}
                if of == 0:
                    if link[0] not in held:  # another text of the same id may answer, too: the first holds
                        held[link[0]] = link[2], np.frombuffer(codes[k].as_py(), np.uint32)
                    continue
                sides = []
                for doc, start, n in ((link[0], link[2], link[4]), (link[1], link[3], link[5])):
                    first, code = held.get(doc, (start, np.zeros(0, np.uint32)))
                    sides.append(code[start - first:start - first + n])
                links.append(link)
                pairs.append(tuple(sides))
                size += len(sides[0]) + len(sides[1])
                if size > COMPARED:
                    yield judged(links, pairs)
                    links, pairs, size = [], [], 0
        if links:
            yield judged(links, pairs)

    links = tables.keep(tiled(tables.keep(links)))
    none = {c: F.lit(0).cast("long") for c in ("lead", "lead_start", "size", "lead_size")}
    rows = (fetch(links, docs).withColumns({"of": F.lit(0), **none})
            .unionByName(links.select("tile", *own).withColumns({"of": F.lit(1), "codes": F.lit(None).cast("binary")})))
    return rows.repartition("tile").sortWithinPartitions("tile", "of").mapInArrow(run, ", ".join(f"{f.name} {'double' if f.name == 'similarity' else 'long'}" for f in schema))


def covering(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``(key, doc, place, sure, same)`` per node of ``pairs``: whether a verified interval with its lead holds its
    whole extent, and whether that is an exact repeat on the node's own diagonal."""
    offset = F.col("start") + F.col("a") - F.col("lead_start") - F.col("c")
    covered = (rows.groupBy("doc", "lead").agg(F.collect_set(F.struct(
        (F.col("start") + F.col("a")).alias("x"), (F.col("start") + F.col("b") - 1).alias("y"), offset.alias("offset"),
        ((F.col("similarity") == 1) & (F.col("b") - F.col("a") == F.col("d") - F.col("c"))).alias("same"))).alias("covered")))
    at, left, right = _part("place")

    def near(i: Column) -> Column:
        return F.abs(i["offset"] - F.col("diagonal")) <= SLACK

    def holds(i: Column) -> Column:
        return (i["x"] <= at - left) & (i["y"] >= at + right)

    def any_of(test) -> Column:
        return F.coalesce(F.exists("covered", test), F.lit(False))

    return (pairs.join(covered, ["doc", "lead"], "left")
            .select("key", "doc", "place", any_of(lambda i: near(i) & holds(i)).alias("sure"),
                    any_of(lambda i: i["same"] & (i["offset"] == F.col("diagonal")) & holds(i)).alias("same")))


def verified_pairs(docs: DataFrame, similarity: float, least: int) -> DataFrame:
    """``near_duplicate_passages`` of ``docs(doc_id, text)`` without nulls as ``links`` with their intervals, checkpointed."""
    tables = Tables(docs.sparkSession)
    met = meetings(windows(docs, least), tables)
    nodes, leading = met.drop("lead"), tables.keep(met.where(F.col("doc") == F.col("lead")).select("key", "doc", "place"))
    places = tables.keep(leading.groupBy("key", F.col("doc").alias("lead")).agg(F.min("place").alias("lead_place")))
    # Kept as places: diagonals and ends are made anew where they are read.
    meet = tables.keep(nodes.drop("kind").join(places, "key").where(F.col("doc") > F.col("lead")))
    pairs = meeting_pairs(meet, SLACK)
    tables.drop(places)
    to_compare = meet.drop("key")
    classes = tables.keep(class_leads(nodes))
    keys = tables.keep(classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("key"))
    if not keys.isEmpty():
        several = with_keys(nodes, keys).join(keys, "key", "left_semi")
        first = tables.keep(several.join(classes.select("key", "kind", F.col("lead").alias("doc")), ["key", "kind", "doc"], "left_semi")
                            .select("key", "doc", "place"))
        tables.drop(classes, met)
        near = near_meetings(first, None, docs, int(np.ceil(similarity * least - 1e-9)), tables)
        between = pairs_of_the_rest(near, None, tables)
        tables.drop(near, first)
        to_compare = to_compare.unionByName(between)
    joined = [tables.keep(stretches(meeting_pairs(brought_together(to_compare, k), SLACK), SLACK)) for k in range(ROUNDS)]
    links = stretches(widened(union_all(joined), AROUND), SLACK)
    rows = tables.keep(compare(links, docs, similarity, least, tables))
    here = tables.keep(covering(pairs, rows))
    keys = tables.keep(here.where(~F.col("sure")).select("key").distinct())
    # Nodes that are no exact repeat of a lead in all their extent, and the leads of uncovered keys.
    opened = [here.where(~F.col("same")).select("key", "doc", "place"), with_keys(leading.select("key", "doc", "place"), keys)]
    # A node that equals a lead's in all its extent is spoken for by that lead; the others of an uncovered key are opened.
    opened = tables.keep(union_all(opened).join(keys, "key", "left_semi").select("doc", "place").distinct())
    rows = cut_lineage(rows)
    if not opened.isEmpty():
        # Windows with equal keys are equal in every shingle, and so are their unions along a diagonal.
        last = Tables(docs.sparkSession)
        again = meetings(whole_windows(opened, docs, least), last)
        places = last.keep(again.where(F.col("doc") == F.col("lead")).groupBy("key").agg(F.min("place").alias("lead_place")))
        same = stretches(meeting_pairs(again.join(places, "key"), 0), 0)
        size = F.col("size").cast("long")
        rows = cut_lineage(rows.unionByName(same.withColumns({"a": F.lit(0).cast("long"), "b": size, "c": F.lit(0).cast("long"), "d": size,
                                                              "similarity": F.lit(1.0)})))
        drop_folder(docs.sparkSession, last.folder)
    drop_folder(docs.sparkSession, tables.folder)
    return rows


def near_duplicate_passages(docs: DataFrame, similarity: float = SIMILARITY, least: int = MIN_SHINGLES) -> DataFrame:
    """Passages of ``docs(doc_id, text)`` that an earlier document has too.

    One row per verified pair of intervals: doc_id, start_word, end_word, first_doc_id,
    first_start, first_end, similarity; word numbers, ends exclusive, first_doc_id <
    doc_id. Null ids and texts of fewer than 50 words take no part; rows of one doc_id
    are not compared with each other. Every exact repeat is found; near duplicates as
    the module says: RECALL against any document, the first of its class standing for equal passages.
    """
    docs = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # The tables' files are a fraction of their rows: by their size Spark would broadcast tables of millions of rows.
    with measured_broadcasts(docs.sparkSession):
        rows = verified_pairs(docs, similarity, least)
    extra = SHINGLE_WORDS - 1
    return rows.select(
        F.col("doc").alias("doc_id"), (F.col("start") + F.col("a")).alias("start_word"), (F.col("start") + F.col("b") + extra).alias("end_word"),
        F.col("lead").alias("first_doc_id"), (F.col("lead_start") + F.col("c")).alias("first_start"),
        (F.col("lead_start") + F.col("d") + extra).alias("first_end"), "similarity").distinct()


def merged(spans: DataFrame) -> DataFrame:
    """Union of overlapping or touching ``(doc_id, start_word, end_word)`` per document; keeps the least first_doc_id."""
    line = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(line.rowsBetween(Window.unboundedPreceding, -1))
    return (spans.withColumn("new", F.when(F.col("start_word") <= reach, 0).otherwise(1))
            .withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc_id", "run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"),
                                          F.min("first_doc_id").alias("first_doc_id"))
            .drop("run"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Every occurrence of a repeated passage: doc_id, start_word, end_word, first_doc_id, repeated.

    ``repeated`` is true where an earlier document has the passage (first_doc_id: the
    smallest found) and false for the occurrence that stays (first_doc_id: itself).
    Overlapping occurrences of a document are merged. Results as in
    ``near_duplicate_passages``.
    """
    pairs = cut_lineage(near_duplicate_passages(docs))
    drop_finished_shuffles(docs.sparkSession)
    later = pairs.groupBy("doc_id", "start_word", "end_word").agg(F.min("first_doc_id").alias("first_doc_id"))
    first = pairs.select(F.col("first_doc_id").alias("doc_id"), F.col("first_start").alias("start_word"),
                         F.col("first_end").alias("end_word"), "first_doc_id").distinct()
    return (merged(later).withColumn("repeated", F.lit(True))
            .unionByName(merged(first).withColumn("repeated", F.lit(False))))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the given (start, end) spans, which do not overlap; words between stay as they are."""
    raw = text.encode("utf-8", "replace")
    _, _, start, end = Shingler().words([raw])
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(raw[at:start[a]])
        at = end[min(b, len(end)) - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with later occurrences of repeated passages cut from ``text`` and n_chars renewed.

    Documents of which nothing but white space is left go. Rows without a doc_id or text
    and documents without a repeated passage stay as they are.
    """
    spans = (repeated_passages(docs.select("doc_id", "text")).where("repeated").groupBy("doc_id")
             .agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans")))

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        return pd.Series([t if s is None or t is None else cut_words(t, [(x["start_word"], x["end_word"]) for x in s])
                          for t, s in zip(text, spans)], dtype="object")

    names = docs.columns
    spans = spans.withColumnRenamed("doc_id", "span_doc").hint("shuffle_hash")  # by its estimate it could be broadcast
    rows = docs.join(spans, F.col("doc_id") == F.col("span_doc"), "left")
    rows = rows.withColumn("text", cut("text", "spans")).where(F.col("spans").isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every occurrence of a passage of 50 words or more that documents share."""
    return repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))
