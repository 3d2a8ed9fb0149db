"""One giant JSON array, read by many tasks (SRC-7, T20).

``from_json`` of a whole file holds the file in one value, and a multi-line JSON reader is
one task a file. Here Spark's text source cuts the files into byte ranges and into the
fragments between commas, by any file system that Spark reads. What a comma means
depends on everything before it: it may stand inside a string, or deep inside an element.
A range cannot know that, but it can say what it does to a state (inside a string or
not, depth of brackets) for either beginning:

1. Each range yields its state map, one row: whether its quotes turn the string state,
   how it changes the depth if it began outside or inside a string, and how many commas
   lie on each relative depth.
2. The maps are composed along each file by running sums, one row per range. That gives
   each range its start state and the number of elements before it.
3. Each range, now with its start state, cuts out its elements. Those that end in another
   range leave as pieces and are joined per (file, position); all others never move.

A range starts behind a comma, and a comma is never escaped, so no escape is pending at a
range's start. Elements of any kind and size work (an element is one value, so at most 2 GB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evalspark.session import cut_lineage

QUOTE, BACKSLASH, COMMA = 34, 92, 44
#: Ranges whose start states are sent to every task, at some 100 bytes each. At 128 MB a range this is 128 TB.
MOST_RANGES = 1_000_000
#: +1 and -1 for brackets, 2 for a comma.
KIND = np.zeros(256, np.int8)
KIND[[ord("["), ord("{")]] = 1
KIND[[ord("]"), ord("}")]] = -1
KIND[COMMA] = 2


def true_quotes(b: np.ndarray) -> np.ndarray:
    """Places of the quotes that are not escaped: those behind an even run of backslashes."""
    quotes = np.flatnonzero(b == QUOTE)
    if len(quotes) and (b == BACKSLASH).any():
        last_other = np.maximum.accumulate(np.where(b != BACKSLASH, np.arange(len(b)), -1))
        run = quotes - 1 - np.where(quotes > 0, last_other[quotes - 1], quotes - 1)
        quotes = quotes[run % 2 == 0]
    return quotes


def marks(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(place, kind, quotes before it mod 2) of the brackets and commas, and the number of true quotes."""
    quotes = true_quotes(b)
    at = np.flatnonzero(KIND[b])
    return at, KIND[b[at]], np.searchsorted(quotes, at) & 1, len(quotes)


class StateMap:
    """What a byte range does to the state, for a start outside (0) and inside (1) a string."""

    def __init__(self) -> None:
        self.turned, self.depth, self.first = 0, [0, 0], b""
        self.commas: list[dict[int, int]] = [{}, {}]
        self.opens: list[dict[int, int]] = [{}, {}]  # opening brackets by the depth behind them

    def feed(self, text: bytes) -> None:
        if not self.first:
            self.first = text.lstrip()[:1]
        at, kind, parity, quotes = marks(np.frombuffer(text, np.uint8))
        for start in (0, 1):
            kinds = kind[parity == (start + self.turned) % 2]
            step = np.where(kinds == 2, 0, kinds).astype(np.int64)
            depth = self.depth[start] + np.cumsum(step)
            for kept, counts in ((kinds == 2, self.commas[start]), (kinds == 1, self.opens[start])):
                for level, n in zip(*np.unique(depth[kept], return_counts=True)):
                    counts[int(level)] = counts.get(int(level), 0) + int(n)
            self.depth[start] += int(step.sum())
        self.turned = (self.turned + quotes) % 2


class Cutter:
    """Cuts the elements out of one byte range whose start state is known."""

    def __init__(self, inside: bool, depth: int, element: int):
        self.inside, self.depth, self.element = int(inside), depth, element
        self.whole = not inside and depth == 1  # whether the open piece is the element's beginning
        self.open: list[bytes] = []

    def feed(self, text: bytes) -> Iterator[tuple[int, bool, bytes]]:
        """(element number, whether it is complete, text) of the elements that end in ``text``."""
        at, kind, parity, quotes = marks(np.frombuffer(text, np.uint8))
        outside = parity == self.inside
        at, kind = at[outside], kind[outside]
        step = np.where(kind == 2, 0, kind).astype(np.int64)
        depth = self.depth + np.cumsum(step)
        opens = (kind == 1) & (depth == 1)  # the array's own bracket
        cut = opens | (kind == 2) & (depth == 1) | (kind == -1) & (depth == 0)
        done = 0
        for place, opened in zip(at[cut].tolist(), opens[cut].tolist()):
            if opened:
                self.open.clear()
            else:
                yield self.element, self.whole, b"".join([*self.open, text[done:place]])
                self.open.clear()
                self.element += 1
            self.whole, done = True, place + 1
        if (self.depth + int(step.sum())) > 0:
            self.open.append(text[done:])
        else:
            self.open.clear()
        self.depth += int(step.sum())
        self.inside = (self.inside + quotes) % 2

    def rest(self) -> Iterator[tuple[int, bool, bytes]]:
        if any(self.open):
            yield self.element, False, b"".join(self.open)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """((file, start, rest of the row), text) of stretches of one byte range, in order; commas are put back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
        edge = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (start[1:] != start[:-1])])
        value = batch.column("value").to_pylist()
        rest = [c for c in batch.schema.names if c not in ("file", "start", "value")]
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(file)]):
            yield (int(file[a]), int(start[a]), *(batch.column(c)[a].as_py() for c in rest)), b",".join([*value[a:b], b""])


def _fragments(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``(file, start, value)``: what stands between commas, in file order within a range; file hashes the path."""
    text = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", ",").text(root))
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("value").cast("binary").alias("value"))


MAP = ("file long, start long, turned int, depth0 long, depth1 long, commas0 map<int,long>, commas1 map<int,long>, "
       "opens0 map<int,long>, opens1 map<int,long>, first string")


def state_maps(fragments: DataFrame) -> DataFrame:
    """One row per byte range: its state map and its first character that is no white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.map_(pa.int32(), pa.int64())] * 4, pa.string()]
        names = [c.split()[0] for c in MAP.split(", ")]

        def row() -> pa.RecordBatch:
            values = (*current, held.turned, *held.depth, *(list(c.items()) for c in (*held.commas, *held.opens)), held.first.decode("latin-1"))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for key, text in _ranges(batches):
            if key != current:
                if held:
                    yield row()
                current, held = key, StateMap()
            held.feed(text)
        if held:
            yield row()

    return fragments.mapInArrow(run, MAP)


def start_states(maps: DataFrame) -> DataFrame:
    """``maps`` with the start state of each range: inside, depth, element (elements begun before it); and the state behind it."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    held = maps.withColumn("inside", F.coalesce(F.sum("turned").over(before), F.lit(0)) % 2)
    held = held.withColumn("change", F.when(F.col("inside") == 0, F.col("depth0")).otherwise(F.col("depth1")))
    held = held.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    top = (1 - F.col("depth")).cast("int")
    for name in ("commas", "opens"):
        held = held.withColumn(name, F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")))
    held = held.withColumn("here", F.coalesce(F.try_element_at("commas", top), F.lit(0)))
    outer = F.aggregate(F.map_entries("commas"), F.lit(0).cast("long"),
                        lambda n, e: n + F.when(e["key"] <= -F.col("depth"), e["value"]).otherwise(0))
    return (held.withColumn("element", F.coalesce(F.sum("here").over(before), F.lit(0)))
            .select("file", "start", (F.col("inside") == 1).alias("inside"), F.col("depth").cast("int").alias("depth"), "element",
                    ((F.col("inside") + F.col("turned")) % 2).alias("inside_after"), (F.col("depth") + F.col("change")).alias("depth_after"),
                    outer.alias("outer_commas"), F.coalesce(F.try_element_at("opens", top), F.lit(0)).alias("arrays"), "first"))


def problems(states: DataFrame) -> DataFrame:
    """``(file, reason)`` of files that are no whole JSON array by their brackets and quotes."""
    first = F.min_by("first", F.when(F.col("first") != "", F.col("start")))
    ends = states.groupBy("file").agg(first.alias("first"), F.max_by("inside_after", "start").alias("inside"),
                                      F.max_by("depth_after", "start").alias("depth"), F.sum("outer_commas").alias("outer"),
                                      F.sum("arrays").alias("arrays"))
    reason = (F.when(F.col("first").isNull() | (F.col("first") != "["), "not an array").when(F.col("inside") == 1, "ends inside a string")
              .when(F.col("depth") != 0, "brackets do not match").when((F.col("outer") > 1) | (F.col("arrays") > 1), "more than one value"))  # one comma is the file's end
    return ends.select("file", reason.alias("reason")).where(F.col("reason").isNotNull())


def _cut(fragments: DataFrame, states: DataFrame, complete: bool) -> DataFrame:
    """``(file, pos, start, piece)``: complete elements, or the pieces of those that lie in several ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cutter = None, None

        def rows(found: Iterator[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
            kept = [(n, piece) for n, whole, piece in found if whole == complete and (not complete or piece.strip())]
            if kept:
                pos, piece = zip(*kept)
                yield pa.RecordBatch.from_arrays([pa.array([current[0]] * len(kept), pa.int64()), pa.array(pos, pa.int64()),
                                                  pa.array([current[1]] * len(kept), pa.int64()), pa.array(piece, pa.binary())],
                                                 ["file", "pos", "start", "piece"])

        for (file, start, inside, depth, element), text in _ranges(batches):
            if depth is None:
                raise RuntimeError("the byte ranges of the files changed between two passes: set spark.sql.files.minPartitionNum "
                                   "and leave spark.sql.files.maxPartitionBytes as it is until the result is read")
            if (file, start) != current:
                if cutter:
                    yield from rows(cutter.rest())
                current, cutter = (file, start), Cutter(inside, depth, element)
            yield from rows(cutter.feed(text))
        if cutter:
            yield from rows(cutter.rest())

    # One row per byte range; the hint keeps the fragments in their order.
    known = F.broadcast(states.select("file", "start", "inside", "depth", "element"))
    return fragments.join(known, ["file", "start"], "left").mapInArrow(run, "file long, pos long, start long, piece binary")


def read_json_array(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """``(shard_path, pos, raw)``: the elements of every JSON array file below ``root``, as text.

    ``pos`` counts the elements of a file from 0, in file order. A file that is no whole
    array raises ValueError with its path and the reason; an empty array has no rows. The
    state maps are computed at once (one pass); the elements lazily (a pass for whole ones and one for those
    that lie in several ranges). Elements are not parsed: white space around them goes, the rest is as in the file.
    Text behind the closing bracket that has neither brackets nor commas is passed over.
    """
    # A listing: the content column is not selected, so no file is opened.
    listing = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).format("binaryFile").load(root)
    names = cut_lineage(listing.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("shard_path")))
    listed = listing.inputFiles()
    if not listed:
        raise FileNotFoundError(f"no {glob} below {root}")
    fragments = _fragments(spark, root, glob)
    states = cut_lineage(start_states(state_maps(fragments)))
    if states.count() > MOST_RANGES or len(listed) > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} files or byte ranges: merge small files or read them in several calls")
    bad = [f"{r['shard_path']}: {r['reason']}" for r in problems(states).join(names, "file").orderBy("shard_path").limit(10).collect()]
    if names.count() < len(listed):  # readers pass over files without a byte
        bad += sorted(f"{p}: empty file" for p in set(listed) - {r["shard_path"] for r in names.select("shard_path").collect()})[:10]
    if bad:
        raise ValueError("; ".join(bad))
    parts = _cut(fragments, states, False).groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("parts"))
    joined = parts.select("file", "pos", F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["piece"])).alias("piece"))
    rows = _cut(fragments, states, True).drop("start").unionByName(joined)
    raw = F.trim(F.col("piece").cast("string"), F.lit(" \t\r\n"))
    return (rows.join(F.broadcast(names.select("file", "shard_path")), "file").select("shard_path", "pos", raw.alias("raw"))
            .where(F.col("raw") != ""))
