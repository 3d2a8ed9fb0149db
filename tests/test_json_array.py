"""Giant JSON arrays: state maps, ranges cut anywhere, pieces joined, what is refused."""

import json
import os
import random

import pytest

from evalspark.sources.json_array import Cutter, StateMap, read_json_array
from evalspark.sources.tables import read_sample_array, read_sample_lines, read_sample_shards


@pytest.fixture
def tiny_ranges(spark):
    """Byte ranges of 64 bytes, so that they begin inside strings, escapes and deep elements."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for n in names:
        spark.conf.set(n, "64b")
    yield spark
    for n in names:
        spark.conf.unset(n)


def value(rng, depth=0):
    r = rng.random()
    if depth > 4 or r < 0.3:
        return rng.choice([1, -2.5, None, True, "", "a,b", '"', "\\", '\\"', "[{", "}],", "é, ", "x" * 100, "\\," * 40, ",\\\\"])
    if r < 0.6:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["a", ",", "{", '"', "\\"]): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


@pytest.mark.parametrize("seed", range(20))
def test_any_comma_may_begin_a_range(seed):
    rng = random.Random(seed)
    array = [value(rng) for _ in range(rng.randint(1, 8))]
    text = json.dumps(array, indent=rng.choice([None, 1])).encode() + b","
    commas = [i for i, c in enumerate(text) if c == 44]
    bounds = [0, *sorted(i + 1 for i in rng.sample(commas[:-1], min(len(commas) - 1, rng.randint(0, 12)))), len(text)]
    inside, depth, element, pieces = 0, 0, 0, {}
    for a, b in zip(bounds, bounds[1:]):
        held, cutter = StateMap(), Cutter(bool(inside), depth, element)
        middle = rng.choice([a, b, *[i + 1 for i in commas if a <= i < b]])  # fed in two batches
        for part in (text[a:middle], text[middle:b]):
            if part:
                held.feed(part)
                for n, whole, piece in cutter.feed(part):
                    pieces.setdefault(n, []).append((whole, piece))
        for n, whole, piece in cutter.rest():
            pieces.setdefault(n, []).append((whole, piece))
        element += held.commas[inside].get(1 - depth, 0)
        depth += held.depth[inside]
        inside = (inside + held.turned) % 2
    assert (inside, depth) == (0, 0)
    assert all(len(p) == 1 or not any(whole for whole, _ in p) for p in pieces.values())
    assert [json.loads(b"".join(x for _, x in pieces[n])) for n in sorted(pieces)] == array


def test_fuzzed_files(tiny_ranges, tree):
    rng, want = random.Random(1), {}
    for n in range(5):
        array = [value(rng) for _ in range((0, 1, 30, 30, 30)[n])]
        text = json.dumps(array, ensure_ascii=n % 2 == 0, indent=(None, 2)[n % 2], separators=rng.choice([None, (",", ":")]))
        os.makedirs(f"{tree}/s{n}")
        with open(f"{tree}/s{n}/output_0.json", "w") as f:
            f.write(rng.choice(["", " \n"]) + text + rng.choice(["", "\n  "]))
        want[f"s{n}"] = array
    got = {k: {} for k in want}
    for r in read_json_array(tiny_ranges, tree).collect():
        got[r.shard_path.split("/")[-2]][r.pos] = json.loads(r.raw)
    assert got == {k: dict(enumerate(v)) for k, v in want.items()}
    assert any(len(json.dumps(v)) > 4 * 64 for v in want["s2"])  # elements over several ranges were among them


def test_one_file_is_read_by_many_tasks(tiny_ranges, tree):
    with open(f"{tree}/output_0.json", "w") as f:
        json.dump([{"image_id": str(i), "intersection": i, "union": 2.0} for i in range(200)] + [None, "text", [1]], f)
    rows = read_sample_array(tiny_ranges, tree)
    assert rows.select("pos").distinct().count() == 203
    got = {r.pos: r.record for r in rows.collect()}
    assert [got[i].intersection for i in range(200)] == list(map(float, range(200))) and [got[i] for i in (200, 201, 202)] == [None] * 3
    whole = read_sample_shards(tiny_ranges, tree)
    assert rows.schema.simpleString() == whole.schema.simpleString() and sorted(map(str, rows.collect())) == sorted(map(str, whole.collect()))
    scan = read_json_array(tiny_ranges, tree)
    assert scan.rdd.getNumPartitions() > 50


@pytest.mark.parametrize("text,reason", [('{"a": [1, 2]}', "not an array"), ("", "empty file"), (" \n ", "not an array"), ('[1, "a, b', "ends inside a string"),
                                         ('[{"a": 1}, {"b": [2, 3}', "brackets do not match"), ("[1, 2] [3, 4]", "more than one value"), ("[1, 2], 3, 4", "more than one value")])
def test_refused_files(spark, tree, text, reason):
    for name, body in (("output_0.json", "[1, 2]"), ("output_1.json", text)):
        with open(f"{tree}/{name}", "w") as f:
            f.write(body)
    with pytest.raises(ValueError, match=f"output_1.json: {reason}"):
        read_json_array(spark, tree)
    with pytest.raises(FileNotFoundError):
        read_json_array(spark, tree, "other_*.json")


def test_lines_are_numbered_across_ranges(tiny_ranges, tree):
    lines = [json.dumps({"image_id": str(i), "union": float(i)}) if i % 7 else ["", "[1]", " "][i % 3] for i in range(300)]
    for name in ("output_a.jsonl", "output_b.jsonl"):
        with open(f"{tree}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")
    got = {}
    for r in read_sample_lines(tiny_ranges, tree).collect():
        got.setdefault(r.shard_path[-7:-6], {})[r.pos] = r.record and r.record.union
    want = {i: float(i) if i % 7 else None for i, line in enumerate(lines) if line.strip()}
    assert got == {"a": want, "b": want}
