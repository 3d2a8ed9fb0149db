"""Collect rules over ``(path, mtime, text)`` rows: roll-up prefixes, NaN, positions; deep metric search; long chains."""

import random

import pytest

import json
import math

from pyspark.sql import functions as F

from evalspark.functions.jsonpath import _parse_deep, find_metric
from evalspark.operators.resolve import descend_groups
from evalspark.plans.collect import collect_from_files


def facts(spark, *texts):
    rows = [(f"/r/{i}.json", t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)]
    files = spark.createDataFrame(rows, "path string, text string").select("path", F.timestamp_seconds(F.lit(1)).alias("mtime"), "text")
    return {(r.model_name, r.task): r for r in collect_from_files(files).facts.collect()}


def test_prefix_rules_see_all_results(spark):
    doc = {"model_name": "m", "groups": {"global_mmlu_full_de": {"acc": 0.5}, "top": {"acc": 0.1}},
           "group_subtasks": {"global_mmlu_full_de": ["x"], "top": ["mmlu"]},
           "results": {"global_mmlu_full_de": {"acc": 0.5}, "global_mmlu_full_de_anatomy": {"acc": 0.4}, "mmlu": {"acc": 0.3},
                       "mmlu_x": {"acc": 0.2}, "mmluish": {"acc": 0.9}, "top": {"acc": 0.1}}}
    got = {t for _, t in facts(spark, doc)}
    assert got == {"global_mmlu_full_de", "top", "mmluish"}


def test_nan_is_a_number(spark):
    got = facts(spark, '{"model_name": "m", "results": {"t": {"acc,none": NaN, "f1": 0.3}, "u": {"acc": "NaN", "f1": 0.4}, "v": {"acc": -Infinity}}}')
    assert got[("m", "t")].metric_name == "acc,none" and math.isnan(got[("m", "t")].performance)
    assert got[("m", "u")].metric_name == "f1" and got[("m", "u")].performance == 0.4
    assert got[("m", "v")].performance == -math.inf


def test_find_metric_at_any_depth(spark):
    deep = {"wer": {"score": 0.04}}
    for i in range(60):
        deep = {"a": [1, {"b": deep}]} if i % 2 else {"c": deep}
    rows = [json.dumps(x) for x in (deep, {"x": {"wer": 1}, "wer": "no"}, {"wer": True}, {"wer": {"score": "x"}, "y": [{"wer": 2.5}]}, [], 3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, None, "{bad"])], "i int, t string")
    got = {r.i: r.m for r in df.select("i", find_metric("t", "wer").alias("m")).collect()}
    assert [got[i] for i in range(8)] == [0.04, 1.0, 1.0, 2.5, None, None, None, None]


def test_chain_of_groups_longer_than_any_cap(spark):
    n = 70
    groups = spark.createDataFrame([(1, f"g{i:03}", i, i == n) for i in range(n + 1)], "file_id int, group string, group_pos long, has_metric boolean")
    edges = spark.createDataFrame([(1, f"g{i:03}", f"g{i + 1:03}", 0) for i in range(n)], "file_id int, parent string, child string, child_pos long")
    assert [(r.group, r.level) for r in descend_groups(groups, edges).collect()] == [(f"g{n:03}", n)]


def walk(groups, edges):
    """Breadth-first walk by a queue: {file: [(group, visit)]} of the groups with a metric."""
    out = {}
    for f in {g[0] for g in groups}:
        order = [(g, m) for _, g, _, m in sorted((x for x in groups if x[0] == f), key=lambda x: x[2])]
        metric, kids = dict(order), {}
        for _, parent, child, pos in sorted((e for e in edges if e[0] == f), key=lambda e: e[3]):
            kids.setdefault(parent, []).append(child)
        under = {c for v in kids.values() for c in v}
        queue = [g for g, _ in order if g not in under] or [g for g, _ in order]
        seen = []
        while queue:
            g = queue.pop(0)
            if g in seen:
                continue
            seen.append(g)
            if not metric[g]:
                queue += [c for c in kids.get(g, []) if c in metric]
        out[f] = [(g, n) for n, g in enumerate(seen) if metric[g]]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_descent_is_breadth_first(spark, seed):
    rng = random.Random(seed)
    groups, edges = [], []
    for f in range(25):
        names = [f"g{n}" for n in range(rng.randint(1, 9))]
        groups += [(f, g, pos, rng.random() < 0.4) for pos, g in enumerate(rng.sample(names, len(names)))]
        for parent in rng.sample([*names, "only results"], rng.randint(0, len(names))):
            below = rng.sample([*names, "task"], rng.randint(0, len(names)))
            edges += [(f, parent, child, pos) for pos, child in enumerate(below)]
    got = {}
    for r in descend_groups(spark.createDataFrame(groups, "file_id int, group string, group_pos long, has_metric boolean"),
                            spark.createDataFrame(edges, "file_id int, parent string, child string, child_pos int")).collect():
        got.setdefault(r.file_id, []).append((r.group, r.visit))
    want = walk(groups, edges)
    assert {f: sorted(v, key=lambda x: x[1]) for f, v in got.items()} == {f: v for f, v in want.items() if v}


def test_descent_lists_no_paths(spark):
    """Thirty layers of two groups each that all lead on to both of the next: 2^30 paths, 60 groups."""
    groups = [(1, f"{side}{n}", 2 * n + k, n == 29) for n in range(30) for k, side in enumerate("ab")]
    edges = [(1, f"{x}{n}", f"{y}{n + 1}", k) for n in range(29) for x in "ab" for k, y in enumerate("ab")]
    got = descend_groups(spark.createDataFrame(groups, "file_id int, group string, group_pos long, has_metric boolean"),
                         spark.createDataFrame(edges, "file_id int, parent string, child string, child_pos int")).collect()
    assert sorted((r.group, r.level, r.visit) for r in got) == [("a29", 29, 58), ("b29", 29, 59)]


def test_find_metric_deeper_than_any_stack(spark):
    n = 100_000
    rows = ['{"a":' * n + '{"wer": 0.5}' + "}" * n, "[" * n + '{"x": {"wer": {"score": 2}}}' + "]" * n, '{"a":' * n + "{}" + "}" * n, "[" * n + '{"wer": 1}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    assert [r.m for r in df.orderBy("i").select(find_metric("t", "wer").alias("m")).collect()] == [0.5, 2.0, None, None]


@pytest.mark.parametrize("key,text,want", [
    ("wer", '{"\\u0077er": 3}', 3.0), ("wer", '{"x": {"\\u0077er": 3}}', 3.0), ("a'b", '{"x": {"a\'b": 4}}', 4.0), ("é", '{"é": 5}', 5.0),
    ('q"', '{"q\\"": 6}', 6.0), ("wer", '{"wer": "7"}', None), ("wer", '{"wer": "7", "z": {"wer": 8}}', 8.0), ("wer", '{"wer": {"score": "9"}, "b": [{"wer": 1}]}', 1.0),
    ("wer", '{"wer": 1, "wer": 2}', 2.0), ("wer", '{"wer": null}', None), ("wer", '{"wer": 12345678901234567890123}', 1.2345678901234568e22),
    ("a.b", '{"a": {"b": 1}, "a.b": 2}', 2.0), ("wer", "", None), ("wer", '{"wer": false}', 0.0)])
def test_find_metric_keys(spark, key, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert [r.m for r in df.select(find_metric("t", key).alias("m")).collect()] == [want]


def test_parser_without_recursion_equals_the_library():
    rng = random.Random(3)

    def value(depth=0):
        r = rng.random()
        if depth > 4 or r < 0.3:
            return rng.choice([1, -2.5, 1e30, None, True, False, "", "a,b", '"', "\\", '\\"', "[{", "é\n"])
        if r < 0.6:
            return [value(depth + 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice(["a", ",", "{", '"', "\\"]): value(depth + 1) for _ in range(rng.randint(0, 3))}

    def outcome(parse, text):
        try:
            return parse(text)
        except ValueError:
            return "unreadable"

    for _ in range(3000):
        text = json.dumps(value(), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if rng.random() < 0.5:
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(["", "]", "}", ",", '"', "x", "[", ":"]) + text[i + rng.choice([0, 1]):]
        assert outcome(json.loads, text) == outcome(_parse_deep, text), text
