"""Run attachment, version-pin audit and extension points."""

import json
import random

from pyspark.sql import functions as F

from evalspark.operators.extensions import (
    MergeableMetric, MetricSpec, TaskSpec, compute_mergeable, compute_metrics, region_metrics, routing_rules, task_spec_rows)
from evalspark.operators.provenance import attach_runs, pin_violations
from evalspark.functions.projections import route_model
from evalspark.operators.registry import select_tasks
from evalspark.plans.collect import DEFAULT_PARSERS, PythonParser, collect_from_files
from evalspark.sources.tables import load_registry


def test_attach_runs_nearest_ancestor(spark):
    rows = spark.createDataFrame([("/e/run1/results/a.json",), ("/e/run1/sub/run2/r/b.json",), ("/x/c.json",)],
                                 "src_path string")
    prov = spark.createDataFrame([("/e/run1/provenance.json",), ("/e/run1/sub/run2/provenance.json",)],
                                 "_path string")
    got = sorted((r.src_path, r.run_path) for r in attach_runs(rows, prov).collect())
    assert got == [("/e/run1/results/a.json", "/e/run1/provenance.json"),
                   ("/e/run1/sub/run2/r/b.json", "/e/run1/sub/run2/provenance.json"),
                   ("/x/c.json", None)]


def test_pin_violations(spark):
    runs = spark.createDataFrame([("p1", {"engine_versions": '{"lm_eval": "0.4.10"}'}),
                                  ("p2", {"engine_versions": '{"lm_eval": "0.4.9.2"}'}),
                                  ("p3", {})], "_path string, record map<string,string>")
    groups = spark.createDataFrame([("p1", "dclm-core-22"), ("p2", "dclm-core-22"), ("p3", "dclm-core-22"),
                                    ("p1", "other")], "_path string, group string")
    got = sorted((r._path, r.recorded) for r in pin_violations(groups, runs).collect())
    assert got == [("p1", "0.4.10"), ("p3", None)]


def test_metric_specs_and_routing(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.9), (0.5, 2.0, 0.1)], "intersection double, union double, bbox_iou double") \
        .select(F.struct("intersection", "union", "bbox_iou").alias("record"))
    specs = region_metrics() + [MetricSpec("n", lambda: F.count(F.lit(1)))]
    got = {r.metric: r.value for r in compute_metrics(df, specs).collect()}
    assert got["gIoU"] == 0.625 and got["cIoU"] == 0.5 and got["n"] == 2.0
    m = spark.createDataFrame([("org/MyQwenVariant",)], "p string")
    rules = routing_rules([(["myqwen"], "custom_family")])
    assert m.select(route_model("p", rules)).collect()[0][0] == "custom_family"


def median_metric():
    """A state of any length: all values (fine for a test); failed samples are left out."""
    return MergeableMetric("median", lambda rows: sorted(rows["x"].dropna().tolist()), lambda a, b: sorted([*a, *b]),
                           lambda s: 0.0 if not s else s[(len(s) - 1) // 2])


def test_mergeable_metrics_equal_one_pass(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 9 + ["a", None]), rng.choice([None, rng.random()])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(13)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.k: r.value for r in compute_mergeable(df, [median_metric()], ["x"], ["k"]).collect()}
        whole = compute_mergeable(df, [median_metric()], ["x"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def median(values):
        s = sorted(v for v in values if v is not None)
        return s[(len(s) - 1) // 2] if s else 0.0

    assert got == {k: median([x for g, x in rows if g == k]) for k in ("hot", "a", None)}
    assert [(r.metric, r.value) for r in whole] == [("median", median([x for _, x in rows]))]
    states = compute_mergeable(df, [median_metric()], ["x"], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert states.index("FlatMapGroupsInPandas") < states.index("Exchange") < states.index("MapInPandas")  # states are shuffled, not samples


def test_mergeable_metrics_of_nothing(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert [(r.metric, r.value) for r in compute_mergeable(df, [median_metric()], ["x"]).collect()] == [("median", 0.0)]
    assert compute_mergeable(df, [median_metric()], ["x"], ["k"]).collect() == []


def test_task_specs_fit_the_registry(spark, tree):
    with open(f"{tree}/reg.yaml", "w") as f:
        f.write('task_groups:\n  g:\n    suite: s\n    valid_langs: [deu_Latn]\n    tasks:\n      - task: "t_{lang}"\n        subset: "{lang}"\n        n_shots: [0]\n')
    reg = load_registry(spark, [f"{tree}/reg.yaml"])["tasks"]
    rows, metrics = task_spec_rows(spark, [TaskSpec("my_task", "mine", n_shots=[0, 5], primary_metric="iou", description="d",
                                                    dataset_files=[{"repo_id": "o/d", "patterns": ["a/*"]}]),
                                           TaskSpec("u", "mine", group="own", engine_task="u_x", subset="fra_Latn")], reg)
    both = reg.unionByName(rows)
    got = {r.task: r for r in both.collect()}
    assert [(got[k].group, got[k].group_pos) for k in ("t_deu_Latn", "my_task", "u_x")] == [("g", 0), ("my-task", 1), ("own", 2)]
    assert got["my_task"].hf_dataset_files[0].patterns == ["a/*"] and got["u_x"].languages == ["fra_Latn"]
    assert [tuple(r) for r in metrics.collect()] == [("my_task", "iou")]
    assert sorted((r.task, r.n_shot) for r in select_tasks(both, spark.createDataFrame([("my-task", None)], "group string, languages array<string>")).collect()) == [
        ("my_task", 0), ("my_task", 5)]


def test_user_parsers_fail_alone(spark):
    def strict(data):
        return data["who"], data["task"], data["shots"], {"acc": data["v"] / data["n"]}

    files = [("/a.json", {"who": "m", "task": "t", "shots": 5, "v": 1, "n": 2}), ("/b.json", {"who": "m", "task": "t", "shots": 0, "v": 1, "n": 0}),
             ("/c.json", {"model_name": "g", "results": {"u": {"acc": 0.5}}, "n-shot": {"u": 3}}), ("/d.json", {"who": "p", "task": "t", "shots": None, "v": 3, "n": 3}),
             ("/e.json", {"model_name": "x", "results": {"audiobench_q": {"wer": 0.1}}})]
    df = spark.createDataFrame([(p, json.dumps(d)) for p, d in files], "path string, text string").withColumn("mtime", F.current_timestamp())
    c = collect_from_files(df, parsers=[PythonParser("strict", strict), *DEFAULT_PARSERS])
    assert sorted((r.model_name, r.task, r.n_shot, r.performance) for r in c.facts.collect()) == [
        ("g", "u", "3", 0.5), ("m", "t", "5", 0.5), ("p", "t", "unknown", 1.0), ("x", "audiobench_q", "0", 0.1)]
    errors = {r.path: r.error for r in c.parser_errors.collect()}
    assert errors.keys() == {"/b.json", "/c.json", "/e.json"} and errors["/b.json"].startswith("ZeroDivisionError") and errors["/c.json"] == "KeyError: 'who'"
    assert [r.path for r in c.zero_row_files.collect()] == ["/b.json"]
    # the first listed claim holds
    late = collect_from_files(df.where("path = '/e.json'"), parsers=[*DEFAULT_PARSERS, PythonParser("all", lambda d: ("z", "t", 0, {"acc": 1}))])
    assert [r.model_name for r in late.facts.collect()] == ["x"]
    early = collect_from_files(df.where("path = '/e.json'"), parsers=[PythonParser("all", lambda d: ("z", "t", 0, {"acc": 1})), *DEFAULT_PARSERS])
    assert [r.model_name for r in early.facts.collect()] == ["z"]
