"""Sources and sinks on temporary trees."""

import json
import os

import pytest

from pyspark.sql import functions as F

from evalspark.operators.analysis import compare_runs, leaderboard, missing_jobs
from evalspark.operators.prompts import fewshot_blocks, fewshot_prompts
from evalspark.operators.grounding import grounding_metrics, per_round_metrics
from evalspark.operators.jobs import attach_suite
from evalspark.constants import AUDIO_MODEL_RULES
from evalspark.functions.projections import route_model
from evalspark.operators.registry import (
    aux_requirements, expand_selection, fan_out_pairs, registry_summary, requested_languages, select_tasks, unmatched_languages)
from evalspark.plans.collect import collect_results
from evalspark.sinks.writers import missing_path, report_lines, write_envelope, write_missing, write_results, write_shards
from evalspark.sources.tables import (
    load_registry, read_envelope, read_jobs_csv, read_parallel_corpus, read_sample_lines, read_sample_shards, read_score_tables, scan_jobs)


def put(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_jobs_scan_and_defaults(spark, tree):
    put(tree, "a/jobs.csv", "model_path,task_path,n_shot,eval_suite\nm1,t,0,LM_EVAL\nm2,t,0,\n")
    put(tree, "b/jobs.csv", "model_path,task_path,n_shot,eval_suite\nm1,t,0,lmms_eval:Qwen\n")
    jobs = scan_jobs(spark, tree)
    got = sorted((r.model_path, r.eval_suite) for r in jobs.collect())
    assert got == [("m1", "lmms_eval:Qwen"), ("m2", None)]
    one = read_jobs_csv(spark, os.path.join(tree, "a/jobs.csv"))
    assert sorted(r.eval_suite for r in one.collect()) == ["lm_eval", "lm_eval"]


def test_registry_yaml(spark, tree):
    p = put(tree, "reg.yaml", """
task_metrics:
  sib200_deu_Latn: acc
task_groups:
  sib-eu:
    description: "SIB"
    suite: lm-eval-harness
    n_shots: [0]
    valid_langs: [deu_Latn, fra_Latn]
    tasks:
      - task: "sib200_{lang}"
        subset: "{lang}"
  misc:
    description: "Misc"
    suite: lm-eval-harness
    tasks:
      - task: copa
        n_shots: [0, 5]
super_groups:
  all-eu:
    description: "Everything"
    task_groups:
      - task: sib-eu
      - task: misc
""")
    reg = load_registry(spark, [p])
    tasks = reg["tasks"]
    assert sorted(r.task for r in tasks.collect()) == ["copa", "sib200_deu_Latn", "sib200_fra_Latn"]
    summ = {r.name: (r.suite, r.n_tasks, r.n_shots) for r in registry_summary(tasks, reg["supers"]).collect()}
    assert summ == {"sib-eu": ("lm-eval-harness", 2, "0"), "misc": ("lm-eval-harness", 1, "0, 5"),
                    "all-eu": ("mixed", 3, ""), "all": ("mixed", 3, "")}
    sel = spark.createDataFrame([("sib-eu", ["deu_Latn"]), ("misc", None)], "group string, languages array<string>")
    picked = sorted((r.task, r.n_shot) for r in select_tasks(tasks, sel).collect())
    assert picked == [("copa", 0), ("copa", 5), ("sib200_deu_Latn", 0)]


def test_sample_shards_and_metrics(spark, tree):
    put(tree, "shard_0/output_0.json", json.dumps([
        {"image_id": "1", "intersection": 1.0, "union": 1.0, "bbox_iou": 0.9},
        {"image_id": "2", "intersection": 0.5, "union": 1.0, "bbox_iou": 0.9}]))
    put(tree, "shard_1/output_0.json", json.dumps([
        {"image_id": "1", "intersection": 0.5, "union": 1.0, "bbox_iou": 0.9},
        {"image_id": "2", "intersection": 0.3, "union": 1.0, "bbox_iou": 0.1}, None]))
    s = read_sample_shards(spark, tree)
    assert s.count() == 5
    r = grounding_metrics(s, record="record").collect()[0]
    assert round(r.giou, 6) == round((1 + 0.5 + 0.5 + 0.3) / 5, 6)
    rounds = {x["round"]: x.n_samples for x in per_round_metrics(s, "record.image_id", ["shard_path", "pos"],
                                                                 record="record").collect()}
    assert rounds == {1: 3, 2: 2}


def test_envelope_roundtrip_and_compare(spark, tree):
    put(tree, "a/r.json", json.dumps({"model_name": "m", "results": {"t": {"acc,none": 0.70}}, "n-shot": {"t": 0}}))
    put(tree, "b/r.json", json.dumps({"model_name": "m", "results": {"t": {"acc,none": 0.75}}, "n-shot": {"t": 0}}))
    ea, eb = os.path.join(tree, "outa", "eval_results.json"), os.path.join(tree, "outb", "eval_results.json")
    write_envelope(collect_results(spark, os.path.join(tree, "a")).facts, [], ea)
    env = write_envelope(collect_results(spark, os.path.join(tree, "b")).facts, [{"run": 1}], eb)
    parts = sorted(p for p in os.listdir(eb) if p.startswith("part-"))
    doc = json.loads("".join(open(os.path.join(eb, p)).read() for p in parts))
    assert doc["version"] == env["version"] == "1.2" and doc["runs"] == [{"run": 1}] and doc["results"][0]["metric"] == "acc,none"
    a, b = read_envelope(spark, os.path.dirname(ea)), read_envelope(spark, eb)
    cmp = compare_runs(a, b).collect()
    assert len(cmp) == 1 and round(cmp[0].delta, 4) == 0.05


def test_score_tables_leaderboard_report(spark, tree):
    p1 = put(tree, "s1.csv", "model_name,task,n_shot,performance,performance_normalized,metric_name\n"
                             "m1,t,0,0.5,50.0,acc\nm2,t,0,0.7,70.0,acc\n")
    p2 = put(tree, "s2.csv", "model_name,task,n_shot,performance\nm1,u,5,3.0\n")
    df = read_score_tables(spark, [p1, p2, os.path.join(tree, "nope.csv")])
    wide = leaderboard(df, average=True)
    cols = wide.columns
    assert cols[1:] == ["t (0-shot, acc)", "u (5-shot, metric, raw)", "average (normalized cols)"]
    got = {r.model_name: (r[1], r[2], r[3]) for r in wide.collect()}
    assert got == {"m1": (50.0, 3.0, 50.0), "m2": (70.0, None, 70.0)}
    lines = [r.line for r in report_lines(df).orderBy("part").collect()]
    assert lines[-1] == "> `*`: not scaled to 0-100, since the native scale of the metric is unknown."


def test_missing_sink_and_shards(spark, tree):
    jobs = spark.createDataFrame([("m", "t", 0, "lm_eval")], "model_path string, task_path string, n_shot int, eval_suite string")
    out = write_missing(jobs, os.path.join(tree, "eval_results.csv"))
    assert out == missing_path(os.path.join(tree, "eval_results.csv"))
    back = read_jobs_csv(spark, out)
    assert [tuple(r) for r in back.select("model_path", "task_path", "n_shot").collect()] == [("m", "t", "0")]
    items = spark.createDataFrame([(0, [{"q": "a"}, {"q": "b"}]), (1, [{"q": "c"}]), (2, [{"q": "d"}, {"q": "e"}, {"q": "f"}])],
                                  "item_no long, conversational_turns array<struct<q:string>>")
    assert write_shards(items, os.path.join(tree, "shards"), 2) == 6
    parts = sorted(os.listdir(os.path.join(tree, "shards")))
    assert [p for p in parts if p.startswith("shard=")] == ["shard=0", "shard=1"]


def test_writes_count_in_one_pass(spark, tree):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    items = spark.range(50).selectExpr("id AS item_no", "transform(sequence(1, id % 4 + 1), x -> named_struct('q', 'a')) AS conversational_turns")
    assert write_shards(items.mapInPandas(count, items.schema), os.path.join(tree, "s"), 3) == sum(i % 4 + 1 for i in range(50))
    assert made.value == 50
    facts = spark.range(20).selectExpr("'m' AS model_name", "'t' AS task", "'0' AS n_shot", "id / 1.0 AS performance", "null AS performance_normalized", "'a' AS metric_name")
    assert write_results(facts.mapInPandas(count, "model_name string, task string, n_shot string, performance double, performance_normalized double, metric_name string"),
                         os.path.join(tree, "r"), "parquet") == 20
    assert made.value == 70 and spark.read.parquet(os.path.join(tree, "r")).count() == 20


def test_jobs_by_header_name(spark, tree):
    put(tree, "a/jobs.csv", "model_path,task_path,n_shot\nm1,t,0\n")
    put(tree, "b/jobs.csv", "n_shot,eval_suite,task_path,model_path\n5,LM,u,\"m,2\"\n0,X,t,m1\n")
    got = sorted((r.model_path, r.task_path, r.n_shot, r.eval_suite) for r in scan_jobs(spark, tree).collect())
    assert got == [("m,2", "u", "5", "LM"), ("m1", "t", "0", "X")]
    os.makedirs(os.path.join(tree, "none"))
    assert scan_jobs(spark, os.path.join(tree, "none")).collect() == []


def test_shards_missing_and_lines(spark, tree):
    os.makedirs(os.path.join(tree, "none"))
    for read in (read_sample_shards, read_sample_lines):
        with pytest.raises(FileNotFoundError):
            read(spark, os.path.join(tree, "none"))
    put(tree, "s/output_0.jsonl", '{"image_id": "1", "intersection": 1.0, "union": 2.0, "bbox_iou": 0.5}\n[1]\n\n')
    got = read_sample_lines(spark, os.path.join(tree, "s")).orderBy("pos").collect()
    assert [r.record and r.record.union for r in got] == [2.0, None]


def test_first_registration_wins(spark):
    jobs = spark.createDataFrame([("m", "t"), ("m", "u")], "model_path string, task_path string")
    suites = spark.createDataFrame([("t", "second", 1), ("t", "first", 0)], "task string, suite string, pos int")
    assert sorted((r.task_path, r.eval_suite) for r in attach_suite(jobs, suites).collect()) == [("t", "first"), ("u", "lm_eval")]


def test_selection_of_groups(spark):
    tasks = spark.createDataFrame([("g1", ["deu_Latn"]), ("g1", ["fra_Latn"]), ("g2", [])], "group string, languages array<string>")
    supers = spark.createDataFrame([("both", "g1"), ("both", "g2")], "super string, group string")

    def ask(*rows):
        return expand_selection(spark.createDataFrame(list(rows), "name string, languages array<string>"), tasks, supers)

    assert sorted((r.name, r.group) for r in ask(("all", None), ("both", None), ("g2", None)).collect()) == [
        ("all", "g1"), ("all", "g2"), ("both", "g1"), ("both", "g2"), ("g2", "g2")]
    with pytest.raises(ValueError, match="nope"):
        ask(("nope", None))
    got = unmatched_languages(tasks, ask(("both", ["deu_Latn", "ita_Latn"]), ("g2", None))).collect()
    assert [(r.name, r.language) for r in got] == [("both", "ita_Latn")]
    with pytest.raises(ValueError, match="g2"):
        unmatched_languages(tasks, ask(("g2", ["deu_Latn"])))


def test_aux_requirements_and_pairs(spark):
    aux = spark.createDataFrame([("t", 0, [], []), ("t", 1, ["m1", "m2"], [("r", None, ["a", "b"])]), ("t", 2, ["x"], []),
                                 ("u", 3, ["m2", "m3"], [("r", None, ["b", "c"]), ("", None, ["z"])])],
                                "task string, reg_pos int, hf_models array<string>, "
                                "files array<struct<repo_id:string,revision:string,patterns:array<string>>>")
    names = spark.createDataFrame([(" u ", 0), ("t", 1), ("u", 2), ("w", 3)], "task string, pos int")
    models, files = aux_requirements(names, aux)
    assert [r.repo_id for r in models.orderBy("pos").collect()] == ["m2", "m3", "m1"]
    assert [(r.repo_id, r.patterns) for r in files.collect()] == [("r", ["b", "c", "a"])]
    reqs = spark.createDataFrame([("flores200:a-b", "fl", None), ("flores200:a-b", "fl", "s"), ("x", "o", None)], "task string, repo_id string, subset string")
    assert sorted((r.repo_id, r.subset or "") for r in fan_out_pairs(reqs, "fl").collect()) == [
        ("fl", "a"), ("fl", "a-b"), ("fl", "b"), ("fl", "s"), ("o", "")]


def test_audio_routing(spark):
    df = spark.createDataFrame([("org/Qwen2-Audio-7B-Instruct",), ("x/SALMONN-13B",)], "m string")
    assert [r[0] for r in df.select(route_model("m", AUDIO_MODEL_RULES, strict=True)).collect()] == ["Qwen2-Audio-7B-Instruct", "SALMONN_7B"]
    with pytest.raises(Exception, match="no routing rule matches model other"):
        spark.createDataFrame([("other",)], "m string").select(route_model("m", AUDIO_MODEL_RULES, strict=True)).collect()


def test_any_number_of_splits(spark, tree):
    spark.range(3000).selectExpr("concat('s', lpad(id, 4, '0')) AS split", "id AS line").repartition(2, "split").write.partitionBy("split").parquet(os.path.join(tree, "many"))
    for split in ("s0000", "s2999"):
        assert [r.line for r in read_parallel_corpus(spark, os.path.join(tree, "many"), split).collect()] == [int(split[1:])]
    with pytest.raises(ValueError, match="'dev' not found; available: s0000, s0001, .*s0099, ...$"):
        read_parallel_corpus(spark, os.path.join(tree, "many"), "dev")
    spark.range(4).selectExpr("'only' AS split", "id AS line").write.parquet(os.path.join(tree, "column"))
    assert read_parallel_corpus(spark, os.path.join(tree, "column"), "dev").count() == 4


def test_requested_languages(spark):
    known = spark.createDataFrame([("deu_Latn",), ("fra_Latn",), ("ita_Latn",)], "code string")
    assert requested_languages([" fra_Latn", "", "deu_Latn", "fra_Latn"], known) == ["fra_Latn", "deu_Latn"]
    assert requested_languages([" "], known) == []
    with pytest.raises(ValueError, match=r"unknown language codes: xx, de \(use deu_Latn\); valid codes: deu_Latn, fra_Latn, ita_Latn"):
        requested_languages(["fra_Latn", "xx", "de"], known)


def test_missing_jobs_compare_shots_in_canonical_form(spark):
    jobs = spark.createDataFrame([("a/m", "t", "5"), ("m", "t", "5.0"), ("m", "u", "unknown"), ("m", "v", "0")], "model_path string, task_path string, n_shot string")
    done = spark.createDataFrame([("m", "t", "5.0"), ("m", "u", "5"), ("m", "v", "00")], "model string, task string, n_shot string")
    assert sorted(r.task_path for r in missing_jobs(jobs, done).collect()) == ["u"]


def test_fewshot_blocks(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 1, "w")], "g string, n int, s string")
    blocks = fewshot_blocks(rows, F.col("s"), 2, ["n"], ["g"], sep="|")
    assert {r.g: r.block for r in blocks.collect()} == {"a": "y|z", "b": "w"}
    asked = spark.createDataFrame([("a", "q1"), ("c", "q2")], "g string, q string")
    assert {r.g: r.prompt for r in fewshot_prompts(asked, blocks, F.col("q"), ["g"], "|").collect()} == {"a": "y|z|q1", "c": "q2"}
    none = fewshot_blocks(rows.limit(0), F.col("s"), 2, ["n"])
    assert [r.prompt for r in fewshot_prompts(asked, none, F.col("q")).orderBy("g").collect()] == ["q1", "q2"]
