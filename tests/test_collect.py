"""End-to-end collect on small result trees shaped like the source tool's fixtures."""

import json
import os
import time

from evalspark.plans.collect import collect_results


def write(root, rel, obj, mtime=None, raw=None):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(raw if raw is not None else json.dumps(obj, indent=2))
    if mtime is not None:
        os.utime(p, (mtime, mtime))
    return p


def facts(spark, root, policy=None):
    c = collect_results(spark, root, policy=policy)
    rows = c.facts.select("model_name", "task", "n_shot", "performance", "performance_normalized",
                          "metric_name").collect()
    return sorted((r.model_name, r.task, r.n_shot, round(r.performance, 6),
                   None if r.performance_normalized is None else round(r.performance_normalized, 6),
                   r.metric_name) for r in rows)


def test_flat_file(spark, tree):
    write(tree, "results/a.json", {"model_name": "m1", "results": {"hellaswag": {"acc,none": 0.75}},
                                   "n-shot": {"hellaswag": 5}})
    assert facts(spark, tree) == [("m1", "hellaswag", "5", 0.75, 75.0, "acc,none")]


def test_scoped_keys_and_model_path(spark, tree):
    write(tree, "x.json", {"model_name_or_path": "/ckpt/llava", "model_name": "llava_hf",
                           "results": {"vqav2": {"vqav2/exact_match,none": 0.5, "alias": "vqav2"}},
                           "n-shot": {"vqav2": 0}})
    assert facts(spark, tree) == [("/ckpt/llava", "vqav2", "0", 0.5, 50.0, "exact_match,none")]


def test_bar_suffix_and_all(spark, tree):
    write(tree, "r.json", {"config_general": {"model_name": "m"},
                           "results": {"all": {"acc": 0.1},
                                       "belebele_fra_Latn_cf|5": {"acc_norm": 0.4, "acc_norm_stderr": 0.01}}})
    assert facts(spark, tree) == [("m", "belebele_fra_Latn_cf", "5", 0.4, 40.0, "acc_norm")]


def test_groups_top_level_only(spark, tree):
    write(tree, "g.json", {"model_name": "m",
                           "results": {"g": {"acc,none": 0.6}, "t1": {"acc,none": 0.5},
                                       "t2": {"acc,none": 0.7}, "solo": {"acc,none": 0.9}},
                           "groups": {"g": {"acc,none": 0.6}},
                           "group_subtasks": {"g": ["t1", "t2"]}, "n-shot": {"t1": 0, "t2": 0, "solo": 0}})
    got = facts(spark, tree)
    assert [r[1] for r in got] == ["g", "solo"]
    assert got[0][2] == "0"  # group shot from its first subtask / global


def test_metric_less_parent_descends(spark, tree):
    write(tree, "g.json", {"model_name": "m",
                           "results": {"childg": {"acc,none": 0.3}, "s1": {"acc,none": 0.3}},
                           "groups": {"parent": {}, "childg": {"acc,none": 0.3}},
                           "group_subtasks": {"parent": ["childg"], "childg": ["s1"]}})
    assert [r[1] for r in facts(spark, tree)] == ["childg"]


def test_placeholder_parent_mean(spark, tree):
    kids = {f"mvbench_{i}": {"mvbench_accuracy,none": v} for i, v in enumerate([75, 100, 0, 25])}
    write(tree, "p.json", {"model_name": "m",
                           "results": {"mvbench": {" ": " ", "alias": "mvbench"}, **kids},
                           "group_subtasks": {"mvbench": list(kids)}})
    got = facts(spark, tree)
    assert got == [("m", "mvbench", "unknown", 50.0, 50.0, "mvbench_accuracy,none")]


def test_prefix_rules(spark, tree):
    write(tree, "a.json", {"model_name": "m", "results": {"mmlu_pro": {"acc,none": 0.2}}})
    write(tree, "b.json", {"model_name": "m2", "results": {"mmlu": {"acc,none": 0.5},
                                                           "mmlu_x": {"acc,none": 0.4}}})
    write(tree, "c.json", {"model_name": "m3", "results": {
        "global_mmlu_full_zh_hans": {"acc,none": 0.5},
        "global_mmlu_full_zh_hans_anatomy": {"acc,none": 0.4}}})
    got = [(r[0], r[1]) for r in facts(spark, tree)]
    assert got == [("m", "mmlu_pro"), ("m2", "mmlu"), ("m3", "global_mmlu_full_zh_hans")]


def test_newest_wins(spark, tree):
    now = time.time()
    write(tree, "z_old.json", {"model_name": "m", "results": {"t": {"acc,none": 0.80}}, "n-shot": {"t": 0}},
          mtime=now - 100)
    write(tree, "a_new.json", {"model_name": "m", "results": {"t": {"acc,none": 0.85}}, "n-shot": {"t": 0}},
          mtime=now)
    assert facts(spark, tree) == [("m", "t", "0", 0.85, 85.0, "acc,none")]


def test_corrupt_files_skipped(spark, tree):
    write(tree, "good.json", {"model_name": "m", "results": {"t": {"acc,none": 0.5}}})
    write(tree, "trunc.json", None, raw='{"model_name": "m", "results": {"t": {"acc')
    write(tree, "samples.json", [{"doc": 1}])
    write(tree, "envelope.json", {"version": "1.2", "results": [{"model": "m"}]})
    c = collect_results(spark, tree)
    assert c.facts.count() == 1
    reasons = sorted(r.reason for r in c.rejects.collect())
    assert reasons == ["not_object", "results_not_object", "unreadable"]


def test_policy_never_falls_back(spark, tree):
    write(tree, "a.json", {"model_name": "m", "results": {"t": {"acc,none": 0.5}, "u": {"f1": 0.4}}})
    got = facts(spark, tree, policy={"t": "exact_match", "u": "f1"})
    assert got == [("m", "u", "unknown", 0.4, 40.0, "f1")]


def test_numeric_strings_are_not_numbers(spark, tree):
    write(tree, "a.json", {"model_name": "m", "results": {"t": {"acc,none": "0.9", "acc_norm,none": 0.3}}})
    assert facts(spark, tree) == [("m", "t", "unknown", 0.3, 30.0, "acc_norm,none")]


def test_plugin_claim(spark, tree):
    write(tree, "r.json", {"model_name_or_path": "/m/region", "results": {
        "regiondial_refcocog": {"gIoU": 0.61, "cIoU": 0.5}, "other": {"acc": 0.1}},
        "configs": {"regiondial_refcocog": {"num_fewshot": 0}}})
    got = facts(spark, tree, policy={"regiondial_refcocog": "gIoU"})
    assert got == [("/m/region", "regiondial_refcocog", "0", 0.61, 61.0, "gIoU")]


def test_scale_overrides(spark, tree):
    write(tree, "a.json", {"model_name": "m", "results": {
        "squadv2": {"f1,none": 55.3}, "coqa": {"f1,none": 0.553},
        "voicebench_commoneval": {"llm_as_judge_eval,none": 3.4}}})
    got = {r[1]: r[4] for r in facts(spark, tree)}
    assert got == {"squadv2": 55.3, "coqa": 55.3, "voicebench_commoneval": 68.0}


def test_missing_jobs_path_match(spark, tree):
    from evalspark.operators.analysis import missing_jobs
    write(tree, "a.json", {"model_name": "pythia-160m", "results": {"t": {"acc,none": 0.5}}, "n-shot": {"t": 0}})
    c = collect_results(spark, tree)
    jobs = spark.createDataFrame([("/abs/checkpoints/pythia-160m", "t", 0, "lm_eval"),
                                  ("/abs/checkpoints/pythia-160m-deduped", "t", 0, "lm_eval"),
                                  ("/abs/checkpoints/pythia-160m", "t", 5, "lm_eval")],
                                 "model_path string, task_path string, n_shot int, eval_suite string")
    miss = sorted((r.model_path, r.n_shot) for r in missing_jobs(jobs, c.completed).collect())
    assert miss == [("/abs/checkpoints/pythia-160m", 5), ("/abs/checkpoints/pythia-160m-deduped", 0)]
