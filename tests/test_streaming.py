"""EX-1: incremental collect over a file stream, newest result wins across batches."""

import json
import os
import time

from evalspark.sources.results import scan_result_files
from evalspark.streaming.collect_stream import latest_version, merge_batch, start_collect_stream


def put(root, name, obj, mtime):
    p = os.path.join(root, name)
    with open(p, "w") as f:
        json.dump(obj, f, indent=2)
    os.utime(p, (mtime, mtime))


def test_stream_upsert(spark, tree):
    src, table, ck = (os.path.join(tree, x) for x in ("in", "table", "ck"))
    os.makedirs(src)
    now = time.time()
    put(src, "a.json", {"model_name": "m", "results": {"t": {"acc,none": 0.5}}, "n-shot": {"t": 0}}, now - 100)
    q = start_collect_stream(spark, src, table, ck, once=True)
    q.awaitTermination(300)
    put(src, "b.json", {"model_name": "m", "results": {"t": {"acc,none": 0.6}, "u": {"f1": 0.2}},
                        "n-shot": {"t": 0, "u": 0}}, now)
    q = start_collect_stream(spark, src, table, ck, once=True)
    q.awaitTermination(300)
    rows = sorted((r.task, r.performance) for r in spark.read.parquet(latest_version(spark, table)).collect())
    assert rows == [("t", 0.6), ("u", 0.2)]


def test_replay_and_partial_folders_keep_history(spark, tree):
    table = os.path.join(tree, "table")
    run = merge_batch(table)
    for k, tasks in enumerate([{"t0": {"acc": 0.1}}, {"t1": {"acc": 0.2}}]):
        os.makedirs(os.path.join(tree, f"in{k}"))
        put(os.path.join(tree, f"in{k}"), "r.json", {"model_name": "m", "results": tasks}, 1_700_000_000 + k)
    batches = [scan_result_files(spark, os.path.join(tree, f"in{k}")) for k in range(2)]
    for k in (0, 1, 1):
        run(batches[k], k)
        os.makedirs(os.path.join(table, "batch=7"), exist_ok=True)  # a folder without _SUCCESS
    assert latest_version(spark, table).endswith("batch=1")
    assert {r.task for r in spark.read.parquet(latest_version(spark, table)).collect()} == {"t0", "t1"}
    assert latest_version(spark, os.path.join(tree, "nowhere")) is None
