"""The collect job over result files of every shape: groups and nested groups, placeholder parents, scoped keys, shots by
prefix, plugin files, files without a numeric metric. One file per customer with orders, its shape by customer number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.plans.catalog import query, r6, t
from evalspark.plans.collect import PythonParser, collect_from_files

GROUPS, PARENT, PLUGIN, BARE, PREFIX = range(5)

_SHAPES_SQL = """
WITH k AS (
  SELECT o_custkey AS cust, lower(substr(o_orderpriority, 3, 20)) AS task, count(*) / 100.0::DOUBLE AS v FROM orders GROUP BY ALL),
c AS (
  SELECT cust % 5 AS shape, 'm' || c_nationkey AS model_name, '/r/' || cust || '.json' AS src_path, task, v,
         CAST((cust + length(task)) % 7 AS VARCHAR) AS shot
  FROM k JOIN customer ON cust = c_custkey)
"""


def shaped_files(spark, sf) -> DataFrame:
    orders = t(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderdate")
    nations = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    per_task = (orders.groupBy("o_custkey", F.lower(F.substring("o_orderpriority", 3, 20)).alias("task"))
                .agg((F.count(F.lit(1)) / 100.0).alias("v"), F.max("o_orderdate").alias("at")))
    files = (per_task.groupBy("o_custkey").agg(F.max("at").alias("at"), F.sort_array(F.collect_list(F.struct("task", "v"))).alias("e"))
             .join(nations, F.col("o_custkey") == F.col("c_custkey")))
    shape = F.col("o_custkey") % 5
    model = F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("model_name")

    def entries(name, bag) -> Column:
        return F.map_from_entries(F.transform("e", lambda x: F.struct(name(x["task"]), bag(x["task"], x["v"]))))

    def scored(key) -> Column:
        return lambda task, v: F.create_map(key(task), v)

    def same(task):
        return task

    def named(prefix, end=""):
        return lambda task: F.concat(F.lit(prefix), task, F.lit(end))

    def fixed(key):
        return lambda task: F.lit(key)

    shots = lambda name: entries(name, lambda task, v: ((F.col("o_custkey") + F.length(task)) % 7).cast("int"))
    names = F.transform("e", lambda x: x["task"])
    text = F.lit(None).cast("string")
    for kind, parts in {
        # a metric-less group on top, groups with scoped keys below it, tasks below those
        GROUPS: [entries(same, scored(fixed("acc,none"))).alias("results"), shots(same).alias("n-shot"),
                 F.map_concat(F.create_map(F.lit("bench"), F.create_map(F.lit("alias"), F.lit(None).cast("double"))),
                              entries(named("g_"), scored(lambda task: F.concat(F.lit("g_"), task, F.lit("/acc,none"))))).alias("groups"),
                 F.map_concat(F.create_map(F.lit("bench"), F.transform(names, named("g_"))),
                              entries(named("g_"), lambda task, v: F.array(task))).alias("group_subtasks")],
        # an empty parent, one of its children absent
        PARENT: [F.map_concat(F.create_map(F.lit("parent"), F.create_map(F.lit("alias"), F.lit(None).cast("double"))),
                              entries(same, scored(lambda task: F.concat(task, F.lit("/acc,none"))))).alias("results"),
                 shots(same).alias("n-shot"),
                 F.create_map(F.lit("parent"), F.concat(names, F.array(F.lit("absent")))).alias("group_subtasks")],
        PLUGIN: [entries(named("audiobench_"), scored(fixed("wer"))).alias("results")],
        BARE: [entries(same, lambda task, v: F.create_map(F.lit("acc"), F.lit("n/a"))).alias("results")],
        PREFIX: [entries(named("global_mmlu_full_"), scored(fixed("acc,none"))).alias("results"),
                 shots(named("global_mmlu_full_", "_de")).alias("n-shot")],
    }.items():
        text = F.when(shape == kind, F.to_json(F.struct(model, *parts), {"ignoreNullFields": "false"})).otherwise(text)
    return files.select(F.format_string("/r/%d.json", "o_custkey").alias("path"), F.col("at").cast("timestamp").alias("mtime"), text.alias("text"))


@query("collect_shapes", _SHAPES_SQL + f"""
SELECT src_path, model_name, 'g_' || task AS task, shot AS n_shot, v AS performance, 'acc,none' AS metric_name FROM c WHERE shape = {GROUPS}
UNION ALL
SELECT src_path, model_name, 'parent', arg_min(shot, task), round(avg(v), 6), 'acc,none' FROM c WHERE shape = {PARENT} GROUP BY ALL
UNION ALL
(SELECT src_path, model_name, 'audiobench_' || task, '0', v, 'wer' FROM c WHERE shape = {PLUGIN}
 QUALIFY row_number() OVER (PARTITION BY src_path ORDER BY task) = 1)
UNION ALL
SELECT src_path, model_name, 'global_mmlu_full_' || task, shot, v, 'acc,none' FROM c WHERE shape = {PREFIX}
""")
def q_collect_shapes(spark, sf):
    rows = collect_from_files(shaped_files(spark, sf)).rows
    return rows.select("src_path", "model_name", "task", "n_shot", r6(F.col("performance")).alias("performance"), "metric_name")


@query("collect_audit", _SHAPES_SQL + f"""
SELECT 'zero rows' AS finding, src_path AS path, NULL AS task, NULL::BIGINT AS n_present, NULL::BIGINT AS n_expected
FROM c WHERE shape = {BARE} GROUP BY ALL
UNION ALL SELECT 'no metric', src_path, task, NULL, NULL FROM c WHERE shape = {BARE}
UNION ALL SELECT 'children absent', src_path, 'parent', count(*), count(*) + 1 FROM c WHERE shape = {PARENT} GROUP BY ALL
""")
def q_collect_audit(spark, sf):
    """AG-22: what the collect job could not use, as one table."""
    return collect_from_files(shaped_files(spark, sf)).findings()


@query("user_parsers", _SHAPES_SQL + """
, f AS (SELECT src_path, any_value(model_name) AS model_name, arg_min(task, task) AS task, sum(v) AS v, CAST(split_part(split_part(src_path, '/', 3), '.', 1) AS BIGINT) AS cust
        FROM c GROUP BY src_path)
SELECT src_path AS path, task, model_name, CASE WHEN cust % 3 = 0 THEN NULL ELSE CAST(cust % 4 AS VARCHAR) END AS n_shot, round(v, 6) AS performance,
       NULL AS error
FROM f WHERE cust % 7 <> 0
UNION ALL SELECT src_path, NULL, NULL, NULL, NULL, 'mine: KeyError: ''total''' FROM f WHERE cust % 7 = 0
""".replace("CASE WHEN cust % 3 = 0 THEN NULL", "CASE WHEN cust % 3 = 0 THEN 'unknown'"))
def q_user_parsers(spark, sf):
    """UD-2: files of a format of its own, one user parser that declines every file and one that raises on some."""
    orders = t(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderdate")
    nations = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    files = (orders.groupBy("o_custkey").agg((F.count(F.lit(1)) / 100.0).alias("v"), F.max("o_orderdate").alias("at"),
                                             F.min(F.lower(F.substring("o_orderpriority", 3, 20))).alias("task"))
             .join(nations, F.col("o_custkey") == F.col("c_custkey")))
    c = F.col("o_custkey")
    score = F.when(c % 7 != 0, F.col("v"))  # a NULL field is left out, so the key is missing
    body = F.struct(F.lit("own").alias("format"), F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("who"), "task",
                    F.when(c % 3 != 0, c % 4).alias("shots"), score.alias("total"))
    files = files.select(F.format_string("/r/%d.json", "o_custkey").alias("path"), F.col("at").cast("timestamp").alias("mtime"), F.to_json(body).alias("text"))

    def mine(data):
        if data.get("format") == "own":
            return data["who"], data["task"], data.get("shots"), {"total": data["total"], "note": "no number"}

    got = collect_from_files(files, parsers=[PythonParser("others", lambda data: None), PythonParser("mine", mine)])
    rows = got.rows.select(F.col("src_path").alias("path"), "task", "model_name", "n_shot", r6(F.col("performance")).alias("performance"),
                           F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast(k).alias(n) for n, k in (("task", "string"), ("model_name", "string"), ("n_shot", "string"), ("performance", "double"))]
    return rows.unionByName(got.parser_errors.select("path", *none, F.concat_ws(": ", "parser", "error").alias("error")))
