"""Collect end to end, registry requirements and job guards bound to driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.answers import strict_match
from evalspark.operators.analysis import compare_runs, sorted_comparison
from evalspark.operators.jobs import needs_judge, suites_without
from evalspark.operators.registry import expand_selection, first_seen, merge_file_patterns, requirements_for, select_tasks
from evalspark.plans.catalog import query, t
from evalspark.plans.collect import collect_from_files


def _result_files(spark, sf):
    """One result file per customer with orders: a task per order priority, its score a hundredth of the order count.

    The shot count comes as an ``n-shot`` entry, as ``configs``, or as a name suffix.
    """
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    nations = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    kind = F.col("o_custkey") % 3
    task = F.concat(F.lower(F.substring("o_orderpriority", 3, 20)), F.when(kind == 2, "|5").otherwise(""))
    per_task = (orders.groupBy("o_custkey", task.alias("task"))
                .agg((F.count(F.lit(1)) / 100.0).alias("v"), F.max("o_orderdate").alias("at")))
    files = per_task.groupBy("o_custkey").agg(
        F.max("at").alias("at"),
        F.map_from_entries(F.collect_list(F.struct("task", F.create_map(F.lit("acc,none"), "v").alias("m")))).alias("results"),
        F.map_from_entries(F.collect_list(F.struct("task", (F.col("o_custkey") % 5).cast("int").alias("s")))).alias("shots"))
    files = files.join(nations, F.col("o_custkey") == F.col("c_custkey"))
    model = F.concat(F.lit("m"), F.col("c_nationkey").cast("string"))
    text = (F.when(kind == 0, F.to_json(F.struct(model.alias("model_name"), "results", F.col("shots").alias("n-shot"))))
            .when(kind == 1, F.to_json(F.struct(model.alias("model_name"), "results", F.transform_values(
                "shots", lambda k, v: F.create_map(F.lit("num_fewshot"), v)).alias("configs"))))
            .otherwise(F.to_json(F.struct(model.alias("model_name"), "results"))))
    return files.select(F.format_string("/r/%d.json", "o_custkey").alias("path"), F.col("at").cast("timestamp").alias("mtime"),
                        text.alias("text"))


_ROWS_SQL = """
k AS (
  SELECT o_custkey, lower(substr(o_orderpriority, 3, 20)) AS task, count(*) / 100.0::DOUBLE AS performance, max(o_orderdate) AS seen
  FROM orders GROUP BY ALL),
r AS (
  SELECT 'm' || c_nationkey AS model_name, task, CASE WHEN o_custkey % 3 = 2 THEN '5' ELSE CAST(o_custkey % 5 AS VARCHAR) END AS n_shot,
         performance, '/r/' || o_custkey || '.json' AS src_path, max(seen) OVER (PARTITION BY o_custkey) AS mtime
  FROM k JOIN customer ON o_custkey = c_custkey)"""


@query("collect_facts", "WITH" + _ROWS_SQL + """
SELECT model_name, task, n_shot, performance, 'acc,none' AS metric_name, round(performance * 100, 6) AS performance_normalized FROM r
QUALIFY row_number() OVER (PARTITION BY model_name, task, n_shot ORDER BY mtime DESC, src_path DESC) = 1
""")
def q_collect_facts(spark, sf):
    facts = collect_from_files(_result_files(spark, sf)).facts
    return facts.select("model_name", "task", "n_shot", "performance", "metric_name",
                        F.round("performance_normalized", 6).alias("performance_normalized"))


@query("resolve_n_shot", "WITH" + _ROWS_SQL + "\nSELECT src_path, task, n_shot FROM r")
def q_resolve_n_shot(spark, sf):
    return collect_from_files(_result_files(spark, sf)).rows.select("src_path", "task", "n_shot")


_JUDGED = ["1-URGENT", "5-LOW", "6-NONE"]


@query("judge_tasks", f"""
SELECT DISTINCT o_orderpriority AS task FROM orders WHERE o_orderpriority IN ({", ".join(f"'{x}'" for x in _JUDGED)}) ORDER BY task
""")
def q_judge_tasks(spark, sf):
    return needs_judge(t(spark, sf, "orders").select(F.col("o_orderpriority").alias("task_path")), judge_tasks=_JUDGED)


@query("suites_without", """
SELECT DISTINCT c_mktsegment AS suite FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
""")
def q_suites_without(spark, sf):
    jobs = t(spark, sf, "customer").select(F.concat("c_mktsegment", F.lit(":"), "c_name").alias("eval_suite"))
    return suites_without(jobs, spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "suite string"))


@query("file_patterns", """
WITH f AS (
  SELECT CASE WHEN p_size % 11 = 0 THEN ' ' ELSE p_brand END AS repo_id, CASE WHEN p_size % 2 = 0 THEN 'v1' ELSE 'main' END AS revision,
         p_type AS pattern, min(p_partkey) AS pos
  FROM part GROUP BY ALL)
SELECT repo_id, revision, string_agg(pattern, ',' ORDER BY pos) AS patterns FROM f WHERE trim(repo_id) <> '' GROUP BY ALL
""")
def q_file_patterns(spark, sf):
    p = t(spark, sf, "part")
    files = p.select(F.when(F.col("p_size") % 11 == 0, " ").otherwise(F.col("p_brand")).alias("repo_id"),
                     F.when(F.col("p_size") % 2 == 0, "v1").alias("revision"), F.col("p_type").alias("pattern"),
                     F.col("p_partkey").alias("pos"))
    return merge_file_patterns(files).select("repo_id", "revision", F.array_join("patterns", ",").alias("patterns"))


@query("first_seen", "SELECT p_type, min(p_partkey) AS pos FROM part GROUP BY p_type ORDER BY pos")
def q_first_seen(spark, sf):
    return first_seen(t(spark, sf, "part").select("p_type", "p_partkey"), "p_type", "p_partkey")


@query("requirements", """
WITH d AS (SELECT p_type, p_brand, CAST(p_size AS VARCHAR) AS subset, p_name AS suite,
                  row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn FROM part),
n AS (SELECT DISTINCT c_mktsegment AS task FROM customer UNION SELECT p_type FROM part)
SELECT task, p_brand AS repo_id, subset, suite FROM n JOIN d ON task = p_type AND rn = 1
""")
def q_requirements(spark, sf):
    p = t(spark, sf, "part")
    datasets = p.select(F.col("p_type").alias("task"), F.col("p_partkey").alias("reg_pos"), F.col("p_brand").alias("repo_id"),
                        F.col("p_size").cast("string").alias("subset"), F.col("p_name").alias("suite"))
    names = (t(spark, sf, "customer").select(F.concat(F.lit(" "), "c_mktsegment").alias("name"))
             .union(p.select(F.concat("p_type", F.lit("  ")))))
    return requirements_for(names, datasets)


@query("expand_groups", """
WITH s AS (SELECT * FROM (VALUES ('ASIA', NULL), ('EUROPE', 2), ('AMERICA', NULL)) v(g, want)),
j AS (
  SELECT n_name AS task, unnest([n_nationkey % 3, 5]) AS n_shot, 'lm_eval' AS suite, r_regionkey AS group_pos, n_nationkey AS task_pos
  FROM nation JOIN region ON n_regionkey = r_regionkey JOIN s ON g = r_name WHERE want IS NULL OR n_nationkey % 4 = want)
SELECT task, CAST(n_shot AS INTEGER) AS n_shot, suite, group_pos, task_pos FROM j
""")
def q_expand_groups(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    tasks = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("group"), F.col("r_regionkey").alias("group_pos"), F.col("n_name").alias("task"),
        F.col("n_nationkey").alias("task_pos"), F.lit("lm_eval").alias("suite"),
        F.array((F.col("n_nationkey") % 3).cast("int"), F.lit(5)).alias("n_shots"),
        F.array((F.col("n_nationkey") % 4).cast("string")).alias("languages"))
    supers = spark.createDataFrame([("EAST", "ASIA")], "super string, group string")
    requested = spark.createDataFrame([("EAST", None), ("EUROPE", ["2"]), ("AMERICA", None)], "name string, languages array<string>")
    return select_tasks(tasks, expand_selection(requested, tasks, supers).select("group", "languages"))


@query("strict_match", """
SELECT conv_id, turn, regexp_replace(text, '^\\s+', '') = rtrim(text) AS matched FROM conversations
""")
def q_strict_match(spark, sf):
    c = t(spark, sf, "conversations")
    return c.select("conv_id", "turn", strict_match("text", F.rtrim("text")).alias("matched"))


@query("sorted_comparison", """
WITH a AS (SELECT o_orderpriority AS task, count(*) / 1.0 AS x FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
b AS (SELECT o_orderpriority AS task, count(*) / 1.0 AS x FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
SELECT 'm' AS model, coalesce(a.task, b.task) AS task, '0' AS n_shot, 'n' AS metric, a.x::DOUBLE AS a, b.x::DOUBLE AS b,
       (b.x - a.x)::DOUBLE AS delta
FROM a FULL OUTER JOIN b ON a.task = b.task ORDER BY task
""")
def q_sorted_comparison(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")

    def side(odd):
        return (o.where(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_orderpriority").alias("task"))
                .agg((F.count(F.lit(1)) / 1.0).alias("performance"))
                .select(F.lit("m").alias("model"), "task", F.lit(0).alias("n_shot"), F.lit("n").alias("metric"), "performance",
                        F.lit(0).alias("pos")))
    return sorted_comparison(compare_runs(side(0), side(1))).select("model", "task", "n_shot", "metric", "a", "b", "delta")
