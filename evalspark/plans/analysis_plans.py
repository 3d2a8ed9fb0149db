"""Coverage, comparison and leaderboard operators bound to driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.projections import normalize_to_100
from evalspark.operators.analysis import cap_per_task, compare_runs, coverage, leaderboard, missing_jobs, top_k
from evalspark.operators.jobs import assign_slices, attach_suite, job_grid
from evalspark.plans.catalog import query, r6, t

_SHOTS = (0, 5, 10)
_GRID_SQL = """
jobs AS (
  SELECT {model} AS model_path, seg AS task_path, s AS n_shot,
         CASE WHEN seg = 'AUTOMOBILE' THEN 'lmms_eval' ELSE 'lm_eval' END AS eval_suite
  FROM nation, (SELECT DISTINCT c_mktsegment AS seg FROM customer), (VALUES (0), (5), (10)) v(s))"""
_DONE_SQL = """
done AS (
  SELECT DISTINCT n_name AS model, c_mktsegment AS task, CAST((c_custkey % 97) * 5 AS INTEGER) AS n_shot
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
missing AS (
  SELECT * FROM jobs j WHERE NOT EXISTS (
    SELECT 1 FROM done d WHERE d.task = j.task_path AND d.n_shot = j.n_shot
      AND (d.model = j.model_path OR ends_with(j.model_path, '/' || d.model)
           OR ends_with(d.model, '/' || j.model_path))))"""


def _grid(spark, sf, path_form: bool):
    nation = t(spark, sf, "nation")
    model = F.concat(F.lit("/m/"), "n_name") if path_form else F.col("n_name")
    models = nation.select(model.alias("model_path"))
    tasks = t(spark, sf, "customer").select(F.col("c_mktsegment").alias("task_path")).distinct()
    suites = spark.createDataFrame([("AUTOMOBILE", "lmms_eval")], "task string, suite string")
    return attach_suite(job_grid(models, tasks, _SHOTS), suites)


def _completed(spark, sf):
    cust = t(spark, sf, "customer")
    nation = t(spark, sf, "nation")
    return (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
            .select(F.col("n_name").alias("model"), F.col("c_mktsegment").alias("task"),
                    ((F.col("c_custkey") % 97) * 5).cast("int").alias("n_shot")))


def _missing(spark, sf):
    return missing_jobs(_grid(spark, sf, True), _completed(spark, sf))


@query("job_grid", "WITH" + _GRID_SQL.format(model="n_name") + "\nSELECT * FROM jobs")
def q_job_grid(spark, sf):
    return _grid(spark, sf, False).select("model_path", "task_path", "n_shot", "eval_suite")


@query("missing_jobs", "WITH" + _GRID_SQL.format(model="'/m/' || n_name") + "," + _DONE_SQL
       + "\nSELECT model_path, task_path, n_shot, eval_suite FROM missing")
def q_missing_jobs(spark, sf):
    return _missing(spark, sf).select("model_path", "task_path", "n_shot", "eval_suite")


@query("coverage_rollup", "WITH" + _GRID_SQL.format(model="'/m/' || n_name") + "," + _DONE_SQL + """,
flag AS (
  SELECT j.model_path, j.task_path,
         CASE WHEN EXISTS (SELECT 1 FROM missing m WHERE m.model_path = j.model_path
                           AND m.task_path = j.task_path AND m.n_shot = j.n_shot) THEN 1 ELSE 0 END AS miss
  FROM jobs j)
SELECT model_path, task_path, count(*) AS scheduled, CAST(sum(miss) AS BIGINT) AS missing,
       CAST(count(*) - sum(miss) AS BIGINT) AS completed
FROM flag GROUP BY ROLLUP (model_path, task_path)
""")
def q_coverage_rollup(spark, sf):
    jobs = _grid(spark, sf, True)
    res = coverage(jobs, missing_jobs(jobs, _completed(spark, sf)))
    return res.select("model_path", "task_path", "scheduled", "missing", "completed")


@query("top_missing", "WITH" + _GRID_SQL.format(model="'/m/' || n_name") + "," + _DONE_SQL + """
SELECT model_path, task_path, n_shot, (SELECT count(*) FROM missing) AS n_total
FROM missing ORDER BY model_path, task_path, n_shot LIMIT 5
""")
def q_top_missing(spark, sf):
    m = _missing(spark, sf).select("model_path", "task_path", "n_shot")
    return top_k(m, ["model_path", "task_path", "n_shot"], 5)


@query("sample_cap", """
SELECT c_mktsegment, c_custkey, rn FROM (
  SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn
  FROM customer) WHERE rn <= 3
""")
def q_sample_cap(spark, sf):
    return cap_per_task(t(spark, sf, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", ["c_custkey"], 3)


_CUT = "1998-06-01"


@query("compare_runs", f"""
WITH base AS (
  SELECT p_brand AS model, l_returnflag AS task, l_extendedprice AS price, l_shipdate
  FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT model, task, CAST(sum(CAST(price AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS a FROM base
      WHERE l_shipdate < TIMESTAMP '{_CUT}' GROUP BY ALL),
b AS (SELECT model, task, CAST(sum(CAST(price AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS b FROM base
      WHERE l_shipdate >= TIMESTAMP '{_CUT}' GROUP BY ALL)
SELECT coalesce(a.model, b.model) AS model, coalesce(a.task, b.task) AS task, '0' AS n_shot,
       'mean_price' AS metric, a.a, b.b, b.b - a.a AS delta
FROM a FULL OUTER JOIN b ON a.model = b.model AND a.task = b.task
""")
def q_compare_runs(spark, sf):
    li = t(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice", "l_shipdate")
    part = t(spark, sf, "part").select("p_partkey", "p_brand")
    base = li.join(part, li.l_partkey == part.p_partkey)

    def side(cond):
        return (base.filter(cond)
                .groupBy(F.col("p_brand").alias("model"), F.col("l_returnflag").alias("task"))
                # exact decimal sum / count: the same double in any engine and
                # any summation order, so no rounding is needed to compare
                .agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
                      / F.count(F.lit(1))).alias("performance"))
                .select("model", "task", F.lit(0).alias("n_shot"), F.lit("mean_price").alias("metric"),
                        "performance", F.lit(0).alias("pos")))

    cut = F.lit(_CUT).cast("timestamp_ntz")
    ts = F.col("l_shipdate").cast("timestamp_ntz")
    res = compare_runs(side(ts < cut), side(ts >= cut))
    return res.select("model", "task", "n_shot", "metric", "a", "b", "delta")


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _leaderboard_sql() -> str:
    cols = ",\n  ".join(
        f"round(max(value) FILTER (WHERE label = '{p} (0-shot, score)'), 6) AS \"{p} (0-shot, score)\""
        for p in _PRIOS)
    return f"""
WITH f AS (
  SELECT n_name AS model_name, o_orderpriority AS task,
         count(*) / 1000.0::DOUBLE AS perf
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL),
c AS (SELECT model_name, task || ' (0-shot, score)' AS label, perf * (100.0 / 1.0) AS value FROM f)
SELECT model_name,
  {cols},
  round(avg(value), 6) AS "average (normalized cols)"
FROM c GROUP BY model_name
"""


@query("leaderboard", _leaderboard_sql())
def q_leaderboard(spark, sf):
    # score = orders per (nation, priority) in thousands: a tie-free measure, so
    # both engines round every cell and the row average identically
    o = t(spark, sf, "orders").select("o_custkey", "o_orderpriority")
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = t(spark, sf, "nation").select("n_nationkey", "n_name")
    facts = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
             .groupBy(F.col("n_name").alias("model_name"), F.col("o_orderpriority").alias("task"))
             .agg((F.count(F.lit(1)) / 1000.0).alias("performance"))
             .select("model_name", "task", F.lit(0).alias("n_shot"), F.lit("score").alias("metric_name"),
                     "performance", F.lit(0).alias("pos")))
    facts = facts.withColumn("performance_normalized",
                             normalize_to_100("performance", "metric_name", "task"))
    wide = leaderboard(facts, average=True, labels=[f"{p} (0-shot, score)" for p in _PRIOS])
    return wide.select("model_name", *[r6(F.col(f"`{c}`")).alias(c) for c in wide.columns[1:]])


@query("slices", """
WITH n AS (SELECT greatest(1, least(250, count(*))) AS slices, count(*) AS n FROM orders),
i AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey, CAST(i // greatest(1, CAST(ceil(n / slices) AS BIGINT)) AS BIGINT) AS slice FROM i, n
""")
def q_slices(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return assign_slices(o, ["o_orderkey"], capacity=250).select("o_orderkey", "slice")
