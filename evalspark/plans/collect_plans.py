"""Collection operators bound to driver tables: dedup, audit, summary, scale
normalization, metric resolution, JSON parsing, shot inference, roll-up rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.constants import METRIC_FALLBACK_KEYS
from evalspark.functions.jsonpath import find_metric, json_kind
from evalspark.functions.projections import normalize_to_100
from evalspark.operators.dedup import last_wins, newest_wins
from evalspark.operators.resolve import (
    collapse_scoped_keys,
    descend_groups,
    drop_prefix_subtasks,
    global_n_shot,
    mean_of_children,
    resolve_metric,
)
from evalspark.operators.sequence import number_within
from evalspark.plans.catalog import query, r6, t


@query("newest_wins", """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def q_newest_wins(spark, sf):
    ev = t(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    res = newest_wins(ev, ["user_id", "event_type"], ["ts", "event_id"])
    return res.select("user_id", "event_type", "event_id", "value")


@query("jobs_last_wins", """
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
                               ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1
""")
def q_jobs_last_wins(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey",
                                      "o_totalprice", "o_orderdate")
    res = last_wins(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])
    return res.select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@query("result_summary", """
WITH w AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1)
SELECT count(DISTINCT user_id) AS n_models, count(DISTINCT event_type) AS n_tasks,
       count(*) AS n_results,
       string_agg(DISTINCT CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR), ','
                  ORDER BY CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR)) AS n_shots
FROM w
""")
def q_result_summary(spark, sf):
    from evalspark.operators.analysis import result_summary
    ev = t(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    latest = newest_wins(ev, ["user_id", "event_type"], ["ts", "event_id"])
    rows = latest.select(F.col("user_id").alias("model_name"), F.col("event_type").alias("task"),
                         F.floor(F.col("value") / 10).cast("string").alias("n_shot"))
    return result_summary(rows)


@query("audit", """
SELECT * FROM (
  SELECT user_id, event_type, event_id,
         lag(event_id) OVER w AS prev_event_id, lag(value) OVER w AS prev_value, value
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
WHERE prev_event_id IS NOT NULL AND prev_value <> value
""")
def q_audit(spark, sf):
    from evalspark.operators.analysis import superseded
    ev = t(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return superseded(ev, ["user_id", "event_type"], ["ts", "event_id"], "event_id", "value")


_SCALES = {"view": 1.0, "click": 100.0, "purchase": 5.0}
_OVERRIDES = {("task_1", "click"): 1.0}


@query("normalize_scores", """
WITH e AS (
  SELECT event_id, 'task_' || CAST(user_id % 5 AS VARCHAR) AS task,
         event_type || ',none' AS metric, value FROM events),
s AS (SELECT * FROM (VALUES ('view', 1.0::DOUBLE), ('click', 100.0::DOUBLE), ('purchase', 5.0::DOUBLE)) v(m, scale)),
o AS (SELECT * FROM (VALUES ('task_1', 'click', 1.0::DOUBLE)) v(task, m, scale))
SELECT e.event_id, e.task, e.metric, e.value AS performance,
       round(e.value * (100.0 / coalesce(o.scale, s.scale)), 6) AS performance_normalized
FROM e LEFT JOIN s ON split_part(e.metric, ',', 1) = s.m
       LEFT JOIN o ON o.task = e.task AND o.m = split_part(e.metric, ',', 1)
""")
def q_normalize_scores(spark, sf):
    ev = t(spark, sf, "events")
    rows = ev.select("event_id",
                     F.concat(F.lit("task_"), (F.col("user_id") % 5).cast("string")).alias("task"),
                     F.concat(F.col("event_type"), F.lit(",none")).alias("metric"),
                     F.col("value").alias("performance"))
    return rows.withColumn("performance_normalized", r6(normalize_to_100(
        "performance", "metric", "task", scales=_SCALES, overrides=_OVERRIDES)))


# event type -> metric key of the bag, by role
_KEY_OF = {"view": "acc,none", "click": "f1", "purchase": "bleu,none",
           "error": "acc_stderr,none", "signup": "exact_match"}
_POLICY = {"task_0": "bleu", "task_1": "f1", "task_2": "nonexistent"}


def _resolve_sql() -> str:
    keymap = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KEY_OF.items())
    pol = ", ".join(f"('{k}', '{v}')" for k, v in _POLICY.items())
    fb = []
    for i, m in enumerate(METRIC_FALLBACK_KEYS):
        b = m.split(",")[0]
        fb.append(f"CASE WHEN key = '{m}' THEN {2 * i} END")
        fb.append(f"CASE WHEN key = '{b}' OR starts_with(key, '{b},') THEN {2 * i + 1} END")
    fb.append("CASE WHEN NOT contains(key, 'stderr') AND key NOT IN ('alias', ' ', '') THEN 1000000 END")
    return f"""
WITH b AS (
  SELECT user_id, 'task_' || CAST(user_id % 5 AS VARCHAR) AS task,
         CASE WHEN user_id % 2 = 1 THEN 'task/' ELSE '' END || CASE event_type {keymap} END AS raw_key,
         event_id, value
  FROM events),
k AS (
  SELECT user_id, task, regexp_replace(raw_key, '^[^/]*/', '') AS key,
         min(event_id) AS pos, arg_max(value, event_id) AS value
  FROM b GROUP BY ALL),
p AS (SELECT * FROM (VALUES {pol}) v(task, pref)),
r AS (
  SELECT k.*, CASE WHEN p.pref IS NOT NULL THEN
           (CASE WHEN key = pref || ',none' THEN 0 WHEN key = pref THEN 1
                 WHEN starts_with(key, pref || ',') THEN 2 END)
         ELSE least({", ".join(fb)}) END AS tier
  FROM k LEFT JOIN p USING (task)),
x AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, task ORDER BY tier, pos) AS rn
  FROM r WHERE tier IS NOT NULL)
SELECT user_id, task, key AS metric_name, value AS performance FROM x WHERE rn = 1
"""


@query("resolve_metric", _resolve_sql())
def q_resolve_metric(spark, sf):
    ev = t(spark, sf, "events")
    keymap = F.create_map(*[F.lit(x) for kv in _KEY_OF.items() for x in kv])
    scoped = F.when(F.col("user_id") % 2 == 1, F.lit("task/")).otherwise(F.lit(""))
    rows = ev.select(
        "user_id",
        F.concat(F.lit("task_"), (F.col("user_id") % 5).cast("string")).alias("task"),
        F.concat(scoped, keymap[F.col("event_type")]).alias("key"),
        F.col("event_id").alias("pos"), "value", F.lit(True).alias("numeric"))
    bags = collapse_scoped_keys(rows, ["user_id", "task"])
    res = resolve_metric(bags, ["user_id"], "task", _POLICY)
    return res.select("user_id", "task", "metric_name", "performance")


@query("json_props", """
WITH d AS (
  SELECT event_id,
         CASE WHEN event_id % 97 = 0 THEN substr(props, 1, length(props) - 1)
              WHEN event_id % 89 = 0 THEN '[' || props || ']'
              WHEN event_id % 83 = 0 THEN '{"metrics": ' || props || '}'
              WHEN event_id % 79 = 0 THEN '{"m": {"k": {"score": ' || json_extract_string(props, '$.k') || '}}}'
              ELSE props END AS doc
  FROM events)
SELECT event_id,
       CASE WHEN NOT json_valid(doc) THEN 'unreadable'
            WHEN json_type(doc) <> 'OBJECT' THEN 'not_object' ELSE 'ok' END AS status,
       CASE WHEN json_valid(doc) AND json_type(doc) = 'OBJECT' THEN
         coalesce(CAST(json_extract(doc, '$.k') AS DOUBLE),
                  CAST(json_extract(doc, '$.metrics.k') AS DOUBLE),
                  CAST(json_extract(doc, '$.m.k.score') AS DOUBLE)) END AS k
FROM d
""")
def q_json_props(spark, sf):
    ev = t(spark, sf, "events").select("event_id", "props")
    e, p = F.col("event_id"), F.col("props")
    doc = (F.when(e % 97 == 0, F.expr("substr(props, 1, length(props) - 1)"))
           .when(e % 89 == 0, F.concat(F.lit("["), p, F.lit("]")))
           .when(e % 83 == 0, F.concat(F.lit('{"metrics": '), p, F.lit("}")))
           .when(e % 79 == 0, F.concat(F.lit('{"m": {"k": {"score": '),
                                       F.get_json_object(p, "$.k"), F.lit("}}}")))
           .otherwise(p))
    d = ev.select("event_id", doc.alias("doc"))
    status = json_kind(F.col("doc"))
    return d.select("event_id", status.alias("status"),
                    F.when(status == "ok", find_metric(F.col("doc"), "k")).alias("k"))


@query("global_n_shot", """
SELECT l_orderkey,
       CASE WHEN count(DISTINCT l_linenumber % 3) = 1 THEN max(l_linenumber % 3) END AS global_n_shot
FROM lineitem GROUP BY l_orderkey
""")
def q_global_n_shot(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("value"))
    return global_n_shot(li, ["l_orderkey"]).withColumn("global_n_shot",
                                                        F.col("global_n_shot").cast("int"))


@query("drop_rolled_up", """
WITH p AS (
  SELECT p_brand AS file, lower(p_type) AS ty, split_part(p_name, ' ', 1) AS w1,
         split_part(p_name, ' ', 2) AS w2, p_size FROM part),
tasks AS (
  SELECT DISTINCT file, task FROM (
    SELECT file, CASE WHEN p_size <= 10 THEN 'global_mmlu_' || ty ELSE 'other_' || ty END AS task FROM p
    UNION ALL SELECT file, 'global_mmlu_' || ty || '_' || w1 FROM p
    UNION ALL SELECT file, 'mmlu_' || w2 FROM p
    UNION ALL SELECT file, CASE WHEN p_size > 48 THEN 'mmlu' ELSE 'plain' END FROM p)),
mm AS (SELECT DISTINCT file FROM tasks WHERE task = 'mmlu')
SELECT file, task FROM tasks t
WHERE NOT (starts_with(task, 'mmlu_') AND file IN (SELECT file FROM mm))
  AND NOT EXISTS (
    SELECT 1 FROM tasks o
    WHERE o.file = t.file AND starts_with(o.task, 'global_mmlu_') AND o.task <> t.task
      AND starts_with(t.task, 'global_mmlu_') AND starts_with(t.task, o.task || '_'))
""")
def q_drop_rolled_up(spark, sf):
    p = t(spark, sf, "part").select(
        F.col("p_brand").alias("file"), F.lower("p_type").alias("ty"),
        F.split("p_name", " ").getItem(0).alias("w1"),
        F.coalesce(F.get(F.split("p_name", " "), 1), F.lit("")).alias("w2"), "p_size")
    g = F.lit("global_mmlu_")
    tasks = (p.select("file", F.concat(F.when(F.col("p_size") <= 10, g).otherwise("other_"), "ty").alias("task"))
             .unionByName(p.select("file", F.concat(g, "ty", F.lit("_"), "w1").alias("task")))
             .unionByName(p.select("file", F.concat(F.lit("mmlu_"), "w2").alias("task")))
             .unionByName(p.select("file", F.when(F.col("p_size") > 48, "mmlu").otherwise("plain").alias("task")))
             .distinct())
    return drop_prefix_subtasks(tasks, "file", "task").select("file", "task")


def _hierarchy(spark, sf):
    """region -> nation -> supplier as group metadata of one result file."""
    region = t(spark, sf, "region")
    nation = t(spark, sf, "nation")
    supplier = t(spark, sf, "supplier")
    nat_metric = (supplier.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("v"))
                  .withColumnRenamed("s_nationkey", "n_nationkey"))
    groups = (region.select(F.lit(1).alias("file_id"), F.col("r_name").alias("group"),
                            F.col("r_regionkey").cast("long").alias("group_pos"),
                            (F.col("r_regionkey") % 2 == 1).alias("has_metric"))
              .unionByName(nation.select(F.lit(1).alias("file_id"), F.col("n_name").alias("group"),
                                         (F.col("n_nationkey") + 100).cast("long").alias("group_pos"),
                                         (F.col("n_nationkey") % 3 != 0).alias("has_metric"))))
    edges = (nation.join(region, nation.n_regionkey == region.r_regionkey)
             .select(F.lit(1).alias("file_id"), F.col("r_name").alias("parent"),
                     F.col("n_name").alias("child"), F.col("n_nationkey").cast("long").alias("child_pos")))
    return groups, edges, nat_metric


@query("group_descent", """
WITH g AS (  -- regions, nations, suppliers: a tree in file 1; in file 2 nations lead back to their region
  SELECT r_name AS grp, r_regionkey AS pos, r_regionkey % 2 = 1 AS has_metric, r_regionkey AS a, NULL::BIGINT AS b, NULL::BIGINT AS c FROM region
  UNION ALL SELECT n_name, n_nationkey + 100, n_nationkey % 3 <> 0, n_regionkey, n_nationkey, NULL FROM nation
  UNION ALL SELECT s_name, s_suppkey + 1000, s_suppkey % 4 <> 0, n_regionkey, n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
seen AS (
  SELECT *, (b IS NOT NULL)::INTEGER + (c IS NOT NULL)::INTEGER AS level FROM g
  WHERE (b IS NULL OR a % 2 = 0) AND (c IS NULL OR b % 3 = 0)),
visits AS (
  SELECT 1 AS file_id, grp, level, has_metric, row_number() OVER (ORDER BY level, a, b, c) - 1 AS visit FROM seen
  UNION ALL SELECT 2, grp, 0, has_metric, row_number() OVER (ORDER BY pos) - 1 FROM g WHERE c IS NULL)
SELECT file_id, grp AS "group", level, visit::INTEGER AS visit FROM visits WHERE has_metric
""")
def q_group_descent(spark, sf):
    groups, edges, _ = _hierarchy(spark, sf)
    suppliers = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    back = edges.select(F.lit(2).alias("file_id"), F.col("child").alias("parent"), F.col("parent").alias("child"), "child_pos")
    deeper = suppliers.select(F.lit(1).alias("file_id"), F.col("s_name").alias("group"), (F.col("s_suppkey") + 1000).cast("long").alias("group_pos"),
                              (F.col("s_suppkey") % 4 != 0).alias("has_metric"))
    down = suppliers.select(F.lit(1).alias("file_id"), F.col("n_name").alias("parent"), F.col("s_name").alias("child"), F.col("s_suppkey").cast("long").alias("child_pos"))
    second = F.lit(2).alias("file_id")
    res = descend_groups(groups.unionByName(deeper).unionByName(groups.select(second, "group", "group_pos", "has_metric")),
                         edges.unionByName(down).unionByName(edges.select(second, "parent", "child", "child_pos")).unionByName(back))
    return res.select("file_id", "group", F.col("level").cast("int").alias("level"), F.col("visit").cast("int").alias("visit"))


@query("mean_of_children", """
WITH v AS (SELECT s_nationkey, avg(s_acctbal) AS v FROM supplier GROUP BY s_nationkey),
k AS (
  SELECT r_name, n_nationkey, v.v FROM nation JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN v ON v.s_nationkey = n_nationkey)
SELECT r_name AS parent,
       round(avg(v) FILTER (WHERE n_nationkey % 3 <> 0 AND v IS NOT NULL), 6) AS performance,
       'score' AS metric_name,
       count(*) FILTER (WHERE n_nationkey % 3 <> 0 AND v IS NOT NULL) AS n_present,
       count(*) AS n_expected
FROM k GROUP BY r_name
HAVING count(*) FILTER (WHERE n_nationkey % 3 <> 0 AND v IS NOT NULL) > 0
""")
def q_mean_of_children(spark, sf):
    region = t(spark, sf, "region")
    groups, edges, nat_metric = _hierarchy(spark, sf)
    nation = t(spark, sf, "nation")
    parents = region.select(F.lit(1).alias("file_id"), F.col("r_name").alias("parent"),
                            F.col("r_name").alias("policy_name"))
    child_metrics = (nation.join(nat_metric, "n_nationkey")
                     # a third of the bags hold a text where the others hold the number
                     .select(F.lit(1).alias("file_id"), F.col("n_name").alias("child"),
                             F.lit("score").alias("key"), F.lit(0).alias("pos"),
                             F.col("v").alias("value"), (F.col("n_nationkey") % 3 != 0).alias("numeric")))
    res = mean_of_children(parents, edges, child_metrics)
    return res.select("parent", r6(F.col("performance")).alias("performance"), "metric_name",
                      "n_present", "n_expected")
