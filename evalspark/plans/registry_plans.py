"""Registry, routing and job-guard operators bound to driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.language import canonical_language
from evalspark.functions.projections import canonical_suite, route_model
from evalspark.operators.jobs import reject_unsafe, unknown_names, unmapped_tasks
from evalspark.constants import SNAPSHOT_SUITES
from evalspark.operators.registry import language_matches, merge_dataset_specs, registry_summary
from evalspark.plans.catalog import query, t


@query("registry_summary", """
SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'lm_eval' ELSE 'lmms_eval' END AS suite,
       count(*) AS n_tasks,
       string_agg(DISTINCT CAST(n_nationkey % 3 AS VARCHAR), ', ' ORDER BY CAST(n_nationkey % 3 AS VARCHAR)) AS n_shots,
       'Region ' || r_name AS description
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey
UNION ALL
SELECT 'all', 'mixed', count(*), '', 'Every region' FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def q_registry_summary(spark, sf):
    region = t(spark, sf, "region")
    nation = t(spark, sf, "nation")
    tasks = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("group"),
        F.when(F.col("r_regionkey") % 2 == 0, F.lit("lm_eval")).otherwise(F.lit("lmms_eval")).alias("suite"),
        F.concat(F.lit("Region "), "r_name").alias("description"),
        F.col("n_name").alias("task"), F.array((F.col("n_nationkey") % 3).cast("int")).alias("n_shots"))
    supers = region.select(F.lit("all").alias("super"), F.col("r_name").alias("group"),
                           F.lit("Every region").alias("description"))
    return registry_summary(tasks, supers)


@query("merge_specs", """
WITH q AS (SELECT p_brand AS repo_id, CASE WHEN p_size % 2 = 0 THEN 'even' END AS subset,
                  CASE WHEN p_size % 7 = 0 THEN 'main' ELSE p_type END AS revision, p_partkey AS pos, p_size > 25 AS snap FROM part),
f AS (SELECT repo_id, subset, revision, min(pos) AS pos FROM q GROUP BY ALL),
r AS (SELECT repo_id, subset, string_agg(revision, ',' ORDER BY pos) AS revisions FROM f GROUP BY ALL),
b AS (SELECT repo_id, subset, bool_or(snap) AS needs_snapshot FROM q GROUP BY ALL)
SELECT r.repo_id, r.subset, revisions, needs_snapshot FROM r JOIN b ON r.repo_id = b.repo_id AND r.subset IS NOT DISTINCT FROM b.subset
""")
def q_merge_specs(spark, sf):
    p = t(spark, sf, "part")
    reqs = p.select(F.col("p_brand").alias("repo_id"), F.when(F.col("p_size") % 2 == 0, "even").alias("subset"),
                    F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("revision"), F.col("p_partkey").alias("pos"),
                    F.when(F.col("p_size") > 25, sorted(SNAPSHOT_SUITES)[0]).otherwise("another").alias("suite"))
    return merge_dataset_specs(reqs).select("repo_id", "subset", F.array_join("revisions", ",").alias("revisions"), "needs_snapshot")


_SELECTION = ["deu_Latn", "fra_Latn", "ita_Latn"]


@query("language_filter", f"""
SELECT doc_id, lang, CASE lang WHEN 'de' THEN 'deu_Latn' WHEN 'fr' THEN 'fra_Latn'
                               WHEN 'es' THEN 'spa_Latn' WHEN 'en' THEN 'eng_Latn' END AS language
FROM documents
WHERE CASE lang WHEN 'de' THEN 'deu_Latn' WHEN 'fr' THEN 'fra_Latn'
                WHEN 'es' THEN 'spa_Latn' WHEN 'en' THEN 'eng_Latn' END IN ({", ".join(f"'{c}'" for c in _SELECTION)})
""")
def q_language_filter(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang")
    lang = canonical_language("lang")
    return d.select("doc_id", "lang", lang.alias("language")).filter(F.col("language").isin(*_SELECTION))


@query("language_matches", f"""
WITH sel AS (SELECT * FROM (VALUES {", ".join(f"('{c}')" for c in _SELECTION)}) v(language)),
avail AS (SELECT DISTINCT CASE lang WHEN 'de' THEN 'deu_Latn' WHEN 'fr' THEN 'fra_Latn'
                          WHEN 'es' THEN 'spa_Latn' WHEN 'en' THEN 'eng_Latn' END AS language FROM documents)
SELECT language, language IN (SELECT language FROM avail) AS matched FROM sel
""")
def q_language_matches(spark, sf):
    # SO-4: requested codes split into matched and unmatched by the corpus' languages
    avail = t(spark, sf, "documents").select(canonical_language("lang").alias("language"))
    return language_matches(spark.createDataFrame([(c,) for c in _SELECTION], "language string"), avail)


_RULES = [(["widget", "gadget"], "tools"), (["red", "blue"], "colors"), (["ring", "bolt"], "hardware")]


def _route_sql() -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(p_name), '{p}')" for p in pats) + f" THEN '{fam}'"
        for pats, fam in _RULES)
    return f"""
WITH e AS (
  SELECT p_partkey, p_name,
         CASE p_size % 3 WHEN 0 THEN ' LM-EVAL ' WHEN 1 THEN 'lmms-eval:Qwen2-VL' ELSE 'custom:X' END AS engine
  FROM part)
SELECT p_partkey, CASE {whens} END AS family,
       CASE WHEN trim(engine) = 'LM-EVAL' THEN 'lm_eval'
            WHEN trim(engine) = 'lmms-eval:Qwen2-VL' THEN 'lmms_eval:Qwen2-VL'
            ELSE trim(engine) END AS suite
FROM e
"""


@query("route_models", _route_sql())
def q_route_models(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    engine = (F.when(F.col("p_size") % 3 == 0, F.lit(" LM-EVAL "))
              .when(F.col("p_size") % 3 == 1, F.lit("lmms-eval:Qwen2-VL")).otherwise(F.lit("custom:X")))
    return p.select("p_partkey", route_model("p_name", _RULES).alias("family"),
                    canonical_suite(engine).alias("suite"))


@query("unsafe_fields", """
SELECT doc_id, CASE WHEN regexp_matches(source, '[,"\\n\\r]') THEN 'model_path'
                    WHEN regexp_matches(text, '[,"\\n\\r]') THEN 'task_path'
                    WHEN regexp_matches(lang, '[,"\\n\\r]') THEN 'eval_suite' END AS bad_field
FROM documents
WHERE regexp_matches(source, '[,"\\n\\r]') OR regexp_matches(text, '[,"\\n\\r]') OR regexp_matches(lang, '[,"\\n\\r]')
""")
def q_unsafe_fields(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.col("source").alias("model_path"),
                                         F.col("text").alias("task_path"), F.col("lang").alias("eval_suite"))
    return reject_unsafe(d, id_cols=["doc_id"]).select("doc_id", "bad_field")


_POLICY = ["economy_widget", "small_ring", "standard_bolt", "large_gadget", "promo_widget"]


@query("unmapped_tasks", f"""
WITH s AS (SELECT DISTINCT lower(p_type) || '_' || split_part(p_name, ' ', 2) AS task FROM part),
m AS (SELECT task FROM s WHERE task NOT IN ({", ".join(f"'{x}'" for x in _POLICY)}))
SELECT task, (SELECT count(*) FROM m) AS n_unmapped FROM m ORDER BY task LIMIT 10
""")
def q_unmapped_tasks(spark, sf):
    p = t(spark, sf, "part")
    jobs = p.select(F.concat(F.lower("p_type"), F.lit("_"),
                             F.coalesce(F.get(F.split("p_name", " "), 1), F.lit(""))).alias("task_path"))
    policy = spark.createDataFrame([(x, "acc") for x in _POLICY], "task string, metric string")
    return unmapped_tasks(jobs, policy)


_KNOWN = ["BUILDING", "MACHINERY"]


@query("unknown_names", f"""
SELECT DISTINCT c_mktsegment AS name FROM customer
WHERE c_mktsegment NOT IN ({", ".join(f"'{x}'" for x in _KNOWN)})
""")
def q_unknown_names(spark, sf):
    req = t(spark, sf, "customer").select("c_mktsegment")
    known = spark.createDataFrame([(x,) for x in _KNOWN], "name string")
    return unknown_names(req, known)
