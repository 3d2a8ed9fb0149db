"""Answer grading, extraction, corpus preparation and corpus metrics bound to driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.answers import (
    FLEXIBLE_NUMBER_PATTERN,
    STRICT_LETTER_PATTERN,
    answer_match,
    first_boxed,
    flexible_extract,
    strict_letter,
)
from evalspark.functions.text import format_series, paraphrase_pair, pipe_table, render_prompt, sentence_pairs, valid_pair
from evalspark.operators.decontam import decontaminate
from evalspark.operators.prompts import fewshot_blocks, fewshot_prompts
from evalspark.operators.scoring import grade_answers, mean_score
from evalspark.operators.sequence import number_within
from evalspark.operators.translation import corpus_bleu, corpus_chrf
from evalspark.plans.catalog import query, r6, t


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _responses(spark, sf):
    """Model responses built from lineitem numbers; gold = whole price.

    Line 1 nests one to eight braces, line 2 has no span, line 3 leaves an outer span
    open around a closed one, the others box the price.
    """
    li = t(spark, sf, "lineitem")
    nested = F.concat(F.expr("repeat('\\\\frac{', cast(l_orderkey % 8 + 1 as int))"), F.col("l_quantity").cast("long").cast("string"),
                      F.expr("repeat('}', cast(l_orderkey % 8 + 1 as int))"))
    resp = (F.when(F.col("l_linenumber") == 1, F.concat(F.lit("We get \\boxed{"), nested, F.lit("{ 2 }} here.")))
            .when(F.col("l_linenumber") == 2, F.lit("No final answer."))
            .when(F.col("l_linenumber") == 3, F.concat(F.lit("First \\boxed{open, then \\boxed{"),
                                                       F.floor("l_extendedprice").cast("string"), F.lit("} and more")))
            .otherwise(F.concat(F.lit("So the total is \\boxed{"),
                                F.format_string("%.2f", "l_extendedprice"), F.lit("} dollars."))))
    gold = F.floor("l_extendedprice").cast("long").cast("string")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
                     resp.alias("response"), gold.alias("gold"))


# The expected span follows from how the response was built, not from a pattern.
_RESP_SQL = """
p AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
         CASE WHEN l_linenumber = 1 THEN repeat('\\frac{', CAST(l_orderkey % 8 + 1 AS INTEGER))
                || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || repeat('}', CAST(l_orderkey % 8 + 1 AS INTEGER)) || '{2}'
              WHEN l_linenumber = 2 THEN NULL
              WHEN l_linenumber = 3 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)
              ELSE printf('%.2f', l_extendedprice) END AS pred,
         CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS gold
  FROM lineitem),
g AS (
  SELECT *, TRY_CAST(replace(pred, ',', '') AS DOUBLE) AS pn, TRY_CAST(gold AS DOUBLE) AS gn FROM p),
s AS (
  SELECT *, CASE WHEN pred IS NULL THEN 0
                 WHEN lower(trim(pred)) = lower(trim(gold)) THEN 1
                 WHEN pn IS NOT NULL AND gn IS NOT NULL THEN
                   CASE WHEN abs(pn - gn / 100) <= 1e-4 * greatest(abs(pn), abs(gn / 100))
                          OR abs(pn - gn) <= 1e-4 * greatest(abs(pn), abs(gn))
                          OR abs(pn - gn * 100) <= 1e-4 * greatest(abs(pn), abs(gn * 100)) THEN 1 ELSE 0 END
                 ELSE 0 END AS exact_match
  FROM g)"""


def _graded(spark, sf):
    r = _responses(spark, sf).select("*", first_boxed("response").alias("pred"))
    graded = answer_match(r, "pred", "gold", out="_eq")
    return graded.withColumn("exact_match", F.col("_eq").cast("int")).drop("_eq")


@query("boxed_answers", "WITH" + _RESP_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, pred, exact_match FROM s""")
def q_boxed_answers(spark, sf):
    return _graded(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                     "pred", "exact_match")


@query("grade_answers", """
WITH o AS (
  SELECT o_orderpriority AS task, o_orderkey % 4 AS kind, o_totalprice AS p, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS answer FROM orders),
s AS (
  SELECT task, CASE WHEN kind = 0 THEN 1 WHEN kind = 1 THEN
                 CASE WHEN abs(p - floor(p)) <= 1e-4 * greatest(abs(p), floor(p)) THEN 1 ELSE 0 END ELSE 0 END AS ok FROM o)
SELECT task, count(*) AS n, round(avg(ok), 6) AS mean, round(stddev_samp(ok) / sqrt(count(*)), 6) AS stderr FROM s GROUP BY task
""")
def q_grade_answers(spark, sf):
    # by order key: boxed right answer, boxed price, no box, no response at all
    o = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("doc"), "o_totalprice")
    kind, whole = F.col("doc") % 4, F.floor("o_totalprice").cast("long").cast("string")
    said = (F.when(kind == 0, F.concat(F.lit("so \\boxed{ "), whole, F.lit("}")))
            .when(kind == 1, F.concat(F.lit("\\boxed{"), F.format_string("%.2f", "o_totalprice"), F.lit("}")))
            .otherwise("no idea"))
    predictions = o.where(kind != 3).select("task", "doc", said.alias("response"))
    res = mean_score(grade_answers(predictions, o.select("task", "doc", whole.alias("answer"))), ["task"], "exact_match")
    return res.select("task", "n", r6(F.col("mean")).alias("mean"), r6(F.col("stderr")).alias("stderr"))


@query("answer_extraction", f"""
WITH f AS (
  SELECT doc_id, regexp_extract_all(text, {_sql_str(FLEXIBLE_NUMBER_PATTERN)}) AS nums,
         regexp_extract_all(text, {_sql_str(STRICT_LETTER_PATTERN)}, 1) AS g1,
         regexp_extract_all(text, {_sql_str(STRICT_LETTER_PATTERN)}, 2) AS g2,
         regexp_extract_all(text, {_sql_str(STRICT_LETTER_PATTERN)}, 3) AS g3
  FROM documents)
SELECT doc_id,
       CASE WHEN len(nums) > 0 THEN trim(nums[-1]) ELSE '[invalid]' END AS flexible,
       CASE WHEN len(g1) > 0 THEN coalesce(nullif(g1[-1], ''), nullif(g2[-1], ''), nullif(g3[-1], ''), '[invalid]')
            ELSE '[invalid]' END AS strict
FROM f
""")
def q_answer_extraction(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", flexible_extract("text").alias("flexible"),
                    strict_letter("text").alias("strict"))


_DETOK_SQL = """regexp_replace(replace(replace(replace(replace(replace({x}, ' n''t', 'n''t'), ' )', ')'), '( ', '('), '" ', '"'), ' "', '"'), ' ([''.,])', '\\1', 'g')"""


@query("sentence_pairs", f"""
WITH p AS (
  SELECT a.conv_id, a.turn, a.text AS s1, b.text AS s2
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.text IS NOT NULL AND a.text <> '' AND b.text IS NOT NULL AND b.text <> ''),
d AS (
  SELECT conv_id, turn,
         regexp_replace({_DETOK_SQL.format(x='s1')}, '^\\s+|\\s+$', '', 'g') AS a,
         regexp_replace({_DETOK_SQL.format(x='s2')}, '^\\s+|\\s+$', '', 'g') AS b
  FROM p)
SELECT conv_id, turn, regexp_replace(a, '[.,;]$', '') AS src,
       lower(substr(b, 1, 1)) || substr(b, 2) AS tgt
FROM d
""")
def q_sentence_pairs(spark, sf):
    conv = t(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("s2"))
    pairs = conv.withColumnRenamed("text", "s1").join(nxt, ["conv_id", "turn"])
    pairs = pairs.filter(valid_pair("s1", "s2", trim=False))
    src, tgt = paraphrase_pair(F.col("s1"), F.col("s2"))
    return pairs.select("conv_id", "turn", src.alias("src"), tgt.alias("tgt"))


@query("pipe_table", """
WITH r AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)),
                             lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) > 0) AS rows
  FROM documents),
l AS (
  SELECT doc_id, rows,
         list_transform(rows[1:30], lambda r: array_to_string(
           list_transform(string_split(r, ' '), lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')), ' | ')) AS lines
  FROM r)
SELECT doc_id,
       array_to_string(
         list_concat(lines[1:1],
                     CASE WHEN len(rows) > 1 THEN [repeat('-', least(80, greatest(3, length(lines[1]))))]
                          ELSE []::VARCHAR[] END,
                     lines[2:30],
                     CASE WHEN len(rows) > 30 THEN ['... (' || CAST(len(rows) - 30 AS VARCHAR) || ' more rows)']
                          ELSE []::VARCHAR[] END), chr(10)) AS table_text
FROM l
""")
def q_pipe_table(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", pipe_table("text", cell_sep=" ").alias("table_text"))


@query("subsample", """
WITH s AS (SELECT vec_id, list_concat(embedding, list_concat(embedding, embedding)) AS x FROM embeddings)
SELECT vec_id, len(x) AS n_points,
       array_to_string(list_transform(
         CASE WHEN len(x) > 128
              THEN list_transform(range(0, 128), lambda i: x[CAST(floor(i * (len(x) / 128.0)) AS INTEGER) + 1])
              ELSE x END,
         lambda v: printf('%.4g', CAST(v AS DOUBLE))), ', ') AS series
FROM s
""")
def q_subsample(spark, sf):
    # a vector three times over is a series longer than the cap
    e = t(spark, sf, "embeddings").select("vec_id", F.concat("embedding", "embedding", "embedding").alias("x"))
    return e.select("vec_id", F.size("x").alias("n_points"), format_series("x", 128).alias("series"))


@query("fewshot_prompts", """
WITH shots AS (
  SELECT string_agg('Example: ' || text, chr(10) || chr(10) ORDER BY item_id) AS block
  FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 3))
SELECT conv_id, turn,
       block || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS prompt
FROM conversations, shots
""")
def q_fewshot_prompts(spark, sf):
    bench = t(spark, sf, "benchmark").select("item_id", "text")
    block = fewshot_blocks(bench, render_prompt("Example: {x}", x="text"), 3, ["item_id"])
    asked = fewshot_prompts(t(spark, sf, "conversations"), block, render_prompt("Question: {q}\nAnswer:", q="text"))
    return asked.select("conv_id", "turn", "prompt")


@query("fewshot_by_group", """
WITH r AS (
  SELECT source, n_chars, text, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn FROM documents WHERE lang = 'en'),
b AS (SELECT source, string_agg('- ' || n_chars, chr(10) ORDER BY rn) AS block FROM r WHERE rn <= 5 GROUP BY source)
SELECT doc_id, coalesce(block || chr(10), '') || 'size of ' || doc_id || '?' AS prompt
FROM documents LEFT JOIN b USING (source)
""")
def q_fewshot_by_group(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang")
    blocks = fewshot_blocks(docs.where("lang = 'en'"), render_prompt("- {n}", n="n_chars"), 5, ["n_chars", "doc_id"], ["source"], sep="\n")
    asked = fewshot_prompts(docs, blocks, render_prompt("size of {d}?", d="doc_id"), ["source"], sep="\n")
    return asked.select("doc_id", "prompt")


@query("parallel_sentences", """
SELECT CAST(a.conv_id AS VARCHAR) AS id, CAST(a.conv_id AS VARCHAR) AS movie_id,
       CASE WHEN a.turn % 3 = 0 THEN -1 ELSE a.turn END AS segment_id, 'en' AS src_lang, 'de' AS tgt_lang, a.text AS src, b.text AS tgt
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def q_parallel_sentences(spark, sf):
    """SC-13: consecutive turns as translations, in the map form and in the wide form (odd and even conversations)."""
    c = t(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("de"))
    corpus = (c.join(after, ["conv_id", "turn"]).withColumnRenamed("text", "en").withColumn("id", F.col("conv_id").cast("string"))
              .withColumn("line_number", F.when(F.col("turn") % 3 == 0, "none").otherwise(F.col("turn").cast("string"))))
    wide = corpus.where("conv_id % 2 = 0").select("id", F.col("id").alias("doc_id"), "line_number", "en", "de")
    mapped = corpus.where("conv_id % 2 = 1").select("id", F.col("id").alias("movie_id"), F.col("line_number").alias("segment_id"),
                                                    F.create_map(F.lit("en"), "en", F.lit("de"), "de", F.lit("fr"), "en").alias("translation"))
    return sentence_pairs(wide, "en", "de").unionByName(sentence_pairs(mapped, "en", "de"))


_TOK_SQL = "list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query("decontaminate", f"""
WITH dt AS (SELECT doc_id, {_TOK_SQL.format(x='text')} AS tok FROM documents),
bt AS (SELECT item_id, {_TOK_SQL.format(x='text')} AS tok FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(tok[i:i + 12], ' ') AS g
       FROM dt, range(1, len(tok) - 11) r(i) WHERE len(tok) >= 13),
bg AS (SELECT DISTINCT item_id, array_to_string(tok[i:i + 12], ' ') AS g
       FROM bt, range(1, len(tok) - 11) r(i) WHERE len(tok) >= 13),
sz AS (SELECT item_id, count(*) AS n_item_ngrams FROM bg GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_overlap FROM dg JOIN bg USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_overlap, n_item_ngrams,
       round(n_overlap / n_item_ngrams, 6) AS overlap, n_overlap = n_item_ngrams AS verbatim
FROM h JOIN sz USING (item_id)
""")
def q_decontaminate(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "text")
    bench = t(spark, sf, "benchmark").select("item_id", "text")
    res = decontaminate(docs, bench, n=13)
    return res.withColumn("overlap", r6(F.col("overlap")))


def _mt_pairs(spark, sf):
    """hypothesis = a document, reference = the next document (by id) in the same language.

    Only the narrow ``(doc_id, lang)`` rows are numbered; the texts are attached
    afterwards, so the wide text column is never range-shuffled or materialized
    by the numbering step.
    """
    docs = t(spark, sf, "documents")
    n = number_within(docs.select("doc_id", "lang"), ["lang"], ["doc_id"], out="rn")
    nxt = n.select("lang", (F.col("rn") - 1).alias("rn"), F.col("doc_id").alias("ref_id"))
    pairs = n.join(nxt, ["lang", "rn"]).select(F.col("doc_id").alias("pair_id"), "lang", "ref_id")
    text = docs.select("doc_id", "text")
    # the per-pair statistics are CPU-heavy: the last join spreads pairs over a fixed
    # number of tasks (an explicit count is not coalesced away by AQE, which would
    # otherwise follow the single split of a small text file)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hyp = pairs.join(text.withColumnRenamed("doc_id", "pair_id"), "pair_id").repartition(parts, "ref_id")
    ref = text.select(F.col("doc_id").alias("ref_id"), F.col("text").alias("reference")).repartition(parts, "ref_id")
    return hyp.join(ref, "ref_id").select("pair_id", "lang", F.col("text").alias("hypothesis"), "reference")


_PAIRS_SQL = """
pairs AS (
  SELECT doc_id AS pair_id, lang, text AS hyp,
         lead(text) OVER (PARTITION BY lang ORDER BY doc_id) AS ref
  FROM documents QUALIFY ref IS NOT NULL),
tok AS (
  SELECT pair_id, lang, list_filter(regexp_split_to_array(hyp, '\\s+'), lambda x: x <> '') AS h,
         list_filter(regexp_split_to_array(ref, '\\s+'), lambda x: x <> '') AS r, hyp, ref
  FROM pairs)"""


def _bleu_sql() -> str:
    return "WITH" + _PAIRS_SQL + """,
ns AS (SELECT * FROM range(1, 5) t(n)),
hg AS (SELECT lang, pair_id, n, array_to_string(h[i:i + n - 1], ' ') AS g, count(*) AS c
       FROM tok, ns, range(1, len(h) - n + 2) r(i) WHERE len(h) >= n GROUP BY ALL),
rg AS (SELECT lang, pair_id, n, array_to_string(r[i:i + n - 1], ' ') AS g, count(*) AS c
       FROM tok, ns, range(1, len(r) - n + 2) r(i) WHERE len(r) >= n GROUP BY ALL),
m AS (SELECT lang, n, sum(least(hg.c, rg.c)) AS matches FROM hg JOIN rg USING (lang, pair_id, n, g) GROUP BY ALL),
tot AS (SELECT lang, n, sum(c) AS total FROM hg GROUP BY ALL),
p AS (SELECT lang, n, coalesce(m.matches, 0) / tot.total AS p FROM tot LEFT JOIN m USING (lang, n)),
l AS (SELECT lang, sum(len(h)) AS sys_len, sum(len(r)) AS ref_len FROM tok GROUP BY lang),
w AS (
  SELECT lang, max(p) FILTER (WHERE n = 1) AS p1, max(p) FILTER (WHERE n = 2) AS p2,
         max(p) FILTER (WHERE n = 3) AS p3, max(p) FILTER (WHERE n = 4) AS p4
  FROM p GROUP BY lang),
f AS (
  SELECT l.lang, sys_len, ref_len, p1, p2, p3, p4,
         CASE WHEN sys_len > ref_len THEN 1.0 WHEN sys_len > 0 THEN exp(1 - ref_len / sys_len) ELSE 0.0 END AS bp
  FROM l JOIN w USING (lang))
SELECT lang,
       round(CASE WHEN p1 > 0 AND p2 > 0 AND p3 > 0 AND p4 > 0 AND sys_len > 0
                  THEN bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) * 100 ELSE 0.0 END, 6) AS bleu,
       round(bp, 6) AS bp, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4,
       CAST(sys_len AS BIGINT) AS sys_len, CAST(ref_len AS BIGINT) AS ref_len
FROM f
"""


@query("corpus_bleu", _bleu_sql())
def q_corpus_bleu(spark, sf):
    res = corpus_bleu(_mt_pairs(spark, sf), by=["lang"])
    return res.select("lang", *[r6(F.col(c)).alias(c) for c in ("bleu", "bp", "p1", "p2", "p3", "p4")],
                      "sys_len", "ref_len")


def _chrf_sql() -> str:
    return "WITH" + _PAIRS_SQL + """,
cs AS (SELECT pair_id, lang, string_split(regexp_replace(hyp, '\\s+', '', 'g'), '') AS hc,
                  string_split(regexp_replace(ref, '\\s+', '', 'g'), '') AS rc, h, r FROM tok),
ch AS (
  SELECT pair_id, lang, 'h' AS side, unnest(hc) AS x, generate_subscripts(hc, 1) AS i FROM cs
  UNION ALL
  SELECT pair_id, lang, 'r', unnest(rc), generate_subscripts(rc, 1) FROM cs),
cl AS (
  SELECT pair_id, lang, side, x, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2, lead(x, 3) OVER w AS x3,
         lead(x, 4) OVER w AS x4, lead(x, 5) OVER w AS x5
  FROM ch WINDOW w AS (PARTITION BY pair_id, side ORDER BY i)),
wd AS (
  SELECT pair_id, lang, 'h' AS side, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM cs
  UNION ALL
  SELECT pair_id, lang, 'r', unnest(r), generate_subscripts(r, 1) FROM cs),
wl AS (SELECT pair_id, lang, side, x, lead(x, 1) OVER (PARTITION BY pair_id, side ORDER BY i) AS x1 FROM wd),
grams AS (
  SELECT * FROM (
    SELECT lang, pair_id, side, 'c' AS kind, unnest([1, 2, 3, 4, 5, 6]) AS n,
           unnest([x, x || x1, x || x1 || x2, x || x1 || x2 || x3, x || x1 || x2 || x3 || x4,
                   x || x1 || x2 || x3 || x4 || x5]) AS g
    FROM cl
    UNION ALL
    SELECT lang, pair_id, side, 'w', unnest([1, 2]), unnest([x, x || ' ' || x1]) FROM wl)
  WHERE g IS NOT NULL),
c AS (SELECT lang, pair_id, side, kind, n, g, count(*) AS c FROM grams GROUP BY ALL),
hh AS (SELECT * FROM c WHERE side = 'h'), rr AS (SELECT * FROM c WHERE side = 'r'),
m AS (SELECT lang, kind, n, sum(least(hh.c, rr.c)) AS matches FROM hh JOIN rr USING (lang, pair_id, kind, n, g) GROUP BY ALL),
ht AS (SELECT lang, kind, n, sum(c) AS ht FROM hh GROUP BY ALL),
rt AS (SELECT lang, kind, n, sum(c) AS rt FROM rr GROUP BY ALL),
s AS (
  SELECT lang, kind, n,
         CASE WHEN coalesce(ht, 0) > 0 THEN coalesce(matches, 0) / ht ELSE 0.0 END AS prec,
         CASE WHEN coalesce(rt, 0) > 0 THEN coalesce(matches, 0) / rt ELSE 0.0 END AS rec
  FROM ht FULL OUTER JOIN rt USING (lang, kind, n) LEFT JOIN m USING (lang, kind, n)),
a AS (
  SELECT lang, sum(prec) FILTER (WHERE kind = 'c') / 6 AS cp, sum(rec) FILTER (WHERE kind = 'c') / 6 AS cr,
         sum(prec) / 8 AS ap, sum(rec) / 8 AS ar FROM s GROUP BY lang)
SELECT lang,
       round(CASE WHEN cp + cr > 0 THEN 5 * cp * cr / (4 * cp + cr) ELSE 0.0 END * 100, 6) AS chrf,
       round(CASE WHEN ap + ar > 0 THEN 5 * ap * ar / (4 * ap + ar) ELSE 0.0 END * 100, 6) AS chrf_pp
FROM a
"""


@query("corpus_chrf", _chrf_sql())
def q_corpus_chrf(spark, sf):
    res = corpus_chrf(_mt_pairs(spark, sf), by=["lang"])
    return res.select("lang", r6(F.col("chrf")).alias("chrf"), r6(F.col("chrf_pp")).alias("chrf_pp"))


@query("matrix_answers", r"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 7 AS kind FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, kind NOT IN (1, 2, 5) AS exact_match FROM s
""")
def q_matrix_answers(spark, sf):
    """SC-5: matrices, nested tuples and equations built from the rows' numbers; kinds 1, 2 and 5 are wrong by construction."""
    li = t(spark, sf, "lineitem")
    a, b, c = (F.col(x).cast("int").cast("string") for x in ("l_quantity", "l_linenumber", "l_suppkey"))
    kind = F.col("l_orderkey") % 7
    text = F.concat

    def matrix(name, *rows):
        return text(F.lit("\\begin{" + name + "}"), F.concat_ws(" \\\\ ", *rows), F.lit("\\end{" + name + "}"))

    first, second = text(a, F.lit(" & "), b, F.lit(".0")), text(c, F.lit("&7"))
    wrong = text((F.col("l_quantity") + 1).cast("int").cast("string"), F.lit("&"), b)
    plain = matrix("bmatrix", text(a, F.lit("&"), b), second)
    pair = text(F.lit("(("), a, F.lit(", "), b, F.lit("), ["), c, F.lit(", 2])"))
    near = text(F.lit("(("), a, F.lit(".0,"), b, F.lit("),["), c, F.lit(",2.00])"))
    far = text(F.lit("(("), a, F.lit(","), c, F.lit("0.5),["), b, F.lit(",3])"))
    pred = (F.when(kind <= 2, matrix("pmatrix", first, second)).when(kind <= 5, pair).otherwise(a))
    pred = F.when(kind == 4, text(F.lit("x = "), a)).otherwise(pred)
    gold = (F.when(kind == 0, plain).when(kind == 1, matrix("pmatrix", wrong, second)).when(kind == 2, matrix("bmatrix", first))
            .when(kind == 3, near).when(kind == 4, text(a, F.lit(".00"))).when(kind == 5, far).otherwise(text(F.lit("y="), a)))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", pred.alias("pred"), gold.alias("gold"))
    return answer_match(rows, "pred", "gold").select("l_orderkey", "l_linenumber", "l_partkey", "exact_match")
