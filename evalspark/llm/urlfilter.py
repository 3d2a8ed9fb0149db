"""URL filter: rules first, then the ratio of two character language models.

Rules decide the urls they fit. Their decisions also label the training urls: one
variable-order Markov model is counted over the accepted urls, one over the rejected.
Both use interpolated Witten-Bell smoothing from ORDER characters of context down to a
uniform distribution. A url without a rule is accepted if its mean log-likelihood
difference per character reaches a threshold, which is calibrated (best balanced
accuracy) on a fifth of the labelled urls that the models never counted.

Everything is DataFrame functions. Urls are read in a fixed alphabet (lower case, one
digit class, other characters as ``~``) and each distinct spelling is scored once. The
models hold one row per distinct (ORDER + 1)-gram; grams are counted with a partial
aggregate before any shuffle. No join is hinted: Spark broadcasts the model while it is
small and otherwise shuffles both sides, where AQE splits hot grams.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evalspark.llm.common import table
from evalspark.session import cut_lineage

#: (host, path, verdict); a rule fits its host and all subdomains below the path.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
ORDER = 4
ALPHABET = 64
FOLDS = 5
PAD = "^"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as the contract states them; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return _lower(host), path


def by_strength(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Weakest first: shorter before longer, of one length the last listed first."""
    return sorted(reversed(rules), key=lambda r: len(r[0] + r[1]))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, both null where none fits; ties go to the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rhost, rpath, what in by_strength(rules):
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(rpath)
        rule, verdict = F.when(fits, F.lit(rhost + rpath)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def spelling(url: Column) -> Column:
    """The url in the models' alphabet, without its scheme."""
    text = F.translate(_lower(F.coalesce(url, F.lit(""))), string.digits, "0" * 10)
    text = F.regexp_replace(text, r"^[a-z]*://", "")
    return F.regexp_replace(text, r"[^a-z0./:?=&_#%+,;@-]", "~")


def kept_out(text: Column) -> Column:
    """Whether a spelling is in the calibration fold, by its MD5."""
    return F.conv(F.left(F.md5(text), F.lit(6)), 16, 10).cast("long") % FOLDS == 0


def _grams(text: Column) -> Column:
    """Every character with its ORDER characters of context."""
    padded = F.concat(F.lit(PAD * ORDER), text)
    return F.transform(F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>")),
                       lambda i: F.substr(padded, i, F.lit(ORDER + 1)))


def gram_ratios(grams: DataFrame) -> DataFrame:
    """``(gram, ratio)`` from ``(gram, allow, block)`` counts of the training urls.

    Each order adds one row per distinct suffix; a context has at most one row per
    character of the alphabet, so its window is bounded.
    """
    model = None
    for order in range(ORDER + 1):
        here = (grams.groupBy(F.expr(f"right(gram, {order + 1})").alias("gram"))
                .agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
        context = Window.partitionBy(F.expr(f"left(gram, {order})"))
        for side in ("allow", "block"):
            here = (here.withColumn(f"{side}_n", F.sum(side).over(context))
                    .withColumn(f"{side}_t", F.sum((F.col(side) > 0).cast("long")).over(context)))
        if model is None:
            here = here.withColumns({f"p_{s}_low": F.lit(1.0 / ALPHABET) for s in ("allow", "block")})
        else:
            low = model.select(F.col("gram").alias("low"), F.col("p_allow").alias("p_allow_low"),
                               F.col("p_block").alias("p_block_low"))
            here = here.join(low, F.expr(f"right(gram, {order})") == F.col("low"))
        model = here.select("gram", *(
            F.when(F.col(f"{s}_n") > 0, (F.col(s) + F.col(f"{s}_t") * F.col(f"p_{s}_low"))
                   / (F.col(f"{s}_n") + F.col(f"{s}_t"))).otherwise(F.col(f"p_{s}_low")).alias(f"p_{s}")
            for s in ("allow", "block")))
    return model.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def calibrate(scored: DataFrame) -> DataFrame:
    """One row ``threshold``: best balanced accuracy over ``(score, allow, block)`` rows; 0 without both classes.

    Scores are binned to hundredths first, and a mean log ratio is limited by the
    smoothing, so the window sees a few thousand rows at most.
    """
    bins = (scored.groupBy(F.floor(F.col("score") * 100).alias("bin"))
            .agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
            .where(F.col("allow") + F.col("block") > 0))
    up = Window.orderBy(F.col("bin").desc())
    every = Window.partitionBy()
    gain = (F.try_divide(F.sum("allow").over(up), F.sum("allow").over(every))
            - F.try_divide(F.sum("block").over(up), F.sum("block").over(every)))
    best = bins.select("bin", gain.alias("gain")).agg(
        F.max(F.struct("gain", F.col("bin").alias("bin"))).alias("b"))
    return best.select(F.coalesce(F.when(F.col("b.gain").isNotNull(), F.col("b.bin") / 100.0), F.lit(0.0)).alias("threshold"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, score.

    ``score`` is the mean log ratio per character, 0 for a null or empty url. Without
    a rule the verdict is ``allow`` if the score reaches the threshold (0 when the
    rules label no accepted or no rejected url in the calibration fold). Repeated rows
    come back as often; page_id is only carried.
    """
    host, path = split_url(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), spelling(F.col("url")).alias("text"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    pages = pages.withColumn("rule", rule).withColumn("ruled", verdict)
    texts = cut_lineage(pages.groupBy("text").agg(
        F.sum((F.col("ruled") == "allow").cast("long")).alias("allow"),
        F.sum((F.col("ruled") == "block").cast("long")).alias("block"))
        .na.fill(0, ["allow", "block"])
        .withColumn("kept_out", kept_out(F.col("text"))))
    trained = ~F.col("kept_out")
    grams = (texts.select(F.explode(_grams(F.col("text"))).alias("gram"),
                          F.when(trained, F.col("allow")).otherwise(0).alias("allow"),
                          F.when(trained, F.col("block")).otherwise(0).alias("block"))
             .groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    ratios = cut_lineage(gram_ratios(cut_lineage(grams)))
    sums = (texts.select("text", F.explode(_grams(F.col("text"))).alias("gram"))
            .join(ratios, "gram").groupBy("text").agg(F.avg("ratio").alias("score")))
    scored = cut_lineage(texts.join(sums, "text", "left")
                         .withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9)))
    threshold = calibrate(scored.where("kept_out"))
    judged = scored.select("text", "score").crossJoin(threshold)  # one row
    return (pages.join(judged, "text")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")).alias("verdict"),
                    "score"))


def oracle_sql(rules: list[tuple[str, str, str]] = RULES) -> str:
    """The same filter in DuckDB SQL."""
    up, low, digits = string.ascii_uppercase, string.ascii_lowercase, string.digits
    rule = verdict = "NULL"
    for rhost, rpath, what in by_strength(rules):
        fits = f"(host = '{rhost}' OR ends_with(host, '.{rhost}')) AND starts_with(path, '{rpath}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{rhost + rpath}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    orders, last = [], None
    for k in range(ORDER + 1):
        sides = ", ".join(f"{x}, sum({x}) OVER w AS {x}_n, sum(CASE WHEN {x} > 0 THEN 1 ELSE 0 END) OVER w AS {x}_t" for x in ("allow", "block"))
        p = ", ".join(f"CASE WHEN {x}_n > 0 THEN ({x} + {x}_t * p_{x}_low) / ({x}_n + {x}_t) ELSE p_{x}_low END::DOUBLE AS p_{x}"
                      for x in ("allow", "block"))
        below = (f"SELECT *, {1.0 / ALPHABET}::DOUBLE AS p_allow_low, {1.0 / ALPHABET}::DOUBLE AS p_block_low FROM w{k}" if last is None else
                 f"SELECT w{k}.*, m.p_allow AS p_allow_low, m.p_block AS p_block_low FROM w{k} JOIN {last} m ON right(w{k}.gram, {k}) = m.gram")
        orders += [f"c{k} AS (SELECT right(gram, {k + 1}) AS gram, sum(allow) AS allow, sum(block) AS block FROM grams GROUP BY ALL)",
                   f"w{k} AS (SELECT gram, {sides} FROM c{k} WINDOW w AS (PARTITION BY left(gram, {k})))",
                   f"m{k} AS (SELECT gram, {p} FROM ({below}))"]
        last = f"m{k}"
    models = ",\n".join(orders)
    return f"""
WITH raw AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{up}', '{low}') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path,
         regexp_replace(regexp_replace(translate(translate(url, '{up}', '{low}'), '{digits}', '{"0" * 10}'), '^[a-z]*://', ''),
                        '[^a-z0./:?=&_#%+,;@-]', '~', 'g') AS text
  FROM raw),
judged AS (SELECT *, {rule} AS rule, {verdict} AS ruled FROM split),
texts AS (
  SELECT text, sum(CASE WHEN ruled = 'allow' THEN 1 ELSE 0 END) AS allow, sum(CASE WHEN ruled = 'block' THEN 1 ELSE 0 END) AS block,
         CAST('0x' || left(md5(text), 6) AS BIGINT) % {FOLDS} = 0 AS kept_out
  FROM judged GROUP BY text),
each AS (
  SELECT text, allow, block, kept_out, substr('{PAD * ORDER}' || text, i, {ORDER + 1}) AS gram
  FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM texts)),
grams AS (
  SELECT gram, sum(CASE WHEN kept_out THEN 0 ELSE allow END) AS allow, sum(CASE WHEN kept_out THEN 0 ELSE block END) AS block
  FROM each GROUP BY gram),
{models},
sums AS (SELECT text, avg(ln(p_allow) - ln(p_block)) AS score FROM each JOIN {last} USING (gram) GROUP BY text),
scored AS (SELECT t.*, round(coalesce(score, 0.0), 9) AS score FROM texts t LEFT JOIN sums USING (text)),
bins AS (
  SELECT floor(score * 100) AS bin, sum(allow) AS allow, sum(block) AS block FROM scored WHERE kept_out GROUP BY 1 HAVING sum(allow) + sum(block) > 0),
gains AS (
  SELECT bin, sum(allow) OVER up / nullif(sum(allow) OVER (), 0) - sum(block) OVER up / nullif(sum(block) OVER (), 0) AS gain
  FROM bins WINDOW up AS (ORDER BY bin DESC)),
best AS (SELECT coalesce((SELECT bin / 100.0 FROM gains WHERE gain IS NOT NULL ORDER BY gain DESC, bin DESC LIMIT 1), 0.0) AS threshold)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, score
FROM judged JOIN scored USING (text), best
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: host, path, rule and verdict of every page's url."""
    return filter_urls(table(spark, sf_dir, "pages", "page_id", "url"))
