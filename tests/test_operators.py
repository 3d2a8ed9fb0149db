"""Literal tests for operators, with the source tool's own expected values where it has them."""

from pyspark.sql import functions as F

from evalspark.functions.answers import (
    answers_equal, boxed_answers, clean_choice, extract_answer, first_boxed, flexible_extract,
    strict_letter)
from evalspark.functions.language import canonical_language, flores_subsets, task_languages
from evalspark.functions.projections import (
    canonical_suite, is_lower_better, normalize_to_100, route_model, score_label, split_task_nshot)
from evalspark.functions.text import (
    format_series, gold_index, letter_choices, lettered_options, paraphrase_pair, pipe_table)
from evalspark.operators.decontam import decontaminate, item_ngrams, salted, shared_ngrams
from evalspark.operators.grounding import grounding_metrics, per_round_metrics, pass_rate_name
from evalspark.operators.sequence import global_index, number_within


def one(df):
    return df.collect()[0]


SAMPLE = "image_id string, intersection double, union double, bbox_iou double, shard string, pos long"


def samples(spark, rows):
    df = spark.createDataFrame(rows, SAMPLE)
    rec = F.when(F.col("intersection").isNull() & F.col("union").isNull(), F.lit(None)).otherwise(
        F.struct("intersection", "union", "bbox_iou"))
    return df.withColumn("rec", rec)


def test_giou_ciou(spark):
    df = samples(spark, [("a", 100.0, 100.0, 0.9, "s0", 0), ("b", 50.0, 200.0, 0.4, "s0", 1)])
    r = one(grounding_metrics(df, record="rec"))
    assert r.ciou == 0.5 and r.giou == 0.625 and r.bbox_ap == 0.5


def test_failed_sample_counts_zero_in_giou_not_ciou(spark):
    df = samples(spark, [("a", 100.0, 100.0, 0.9, "s0", 0), (None, None, None, None, "s0", 1)])
    r = one(grounding_metrics(df, record="rec"))
    assert r.giou == 0.5 and r.ciou == 1.0 and r.bbox_ap == 0.5


def test_pass_rates_strict(spark):
    df = samples(spark, [("a", 1.0, 1.0, 0.0, "s", 0), ("b", 0.64, 1.0, 0.0, "s", 1)])
    r = one(grounding_metrics(df, record="rec"))
    assert (r.pass_rate_0_3, r.pass_rate_0_5, r.pass_rate_0_7, r.pass_rate_0_9) == (1.0, 1.0, 0.5, 0.5)
    assert pass_rate_name(0.3) == "pass_rate_0.3"


def test_empty_is_zero(spark):
    df = samples(spark, []).filter("false")
    r = one(grounding_metrics(df, record="rec"))
    assert (r.giou, r.ciou, r.bbox_ap) == (0.0, 0.0, 0.0)


def test_rounds(spark):
    # two images x two turns: round 1 IoU 1.0 / 0.5, round 2 0.5 / 0.3
    rows = [("1", 1.0, 1.0, 0.9, "s0", 0), ("2", 0.5, 1.0, 0.9, "s0", 1),
            ("1", 0.5, 1.0, 0.9, "s1", 0), ("2", 0.3, 1.0, 0.1, "s1", 1)]
    res = {r["round"]: (round(r.giou, 6), r.bbox_ap)
           for r in per_round_metrics(samples(spark, rows), "image_id", ["shard", "pos"], record="rec").collect()}
    assert res == {1: (0.75, 1.0), 2: (0.4, 0.5)}


def test_number_within_hot_key(spark):
    # one key holds most rows; numbering must equal a per-key running count
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 < 8, F.lit(0)).otherwise(F.col("id") % 7).alias("k"),
                                     F.col("id"))
    got = number_within(df, ["k"], ["id"], num_partitions=6)
    bad = got.withColumn("exp", F.count(F.lit(1)).over(
        __import__("pyspark.sql.window", fromlist=["Window"]).Window.partitionBy("k").orderBy("id")))
    assert bad.filter("rn != exp").count() == 0
    idx = global_index(df, ["id"], num_partitions=5)
    assert idx.filter("idx != id").count() == 0


def test_split_task_and_normalize(spark):
    df = spark.createDataFrame([("belebele|5", 0.5, "acc,none"), ("x|y", 0.5, "mystery"),
                                ("squadv2", 55.3, "f1,none")], "t string, v double, m string")
    base, n = split_task_nshot(F.col("t"))
    rows = df.select(base.alias("b"), n.alias("n"), normalize_to_100("v", "m", base).alias("norm"),
                     is_lower_better("m").alias("low")).collect()
    assert [(r.b, r.n) for r in rows] == [("belebele", 5), ("x|y", None), ("squadv2", None)]
    assert [r.norm for r in rows] == [50.0, None, 55.3]


def test_lower_better_substring(spark):
    df = spark.createDataFrame([("wer",), ("answer_acc",), ("acc",)], "m string")
    assert [r[0] for r in df.select(is_lower_better("m")).collect()] == [True, True, False]


def test_label(spark):
    df = spark.createDataFrame([("t", "5", "acc,none", 1.0), ("t", "unknown", "", None)],
                               "task string, n string, m string, norm double")
    got = [r[0] for r in df.select(score_label("task", "n", "m", "norm")).collect()]
    assert got == ["t (5-shot, acc)", "t (unknown-shot, metric, raw)"]


def test_language(spark):
    df = spark.createDataFrame([(" de ",), ("German",), ("deu_latn",), ("por_latn_port",), ("ekk_Latn",),
                                ("xx",), (None,)], "c string")
    got = [r[0] for r in df.select(canonical_language("c")).collect()]
    assert got == ["deu_Latn", "deu_Latn", "deu_Latn", "por_Latn", "est_Latn", None, None]
    t = spark.createDataFrame([("flores200:deu_Latn-eng_Latn", None), ("opensubtitles_multi40_en_to_de", None),
                               ("arc_challenge_mt_is", None), ("xnli", "fr"), ("hellaswag", None)],
                              "name string, subset string")
    langs = [r[0] for r in t.select(task_languages("name", "subset")).collect()]
    assert langs == [["deu_Latn"], ["deu_Latn"], ["isl_Latn"], ["fra_Latn"], []]
    f = spark.createDataFrame([("flores200:a-b",), ("other",)], "t string")
    assert [r[0] for r in f.select(flores_subsets("t")).collect()] == [["a-b", "a", "b"], []]


def test_suites_and_routing(spark):
    df = spark.createDataFrame([(" LMMS-EVAL:Qwen2-VL",), ("lm-eval-harness",), ("custom",)], "s string")
    assert [r[0] for r in df.select(canonical_suite("s")).collect()] == [
        "lmms_eval:Qwen2-VL", "lm_eval", "custom"]
    m = spark.createDataFrame([("Qwen/Qwen2.5-VL-7B",), ("llava-hf/llava-1.5",), ("x/Qwen2-Audio",), ("gpt2",)],
                              "p string")
    assert [r[0] for r in m.select(route_model("p")).collect()] == ["qwen2_5_vl", "llava_hf", "qwen2_audio", None]


def test_boxed_and_equal(spark):
    df = spark.createDataFrame([
        ("so \\boxed{\\frac{1}{2}} ok", "\\frac{1}{2}"),
        ("\\boxed{a \\boxed{12}", "12"),
        ("\\boxed{ 0.5 }", "50"),
        ("\\boxed{(1, 2)}", "(1,2)"),
        ("\\boxed{x = 3}", "3"),
        ("no box", "1"),
        ("\\boxed{C}", "C")], "resp string, gold string")
    p = first_boxed("resp")
    got = [(r.p, r.eq) for r in df.select(p.alias("p"), answers_equal(p, F.col("gold")).alias("eq")).collect()]
    assert got == [("\\frac{1}{2}", True), ("12", True), ("0.5", True), ("(1,2)", True), ("x=3", True),
                   (None, False), ("C", True)]
    assert one(df.select(boxed_answers(F.lit("boxed{a}boxed{b}"))))[0] == ["a", "b"]


def test_extractors(spark):
    df = spark.createDataFrame([("I think 12 apples, total $1,234.50 today",
                                 "The best answer is: B"),
                                ("nothing here", "Answer: A but \\boxed{B}")], "a string, b string")
    rows = df.select(flexible_extract("a").alias("f"), strict_letter("b").alias("s"),
                     clean_choice(F.lit("the answer is (c).")).alias("c"),
                     extract_answer(F.lit("so the answer is 42.")).alias("x")).collect()
    assert rows[0].f == "$1,234.50" and rows[0].s == "B" and rows[0].c == "C" and rows[0].x == "42"
    assert rows[1].f == "[invalid]" and rows[1].s == "B"


def test_table_series_options(spark):
    df = spark.createDataFrame([("nation#gold#silver\nusa # 1 # 2\n\n",)], "t string")
    assert one(df.select(pipe_table("t")))[0] == "nation | gold | silver\n----------------------\nusa | 1 | 2"
    s = spark.createDataFrame([([float(i) for i in range(1000)], [1.0, 2.5, 3.0], ["x", " y "], "y")],
                              "a array<double>, b array<double>, o array<string>, ans string")
    r = one(s.select(format_series("a").alias("a"), format_series("b").alias("b"),
                     lettered_options("o").alias("l"), letter_choices("o").alias("c"),
                     gold_index("o", "ans").alias("g")))
    assert r.a.split(", ")[:3] == ["0", "7", "15"] and len(r.a.split(", ")) == 128
    assert r.b == "1, 2.5, 3" and r.l == "A. x\nB.  y " and r.c == [" A", " B"] and r.g == 1


def test_paraphrase_pair(spark):
    df = spark.createDataFrame([("He did n't go ( really ) .", "Yes , he did .")], "a string, b string")
    a, b = paraphrase_pair(F.col("a"), F.col("b"))
    r = one(df.select(a.alias("a"), b.alias("b")))
    assert (r.a, r.b) == ("He didn't go (really)", "yes, he did.")


def test_sentence_pairs_forms(spark):
    from evalspark.functions.text import language_keys, sentence_pairs
    m = spark.createDataFrame([("1", "mv", "x", {"en": "Hi", "de": "Hallo"})],
                              "id string, movie_id string, segment_id string, translation map<string,string>")
    r = sentence_pairs(m, "en", "de").collect()[0]
    assert (r.movie_id, r.segment_id, r.src, r.tgt) == ("mv", -1, "Hi", "Hallo")
    assert [x.lang for x in language_keys(m).collect()] == ["de", "en"]
    w = spark.createDataFrame([("2", "d7", 12, "Yes", "Ja")], "id string, doc_id string, line_number int, en string, de string")
    r = sentence_pairs(w, "en", "de").collect()[0]
    assert (r.movie_id, r.segment_id, r.src, r.tgt) == ("d7", 12, "Yes", "Ja")


def test_decontamination_deals_a_frequent_ngram_over_salts(spark):
    licence = " ".join(f"lic{k}" for k in range(14))
    docs = [(i, f"{licence} own{i} " + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(300)]
    docs += [(300 + i, " ".join(f"q{i}n{k}" for k in range(15))) for i in range(3)] + [(999, None), (998, "short")]
    bench = [(1, licence), (2, " ".join(f"q1n{k}" for k in range(13))), (3, licence + " own7"), (4, None)]
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(bench, "item_id int, text string")

    def grams(text):
        w = (text or "").split()
        return {" ".join(w[k:k + 13]) for k in range(len(w) - 12)}

    want = {(i, j): len(grams(x) & grams(y)) for i, x in docs for j, y in bench if grams(x) & grams(y)}
    assert {(r.doc_id, r.item_id): r.n_overlap for r in decontaminate(d, b).collect()} == want
    left, right = salted(shared_ngrams(d, b, 13, "doc_id", "item_id", "text"), item_ngrams(b, "item_id", "text", 13), "doc_id", share=20, least=1)
    assert left.groupBy("ngram", "_salt").count().agg(F.max("count")).first()[0] < 90  # 300 rows a gram before
    met = left.join(right, ["ngram", "_salt"]).groupBy("doc_id", "item_id").count().collect()
    assert {(r.doc_id, r.item_id): r["count"] for r in met} == want
