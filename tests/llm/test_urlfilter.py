"""URL filter: rules, a brute-force copy of the character models, edge cases."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evalspark.llm import urlfilter as U

SCHEMA = "page_id long, url string"


def frame(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), SCHEMA)


def test_host_path_and_longest_rule(spark):
    urls = ["http://A.Example.org/es/x?q#f", "https://example.org/en/12", "http://notexample.org/en/1", "http://x.COM/fr/",
            "http://x.com/fr", "ftp://com/de/1", "http://h?x://y/z", "http://h#a", "no scheme/de/", "", None, "://", "a://b://c/d"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in U.filter_urls(frame(spark, urls)).collect()}
    want = [("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"),
            ("notexample.org", "/en/1", "org/"), ("x.com", "/fr/", "com/fr/"), ("x.com", "/fr", None),
            ("com", "/de/1", "com/de/"), ("h", "", None), ("h", "", None), ("", "", None), ("", "", None), ("", "", None),
            ("", "", None), ("b:", "//c/d", None)]
    assert [got[i] for i in range(len(urls))] == want


def model(train):
    """Interpolated Witten-Bell character model as a function of a gram, counted from {text: weight}."""
    count = [Counter() for _ in range(U.ORDER + 1)]
    for text, weight in train.items():
        padded = U.PAD * U.ORDER + text
        for i in range(len(text)):
            for k in range(U.ORDER + 1):
                count[k][padded[i + U.ORDER - k:i + U.ORDER + 1]] += weight
    total, kinds = [Counter() for _ in count], [Counter() for _ in count]
    for k, c in enumerate(count):
        for g, n in c.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += n > 0

    def p(gram):
        out = 1.0 / U.ALPHABET
        for k in range(U.ORDER + 1):
            g = gram[U.ORDER - k:]
            n, t = total[k][g[:-1]], kinds[k][g[:-1]]
            out = (count[k][g] + t * out) / (n + t) if n else out
        return out
    return p


def test_scores_and_threshold_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    spelled = df.select("page_id", U.spelling(F.col("url")).alias("t"),
                        U.kept_out(U.spelling(F.col("url"))).alias("out"))
    got = U.filter_urls(df).join(spelled, "page_id").collect()
    ruled = {"allow": Counter(), "block": Counter()}
    label = {}
    for r in got:
        if r["rule"]:
            label.setdefault(r["t"], Counter())[r["verdict"]] += 1
            if not r["out"]:
                ruled[r["verdict"]][r["t"]] += 1
    allow, block = model(ruled["allow"]), model(ruled["block"])

    def score(t):
        grams = [(U.PAD * U.ORDER + t)[i:i + U.ORDER + 1] for i in range(len(t))]
        return round(sum(math.log(allow(g)) - math.log(block(g)) for g in grams) / len(grams), 9) if grams else 0.0

    by_text = {r["t"]: score(r["t"]) for r in got}
    assert all(abs(r["score"] - by_text[r["t"]]) < 1e-8 for r in got)
    bins = defaultdict(Counter)
    for t in {r["t"] for r in got if r["out"]}:
        bins[math.floor(by_text[t] * 100)].update(label.get(t, {}))
    na, nb = sum(b["allow"] for b in bins.values()), sum(b["block"] for b in bins.values())
    best, a, b = None, 0, 0
    for k in sorted((k for k in bins if sum(bins[k].values())), reverse=True):
        a, b = a + bins[k]["allow"], b + bins[k]["block"]
        if na and nb and (best is None or a / na - b / nb > best[0] + 1e-12):
            best = (a / na - b / nb, k)
    limit = best[1] / 100 if best else 0.0
    for r in got:
        if not r["rule"]:
            assert r["verdict"] == ("allow" if r["score"] >= limit else "block")


def test_models_tell_the_labelled_urls_apart(spark):
    got = U.query(spark, "/root/testdata/sf0.01").where("rule IS NOT NULL").groupBy("verdict").agg(F.avg("score").alias("s"))
    s = {r["verdict"]: r["s"] for r in got.collect()}
    assert s["allow"] > s["block"]


def test_no_python_on_the_path(spark):
    plan = U.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("urls", [[], [None], ["", None, ""], ["http://a.org/x"] * 30, ["http://a.com/de/" + "y" * 20000, "http://ü.net/é"]])
def test_edge_tables(spark, urls, with_extras):
    got = U.filter_urls(with_extras(frame(spark, urls))).collect()
    assert len(got) == len(urls) and all(r["verdict"] in ("allow", "block") for r in got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/{sf}/pages.parquet')")
    want = con.execute(U.oracle_sql()).fetchall()
    got = U.query(spark, f"/root/testdata/{sf}").select("page_id", "host", "path", "rule", "verdict", "score").collect()
    assert sorted(map(str, (r[:5] for r in want))) == sorted(map(str, (tuple(r)[:5] for r in got)))
    assert {r[0]: r[5] for r in want} == pytest.approx({r["page_id"]: r["score"] for r in got}, abs=1e-8)


def test_of_two_rules_of_one_length_the_first_listed_wins(spark):
    import duckdb

    rules = [("a.net", "/x", "block"), ("net", "/x/y", "allow"), ("b.net", "/x", "allow")]
    urls = ["http://a.net/x/y/z", "http://b.net/x/y/z", "http://c.net/x/y/z"]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.filter_urls(frame(spark, urls), rules).collect()}
    assert got == {0: ("a.net/x", "block"), 1: ("net/x/y", "allow"), 2: ("net/x/y", "allow")}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES (0, 'http://a.net/x/y/z'), (1, 'http://b.net/x/y/z'), (2, 'http://c.net/x/y/z')) t(page_id, url)")
    want = con.execute(f"SELECT page_id, rule, verdict FROM ({U.oracle_sql(rules)})").fetchall()
    assert {i: (r, v) for i, r, v in want} == got


@pytest.mark.parametrize("verdict", ["allow", "block"])
def test_one_class_leaves_the_threshold_at_zero(spark, verdict):
    host = {"allow": "a.org", "block": "a.com/de"}[verdict]
    urls = [f"http://{host}/page{'x' * i}" for i in range(40)] + ["http://b.net/q"]
    got = U.filter_urls(frame(spark, urls)).collect()
    assert all(r["verdict"] == verdict for r in got if r["page_id"] < 40)
    last = next(r for r in got if r["page_id"] == 40)
    assert last["verdict"] == ("allow" if last["score"] >= 0 else "block")
