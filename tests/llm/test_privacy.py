"""Personal data: patterns against the contract's own, statistics counted by hand, sanitised texts, edge rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from evalspark.llm import privacy as P

SCHEMA = "doc_id long, text string"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    out = [(0, *m.span()) for m in re.finditer(EMAIL, text)]
    out += [(1, *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(CARD, text) if 13 <= len(digits(m.group())) <= 19 and plain_luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m.group())) <= 15]


@pytest.mark.parametrize("seed", range(8))
def test_patterns_equal_the_plain_ones(seed):
    rng = random.Random(seed)
    parts = ["a", "b.c", "@", ".", "x-y", "1", "25", "255", "256", "007", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+", "+1 (743) 555-3824",
             "(", ")", "é", "٣", "\n", "10.0.0.1", "1.2.3.4.5.6.7.8", "a@b@c.d", "a@b.c@d.e", "%+", "_", "0000", "12-34", "  "]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert P.base_spans(text) == brute(text), text


def test_long_runs_cost_linear_time():
    start = time.time()
    for text in ("a" * 2_000_000 + "@", "1" * 2_000_000, "1." * 700_000, "a@" * 500_000, "+1 " * 300_000, "1 " * 800_000, "." * 500_000 + "@b"):
        P.base_spans(text)
    assert time.time() - start < 20


def corpus():
    """An address that a rare name and a code always go with, in different texts; one in copies only; much else."""
    rng = random.Random(4)
    words = [a + b for a in ("lor", "mip", "dol", "sit", "amer", "con", "sec", "adi") for b in ("a", "em", "ol", "ur", "is")]
    docs = []
    for i in range(300):
        docs.append((i, " ".join(rng.choices(words, k=60))))
    for i in range(300, 308):
        a, b = " ".join(rng.choices(words, k=40)), " ".join(rng.choices(words, k=40))
        docs.append((i, f"{a} Zorblatt, member AB-{7000 + i}x or kx4711 Max.Z@mail.example.org {b} zorblatt."))
    docs += [(i, f"{' '.join(words[:30])} Qwert uiop 10.1.2.3 {' '.join(words[10:40])}") for i in range(308, 330)]
    docs += [(330, "zorblatt without an address"), (331, "kx4711 and kx4712"), (332, "kx4712 again"), (333, None), (334, ""), (None, "nobody@x.y zorblatt")]
    return docs


def by_hand(docs):
    """{(entity, term): disclosure} of the pairs that disclose."""
    total, hold, men, both, texts, contexts = len(docs), Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
    for _, text in docs:
        text = text or ""
        words = {m.group().lower() for m in P.TERM.finditer(text)}
        hold.update(words | set(filter(None, map(P.general_form, words))))
        for e, c, terms in P.mentions(text, P.base_spans(text)):
            men[e] += 1
            for t in terms:
                both[e, t] += 1
                texts[e, t].add(text)
                contexts[e, t].add(c)
    out = {}
    for (e, t), n in both.items():
        if len(contexts[e, t]) >= P.CONTEXTS and len(contexts[e, t]) >= P.CONTEXT_SHARE * len(texts[e, t]) and men[e] < total:
            d = math.log2(total * n / men[e] / hold[t]) / math.log2(total / men[e])
            if d >= P.DISCLOSURE:
                out[e, t] = d
    return out


def test_disclosing_terms_equal_counts_by_hand(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, SCHEMA).repartition(7)
    rules = P.disclosing_terms(frame, P.scan(frame)).collect()
    want = by_hand(docs)
    got = {(r["entity"], r["term"]): r for r in rules}
    assert got.keys() == {k for k in want if not k[1].startswith("#")}
    assert all(abs(r["disclosure"] - want[k]) < 1e-9 for k, r in got.items())
    assert {t for _, t in got} == {"zorblatt", "kx4711", "member"}
    for (e, t), r in got.items():
        form = P.general_form(t)
        assert r["general"] == (form[1:] if form and (e, form) not in want else None)


def test_spans_and_texts(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, SCHEMA)
    found = {r["doc_id"]: r for r in P.find_personal_data(frame).collect()}
    for i, text in docs:
        terms = [text[s["start"]:s["end"]].lower() for s in found[i]["added"]]
        assert [(s["kind"], s["start"], s["end"]) for s in found[i]["spans"]] == brute(text or "")
        assert terms == (["zorblatt", "member", "kx4711", "zorblatt"] if i is not None and 300 <= i < 308 else [])
    clean = {r["doc_id"]: r["text"] for r in P.sanitise(frame).collect()}
    for i, text in docs:
        if i is not None and 300 <= i < 308:
            assert "[EMAIL]" in clean[i] and "orblatt" not in clean[i] and "4711" not in clean[i] and "AB-" in clean[i]
        elif not brute(text or ""):
            assert clean[i] == text


def test_a_code_is_generalised_if_its_form_is_common(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("alo", "emi", "ora", "usi")]
    docs = [(i, " ".join(rng.choices(words, k=40)) + f" zip{10000 + i}") for i in range(200)]
    docs += [(i, " ".join(rng.choices(words, k=30)) + " zip98765 a@b.cd " + " ".join(rng.choices(words, k=30))) for i in range(200, 206)]
    f = spark.createDataFrame(docs, SCHEMA)
    rules = {r["term"]: r["general"] for r in P.disclosing_terms(f, P.scan(f)).collect()}
    assert rules == {"zip98765": "zip00000"}
    clean = {r["doc_id"]: r["text"] for r in P.sanitise(f).collect()}
    assert all(" zip00000 [EMAIL] " in clean[i] for i in range(200, 206)) and clean[7] == docs[7][1]


def test_replaced_takes_overlapping_spans_once():
    assert P.replaced("abcdefgh", [(1, 3, "X"), (2, 5, "Y"), (5, 6, ""), (6, 7, "Z")]) == "aXZh"


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, ""), (1, ""), (None, None), (None, "a@b.cd " * 3)],
                                  [(1, "a@b.cd " * 5000 + "x" * 100_000)], [(2, "é 1.2.3.4"), (2, "1.2.3.4 x"), (2, "1.2.3.4 x")]])
def test_edge_tables(spark, docs, with_extras):
    found = P.find_personal_data(with_extras(spark.createDataFrame(docs, SCHEMA))).collect()
    assert sorted((r["doc_id"] or -1, [tuple(s) for s in r["spans"]]) for r in found) == sorted((i or -1, brute(t or "")) for i, t in docs)
    assert P.sanitise(with_extras(spark.createDataFrame(docs, SCHEMA))).count() == len(docs)


def test_query_digests(spark):
    got = {r["doc_id"]: r for r in P.query(spark, "/root/testdata/sf0.01").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect():
        want = brute(r["text"] or "")
        names = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in want)
        row = got[r["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(names.encode()).hexdigest() and row["spans"].startswith(names)
        assert [row[f"n_{k}"] for k in P.KINDS] == [sum(x[0] == k for x in want) for k in range(4)]
