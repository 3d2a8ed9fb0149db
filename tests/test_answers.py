"""Boxed spans: any depth, long and unclosed spans, against a plain brace scan."""

import random

import pytest

from evalspark.functions.answers import answer_match, answers_equal, boxed_answers, extract_answer, first_boxed


def scan(text):
    text, out, at = text.replace(" ", ""), [], 0
    while (at := text.find("boxed{", at)) >= 0:
        at += 6
        depth = 1
        for end in range(at, len(text)):
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            if not depth:
                out.append(text[at:end])
                break
    return out


CASES = ["", "none", "boxed{}", "\\boxed{1}", "a boxed{ x y } b boxed{z}", "boxed{open boxed{in} more", "boxed{a}} boxed{b{c}d}",
         "boxed boxed{{}{}} bbboxed{b}", "}}boxed{q}", "x\\boxed{" + "y" * 100_000 + "}", "boxed{" * 1000 + "tail", "boxed{" * 300 + "}" * 300]
CASES += ["boxed{" + "{" * d + "v" + "}" * d + "}" for d in range(1, 51, 7)]


def test_spans(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)] + [(99, None)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", first_boxed("t").alias("first"), boxed_answers("t").alias("all")).collect()}
    for i, text in enumerate(CASES):
        assert got[i]["all"] == scan(text), text[:40]
        assert got[i]["first"] == next(iter(scan(text)), None), text[:40]
    assert got[99]["first"] is None


@pytest.mark.parametrize("text,want", [
    ("so \\boxed{\\frac{{{{{{7}}}}}}{2}}.", "\\frac{{{{{{7}}}}}}{2}"), ("boxed{never closed", "never closed"), ("boxed 5$ x", "5"), ("boxed", ""),
    ("boxed{" + "9" * 50_000 + "}", "9" * 50_000)])
def test_extract(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(extract_answer("t")).first()[0] == want


def test_elements_of_tuples_matrices_and_equations(spark):
    pm, bm = "\\begin{pmatrix}%s\\end{pmatrix}", "\\begin{bmatrix}%s\\end{bmatrix}"
    cases = [
        (pm % "1 & 2 \\\\ 3 & 4", bm % "1.0&2\\\\3&4.00\\\\", True), (bm % "1 & 2 \\\\ 3 & 4", pm % "1&2\\\\3&5", False),
        (pm % "1&2\\\\3&4", pm % "1&2&3&4", False), (pm % "1&2", pm % "1\\\\2", False), (pm % "a&b\\\\\\\\c&d", bm % "\\\\A & B\\\\ c&d", True),
        (pm % "(1,2)&x", pm % "(1,2)& x", True), ("((1, 2), 3)", "((1.0,2),3.00)", True), ("((1.0, 2), 3)", "(1, (2, 3))", False),
        ("[1, f(2, 3)]", "(1.0, f(2.0,3))", True), ("(1, 2]", "[1.0,2.0)", True), ("(1,2,3)", "(1,2)", False), ("(1,2)", "(2,1)", False),
        ("x = 5", "5.0", True), ("5.0", "x=5", True), ("x=y=5", "5", False), ("long = 5", "5.0", False), ("5.0", "abc=5", False), ("x=5", "y=5", False),
        ("x = (1, 2)", "(1,2)", True), (pm % "1\\2", "{1,2}", True), ("(a, b)", "(a,)", False), ("", "x=1", False), ("x^2+1", "x^2 + 1", False)]
    df = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(cases)], "i int, p string, g string")
    for out in (df.select("i", answers_equal("p", "g").alias("e")), answer_match(df, "p", "g", "e")):
        assert {r.i: r.e for r in out.collect()} == {i: e for i, (_, _, e) in enumerate(cases)}


def test_elements_are_compared_without_repeated_type_checks(spark):
    """Blank rows are no rows, and no lambda's result is taken out of an array, which costs its whole type for every row."""
    pm = "\\begin{pmatrix}%s\\end{pmatrix}"
    rows = [(pm % "(\\\\ \\\\", pm % " \\\\ \\\\", False), (pm % " \\\\ ", pm % "", True), (pm % "1\\\\", pm % "\\\\ \\\\1.0", True), ("1_0", "10", True), ("1__0", "10", False), (None, "1", False)]
    out = answer_match(spark.createDataFrame(rows, "p string, g string, want boolean"), "p", "g", "e")
    assert [r["e"] for r in out.collect()] == [want for _, _, want in rows]
    assert "transform(array(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_boxed_fast_paths_equal_the_fold(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["boxed{", "{", "}", "a", " ", "\\", "boxed", "x+1"], k=rng.randint(0, 14))) for _ in range(400)]

    def spans(t):
        t, out, at = t.replace(" ", ""), [], 0
        while (at := t.find("boxed{", at)) >= 0:
            depth, end = 1, at + 6
            while end < len(t) and depth:
                depth += (t[end] == "{") - (t[end] == "}")
                end += 1
            if not depth:
                out.append(t[at + 6:end - 1])
            at += 1
        return out

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", boxed_answers("t").alias("every"), first_boxed("t").alias("first")).collect():
        want = spans(texts[r.i])
        assert r.every == want and r.first == (want[0] if want else None), texts[r.i]
