"""Passages: compact windows against an explicit Cartesian tree, exact recall, precision, edge rows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from evalspark.llm import passages as P

SCHEMA = "doc_id long, text string"


def tree_nodes(values, least):
    """(position, left, right) of every Cartesian tree node that spans ``least`` positions, extents cut."""
    out, todo = [], [(0, len(values))]
    while todo:
        a, b = todo.pop()
        if b - a >= least:
            c = a + min(range(b - a), key=lambda i: (values[a + i], i))
            out.append((c, min(c - a, least - 1), min(b - 1 - c, least - 1)))
            todo += [(a, c), (c + 1, b)]
    return sorted(out)


@pytest.mark.parametrize("sizes,kinds", [([30, 400, 46, 45, 700], 10 ** 9), ([300, 120], 7), ([0, 200, 0], 1)])
def test_compact_windows_are_the_tree(sizes, kinds):
    rng = np.random.default_rng(2)
    code = P.mix(rng.integers(0, kinds, sum(sizes)).astype(np.uint64))
    text = np.repeat(np.arange(len(sizes)), sizes)
    for function in range(3):
        key, at, left, right = P.compact_windows(code, text, function, 46)
        full = P.mix(code ^ P.mix(np.array([P.SEED + function], np.uint64))) >> np.uint64(24)
        want, first = [], 0
        for n in sizes:
            want += [(first + c, a, b) for c, a, b in tree_nodes(full[first:first + n].tolist(), 46)]
            first += n
        assert list(zip(at.tolist(), left.tolist(), right.tolist())) == want
        assert (key & np.uint64(P.FUNCTION_MASK) == function).all()


def test_shingles_depend_on_words_only():
    s = P.Shingler()
    texts = [b"a b c d e f", b"a  b\tc\nd e f ", b"", b"x", b"a b c d e g", " é".encode() * 5]
    count, code = s.shingles(texts)
    assert count.tolist() == [2, 2, 0, 0, 2, 1]
    assert code[0] == code[2] == code[4] and code[1] == code[3] != code[5]


WORDS = [f"w{i}" for i in range(3000)]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def found(spark, rows):
    return P.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()


def test_exact_near_and_clean(spark, with_extras):
    rng = random.Random(8)
    p, q, short = prose(rng, 55), prose(rng, 400), prose(rng, 45)
    edited = [w if i % 60 else "edit" for i, w in enumerate(q)]
    loose = [w if i % 6 else f"x{i}" for i, w in enumerate(q)]  # far below the similarity
    rows = [(1, prose(rng, 300) + p + prose(rng, 50)), (2, prose(rng, 20) + p + prose(rng, 200)), (3, q + prose(rng, 100)),
            (4, prose(rng, 100) + q), (5, prose(rng, 500)), (6, prose(rng, 10) + edited), (7, short + prose(rng, 60)),
            (8, prose(rng, 60) + short), (9, loose)]
    rows = [(i, " ".join(w)) for i, w in rows] + [(10, None), (11, ""), (None, " ".join(q)), (12, "one two"), (3, " ".join(q))]
    got = P.repeated_passages(with_extras(spark.createDataFrame(rows, SCHEMA))).collect()
    spans = {(r["doc_id"], r["repeated"]): (r["start_word"], r["end_word"], r["first_doc_id"]) for r in got}
    assert spans[(1, False)] == (300, 355, 1) and spans[(2, True)] == (20, 75, 1)
    assert spans[(4, True)] == (100, 500, 3) and spans[(3, False)][2] == 3
    a, b, first = spans[(6, True)]
    assert first == 3 and 10 <= a <= 12 and 405 <= b <= 410
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 6}


def test_a_chance_leader_hides_nothing(spark):
    """Documents 1 and 2 hold most of the passage, too little for themselves, and lead its hashes."""
    rng = random.Random(9)
    p = prose(rng, 52)
    rows = [(1, p[:44] + prose(rng, 30)), (2, prose(rng, 40) + p[8:]), (3, prose(rng, 90) + p + prose(rng, 70)), (4, p + prose(rng, 9))]
    got = found(spark, [(i, " ".join(w)) for i, w in rows])
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == {(3, 90, 142), (4, 0, 52)}


def test_large_groups_periodic_and_long_texts(spark):
    rng = random.Random(10)
    p = " ".join(prose(rng, 80))
    rows = [(i, " ".join(prose(rng, 29)) + f" u{i} " + p) for i in range(400)]
    rows += [(1000, "a " * 30_000), (1001, "a " * 60), (1002, " ".join(prose(rng, 60_000)) + " " + p)]
    got = found(spark, rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert all(by[i][0]["repeated"] and (by[i][0]["start_word"], by[i][0]["end_word"]) == (30, 110) for i in range(1, 400))
    assert by[1002][0]["start_word"] == 60_000 and by[1001][0]["first_doc_id"] == 1000


def test_whole_table_finds_every_exact_repeat(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    where = defaultdict(set)
    for r in rows:
        w = r["text"].lower().split(" ") if False else r["text"].encode().lower().split()
        for k in range(len(w) - 49):
            where[b" ".join(w[k:k + 50])].add(r["doc_id"])
    later, all_ = set(), set()
    for ids in where.values():
        if len(ids) > 1:
            all_ |= ids
            later |= ids - {min(ids)}
    got = P.query(spark, "/root/testdata/sf0.01").collect()
    assert later <= {r["doc_id"] for r in got if r["repeated"]}
    assert all_ <= {r["doc_id"] for r in got}


def test_verified_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = {r["doc_id"]: r["text"].encode().lower().split() for r in docs.collect()}

    def shingles(doc, a, b):
        return {tuple(words[doc][i:i + 5]) for i in range(a, b - 4)}

    pairs = P.near_duplicate_passages(docs).collect()
    assert pairs
    for r in pairs:
        x, y = shingles(r["doc_id"], r["start_word"], r["end_word"]), shingles(r["first_doc_id"], r["first_start"], r["first_end"])
        assert r["first_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50
        assert len(x & y) / len(x | y) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8


def test_cutting(spark):
    assert P.cut_words("a  bb\tc\nd é f", [(1, 3), (4, 5)]) == "a  \nd  f"
    rng = random.Random(3)
    p = " ".join(prose(rng, 60))
    rows = [(1, p, "en", "s", len(p)), (2, p, "en", "s", len(p)), (3, "keep " + p, "en", "s", 5 + len(p)), (4, None, None, None, None),
            (None, p, None, None, None), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in P.without_repeats(docs).collect()}
    assert set(got) == {1, 3, 4, 5, None} and got[1]["text"] == p and got[3]["text"] == "keep " and got[3]["n_chars"] == 5


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []


def test_candidates_reach_the_stated_recall(spark):
    """Pairs of 50 to 60 words with substitutions or inserted words, against brute force over whole passages."""
    rng = random.Random(21)
    rows, want = [], set()
    for i in range(0, 800, 2):
        p = prose(rng, rng.randrange(50, 61))
        q = list(p)
        if i % 4:
            q[len(q) // 2] = f"sub{i}"
        else:
            q.insert(rng.choice([12, 25, len(q) - 12]), f"ins{i}")
        x, y = ({tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (p, q))
        if len(x & y) / len(x | y) >= 0.8:
            want.add(i + 1)
        rows += [(i, " ".join(p)), (i + 1, " ".join(q))]
    got = {r["doc_id"] for r in P.near_duplicate_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(want) > 300 and got <= want and len(want - got) <= 0.01 * len(want)


@pytest.mark.parametrize("inserted", [3, 4, 5])
@pytest.mark.parametrize("turned", [False, True])
def test_sides_of_unequal_length(inserted, turned):
    """60 words with words inserted in the middle: Jaccard 52/63, 52/64 and 52/65, between other text."""
    rng = np.random.default_rng(5)
    p, q, r, s, t = (rng.integers(0, 1 << 32, n).astype(np.uint32) for n in (26, 26, 4, inserted + 4, 7))
    x, y = np.r_[t, p, r, q], np.r_[p, s, q, t[::-1] + np.uint32(1)]
    want = (7, 63, 0, 56 + inserted, 52 / (60 + inserted))
    if turned:
        x, y, want = y, x, (*want[2:4], *want[:2], want[4])
    assert P.verify(x, y, 0.8, 46) == [want]


def test_inserted_words_are_found(spark):
    rng = random.Random(23)
    rows = []
    for i in range(0, 300, 2):
        p = prose(rng, 60)
        q = p[:30] + [f"new{i}x{k}" for k in range(3 + i % 3)] + p[30:]
        rows += [(i, " ".join(prose(rng, 20) + p)), (i + 1, " ".join(q + prose(rng, 20)))]
    got = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in P.near_duplicate_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) >= 147 and all(a <= 1 and 63 <= b <= 66 for a, b in got.values())


def test_exact_repeats_past_the_lead(spark):
    """Documents 3n have words 1-60 of a passage, the next two words 1-80: spans against brute force."""
    rng = random.Random(31)
    rows = []
    for i in range(0, 240, 3):
        p = prose(rng, 80)
        rows += [(i, " ".join(p[:60] + prose(rng, 20))), (i + 1, " ".join(prose(rng, 5) + p)), (i + 2, " ".join(p + prose(rng, 7)))]
    got = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in found(spark, rows) if r["repeated"]}
    assert {i: got.get(i) for i in range(2, 240, 3)} == {i: (0, 80) for i in range(2, 240, 3)}
    assert {i: got.get(i) for i in range(1, 240, 3)} == {i: (5, 65) for i in range(1, 240, 3)}


def test_near_duplicates_behind_leads_that_do_not_match(spark):
    """Two earlier documents each hold 46 words of one side of a near duplicate of 60 words, and lead its hashes."""
    rng = random.Random(5)
    n, early, late = 60, [], []
    for k in range(n):
        x = prose(rng, 60)
        y = [*x[:29], f"edit{k}", *x[30:]]
        early += [prose(rng, 30) + x[:46] + prose(rng, 30), prose(rng, 30) + y[14:] + prose(rng, 30)]
        late += [prose(rng, 40) + x + prose(rng, 20), prose(rng, 50) + y + prose(rng, 20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(early + late)]
    got = {(r["first_doc_id"], r["doc_id"]) for r in P.near_duplicate_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum((2 * n + 2 * k, 2 * n + 2 * k + 1) in got for k in range(n)) >= 0.95 * n


def test_edits_of_one_passage_match_each_other_where_the_first_is_too_far(spark):
    rng = random.Random(6)
    n, rows = 50, []
    for k in range(n):
        base = prose(rng, 90)
        far, near = list(base), list(base)
        for at in (8, 22, 36, 50, 64, 78):
            far[at] = f"far{at}"
        near[44] = "near"
        rows += [prose(rng, 20) + far + prose(rng, 20), prose(rng, 30) + base + prose(rng, 10), prose(rng, 10) + near + prose(rng, 30)]
    got = defaultdict(list)
    for r in P.near_duplicate_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], SCHEMA)).collect():
        got[r["first_doc_id"], r["doc_id"]].append(r["end_word"] - r["start_word"])
    full = [max(got.get((3 * k + 1, 3 * k + 2), [0])) >= 85 for k in range(n)]
    assert sum(full) >= 0.95 * n


def test_prefilter_rejects_only_what_cannot_match():
    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(400):
        x = rng.integers(0, 200, rng.integers(1, 150)).astype(np.uint32)
        y = x.copy() if rng.random() < 0.5 else rng.integers(0, 200, rng.integers(1, 150)).astype(np.uint32)
        y[rng.random(len(y)) < rng.random()] = 999
        pairs.append((x, y))
    kept = P.may_match(pairs, 0.8, 46)
    found = [bool(P.verify(x, y, 0.8, 46)) for x, y in pairs]
    assert not any(f and not k for f, k in zip(found, kept)) and any(found) and not all(kept)


def test_no_number_of_leads_hides_a_near_duplicate(spark):
    """Twelve earlier documents each hold 46 words of one side of a near duplicate of 60 words, and lead its hashes."""
    rng = random.Random(15)
    n, early, late = 20, [], []
    for k in range(n):
        x = prose(rng, 60)
        y = [*x[:29], f"edit{k}", *x[30:]]
        for _ in range(6):
            early += [prose(rng, 30) + x[:46] + prose(rng, 30), prose(rng, 30) + y[14:] + prose(rng, 30)]
        late += [prose(rng, 40) + x + prose(rng, 20), prose(rng, 50) + y + prose(rng, 20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(early + late)]
    got = {(r["first_doc_id"], r["doc_id"]) for r in P.near_duplicate_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum((12 * n + 2 * k, 12 * n + 2 * k + 1) in got for k in range(n)) >= 0.95 * n


def test_a_document_that_no_lead_matches_is_an_earlier_occurrence(spark):
    """Document 1 matches nothing before it; document 2 is held by document 0, and its link with document 1 is found too."""
    rng = random.Random(16)
    rows, n = [], 20
    for k in range(n):
        a, b, c = prose(rng, 60), prose(rng, 14), prose(rng, 14)
        rows += [(3 * k, prose(rng, 20) + b + a), (3 * k + 1, a[14:] + c + prose(rng, 20)), (3 * k + 2, b + a + c)]
    got = {(r["first_doc_id"], r["doc_id"]) for r in P.near_duplicate_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], SCHEMA)).collect()}
    assert all({(3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 2)} <= got for k in range(n))


def test_rare_shingles_meet_wherever_an_interval_may_be(spark):
    """Nodes of one key, extents of 91 places, against all pairs by the number of common places."""
    rng = random.Random(17)
    bases, rows = [prose(rng, 95) for _ in range(4)], []
    for i in range(40):
        base = bases[i % 4]
        rows.append((i, " ".join(w if rng.random() > 0.01 * (i % 9) else f"x{i}" for w in base)))
    docs = spark.createDataFrame(rows, SCHEMA)
    place = 45 << 24 | 45 << 12 | 45
    nodes = spark.createDataFrame([(7, i, place) for i in range(40)], "key long, doc long, place long")
    tables = P.Tables(spark)
    near = P.near_meetings(nodes, nodes, docs, 37, tables)
    got = {(r["lead"], r["doc"]) for r in P.pairs_of_the_rest(near, nodes.limit(0), tables).collect()}
    sets = [{tuple(t.split()[k:k + 5]) for k in range(91)} for _, t in rows]
    want = {(i, j) for j in range(40) for i in range(j) if len(sets[i] & sets[j]) >= 37}
    assert want <= got and all(i % 4 == j % 4 for i, j in got) and len(want) > 100


def test_near_duplicates_that_earlier_documents_hold_are_linked(spark):
    """Documents 0 and 1 hold the two ends of a passage of 100 words each, so every node of documents 2 and 3 is held; those two differ by one word."""
    rng = random.Random(18)
    rows, n = [], 20
    for k in range(n):
        x = prose(rng, 100)
        y = [*x[:50], f"edit{k}", *x[51:]]
        rows += [(4 * k, prose(rng, 20) + x[:75]), (4 * k + 1, x[25:] + prose(rng, 20)), (4 * k + 2, prose(rng, 30) + x), (4 * k + 3, prose(rng, 40) + y)]
    got = {(r["first_doc_id"], r["doc_id"]) for r in P.near_duplicate_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], SCHEMA)).collect()}
    assert sum((4 * k + 2, 4 * k + 3) in got for k in range(n)) >= 0.95 * n


def test_equal_extents_are_one_class(spark):
    """Copies under other words before and after share kinds; nodes of another extent or text do not."""
    rng = random.Random(19)
    x = prose(rng, 300)
    rows = [(i, " ".join(prose(rng, 100) + x + prose(rng, 100))) for i in range(3)] + [(3, " ".join([*x[:150], "edit", *x[151:]]))]
    nodes = [tuple(r) for r in P.windows(spark.createDataFrame(rows, SCHEMA)).collect()]
    texts = [t.split() for _, t in rows]
    content = {}
    for _, doc, place, kind in nodes:
        at, left, right = place >> 24, place >> 12 & 4095, place & 4095
        content.setdefault(kind, set()).add((left, right, tuple(texts[doc][at - left:at + right + 5])))
    assert all(len(c) == 1 for c in content.values()) and len(set.union(*content.values())) == len(content)
    per_doc = [{kind for _, doc, _, kind in nodes if doc == i} for i in range(4)]
    assert len(per_doc[0] & per_doc[1] & per_doc[2]) > 20 and per_doc[0] & per_doc[3] and per_doc[3] - per_doc[0]


def test_nodes_are_joined_without_lone_rows_and_after_the_first_table_is_gone(spark, monkeypatch):
    rng, seen = random.Random(9), []
    base = prose(rng, 400)
    rows = []
    for i in range(12):
        words = list(base)
        for at in range(i % 7, 400, 23):
            words[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(words)))
    joined, paired = P.node_pairs, P.near_meetings

    def node_pairs(met):
        seen.append(met.groupBy("at").agg(F.countDistinct("doc").alias("n")).where("n < 2").count())
        return joined(met)

    def near_meetings(nodes, pending, docs, need, tables):
        for n in range(1, tables.n + 1):
            try:
                seen.append(int("kind" in spark.read.parquet(f"{tables.folder}/{n}").columns))
            except AnalysisException:
                pass  # dropped
        return paired(nodes, pending, docs, need, tables)

    monkeypatch.setattr(P, "node_pairs", node_pairs)
    monkeypatch.setattr(P, "near_meetings", near_meetings)
    P.near_duplicate_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert seen and not any(seen)


def test_no_table_is_broadcast_by_an_estimate(spark):
    """Nothing measured is small enough to be broadcast here, and whatever is broadcast all the same is too large."""
    rng = random.Random(5)
    base = prose(rng, 300)
    rows = [(i, " ".join(w if (k + 7 * i) % 60 else f"x{i}y{k}" for k, w in enumerate(base))) for i in range(8)]
    limits = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "0",
              "spark.sql.maxBroadcastTableSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        assert 0 < P.without_repeats(spark.createDataFrame(rows, SCHEMA)).count() < len(rows)
        assert {k: spark.conf.get(k) for k in limits} == limits
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_nodes_are_paired_once_however_many_shingles_they_share(spark, monkeypatch):
    """Against brute force, in small parts, and without a join by shingle."""
    rng = random.Random(2)
    monkeypatch.setattr(P, "MET_ROWS", 40)
    monkeypatch.setattr(P, "PAIRS", 30)
    met = []
    for key, doc, place in sorted({(rng.randrange(6), rng.randrange(9), rng.randrange(3)) for _ in range(120)}):
        twin, is_open = place if rng.random() < 0.8 else 7, rng.random() < 0.7
        met += [(100 * key + at, key, doc, place, twin, is_open) for at in rng.sample(range(8), 5)]
    want = {(a[2], a[3], b[2], b[3], a[1]) for a in met for b in met
            if a[0] == b[0] and b[3] == b[4] and a[2] > b[2] and (a[5] or b[5])}
    pairs = P.node_pairs(spark.createDataFrame(met, "at long, key long, doc long, place long, twin long, open boolean"))
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(w[:4] for w in want)  # a pair as often as it has hashes
    assert "Join" not in pairs._jdf.queryExecution().toString()


def test_shingles_go_to_each_tile_once_and_links_are_compared_as_alone(spark):
    rng = random.Random(8)
    base = prose(rng, 300)
    texts = [" ".join(w if rng.random() > 0.02 else f"x{i}y{k}" for k, w in enumerate(base)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    sizes, codes = P.Shingler().shingles([P.normal(t) for t in texts])
    codes = np.split(codes.astype(np.uint32), np.cumsum(sizes)[:-1])
    rows = [(i, j, i % 5, j % 7, 200, 210) for i in range(40) for j in range(i)]
    links = spark.createDataFrame(rows, "doc long, lead long, start long, lead_start long, size long, lead_size long")
    fetched = P.fetch(P.tiled(links), docs)
    assert fetched.count() == 40
    want = sorted((*r, *v[:4]) for r in rows for v in P.verify(codes[r[0]][r[2]:r[2] + r[4]], codes[r[1]][r[3]:r[3] + r[5]], P.SIMILARITY, 46))
    got = P.compare(links, docs, P.SIMILARITY, 46, P.Tables(spark)).drop("similarity").collect()
    assert want and sorted(tuple(r) for r in got) == want


def test_stretches_of_met_nodes_are_joined_after_one_shuffle_in_turns(spark):
    rng = random.Random(4)
    rows = sorted({(doc, rng.randrange(400) << 24 | 45 << 12 | 45, rng.randrange(doc), rng.randrange(400) << 24 | 30 << 12 | 45)
                   for doc in range(1, 30) for _ in range(20)})
    met = spark.createDataFrame(rows, "doc long, place long, lead long, lead_place long")
    turns = [P.stretches(P.meeting_pairs(P.brought_together(met, k), P.SLACK), P.SLACK) for k in range(P.ROUNDS)]
    assert all(t._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1 for t in turns)
    got = [tuple(r) for t in turns for r in t.collect()]
    assert sorted(got) == sorted(tuple(r) for r in P.stretches(P.meeting_pairs(met, P.SLACK), P.SLACK).collect())
