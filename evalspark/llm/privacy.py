"""Personal data by patterns, and terms that give it away by information-theoretic sanitisation.

E-mail and IP addresses, card and phone numbers are found by patterns with checks; they
are the protected entities. Deleting them is not enough: a name that stands next to an
address in every document still says whose it is. How much a term t says about an
entity c is their pointwise mutual information over the corpus,

    PMI(c; t) = log2( N * n(c, t) / (n(c) * n(t)) ),

with N documents, n(c) that mention c, n(t) that hold t, and n(c, t) in which t stands
within WINDOW terms of a mention of c. All there is to know about c is IC(c) =
log2(N / n(c)). A term discloses c if PMI(c; t) >= DISCLOSURE * IC(c). With few
mentions every rare word would do so by chance, and with copies every word: the pair
must stand in CONTEXTS different contexts at least (the outermost terms of the window),
and edited copies, many texts with few contexts, are no evidence (CONTEXT_SHARE).

A disclosing term goes wherever it stands in a document that mentions its entity. If it
has digits and its general form (digits as zeros) discloses less than the threshold, it
is generalised to that form, otherwise it is removed.

Documents are scanned once for entities and their windows; terms are counted over the
whole corpus per task first, and only terms that are candidates at all leave a task (a
two-megabyte bit map that any number of candidates fits in). Pairs are joined on (entity,
term), so neither a frequent entity nor a frequent term is one task's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.llm.common import rows_of, short_batches, table
from evalspark.llm.passages import only_listed
from evalspark.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TERM_KIND = "term"
#: Terms on either side of a mention that count as standing with it.
WINDOW = 10
DISCLOSURE = 0.8
CONTEXTS = 3
CONTEXT_SHARE = 0.5
LEAST_LETTERS = 3
#: Bits of the map of candidate terms.
FILTER_BITS = 1 << 24
GENERAL = "#"  # begins the name of a general form; no term has the sign

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The contract's patterns. Possessive digits and the look-behind only save retries that cannot match.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W_]+")

Span = tuple[int, int, int]  # kind, start, end


# --- patterns ----------------------------------------------------------------------------

def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from their at signs, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) of the personal data in ``text``, by kind, then start; code points."""
    if not text:
        return []
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def entity(kind: int, matched: str) -> str:
    """Name of the protected entity that a match mentions."""
    return f"{KINDS[kind]}:{matched.lower() if kind < 2 else re.sub('[^0-9]', '', matched)}"


# --- terms ---------------------------------------------------------------------------------

def free_terms(text: str, spans: list[Span]) -> list[tuple[int, int, str]]:
    """(start, end, term in lower case) of the terms outside all ``spans``, in order."""
    edges = sorted((a, b) for _, a, b in spans)
    out, k, reach = [], 0, 0
    for m in TERM.finditer(text):
        a, b = m.span()
        while k < len(edges) and edges[k][0] < b:
            reach = max(reach, edges[k][1])
            k += 1
        if a >= reach and b - a >= LEAST_LETTERS:
            out.append((a, b, m.group().lower()))
    return out


def general_form(term: str) -> str | None:
    """Name of the term's general form, if it has one."""
    return GENERAL + DIGIT.sub("0", term) if not term.isalpha() and DIGIT.search(term) else None


def mentions(text: str, spans: list[Span]) -> list[tuple[str, int, list[str]]]:
    """(entity, context, terms and general forms near it) of every entity of one text."""
    import xxhash

    terms = free_terms(text, spans)
    starts = [a for a, _, _ in terms]
    found: dict[str, tuple[int, set[str]]] = {}
    for kind, a, b in spans:
        cut = np.searchsorted(starts, a)  # terms are outside all spans: those before a end before it
        near = [t for _, _, t in terms[max(0, cut - WINDOW):cut + WINDOW]]
        if near:
            context = xxhash.xxh64_intdigest(f"{near[0]} {near[-1]}") - (1 << 63)
            _, held = found.setdefault(entity(kind, text[a:b]), (context, set()))
            held.update(near)
            held.update(filter(None, map(general_form, near)))
    return [(name, context, sorted(held)) for name, (context, held) in found.items()]


SCANNED = ("doc_id long, text_key long, spans array<struct<kind:int,start:int,end:int>>, "
           "mentions array<struct<entity:string,context:long,terms:array<string>>>")


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, spans, mentions)`` per row of ``docs(doc_id, text)``; text_key hashes the text."""
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    mention = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64()), ("terms", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, near = [], []
            for value in batch.column("text"):
                text = value.as_py()
                found = base_spans(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                near.append([{"entity": e, "context": c, "terms": t} for e, c, t in mentions(text, found)] if found else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(spans, span), pa.array(near, mention)],
                                             ["doc_id", "text_key", "spans", "mentions"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, SCANNED)


def near_pairs(scanned: DataFrame) -> DataFrame:
    """``(doc_id, text_key, entity, context, term)``: every term that stands near an entity of a document."""
    return (scanned.select("doc_id", "text_key", F.inline("mentions"))
            .select("doc_id", "text_key", "entity", "context", F.explode("terms").alias("term")))


def candidates(scanned: DataFrame) -> DataFrame:
    """``(entity, term, both)`` of pairs with enough contexts; ``both`` counts documents, copies included."""
    per_text = near_pairs(scanned).groupBy("entity", "term", "context", "text_key").agg(F.count(F.lit(1)).alias("both"))
    per_context = per_text.groupBy("entity", "term", "context").agg(F.sum("both").alias("both"), F.count(F.lit(1)).alias("texts"))
    return (per_context.groupBy("entity", "term").agg(F.sum("both").alias("both"), F.sum("texts").alias("texts"), F.count(F.lit(1)).alias("contexts"))
            .where((F.col("contexts") >= CONTEXTS) & (F.col("contexts") >= CONTEXT_SHARE * F.col("texts")))
            .select("entity", "term", "both"))


def holders(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n)``: the documents that hold each of ``terms(term)`` (others may be among the result)."""
    bit = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS))
    words = (terms.select((bit / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("m"))
             .groupBy("w").agg(F.bit_or("m").alias("m")).collect())  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words:
        bits[r["w"]] = r["m"]
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bits = shared.value
        for batch in batches:
            count: Counter[str] = Counter()
            for value in batch.column("text"):
                held = {t.lower() for t in set(TERM.findall(value.as_py() or ""))}
                count.update(held)
                count.update({g for g in map(general_form, held) if g})
            names = list(count)
            bit = np.fromiter((xxhash.xxh64_intdigest(t, 42) & FILTER_BITS - 1 for t in names), np.int64, len(names))
            keep = np.flatnonzero(bits[bit >> 6] >> (bit & 63) & 1)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in keep], pa.string()), pa.array([count[names[k]] for k in keep], pa.int64())],
                                             ["term", "n"])

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(docs: DataFrame, scanned: DataFrame, threshold: float = DISCLOSURE) -> DataFrame | None:
    """``(entity, term, disclosure, general)``: terms that disclose an entity; None if there are no candidates.

    ``general`` is the form that a term is generalised to, null if it is removed.
    """
    pairs = cut_lineage(candidates(scanned))
    if pairs.isEmpty():
        return None
    total = rows_of(scanned)
    # Cut, so that the joins stand between plain shuffles and a frequent entity's pairs can be split.
    known = cut_lineage(scanned.select(F.explode("mentions.entity").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")))
    held = cut_lineage(holders(docs, pairs.select("term").distinct()))
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    judged = cut_lineage(
        pairs.join(known, "entity").join(held, "term")
        .withColumn("disclosure", F.try_divide(F.log2(F.lit(float(total)) * F.col("both") / F.col("n_entity") / F.col("n")), information))
        .where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure"))
    form = F.when(F.col("term").rlike("[0-9]"), F.concat(F.lit(GENERAL), F.regexp_replace("term", "[0-9]", "0")))
    is_form = F.col("term").startswith(GENERAL)
    forms = judged.where(is_form).select("entity", F.col("term").alias("form"), F.lit(True).alias("tells"))
    return (judged.where(~is_form).withColumn("form", form).join(forms, ["entity", "form"], "left")
            .select("entity", "term", "disclosure", F.when(F.col("tells").isNull(), F.substr("form", F.lit(2))).alias("general")))


def added_spans(docs: DataFrame, scanned: DataFrame, threshold: float = DISCLOSURE) -> DataFrame | None:
    """``(doc_id, text_key, added)`` of documents that hold a term which discloses an entity they mention.

    ``added``: array of (start, end, general). None where no term discloses anything.
    """
    rules = disclosing_terms(docs, scanned, threshold)
    if rules is None:
        return None
    rules = cut_lineage(rules)
    # Of several entities that a document mentions, one that a term must be removed for decides.
    asked = cut_lineage(near_pairs(scanned).join(rules, ["entity", "term"]).groupBy("doc_id", "text_key", "term")
                        .agg(F.min(F.struct(F.col("general").isNotNull().alias("kept"), "general")).alias("g"))
                        .groupBy("doc_id", "text_key")  # a document's own terms near its own entities
                        .agg(F.map_from_entries(F.collect_list(F.struct("term", F.coalesce("g.general", F.lit("")).alias("general")))).alias("terms")))
    rows = only_listed(docs, asked.select(F.col("doc_id").alias("doc"))).withColumn("text_key", F.xxhash64("text"))
    rows = (rows.alias("d").join(asked.alias("a"), F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.text_key") == F.col("a.text_key")))
            .select("d.doc_id", "d.text_key", "d.text", "a.terms"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("general", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, terms in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist()):
                goes = dict(terms)
                out.append([{"start": a, "end": b, "general": goes[t] or None} for a, b, t in free_terms(text, base_spans(text)) if t in goes])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(out, kind)], ["doc_id", "text_key", "added"])

    found = rows.mapInArrow(run, "doc_id long, text_key long, added array<struct<start:int,end:int,general:string>>")
    return found.groupBy("doc_id", "text_key").agg(F.any_value("added").alias("added"))  # repeated rows have the same


# --- the operator -----------------------------------------------------------------------------

def find_personal_data(docs: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, text_key, spans, added.

    ``spans``: array of (kind, start, end), kind as a place in KINDS, by kind, then
    start. ``added``: array of (start, end, general) of terms that disclose an entity of the
    same document, by start. Code points, ends exclusive. A null or empty text has
    neither. Repeated rows come back as often, and all of them count as documents; a null
    doc_id is a document like any other. An empty table gives an empty result.
    """
    docs = short_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    scanned = cut_lineage(scan(docs))
    nothing = F.array().cast("array<struct<start:int,end:int,general:string>>")
    more = added_spans(docs, scanned, threshold)
    if more is None:
        return scanned.select("doc_id", "text_key", "spans", nothing.alias("added"))
    s, m = scanned.alias("s"), more.alias("m")
    return (s.join(m, F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.text_key") == F.col("m.text_key")), "left")
            .select("s.doc_id", "s.text_key", "s.spans", F.coalesce("m.added", nothing).alias("added")))


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every (start, end, replacement) put in; of overlapping ones the first, then the longest."""
    out, at = [], 0
    for a, b, new in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], new]
            at = b
        else:  # what overlaps and reaches further goes with it
            at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """``docs(doc_id, text)`` with personal data as ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]``, and disclosing terms
    in their general form or removed. Texts without either, null and empty ones stay as they are."""
    found = find_personal_data(docs, threshold).where((F.size("spans") > 0) | (F.size("added") > 0)).dropDuplicates(["doc_id", "text_key"])
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text"))
    d, f = keyed.alias("d"), found.alias("f")
    rows = (d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key")), "left")
            .select("d.doc_id", "d.text", "f.spans", "f.added"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not (s or m) else replaced(t, [(x["start"], x["end"], f"[{KINDS[x['kind']].upper()}]") for x in s or []]
                                                    + [(x["start"], x["end"], x["general"] or "") for x in m or []])
                     for t, s, m in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "added")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: personal data and disclosing terms of every document."""
    found = find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    names = F.array(*map(F.lit, KINDS))
    base = F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    terms = F.transform("added", lambda s: F.concat_ws(":", F.lit(TERM_KIND), s["start"].cast("string"), s["end"].cast("string")))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select(
        "doc_id", *map(count, range(len(KINDS))),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"),
        F.size("added").cast("long").alias("n_term"))
