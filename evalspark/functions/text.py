"""Corpus and prompt preparation columns (FLT-6, SC-12..SC-19, SC-21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from evalspark.functions.answers import strip_ws

MAX_TABLE_ROWS = 30   # rows kept per serialized text table
MAX_SERIES_POINTS = 128  # points kept per time series


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def detokenize(c) -> Column:
    """SC-12: five literal fixes, then `` ([.,'])`` -> ``\\1``."""
    s = _c(c)
    for a, b in ((" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"')):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(s, r" (['.,])", "$1")


def lower_first(c) -> Column:
    """Lower-case the first character only."""
    s = _c(c)
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, F.length(s)))


def paraphrase_pair(s1, s2) -> tuple[Column, Column]:
    """SC-12 pair form: sentence 1 detokenized, stripped, one final ``.``/``,``/``;``
    removed; sentence 2 detokenized, stripped, first letter lower-cased."""
    a = strip_ws(detokenize(s1))
    a = F.regexp_replace(a, r"[.,;]$", "")
    b = lower_first(strip_ws(detokenize(s2)))
    return a, b


def valid_pair(a, b, allow_empty: bool = False, trim: bool = True) -> Column:
    """FLT-6: both texts present (non-blank after trimming when ``trim``)."""
    if allow_empty:
        return F.lit(True)

    def ok(c):
        c = F.coalesce(_c(c), F.lit(""))
        return F.length(strip_ws(c) if trim else c) > 0

    return ok(a) & ok(b)


def pipe_table(text, cell_sep: str = "#", max_rows: int = MAX_TABLE_ROWS) -> Column:
    """SC-16: text table -> pipe table.

    Rows are split on newlines and blank rows dropped; cells are split on
    ``cell_sep`` and trimmed, joined by `` | ``; a dash rule (3..80 wide) follows
    the header when there is more than one row; at most ``max_rows`` rows are
    printed, then ``... (k more rows)``.
    """
    rows = F.filter(F.split(_c(text).cast("string"), "\n"), lambda r: F.length(strip_ws(r)) > 0)
    sep_regex = "\\Q" + cell_sep + "\\E"
    lines = F.transform(F.slice(rows, 1, max_rows),
                        lambda r: F.array_join(F.transform(F.split(r, sep_regex), lambda x: strip_ws(x)), " | "))
    n = F.size(rows)
    head = F.slice(lines, 1, 1)
    dash = F.when(n > 1, F.array(F.repeat(F.lit("-"), F.least(F.lit(80), F.greatest(
        F.lit(3), F.length(F.get(lines, 0))))))).otherwise(F.array().cast("array<string>"))
    tail = F.slice(lines, 2, max_rows)
    more = F.when(n > max_rows, F.array(F.concat(F.lit("... ("), (n - max_rows).cast("string"),
                                                 F.lit(" more rows)")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, dash, tail, more), "\n")


def format_g4(x) -> Column:
    """``{:.4g}`` as Python prints it: Java's ``%.4g`` with the trailing zeros
    of the mantissa (and a bare ``.``) removed."""
    s = F.format_string("%.4g", _c(x).cast("double"))
    sci = s.contains("e")
    mant = F.regexp_replace(F.regexp_replace(F.substring_index(s, "e", 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exp = F.substring_index(s, "e", -1)
    plain = F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(sci, F.concat(mant, F.lit("e"), exp)).otherwise(plain)


def subsample(arr, max_points: int = MAX_SERIES_POINTS) -> Column:
    """SC-17: if longer than ``max_points``, take ``arr[int(i * n / max_points)]``
    for ``i < max_points`` (order kept); shorter arrays are kept whole."""
    a = _c(arr)
    n = F.size(a)
    picked = F.transform(F.sequence(F.lit(0), F.lit(max_points - 1)),
                         lambda i: F.element_at(a, F.floor(i * (n / F.lit(float(max_points)))).cast("int") + 1))
    return F.when(n > max_points, picked).otherwise(a)


def format_series(arr, max_points: int = MAX_SERIES_POINTS) -> Column:
    """Subsampled series as ``v1, v2, ...`` with 4 significant digits."""
    return F.array_join(F.transform(subsample(arr, max_points), lambda v: format_g4(v)), ", ")


def lettered_options(options) -> Column:
    """SC-18: ``A. first\\nB. second ...``."""
    o = _c(options)
    return F.array_join(F.transform(o, lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), x)), "\n")


def letter_choices(options) -> Column:
    """SC-18: `` A``, `` B`` ... one per option."""
    return F.transform(_c(options), lambda x, i: F.concat(F.lit(" "), F.char(F.lit(65) + i)))


def gold_index(options, answer) -> Column:
    """SC-18: index of the trimmed answer among the trimmed options (NULL if absent)."""
    pos = F.array_position(F.transform(_c(options), lambda x: strip_ws(x.cast("string"))),
                           strip_ws(_c(answer).cast("string")))
    return F.when(pos > 0, pos - 1)


def label_index(labels, key) -> Column:
    """SC-21: ``labels.index(key)``."""
    pos = F.array_position(_c(labels), _c(key))
    return F.when(pos > 0, pos - 1)


def render_prompt(template: str, **cols) -> Column:
    """SC-19: fill ``{name}`` slots of a template from columns.

    ``render_prompt("Problem:\\n{q}\\n\\nSolution:", q="question")``.
    """
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        j = rest.find("}", i + 1) if i >= 0 else -1
        if i < 0 or j < 0 or rest[i + 1:j] not in cols:
            parts.append(F.lit(rest))
            break
        if i > 0:
            parts.append(F.lit(rest[:i]))
        parts.append(_c(cols[rest[i + 1:j]]).cast("string"))
        rest = rest[j + 1:]
    return F.concat(*parts) if parts else F.lit("")


def words(text) -> Column:
    """Whitespace tokens (empty tokens dropped)."""
    return F.filter(F.split(_c(text), r"\s+"), lambda x: x != "")


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """Contiguous ``n``-grams of a token array, joined by ``sep``."""
    size = F.size(tokens)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1),
                                         lambda i: F.array_join(F.slice(tokens, i, n), sep))) \
        .otherwise(F.array().cast("array<string>"))


def chars(text) -> Column:
    """The characters of a string as an array (project it as a column before
    building n-grams: ``substring`` by position on UTF-8 text scans from the
    start, while array slicing is constant time)."""
    return F.filter(F.split(_c(text), ""), lambda x: x != "")


def char_ngrams(char_array: Column, n: int) -> Column:
    """Character ``n``-grams from a character array column (see :func:`chars`)."""
    return ngrams(char_array, n, sep="")


def decontam_tokens(text) -> Column:
    """Lower-cased letter/digit tokens (punctuation and spacing ignored)."""
    return F.filter(F.split(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]+", " "), " "),
                    lambda x: x != "")


def infer_language_columns(columns: Sequence[str], meta: Sequence[str]) -> list[str]:
    """SC-14 (wide form): every column except the meta columns, sorted."""
    return sorted(c for c in columns if c not in set(meta))


def sentence_pairs(df, src: str, tgt: str, translation_col: str = "translation"):
    """SC-13: ``(id, movie_id, segment_id, src_lang, tgt_lang, src, tgt)`` from a
    parallel corpus stored as a ``translation`` map or as one column per
    language. ``movie_id`` falls back to ``doc_id``; ``segment_id`` to
    ``line_number``; a non-integer segment id becomes -1. A language that is
    not present raises an error (schema check for wide tables, ``raise_error``
    per row for maps)."""
    cols = set(df.columns)
    if translation_col in cols:
        m = F.col(translation_col)

        def pick(lang):
            return F.when(F.map_contains_key(m, lang), m[lang]) \
                .otherwise(F.raise_error(F.lit(f"language {lang!r} missing from {translation_col}")))
        s, t = pick(src), pick(tgt)
    else:
        for lang in (src, tgt):
            if lang not in cols:
                raise ValueError(f"language column {lang!r} not found")
        s, t = F.col(src), F.col(tgt)

    def first_of(*names):
        present = [F.col(n).cast("string") for n in names if n in cols]
        return F.coalesce(*present, F.lit(None).cast("string")) if present else F.lit(None).cast("string")

    seg_txt = first_of("segment_id", "line_number")
    seg = F.when(seg_txt.rlike(r"^\s*-?[0-9]+\s*$"), F.trim(seg_txt).cast("long")).otherwise(F.lit(-1))
    return df.select(first_of("id").alias("id"), first_of("movie_id", "doc_id").alias("movie_id"),
                     seg.alias("segment_id"), F.lit(src).alias("src_lang"), F.lit(tgt).alias("tgt_lang"),
                     s.alias("src"), t.alias("tgt"))


def language_keys(df, translation_col: str = "translation"):
    """SC-14 (map form): the sorted distinct languages of a ``translation`` map."""
    return df.select(F.explode(F.map_keys(translation_col)).alias("lang")).distinct().orderBy("lang")
