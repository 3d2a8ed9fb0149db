"""Language codes (PRJ-8, PRJ-9, SC-3, SC-15) as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from evalspark.constants import LANG_ALIAS, LANG_SPECIAL
from evalspark.functions.projections import literal_map


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_language(c) -> Column:
    """PRJ-8: any language spelling -> canonical ``lll_Ssss`` code, else NULL.

    Order: alias lookup on the trimmed lower-case text; ``lll_ssss[_region]``
    -> ``lll_Ssss`` (with the macrolanguage fold); NULL otherwise.
    """
    code = F.trim(_c(c).cast("string"))
    low = F.lower(code)
    alias = literal_map(LANG_ALIAS)[low]
    shaped = low.rlike(r"^[^_]{3}_[^_]{4}(_|$)")
    base = F.concat(F.substring(low, 1, 3), F.lit("_"), F.upper(F.substring(low, 5, 1)),
                    F.substring(low, 6, 3))
    special = literal_map(LANG_SPECIAL)[base]
    folded = F.when(shaped, F.coalesce(special, base))
    return F.when(_c(c).isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(alias, folded))


def task_languages(name, subset) -> Column:
    """PRJ-9: canonical language codes a task belongs to (``ARRAY<STRING>``).

    Translation pairs give their non-English side(s); otherwise the subset's
    language; otherwise, only when the subset is NULL, a trailing ``_xx`` code.
    """
    name, subset = _c(name), _c(subset)

    def canon_list(parts: Column, english: str) -> Column:
        kept = F.filter(parts, lambda p: p != F.lit(english))
        langs = F.transform(kept, lambda p: canonical_language(p))
        return F.filter(langs, lambda x: x.isNotNull())

    flores_pair = F.substring(name, F.instr(name, ":") + 1, F.length(name))
    flores = canon_list(F.split(flores_pair, "-"), "eng_Latn")
    prefix = "opensubtitles_multi40_"
    os_pair = F.substring(name, len(prefix) + 1, F.length(name))
    osub = canon_list(F.split(os_pair, "_to_"), "en")
    sub_lang = canonical_language(subset)
    trailing = canonical_language(F.regexp_extract(name, r"_([a-z]{2})$", 1))
    empty = F.array().cast("array<string>")
    return (F.when(name.startswith("flores200:"), flores)
            .when(name.startswith(prefix), osub)
            .when(sub_lang.isNotNull(), F.array(sub_lang))
            .when(subset.isNull() & name.rlike(r"_[a-z]{2}$") & trailing.isNotNull(),
                  F.array(trailing))
            .otherwise(empty))


def flores_subsets(task) -> Column:
    """SC-3: ``flores200:a-b`` -> ``[a-b, a, b]``; anything else -> ``[]``."""
    t = _c(task)
    pair = F.substring(t, F.instr(t, ":") + 1, F.length(t))
    ok = t.startswith("flores200:") & pair.contains("-")
    a = F.substring_index(pair, "-", 1)
    b = F.substring(pair, F.instr(pair, "-") + 1, F.length(pair))
    return F.when(ok, F.array(pair, a, b)).otherwise(F.array().cast("array<string>"))


def lang_name(code, names: Mapping[str, str]) -> Column:
    """SC-15: display name of a language code: exact; with ``-`` -> ``_``;
    base name plus ``(variant)``; else the code itself."""
    c = _c(code)
    m = literal_map(names)
    under = F.regexp_replace(c, "-", "_")
    base = F.substring_index(under, "_", 1)
    variant = F.substring(under, F.length(base) + 2, F.length(under))
    with_variant = F.when(m[base].isNotNull() & (variant != ""),
                          F.concat(m[base], F.lit(" ("), variant, F.lit(")")))
    return F.coalesce(m[c], m[under], with_variant, c)
