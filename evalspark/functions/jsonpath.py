"""JSON helpers: tolerant parse classification (SRC-2) and nested metric search (SC-20)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F

NUMERIC_VARIANT_TYPES = ("BIGINT", "DOUBLE", "BOOLEAN")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_variant_number(v: Column) -> Column:
    """T3: JSON numbers and booleans count as numeric; numeric *strings* do not."""
    t = F.schema_of_variant(v)
    return t.isin(*NUMERIC_VARIANT_TYPES) | t.startswith("DECIMAL")


def json_kind(text) -> Column:
    """SRC-2 reject reason: ``ok`` for an object, ``not_object`` for other valid
    JSON (e.g. a bare array of per-sample records), ``unreadable`` otherwise.

    A document the variant parser refuses (duplicate keys, T4) still counts as an
    object when it parses as a map.
    """
    t = _c(text)
    v = F.try_parse_json(t)
    kind = F.schema_of_variant(v)
    as_map = F.from_json(t, "map<string,string>")
    return (F.when(kind.startswith("OBJECT"), F.lit("ok"))
            .when(v.isNotNull(), F.lit("not_object"))
            .when(as_map.isNotNull(), F.lit("ok"))
            .otherwise(F.lit("unreadable")))


def _metric_number(value) -> float | None:
    """``value`` as a float when it is a JSON number or boolean, or ``{score: number}``."""
    if isinstance(value, dict):
        value = value.get("score")
    return float(value) if isinstance(value, (int, float)) else None


TOKEN = re.compile(r'[\x20\t\r\n]*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*")|([^\x20\t\r\n\[\]{},:"]+))', re.S)


def _parse_deep(text: str) -> object:
    """``json.loads`` without recursion, for documents nested deeper than the interpreter's stack; ValueError if unreadable."""
    root: list = []
    holders: list = [root]  # open arrays and objects; the outermost takes the document itself
    names: list = [None]    # the name that waits for its value in each of them
    state = "value"         # value, first (value or end), name, first_name (name or end), colon, next (comma or end)
    at = 0

    def put(value: object) -> None:
        top = holders[-1]
        if isinstance(top, dict):
            top[names[-1]] = value
        else:
            top.append(value)

    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            if text[at:].strip(" \t\r\n"):
                raise ValueError("no JSON")
            break
        at = m.end()
        sign, string, plain = m.groups()
        if sign in ("{", "[") and state in ("value", "first"):
            value: object = {} if sign == "{" else []
            put(value)
            holders.append(value)
            names.append(None)
            state = "first_name" if sign == "{" else "first"
        elif sign in ("}", "]") and state in (("first_name", "next") if sign == "}" else ("first", "next")) and len(holders) > 1 \
                and isinstance(holders[-1], dict) == (sign == "}"):
            holders.pop(), names.pop()
            state = "next"
        elif sign == "," and state == "next" and len(holders) > 1:
            state = "name" if isinstance(holders[-1], dict) else "value"
        elif sign == ":" and state == "colon":
            state = "value"
        elif string and state in ("name", "first_name"):
            names[-1] = json.loads(string)
            state = "colon"
        elif (string or plain) and state in ("value", "first"):
            put(json.loads(string or plain))
            state = "next"
        else:
            raise ValueError("no JSON")
    if len(holders) > 1 or len(root) != 1 or state != "next":
        raise ValueError("no JSON")
    return root[0]


def _search(text: str | None, key: str) -> float | None:
    if not text:
        return None
    try:
        try:
            todo = [json.loads(text)]
        except RecursionError:
            todo = [_parse_deep(text)]
    except ValueError:
        return None
    while todo:
        body = todo.pop()
        if isinstance(body, dict):
            found = _metric_number(body.get(key))
            if found is not None:
                return found
            todo.extend(reversed(body.values()))
        elif isinstance(body, list):
            todo.extend(reversed(body))
    return None


def find_metric(text, key: str) -> Column:
    """SC-20: depth-first search for ``key`` in a JSON document, at any depth.

    At each object: ``key`` here (a number, or ``{score: number}``); otherwise each
    child value in document order, through objects and arrays; the first hit wins.
    Unreadable text gives NULL. SQL has no recursion over a value, so the search runs on
    Arrow batches, with stacks of its own, so no depth is too deep. Documents that do not
    hold the key's text are not parsed. (Reading the top level as a variant in the JVM
    first was measured at twice the time.)
    """

    @F.pandas_udf("double")
    def search(texts: pd.Series) -> pd.Series:
        return pd.Series([_search(t, key) for t in texts], dtype="float64" if len(texts) == 0 else object)

    t = _c(text)
    plain = key.isascii() and key.isprintable() and not set(key) & set("'\"\\")
    return search(F.when(t.contains(f'"{key}"') | t.contains("\\"), t) if plain else t)  # an escape may spell the key
