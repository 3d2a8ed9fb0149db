"""Corpus BLEU (AG-12) and chrF / chrF++ (AG-13) from per-pair n-gram statistics.

Corpus metrics are not means of sentence scores: clipped n-gram matches and
totals are summed over all pairs first (T17). Clipping happens *within* a pair,
so each pair's statistics are computed in its own row -- an Arrow-batched helper
numbers the n-grams of many pairs with numpy -- and only a fixed-length vector of
counts per pair reaches Spark's aggregate. No n-gram is ever shuffled: the
work is embarrassingly parallel over pairs and the only exchange is the final
partial-aggregated sum.

Tokenization is ours (the harness owns the original): BLEU uses whitespace
tokens; chrF uses characters with whitespace removed and, for chrF++, word
1- and 2-grams of whitespace tokens. No smoothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Characters of both sides that are numbered together.
_RUN_CHARS = 200_000


def _overlaps(hyp: list[np.ndarray], ref: list[np.ndarray], orders: int) -> np.ndarray:
    """[matches, hyp_total, ref_total] per order for every pair of symbol sequences, as [pairs, 3 * orders].

    N-grams of all pairs are numbered together: an n-gram's number follows from the
    number of its first n - 1 symbols and its last symbol.
    """
    pairs, sequences = len(hyp), [*hyp, *ref]
    size = np.array([len(x) for x in sequences], np.int64)
    symbol = np.concatenate(sequences) if size.sum() else np.zeros(0, np.int64)
    symbol = np.unique(symbol, return_inverse=True)[1].astype(np.int64)
    where = np.repeat(np.arange(2 * pairs), size)
    out = np.zeros((pairs, 3 * orders), np.int64)
    number, kinds = symbol, int(symbol.max(initial=0)) + 1
    for n in range(1, orders + 1):
        if n > 1:
            if len(symbol) < n:
                break
            key = number[:len(symbol) - n + 1] * kinds + symbol[n - 1:]
            number = np.unique(key, return_inverse=True)[1].astype(np.int64)
        whole = where[:len(symbol) - n + 1] == where[n - 1:]
        at, gram = where[:len(symbol) - n + 1][whole], number[whole]
        total = np.bincount(at, minlength=2 * pairs)
        most = int(gram.max(initial=0)) + 1
        mine, theirs = at < pairs, at >= pairs
        h, hc = np.unique(at[mine] * most + gram[mine], return_counts=True)
        r, rc = np.unique((at[theirs] - pairs) * most + gram[theirs], return_counts=True)
        both, i, j = np.intersect1d(h, r, assume_unique=True, return_indices=True)
        out[:, 3 * n - 3] = np.bincount(both // most, weights=np.minimum(hc[i], rc[j]), minlength=pairs)
        out[:, 3 * n - 2], out[:, 3 * n - 1] = total[:pairs], total[pairs:]
    return out


def _sorted_overlaps(hyp: list[np.ndarray], ref: list[np.ndarray], orders: int) -> np.ndarray:
    """``_overlaps`` by one sort of each pair's n-grams of the highest order, packed into 64 bits.

    Sorted n-grams have those of every lower order as runs of equal leading symbols. A
    sequence's last n-grams are filled up with zeros. Where a run of pairs holds too many
    symbols for the bits, its halves are counted, and a single such pair by ``_overlaps``.
    """
    pairs, sequences = len(hyp), [s for pair in zip(hyp, ref) for s in pair]
    size = np.array([len(x) for x in sequences], np.int64)
    symbol = np.concatenate(sequences) if size.sum() else np.zeros(0, np.int64)
    if int(symbol.max(initial=0)) < 1 << 21 and int(symbol.min(initial=0)) >= 0:
        known = np.zeros(int(symbol.max(initial=0)) + 1, bool)
        known[symbol] = True
        number = np.cumsum(known)
    else:
        kinds, symbol = np.unique(symbol, return_inverse=True)
        number = np.arange(1, len(kinds) + 1)
    bits = int(number[-1]).bit_length() if len(number) else 1
    if bits * orders > 63:
        if pairs == 1:
            return _overlaps(hyp, ref, orders)
        half = pairs // 2
        return np.concatenate([_sorted_overlaps(hyp[:half], ref[:half], orders), _sorted_overlaps(hyp[half:], ref[half:], orders)])
    # orders - 1 zeros behind every sequence
    end = np.cumsum(size + orders - 1)
    line = np.zeros(int(end[-1]) + orders if pairs else 0, np.uint64)
    line[np.arange(len(symbol)) + np.repeat((orders - 1) * np.arange(2 * pairs), size)] = number[symbol]
    gram = np.zeros(len(line) - orders + 1 if pairs else 0, np.uint64)
    for k in range(orders):
        gram = gram << np.uint64(bits) | line[k:len(gram) + k]
    side = np.zeros(len(gram), np.uint64)
    for a, b in zip(end[::2].tolist(), end[1::2].tolist()):
        side[a:b] = 1
    gram = gram << np.uint64(1) | side  # the lowest bit tells the sides
    begin = np.r_[0, end[1::2]][:pairs].tolist()
    for a, b in zip(begin, end[1::2].tolist()):
        gram[a:b].sort()
    gram = gram[:int(end[-1])] if pairs else gram
    theirs, gram = (gram & np.uint64(1)).astype(bool), gram >> np.uint64(1)
    owner = np.repeat(np.arange(pairs), np.diff(np.r_[0, end[1::2]]))
    new_pair = np.zeros(len(gram), bool)
    new_pair[[b for b in begin if b < len(gram)]] = True
    inside = gram >> np.uint64(bits * (orders - 1)) > 0  # starts at a symbol, not at a zero
    before = np.r_[0, np.cumsum(theirs)]
    out = np.zeros((pairs, 3 * orders), np.int64)
    for n in range(1, orders + 1):
        lead = gram >> np.uint64(bits * (orders - n))
        start = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]] | new_pair) if len(lead) else np.zeros(0, np.int64)
        total, r = (np.diff(np.r_[x, last]) for x, last in ((start, len(lead)), (before[start], before[-1])))
        whole = inside[start] & (lead[start] & np.uint64((1 << bits) - 1) > 0)
        at, h, r = owner[start][whole], (total - r)[whole], r[whole]
        for k, x in enumerate((np.minimum(h, r), h, r)):
            out[:, 3 * n - 3 + k] = np.bincount(at, weights=x, minlength=pairs)
    return out


def _stats(hyp: list[str], ref: list[str], word_orders: int, char_orders: int) -> np.ndarray:
    """Counts per pair: character orders first, then word orders, then the word lengths."""
    words, out = [t.encode("utf-8", "surrogatepass").split() for t in (*hyp, *ref)], []  # bytes are split at ASCII white space
    if char_orders:
        def points(row: list[bytes]) -> np.ndarray:
            text = b"".join(row).decode("utf-8", "surrogatepass")
            return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)

        sides = [points(row) for row in words]
        out.append(_sorted_overlaps(sides[:len(hyp)], sides[len(hyp):], char_orders))
    if word_orders:
        size = np.array([len(row) for row in words], np.int64)
        flat = [w for row in words for w in row]
        ids = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        coded = np.split(np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat)), np.cumsum(size)[:-1])
        out.append(_sorted_overlaps(coded[:len(hyp)], coded[len(hyp):], word_orders))
        out.append(np.stack([size[:len(hyp)], size[len(hyp):]], axis=1))
    return np.concatenate(out, axis=1)


def pair_stats(hyp: Column, ref: Column, word_orders: int, char_orders: int) -> Column:
    """Per-pair count vector (see :func:`_stats`) as ``ARRAY<BIGINT>``; a batch is counted in runs of bounded size."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def stats(h: pd.Series, r: pd.Series) -> pd.Series:
        rows, start, size = [], 0, 0
        h, r = h.tolist(), r.tolist()
        for i in range(len(h) + 1):
            if i == len(h) or i > start and size > _RUN_CHARS:
                rows += list(_stats(h[start:i], r[start:i], word_orders, char_orders)) if i > start else []
                start, size = i, 0
            size += len(h[i]) + len(r[i]) if i < len(h) else 0
        return pd.Series(rows, dtype=object)

    return stats(F.coalesce(hyp, F.lit("")), F.coalesce(ref, F.lit("")))


def _summed(pairs: DataFrame, hyp: str, ref: str, by: Sequence[str], word_orders: int,
            char_orders: int) -> DataFrame:
    by = list(by)
    k = 3 * (word_orders + char_orders) + (2 if word_orders else 0)
    s = pairs.select(*by, pair_stats(F.col(hyp), F.col(ref), word_orders, char_orders).alias("_s"))
    aggs = [F.sum(F.col("_s")[i]).alias(f"_s{i}") for i in range(k)]
    return s.groupBy(*by).agg(*aggs) if by else s.agg(*aggs)


def corpus_bleu(pairs: DataFrame, hyp: str = "hypothesis", ref: str = "reference",
                by: Sequence[str] = (), max_n: int = 4) -> DataFrame:
    """BLEU (Papineni et al. 2002), 0-100, one row per ``by`` group.

    Columns: ``bleu, bp, p1..p{max_n}, sys_len, ref_len``.
    """
    by = list(by)
    res = _summed(pairs, hyp, ref, by, max_n, 0)
    res = res.select(*by, *[F.when(F.col(f"_s{3 * (n - 1) + 1}") > 0,
                                   F.col(f"_s{3 * (n - 1)}") / F.col(f"_s{3 * (n - 1) + 1}")).alias(f"p{n}")
                            for n in range(1, max_n + 1)],
                     F.col(f"_s{3 * max_n}").alias("sys_len"), F.col(f"_s{3 * max_n + 1}").alias("ref_len"))
    ps = [F.coalesce(F.col(f"p{n}"), F.lit(0.0)) for n in range(1, max_n + 1)]
    all_pos = ps[0] > 0
    for x in ps[1:]:
        all_pos = all_pos & (x > 0)
    logsum = sum((F.log(F.when(x > 0, x)) for x in ps[1:]), F.log(F.when(ps[0] > 0, ps[0])))
    bp = F.when(F.col("sys_len") > F.col("ref_len"), F.lit(1.0)) \
        .when(F.col("sys_len") > 0, F.exp(1 - F.col("ref_len") / F.col("sys_len"))).otherwise(F.lit(0.0))
    bleu = F.when(all_pos & (F.col("sys_len") > 0), bp * F.exp(logsum / max_n) * 100).otherwise(F.lit(0.0))
    return res.select(*by, bleu.alias("bleu"), bp.alias("bp"), *[F.col(f"p{n}") for n in range(1, max_n + 1)],
                      F.col("sys_len").cast("long").alias("sys_len"), F.col("ref_len").cast("long").alias("ref_len"))


def corpus_chrf(pairs: DataFrame, hyp: str = "hypothesis", ref: str = "reference",
                by: Sequence[str] = (), char_order: int = 6,
                word_order: int = 2, beta: float = 2.0) -> DataFrame:
    """chrF and chrF++ (Popovic 2015, 2017), 0-100, one row per ``by`` group.

    Per order, precision and recall come from corpus sums; chrP / chrR are
    their arithmetic means over orders (characters 1..6 for chrF, plus words
    1..2 for chrF++); F-beta with beta = 2.
    """
    by = list(by)
    res = _summed(pairs, hyp, ref, by, word_order, char_order)
    orders = char_order + word_order

    def ratio(i: int, j: int) -> Column:
        return F.when(F.col(f"_s{j}") > 0, F.col(f"_s{i}") / F.col(f"_s{j}")).otherwise(F.lit(0.0))

    prec = [ratio(3 * o, 3 * o + 1) for o in range(orders)]
    rec = [ratio(3 * o, 3 * o + 2) for o in range(orders)]
    b2 = beta * beta

    def fscore(pc: Column, rc: Column) -> Column:
        return F.when(pc + rc > 0, (1 + b2) * pc * rc / (b2 * pc + rc)).otherwise(F.lit(0.0)) * 100

    cp = sum(prec[1:char_order], prec[0]) / char_order
    cr = sum(rec[1:char_order], rec[0]) / char_order
    ap = sum(prec[1:], prec[0]) / orders
    ar = sum(rec[1:], rec[0]) / orders
    return res.select(*by, fscore(cp, cr).alias("chrf"), fscore(ap, ar).alias("chrf_pp"))
