"""Corpus BLEU and chrF counts: one sort of packed n-grams against n-gram by n-gram."""

from collections import Counter

import numpy as np
import pytest

from evalspark.operators import translation as T


def grams(symbols, n):
    return Counter(tuple(symbols[i:i + n]) for i in range(len(symbols) - n + 1))


def by_hand(hyp, ref, orders):
    rows = []
    for h, r in zip(hyp, ref):
        sides = [(grams(list(h), n), grams(list(r), n)) for n in range(1, orders + 1)]
        rows.append([x for a, b in sides for x in ((a & b).total(), a.total(), b.total())])
    return np.array(rows, np.int64).reshape(len(hyp), 3 * orders)


@pytest.mark.parametrize("kinds", [1, 3, 200, 3000, 1 << 40])
@pytest.mark.parametrize("orders", [1, 2, 6])
def test_sorted_overlaps_count_every_n_gram(kinds, orders):
    rng = np.random.default_rng(orders)
    sizes = [0, 1, 2, 5, 6, 7, 60, 1500]
    ref = [rng.integers(0, kinds, n) for n in rng.permutation(sizes)]
    hyp = [r[::-1] if i % 3 else r for i, r in enumerate(ref)]
    hyp[0] = rng.integers(0, kinds, 9)
    for a, b in ((hyp, ref), ([], []), (hyp[:1], ref[:1])):
        assert (T._sorted_overlaps(a, b, orders) == by_hand(a, b, orders)).all()


def test_white_space_is_ascii():
    texts = ["", " \t", "a b\x0bc", "a　b c", "\U0001d518 x \U0001d518", "a\x1cb\x85c d"]
    got = T._stats(texts, texts[::-1], 2, 2)
    words = [[w for w in t.replace("\t", " ").replace("\x0b", " ").split(" ") if w] for t in texts]
    chars = ["".join(w) for w in words]
    size = np.array([[len(w), len(v)] for w, v in zip(words, words[::-1])])
    assert (got == np.concatenate([by_hand(chars, chars[::-1], 2), by_hand(words, words[::-1], 2), size], axis=1)).all()
