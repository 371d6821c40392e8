"""Suffix order of a string of numbers by a difference cover, in numpy."""

from __future__ import annotations

import numpy as np


def packed(a: np.ndarray, b: np.ndarray, above_b: int) -> np.ndarray:
    """Keys in the order of the pairs (a, b), b below above_b; a is ranked first where the product would overflow."""
    if len(a) and (int(a.max()) + 1) * above_b >= 1 << 63:
        a = np.unique(a, return_inverse=True)[1].astype(np.int64)
    return a * above_b + b


def ranked(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1, and how many there are."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), dtype=np.int64)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), dtype=np.int64)
    names = np.cumsum(new)
    out[order] = names
    return out, int(names[-1]) if len(names) else 0


def suffix_order(s: np.ndarray, levels: int) -> np.ndarray:
    """Places of s (numbers from 1) in the order of their suffixes.

    The cover is {1, 2} modulo 3: triples at these places are sorted and named,
    the names' own suffixes ordered by recursion, the remaining places sorted by
    their first number and the name after it, and both merged. After ``levels``
    recursions names stand for 3 ** (levels + 1) numbers; suffixes that agree so
    far may then come in any order.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    t = np.concatenate((s.astype(np.int64), np.zeros(4, np.int64)))
    above = int(t.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a place past the end keeps the two runs of names apart
    sample = np.concatenate((one, two))
    names, distinct = ranked(packed(packed(t[sample], t[sample + 1], above), t[sample + 2], above))
    if distinct < len(sample) and levels > 0:
        order = suffix_order(names, levels - 1)
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    top = len(sample) + 1
    zero = np.arange(0, n, 3)
    zero_key = packed(t[zero], rank[zero + 1], top)
    by = np.argsort(zero_key, kind="stable")
    zero, sampled = zero[by], sample[order]
    sampled = sampled[sampled < n]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    lower = np.zeros(len(zero), dtype=np.int64)
    # against places 1 mod 3 by (number, name after it), against 2 mod 3 by (two numbers, name after them)
    both = packed(t[np.concatenate((zero, first))], rank[np.concatenate((zero, first)) + 1], top)
    lower += np.searchsorted(both[len(zero) :], both[: len(zero)])
    at = np.concatenate((zero, second))
    both = packed(packed(t[at], t[at + 1], above), rank[at + 2], top)
    lower += np.searchsorted(both[len(zero) :], both[: len(zero)])
    # suffixes that agree as far as names reach may be counted differently by the two: any order among them will do
    before = np.arange(len(zero)) + np.maximum.accumulate(lower)
    out = np.empty(n, dtype=np.int64)
    rest = np.ones(n, dtype=bool)
    rest[before] = False
    out[before], out[rest] = zero, sampled
    return out
