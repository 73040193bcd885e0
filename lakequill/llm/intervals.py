"""Groups of equal strings of a fixed length, from a Burrows-Wheeler transform.

Plain functions on arrays; they run inside tasks on one bounded block of texts.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` sorted by at least their first ``depth`` symbols (prefix doubling)."""
    rank = text.astype(np.int64)
    n, step = len(text), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:] + 1
        key = rank * (int(rank.max(initial=0)) + 2 + n) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        step *= 2
        if step >= depth or fresh.max(initial=0) == n - 1:
            return order
        rank = fresh


def equal_starts(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): suffixes in sorted order, and the number of each one's interval of equal first ``depth`` symbols.

    Breadth-first backward extension on the Burrows-Wheeler transform.  At
    value v every interval of suffixes with v symbols in common is extended by
    the symbol before; where two neighbouring suffixes fall into different
    intervals for the first time, their common prefix is v long.  All intervals
    of one value are extended together, only places without a value yet are
    looked at, and the expansion stops at ``depth``: what has no value then has
    at least ``depth`` symbols in common.
    """
    n = len(text)
    order = suffix_order(text, depth)
    bwt = text[order - 1]
    back = np.argsort(bwt, kind="stable")  # the place, in sorted order, of the suffix one symbol further
    first = bwt[back]
    bound = np.zeros(n, bool)  # has a value: differs from its neighbour within the symbols seen so far
    bound[:1] = True
    open_ = np.arange(1, n)
    interval = np.zeros(n, np.int64)
    for value in range(depth):
        if value == 0:
            new = first[open_] != first[open_ - 1]
        else:
            new = interval[back[open_]] != interval[back[open_ - 1]]
        if new.any():
            bound[open_[new]] = True
            open_ = open_[~new]
        interval = np.cumsum(bound)
    return order, interval


def least_of_equal(texts: list[np.ndarray] | np.ndarray, sizes: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """For each string of ``depth`` bytes in the texts, the least owner of an equal one.

    ``texts``: all bytes in a row; ``sizes``: bytes of each text; ``owner``: a
    number for each text.  Returns one entry for each start, text by text
    (``size - depth + 1`` of each).
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = int(ends[-1]) + len(sizes)
    text = np.zeros(n, np.int64)  # zero after each text: no string crosses it
    shift = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(int(ends[-1])) + shift] = texts.astype(np.int64) + 1
    order, interval = equal_starts(text, depth)
    of = np.empty(n, np.int64)
    of[order] = interval
    counts = sizes - depth + 1
    at = np.repeat(starts + np.arange(len(sizes)) - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    groups = of[at]
    least = np.full(int(interval[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, groups, np.repeat(owner, counts))
    return least[groups]
