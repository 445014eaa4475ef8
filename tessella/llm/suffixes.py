"""Suffix sorting by difference cover, with numpy.

Suffixes at positions 1 and 2 modulo 3 are the sample. Their triples are sorted and named; if names repeat, the string of
names is sorted by the same algorithm, which ranks the sample. Suffixes at positions 0 modulo 3 are sorted by their first
letter and the rank of the next suffix, and merged into the sample by comparing letters and ranks. Recursion also ends
when names stand for more letters than a caller compares: the order is then right for prefixes of that length.
"""

from __future__ import annotations

import numpy as np


def _names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense names, in order, of tuples of small numbers, and how many there are."""
    name = columns[0].astype(np.int64)
    for column in columns[1:]:
        name = np.unique(name << 32 | column, return_inverse=True)[1]
    values, name = np.unique(name, return_inverse=True)
    return name, len(values)


def suffix_array(letters: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes, by their first `depth` letters at least. Letters are from 0 to 2^31 - 1; the end sorts first."""
    n = len(letters)
    if n < 3:
        return np.array(sorted(range(n), key=lambda k: letters[k:].tolist()), np.int64)
    s = np.zeros(n + 4, np.int64)
    s[:n] = letters.astype(np.int64) + 1
    # a further position, when n is 1 modulo 3, keeps the last triple of the first half apart from the second half
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    name, count = _names(s[sample], s[sample + 1], s[sample + 2])
    if count < len(sample) and depth > 3:
        order = suffix_array(name, -(-depth // 3))
        ranked = np.empty(len(sample), np.int64)
        ranked[order] = np.arange(len(sample))
    else:
        ranked = name
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = ranked + 1
    by_rank = sample[np.argsort(ranked, kind="stable")]
    by_rank = by_rank[by_rank < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(s[zeros] << 32 | rank[zeros + 1], kind="stable")]
    # place of each of `zeros` among the sample at 1 and at 2 modulo 3
    is_one = by_rank % 3 == 1
    first, second = by_rank[is_one], by_rank[~is_one]
    below = np.searchsorted(s[first] << 32 | rank[first + 1], s[zeros] << 32 | rank[zeros + 1])
    pairs = np.unique(np.concatenate([s[second] << 32 | s[second + 1], s[zeros] << 32 | s[zeros + 1]]), return_inverse=True)[1]
    below += np.searchsorted(pairs[: len(second)] << 32 | rank[second + 2], pairs[len(second) :] << 32 | rank[zeros + 2])
    # ranks of suffixes alike in all letters that count are in any order, so places among those may cross; they are set straight
    at = np.maximum.accumulate(below) + np.arange(len(zeros))
    out = np.empty(n, np.int64)
    out[at] = zeros
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = by_rank
    return out


def repeats(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Of `starts` (ascending, each with `length` bytes of text after it), those whose string also starts at a smaller one."""
    if len(starts) < 2:
        return starts[:0]
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_array(text, length)
    order = order[wanted[order]]
    strings = np.lib.stride_tricks.sliding_window_view(text, length)
    same = np.empty(len(order) - 1, bool)
    for k in range(0, len(same), 50_000):
        this, following = order[:-1][k : k + 50_000], order[1:][k : k + 50_000]
        same[k : k + 50_000] = (strings[this] == strings[following]).all(axis=1)
    group = np.concatenate([[0], np.cumsum(~same)])
    least = np.minimum.reduceat(order, np.flatnonzero(np.concatenate([[True], ~same])))
    return np.sort(order[least[group] != order])
