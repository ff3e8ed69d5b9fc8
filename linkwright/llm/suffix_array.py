"""Suffix array of an integer string by linear grouping.

First phase: suffixes start in groups of equal first symbol. Groups are taken in
descending order; each suffix of the group finds, along pointers already set, the
nearest suffix to its left that lies in a smaller group. The suffixes found are
moved up inside their own group, those found more often further. At the end every
group holds the suffixes that begin with the same Lyndon word, groups ascending.
Second phase: walking the array from its start, every suffix puts its left
neighbour, and the chain of pointers behind it, at the next free place of their
groups. No symbols are renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """``symbols``: non-negative; the last one is smaller than all others and occurs once."""
    n = len(symbols)
    first = np.argsort(symbols, kind="stable")
    by_symbol = symbols[first]
    place: list[int] = first.tolist()
    group: list[int] = np.searchsorted(by_symbol, symbols, "left").tolist()
    where = [0] * n
    for at, i in enumerate(place):
        where[i] = at
    starts = np.unique(by_symbol, return_index=True)[1]
    end_of = dict(zip(starts.tolist(), [*starts[1:].tolist(), n]))
    left = [-1] * n
    high = n
    while high > 0:
        low = group[place[high - 1]]
        if high - low == 1:  # a group of one moves one suffix at most
            i = place[low]
            high = low
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = left[j]
            left[i] = j
            if j >= 0:
                start = group[j]
                end = end_of[start]
                new = end - 1
                if new != start:
                    other, from_ = place[new], where[j]
                    place[from_], where[other] = other, from_
                    place[new], where[j] = j, new
                    group[j] = new
                    end_of[start], end_of[new] = new, end
            continue
        members = place[low:high]
        members.sort()
        found: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = left[j]
            left[i] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        high = low
        if not found:
            continue
        by_times: dict[int, dict[int, list[int]]] = {}
        for j, times in found.items():
            by_times.setdefault(times, {}).setdefault(group[j], []).append(j)
        for times in sorted(by_times, reverse=True):
            for start, moved in by_times[times].items():
                end = end_of[start]
                new = end - len(moved)
                if new == start:
                    continue
                for at, j in enumerate(moved, new):  # swap to the end of the group
                    other, from_ = place[at], where[j]
                    place[from_], where[other] = other, from_
                    place[at], where[j] = j, at
                    group[j] = new
                end_of[start], end_of[new] = new, end
    out = [-1] * n
    out[0] = n - 1
    done = bytearray(n)
    done[n - 1] = 1
    free = list(range(n))
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            start = group[j]
            at = free[start]
            out[at] = j
            free[start] = at + 1
            done[j] = 1
            j = left[j]
    return np.array(out, dtype=np.int64)


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in ``order``."""
    n = len(symbols)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    s, sa, at = symbols.tolist(), order.tolist(), rank.tolist()
    shared = [0] * n
    h = 0
    for i in range(n - 1):
        k = at[i]
        if k == 0:
            h = 0
            continue
        j = sa[k - 1]
        while s[i + h] == s[j + h]:  # separators occur once, so this ends
            h += 1
        shared[k] = h
        if h:
            h -= 1
    return np.array(shared, dtype=np.int64)
