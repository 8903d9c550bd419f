"""Suffix arrays by linear grouping, many texts side by side.

A suffix's Lyndon prefix is the longest prefix that is smaller than all its own
proper suffixes. Suffixes are kept in groups, at first by their first symbol.
Groups are taken in descending order. For every member of the group the pointer to
the nearest earlier suffix of a lower group is found, along pointers that are known
already. A suffix that is pointed to is longer by the group's text, as often as it is
pointed to; it leaves its group for one right above it, the higher the more often.
When all groups were taken, each holds the suffixes of one Lyndon prefix. Then one
ascending pass emits every group's order: suffixes that end before the one just
emitted are the chain of pointers that starts left of it. Nothing is renamed or
sorted again.

The texts of a batch are independent. One step takes the highest group of each, so
array operations run over thousands of texts at once.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of all ranges, one after another."""
    ends = np.cumsum(sizes)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(out):
        keep = sizes > 0
        starts, sizes, ends = starts[keep], sizes[keep], ends[keep]
        out[0] = starts[0]
        out[ends[:-1]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(out)


def _group(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each suffix's group, pointer to the nearest earlier suffix of a lower group)."""
    n = len(symbols)
    key = np.repeat(np.arange(len(starts), dtype=np.int64), sizes) * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[order], prepend=-1))
    first = np.empty(n + 1, np.int64)  # the last cell stands before the first text
    first[order] = np.repeat(new, np.diff(new, append=n))
    first[n] = -1
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    end = np.zeros(n, np.int64)  # by a group's first place
    end[new] = np.append(new[1:], n)
    before = np.full(n + 1, -1, np.int64)
    done = np.zeros(n + 1, bool)
    base, top = starts.copy(), starts + sizes
    while len(top):
        low = first[order[top - 1]]
        count = top - low
        members = order[_ranges(low, count)]
        own = np.repeat(low, count)
        at = members - 1
        walking = np.flatnonzero(first[at] >= own)
        while len(walking):
            here = at[walking]
            here = np.where(done[here], before[here], here - 1)
            at[walking] = here
            walking = walking[first[here] >= own[walking]]
        before[members] = at
        done[members] = True
        inside = at >= np.repeat(base, count)
        seen = np.sort(at[inside])
        if len(seen):
            run = np.flatnonzero(np.diff(seen, prepend=-1))
            moved, times = seen[run], np.diff(run, append=len(seen))
            by = np.lexsort((times, first[moved]))
            moved, times = moved[by], times[by]
            group = first[moved]
            head = np.flatnonzero(np.diff(group, prepend=-1))
            many = np.diff(head, append=len(moved))
            stop = end[group[head]]
            to = _ranges(stop - many, many)
            # those that stand where the moved ones go take the places that these leave
            leaving = np.zeros(0, np.int64)
            was = place[moved]
            out = was < np.repeat(stop - many, many)
            if out.any():
                leaving = was[out]
                there = order[to]
                place[there] = -1
                place[moved] = -2
                displaced = there[place[there] == -1]
                order[leaving] = displaced
                place[displaced] = leaving
            order[to] = moved
            place[moved] = to
            part = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(times, prepend=-1) != 0))
            lows = to[part]
            highs = np.append(to[part[1:] - 1] + 1, to[-1] + 1) if len(part) > 1 else np.array([to[-1] + 1])
            end[group[head]] = stop - many  # what is left of the group
            first[moved] = np.repeat(lows, np.diff(part, append=len(moved)))
            end[lows] = highs
        top = low
        left = top > base
        top, base = top[left], base[left]
    return first[:n], before[:n]


def _emit(starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The suffix array of each text, in its places, from groups and pointers."""
    n = len(first)
    out = np.full(n, -1, np.int64)
    out[starts] = starts + sizes - 1  # the end mark is each text's smallest suffix
    placed = np.zeros(n + 1, bool)
    placed[starts + sizes - 1] = True
    free = np.arange(n, dtype=np.int64)  # by a group's first place: its next free one
    at, base, stop = starts.copy(), starts.copy(), starts + sizes
    while len(at):
        j = out[at] - 1
        floor = base
        while len(j):
            go = (j >= floor) & ~placed[j]
            j, floor = j[go], floor[go]
            if not len(j):
                break
            group = first[j]
            spot = free[group]
            out[spot] = j
            free[group] = spot + 1
            placed[j] = True
            j = before[j]
        at = at + 1
        more = at < stop
        at, base, stop = at[more], base[more], stop[more]
    return out


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix arrays of texts that stand one after another in ``symbols``.

    Every text ends in a mark that is smaller than its other symbols. Returns, in
    each text's places, the starts of its suffixes in ascending order.
    """
    if not len(symbols):
        return np.zeros(0, np.int64)
    first, before = _group(symbols, starts, sizes)
    return _emit(starts, sizes, first, before)
