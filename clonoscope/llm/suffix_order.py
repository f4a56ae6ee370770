"""Suffix arrays by Lyndon grouping, without recursion and without renaming.

First suffixes are put into groups by their longest Lyndon prefix: beginning with groups by first symbol, the groups are taken
in descending order; each suffix of a group points to the nearest suffix before it that is in a lower group, and the suffixes pointed to leave
their group for a new one right above it, the higher the more pointers they got. Then the suffixes are emitted in ascending
order: each emitted suffix places the one before it, and along its chain of pointers all that aren't placed, at the next free place of their groups.

`one` does this for one string. `many` takes many short strings a step at a time, all at once: each step takes
every string's highest group that is left (or, emitting, every string's next suffix).
"""

from __future__ import annotations

import numpy as np

#: Strings longer than this are sorted one by one.
LONG = 3000


def one(s: list[int]) -> list[int]:
    """The suffix array of s, whose last symbol must be its only smallest one."""
    n = len(s)
    at = sorted(range(n), key=s.__getitem__)
    where, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for r, i in enumerate(at):
        if r and s[i] != s[at[r - 1]]:
            start = r
        where[i], group[i] = r, start
        size[start] += 1
    before = list(range(-1, n - 1))
    end = n
    while end:
        low = group[at[end - 1]]
        pointers: dict[int, int] = {}
        for i in sorted(at[low:end]):
            j = before[i]
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        by_number: dict[int, list[int]] = {}
        for j, k in pointers.items():
            by_number.setdefault(k, []).append(j)
        for k in sorted(by_number, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_number[k]:
                old = group[j]
                size[old] -= 1
                last = old + size[old]  # swapped with the last of those that stay
                other, place = at[last], where[j]
                at[last], at[place] = j, other
                where[j], where[other] = last, place
                moved.setdefault(old, []).append(j)
            for old, js in moved.items():
                new = old + size[old]
                size[new] = len(js)
                for j in js:
                    group[j] = new
        end = low
    out, free, placed = [-1] * n, list(range(n)), [False] * n
    out[0], placed[n - 1] = n - 1, True
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
    return out


def many(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix arrays of strings that lie one after another in symbols, from starts on: at each place of a string the place in
    symbols of its suffix of that rank. The last symbol of each must be its only smallest one."""
    n = len(symbols)
    ends = np.append(starts[1:], n)
    string = np.repeat(np.arange(len(starts)), ends - starts)
    order = np.lexsort((symbols, string))
    at = order.astype(np.int64)
    where = np.empty(n, np.int64)
    where[at] = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (string[at[1:]] != string[at[:-1]]) | (symbols[at[1:]] != symbols[at[:-1]])
    opened = np.flatnonzero(fresh)
    group = np.empty(n + 1, np.int64)
    group[at] = opened[np.cumsum(fresh) - 1]
    group[n] = -1  # the place before every string
    size = np.zeros(n, np.int64)
    size[opened] = np.diff(np.append(opened, n))
    before = np.arange(-1, n - 1)
    before[starts] = n
    before = np.append(before, n)
    target, source = np.zeros(n, bool), np.zeros(n, bool)
    live, end = np.arange(len(starts)), ends.copy()
    while len(live):
        top = end[live]
        low = group[at[top - 1]]
        count = top - low
        first = np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count)
        i = at[first + np.arange(len(first))]
        floor = np.repeat(low, count)
        j = before[i]
        todo = np.flatnonzero(group[j] >= floor)
        while len(todo):
            # Pointers within the group are being followed, too: each round reads what the last one wrote.
            j[todo] = before[j[todo]]
            before[i[todo]] = j[todo]
            todo = todo[group[j[todo]] >= floor[todo]]
        j = np.sort(j[j < n])
        if len(j):
            new = np.ones(len(j), bool)
            new[1:] = j[1:] != j[:-1]
            heads = np.flatnonzero(new)
            number = np.diff(np.append(heads, len(j)))
            j = j[heads]
            old = group[j]
            by = np.lexsort((-number, old))
            j, old, number = j[by], old[by], number[by]
            change = np.ones(len(j), bool)
            change[1:] = old[1:] != old[:-1]
            heads = np.flatnonzero(change)
            counts = np.diff(np.append(heads, len(j)))
            stop = old[heads] + size[old[heads]]
            to = np.repeat(stop + heads, counts) - 1 - np.arange(len(j))  # from the group's end downwards
            came = where[j]
            target[to] = source[came] = True
            hole, out = came[~target[came]], to[~source[to]]
            target[to] = source[came] = False
            hole.sort()
            out.sort()
            shifted = at[out]
            at[hole] = shifted
            where[shifted] = hole
            at[to] = j
            where[j] = to
            size[old[heads]] -= counts
            change[1:] |= number[1:] != number[:-1]
            heads = np.flatnonzero(change)
            counts = np.diff(np.append(heads, len(j)))
            made = to[heads + counts - 1]
            size[made] = counts
            group[j] = np.repeat(made, counts)
        end[live] = low
        live = live[low > starts[live]]
    out = np.full(n, -1)
    free = np.arange(n)
    placed = np.zeros(n + 1, bool)
    placed[n] = True
    out[starts] = ends - 1
    placed[ends - 1] = True
    by = np.argsort(starts - ends, kind="stable")  # the longest first
    head, lengths = starts[by], (ends - starts)[by]
    for r in range(int(lengths.max(initial=0))):
        here = head[: np.searchsorted(-lengths, -r)]
        j = np.where(out[here + r] == here, n, out[here + r] - 1)
        j = j[~placed[j]]
        while len(j):
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
            j = j[~placed[j]]
    return out


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """As `many`, for any number of strings: short ones in batches of like length, long ones one by one."""
    ends = np.append(starts[1:], len(symbols))
    lengths = ends - starts
    out = np.empty(len(symbols), np.int64)
    for k in np.flatnonzero(lengths > LONG):
        out[starts[k] : ends[k]] = starts[k] + np.array(one(symbols[starts[k] : ends[k]].tolist()))
    short = np.flatnonzero(lengths <= LONG)
    short = short[np.argsort(lengths[short], kind="stable")]
    upto = np.cumsum(lengths[short])
    lo = 0
    while lo < len(short):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + at_once)))
        some = short[lo:hi]
        size = lengths[some]
        own = np.append(0, np.cumsum(size)[:-1])
        places = np.repeat(starts[some] - own, size) + np.arange(size.sum())
        out[places] = places[many(symbols[places], own)]
        lo = hi
    return out
