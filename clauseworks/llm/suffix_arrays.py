"""Suffix arrays of many small texts at once, by grouping.

First every suffix gets into the group of its Lyndon prefix (the longest prefix that is smaller than all its own
suffixes). Groups begin as those of the first symbols and are worked off in descending order: each suffix of a group
points to the nearest suffix before it that lies in a lower group (its previous smaller one), and the prefix of that
one goes on with the group's. So those pointed at move up, behind the rest of their own group, in order of how many
pointers they got. Then the order is emitted, from the smallest suffix on: whichever suffix is next in order, those
that it ends the Lyndon prefix of (the one before it, and the chain of pointers from there) take the next free places
of their groups. No names are given and nothing is sorted again. Both phases touch each suffix a few times.

The phases run for all texts of a batch in step: each step works on one group (or one place) of every text, by numpy.
Texts of much the same length go well together. Where a batch has few texts for their length, so that a step has next to
nothing to do, they run text by text over plain lists.
"""

from __future__ import annotations

import numpy as np


def _ramps(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … (sizes[0] of them), starts[1], … in one array."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _lyndon_groups(symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each suffix's final group, and its previous smaller suffix."""
    n, sizes = len(symbols), np.diff(begins)
    key = np.repeat(np.arange(len(sizes)), sizes) * (int(symbols.max()) + 1) + symbols
    at = np.argsort(key, kind="stable")
    ordered = key[at]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    width = np.diff(np.r_[first, n])
    place = np.empty(n, np.int64)
    place[at] = np.arange(n)
    group = np.empty(n, np.int64)
    group[at] = np.repeat(first, width)
    end = np.zeros(n + 1, np.int64)
    end[first] = first + width
    before = np.arange(n) - 1
    moved = np.zeros(n, bool)

    top, floor = begins[1:].copy(), begins[:-1] + 1
    while len(live := np.flatnonzero(top > floor)):
        start = group[at[top[live] - 1]]
        size = top[live] - start
        top[live] = start
        members = at[_ramps(start, size)]
        # previous smaller suffixes: over those of higher groups, which have theirs, and of this one, which get theirs now
        who, own = members, np.repeat(start, size)
        while True:
            to = before[who]
            on = group[to] >= own
            if not on.any():
                break
            who, own = who[on], own[on]
            before[who] = before[to[on]]
        hit = before[members]
        hit = hit[symbols[hit] > 0]
        if not len(hit):
            continue
        hit.sort()
        new = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1]])
        u, times = hit[new], np.diff(np.r_[new, len(hit)])
        rank = group[u] * (int(times.max()) + 1) + times
        order = np.argsort(rank, kind="stable")
        u, rank = u[order], rank[order]
        old = group[u]
        head = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        k = np.diff(np.r_[head, len(u)])
        tail = end[old[head]] - k
        goes = _ramps(tail, k)
        # whoever holds a place of the tail and does not move itself takes a place that became free
        moved[u] = True
        held = at[goes]
        stays = held[~moved[held]]
        moved[u] = False
        was = place[u]
        free = np.sort(was[was < np.repeat(tail, k)])
        at[free], place[stays] = stays, free
        at[goes], place[u] = u, goes
        end[old[head]] = tail
        split = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        parts = np.diff(np.r_[split, len(u)])
        group[u] = np.repeat(goes[split], parts)
        end[goes[split]] = goes[split] + parts
    return group, before


def _emit(symbols: np.ndarray, begins: np.ndarray, group: np.ndarray, before: np.ndarray) -> np.ndarray:
    n = len(symbols)
    out = np.full(n, -1, np.int64)
    out[begins[:-1]] = begins[1:] - 1
    free, open_ = np.arange(n), np.ones(n, bool)
    sizes = np.diff(begins)
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = begins[:-1][by_size], sizes[by_size]
    for i in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -i, side="left"))
        j = out[starts[:live] + i] - 1
        while True:
            j = j[(j >= 0)]
            j = j[(symbols[j] > 0) & open_[j]]
            if not len(j):
                break
            g = group[j]
            to = free[g]
            out[to] = j
            free[g] = to + 1
            open_[j] = False
            j = before[j]
    return out


def _one(symbols: list[int]) -> list[int]:
    """The same two phases for one text."""
    n = len(symbols)
    at = sorted(range(n), key=symbols.__getitem__)
    place, group, end = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for k, i in enumerate(at):
        if symbols[i] != symbols[at[start]]:
            end[start], start = k, k
        place[i], group[i] = k, start
    end[start] = n
    before, top = list(range(-1, n - 1)), n
    while top > 1:
        start = group[at[top - 1]]
        times: dict[int, int] = {}
        for i in sorted(at[start:top]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        top = start
        by_times: dict[int, list[int]] = {}
        for j, k in times.items():
            by_times.setdefault(k, []).append(j)
        for k in sorted(by_times, reverse=True):
            ends: dict[int, int] = {}
            for j in by_times[k]:
                g = group[j]
                ends.setdefault(g, end[g])
                last = end[g] = end[g] - 1
                other, p = at[last], place[j]
                at[p], place[other], at[last], place[j] = other, p, j, last
            first = {g: end[g] for g in ends}
            for j in by_times[k]:
                group[j] = first[group[j]]
            for g, was in ends.items():
                end[first[g]] = was
    out, free, open_ = [-1] * n, list(range(n)), [True] * n
    out[0] = n - 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and open_[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            open_[j] = False
            j = before[j]
    return out


#: Texts of the greatest length that a batch must have the bytes of, for steps over all of them to pay.
FEW = 64


def suffix_arrays(symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions of all suffixes: those of text t, in order, from begins[t] to begins[t + 1].

    Every text ends with a 0, which it has nowhere else.
    """
    if not len(symbols):
        return np.empty(0, np.int64)
    if len(symbols) < FEW * int(np.diff(begins).max()):
        return np.concatenate([np.array(_one(symbols[a:b].tolist()), np.int64) + a for a, b in zip(begins[:-1], begins[1:], strict=True)])
    # a text of its end alone goes before, so that every text has an end before it
    symbols = np.r_[0, symbols].astype(np.int64)
    begins = np.r_[0, np.asarray(begins, np.int64) + 1]
    group, before = _lyndon_groups(symbols, begins)
    return _emit(symbols, begins, group, before)[1:] - 1
