"""Suffix arrays by linear grouping, for many texts side by side in numpy.

Suffixes are grouped by their Lyndon prefix. Phase 1 starts from groups of equal
first letters and processes groups in descending order: every member finds its
previous smaller pointer, the nearest earlier suffix of a lower group; the
suffixes pointed at have their prefix extended by the group's word, once for each
member that points at them, so they leave their group for a new one right above
it. Phase 2 emits the suffixes in ascending order: whoever is emitted lets the
suffix before it, and then that one's chain of previous smaller pointers, take
the next place of their groups. Nothing is renamed and nothing recurses. All
texts advance together: one numpy step handles the current group of every text.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for every range, one after another."""
    total = int(size.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    keep = size > 0
    start, size = start[keep], size[keep]
    ends = np.cumsum(size)
    out[0] = start[0]
    out[ends[:-1]] = start[1:] - start[:-1] - size[:-1] + 1
    return np.cumsum(out)


def suffix_arrays(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Suffix arrays of the texts values[first[k]:first[k+1]], as positions in ``values``, text after text.

    A suffix that is a prefix of another one is the smaller.
    """
    lanes, n = len(first) - 1, len(values)
    if not n:
        return np.zeros(0, np.int64)
    size = np.diff(first)
    lane = np.repeat(np.arange(lanes), size)
    # One guard slot before each text; all indices below count guards.
    at = np.arange(n) + lane + 1
    base = first[:-1] + np.arange(lanes) + 1
    slots = n + lanes
    order = np.full(slots, -1, np.int64)
    rank = np.argsort(lane * (int(values.max()) + 1) + values, kind="stable")
    order[at] = at[rank]
    group = np.full(slots, -1, np.int64)
    v = values[rank]
    new = np.ones(n, bool)
    new[1:] = (v[1:] != v[:-1]) | (lane[1:] != lane[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    group[order[at]] = np.repeat(at[starts], sizes)
    gsize = np.zeros(slots, np.int64)
    gsize[at[starts]] = sizes
    place = np.empty(slots, np.int64)
    place[order[at]] = at
    prev = np.arange(-1, slots - 1)

    live = np.flatnonzero(size > 0)
    low = base[live]
    cur = low + size[live]
    while len(live):
        start = group[order[cur - 1]]
        m = cur - start
        i = order[_ranges(start, m)]
        s = np.repeat(start, m)
        p = prev[i]
        while True:
            up = group[p] >= s
            if not up.any():
                break
            j = np.flatnonzero(up)
            p[j] = prev[p[j]]
            prev[i[j]] = p[j]
        p = p[group[p] >= 0]
        if len(p):
            _extend(p, order, place, group, gsize)
        more = start > low
        if more.all():
            cur = start
        else:
            live, low, cur = live[more], low[more], start[more]
    return _emit(order, group, prev, base, size, at) - lane - 1


def _extend(p: np.ndarray, order: np.ndarray, place: np.ndarray, group: np.ndarray, gsize: np.ndarray) -> None:
    """Move the suffixes ``p`` (once for each member pointing at them) above what stays of their groups, the more often pointed at the higher."""
    if len(p) == 1:
        q, times = p, np.ones(1, np.int64)
    else:
        p = np.sort(p)
        new = np.ones(len(p), bool)
        new[1:] = p[1:] != p[:-1]
        k = np.flatnonzero(new)
        q, times = p[k], np.diff(np.append(k, len(p)))
    h = group[q]
    if len(q) > 1:
        by = np.lexsort((times, h))
        q, times, h = q[by], times[by], h[by]
    head = np.ones(len(q), bool)
    head[1:] = h[1:] != h[:-1]
    k = np.flatnonzero(head)
    moved = np.diff(np.append(k, len(q)))
    hs = h[k]
    tail = hs + gsize[hs] - moved
    target = _ranges(tail, moved)
    # Those that sit in the tail and stay take the places that the movers leave.
    was = place[q]
    leaves = was < np.repeat(tail, moved)
    if leaves.any():
        sitting = order[target]
        flag = np.zeros(len(target), bool)
        inside = ~leaves
        spot = np.repeat(np.cumsum(moved) - moved - tail, moved)
        flag[was[inside] + spot[inside]] = True
        stay, free = sitting[~flag], was[leaves]
        order[free] = stay
        place[stay] = free
    order[target] = q
    place[q] = target
    run = head.copy()
    run[1:] |= times[1:] != times[:-1]
    r = np.flatnonzero(run)
    length = np.diff(np.append(r, len(q)))
    gsize[hs] -= moved
    gsize[target[r]] = length
    group[q] = np.repeat(target[r], length)


def _emit(order: np.ndarray, group: np.ndarray, prev: np.ndarray, base: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Phase 2: every text's suffixes in ascending order."""
    out = np.full(len(order), -1, np.int64)
    free = np.arange(len(order))  # next place of the group that starts here
    done = group < 0
    live = np.flatnonzero(size > 0)
    by = np.argsort(-size[live], kind="stable")
    live = live[by]
    r = base[live].copy()
    end = r + size[live]
    i = end - 1
    left = size[live].copy()
    while len(r):
        blocked = done[i]
        go = np.flatnonzero(~blocked)
        j = i[go]
        g = group[j]
        f = free[g]
        out[f] = j
        free[g] = f + 1
        done[j] = True
        i[go] = prev[j]
        left[go] -= 1
        b = np.flatnonzero(blocked)
        if len(b):
            i[b] = out[r[b]] - 1
            r[b] += 1
        if (left[go] == 0).any():
            keep = left > 0
            r, i, left = r[keep], i[keep], left[keep]
    return out[at]
