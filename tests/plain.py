"""Plain Python versions of operators, one step after another, for the tests."""

from __future__ import annotations

from collections import defaultdict


def tile(streams: dict[int, list[tuple[str, int, bool]]], size: int, min_lines: int, strict: bool, low: int = 2, high: int = 64, admitted: dict[int, list[int]] | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """Clones as (length in tokens, occurrences as (stream, at)).

    ``admitted`` gives the starts of windows that may pair, where the caller has
    counted them over more streams than these. Windows of ``size`` tokens that occur ``low`` to ``high`` times are paired and
    grown to the right as far as both agree. Longest first, a pair whose places
    are both free becomes a clone; a pair with one free place joins a clone of
    its length that holds the other place; what overlaps is dropped.
    """
    text = {s: [t[0] for t in toks] for s, toks in streams.items()}
    seen: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for s in sorted(streams):
        toks = streams[s]
        stated = [0]
        for t in toks:
            stated.append(stated[-1] + t[2])
        for i in range(len(toks) - size + 1) if admitted is None else sorted(admitted.get(s, ())):
            if admitted is not None or strict or stated[i + size] > stated[i]:
                seen[tuple(text[s][i : i + size])].append((s, i))
    pairs = []
    for places in seen.values():
        if admitted is None and not low <= len(places) <= high:
            continue
        for x in range(len(places)):
            for y in range(x + 1, len(places)):
                (sa, a), (sb, b) = places[x], places[y]
                ta, tb = text[sa], text[sb]
                n, most = size, min(len(ta) - a, len(tb) - b)
                while n < most and ta[a + n] == tb[b + n]:
                    n += 1
                if sa != sb or b >= a + n:
                    pairs.append((-n, (sa, a), (sb, b)))
    pairs.sort()
    taken: dict[int, bytearray] = {s: bytearray(len(t)) for s, t in streams.items()}
    clones: list[tuple[int, list[tuple[int, int]]]] = []
    holders: dict[tuple[int, int, int], int] = {}

    def free(p: tuple[int, int], n: int) -> bool:
        return not any(taken[p[0]][p[1] : p[1] + n])

    def claim(p: tuple[int, int], n: int) -> None:
        taken[p[0]][p[1] : p[1] + n] = b"\x01" * n

    for neg, a, b in pairs:
        n = -neg
        toks = streams[a[0]]
        if toks[a[1] + n - 1][1] - toks[a[1]][1] + 1 < min_lines:
            continue
        fa, fb = free(a, n), free(b, n)
        if fa and fb:
            claim(a, n)
            claim(b, n)
            holders[(n, *a)] = holders[(n, *b)] = len(clones)
            clones.append((n, [a, b]))
        elif fa != fb:
            new, old = (a, b) if fa else (b, a)
            k = holders.get((n, *old))
            if k is not None:
                claim(new, n)
                clones[k][1].append(new)
                holders[(n, *new)] = k
    return [(n, sorted(places)) for n, places in clones]


def components(edges: list[tuple]) -> dict:
    """node: least node of its strongly connected component, by reachability."""
    nodes = {x for e in edges for x in e}
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    reach = {}
    for n in nodes:
        todo, seen = [n], {n}
        while todo:
            for m in out[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        reach[n] = seen
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def ranks(edges: list[tuple]) -> dict:
    """component (least node): edges of the longest chain of components above it."""
    comp = components(edges)
    dag = {(comp[a], comp[b]) for a, b in edges if comp[a] != comp[b]}
    above = defaultdict(set)
    for a, b in dag:
        above[b].add(a)
    rank: dict = {}
    while len(rank) < len(set(comp.values())):
        for c in set(comp.values()) - set(rank):
            if all(a in rank for a in above[c]):
                rank[c] = max((rank[a] + 1 for a in above[c]), default=0)
    return rank


def cycles(order: dict, most: int) -> list[list]:
    """Simple cycles by trying every path: those through the least node first, targets as given."""
    out: list[list] = []

    def walk(start, path):
        for t in order[path[-1]]:
            if len(out) >= most:
                return
            if t == start:
                out.append(list(path))
            elif t > start and t in order and t not in path:
                walk(start, [*path, t])

    for start in sorted(order):
        walk(start, [start])
    return out[:most]
