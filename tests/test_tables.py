"""Operators over tables against plain versions on random input."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions.columns import glob_regex
from lodestone.operators import clones, graph, intervals, ngram
from lodestone.operators import globs as globs_op

from . import plain


def test_dyadic_cover(spark):
    rng = random.Random(1)
    rows = [(a, a + rng.randrange(0, 300)) for a in (rng.randrange(-400, 400) for _ in range(200))] + [(-1, 0), (0, 0), (-8, 7), (7, 7), (-(1 << 40), 1 << 40)]
    for r in spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", intervals.dyadic_cover(F.col("a"), F.col("b")).alias("c")).collect():
        pieces = sorted((c.cell << c.level, (c.cell + 1 << c.level) - 1) for c in r.c)
        assert pieces[0][0] == r.a and pieces[-1][1] == r.b and all(x[1] + 1 == y[0] for x, y in zip(pieces, pieces[1:]))
        assert len(r.c) <= 2 * max(1, (r.b - r.a + 1).bit_length())


def test_innermost_span(spark):
    rng = random.Random(2)
    spans = [(rng.choice("abc"), s, s + rng.choice([-1, 0, 3, 30, 300]), k) for k, s in enumerate(rng.randrange(-200, 200) for _ in range(120))]
    spans += [("a", -500, 500, 900), ("a", -500, 500, 901), (None, 0, 9, 902), ("b", None, 9, 903), ("b", 3, None, 904)]
    points = [(k, rng.choice(["a", "b", "c", "d", None]), rng.randrange(-250, 550)) for k in range(400)] + [(400, "a", None), (401, "a", 5), (401, "a", 5)]
    s = spark.createDataFrame(spans, "k string, lo bigint, hi bigint, id int")
    p = spark.createDataFrame(points, "id int, k string, at int")
    got = intervals.innermost(p, s, ["k"], "at", "lo", "hi", ["id"])

    def want(k, at):
        inside = [(-lo, hi, i) for kk, lo, hi, i in spans if None not in (kk, lo, hi, k, at) and kk == k and lo <= at <= hi]
        return min(inside)[2] if inside else None

    assert sorted((r.id, r["__span"].id if r["__span"] else None) for r in got.select("id", "__span").collect()) == sorted((i, want(k, at)) for i, k, at in points)
    assert got.count() == len(points)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.innermost(p, s.where("false"), ["k"], "at", "lo", "hi", ["id"]).where("__span is null").count() == len(points)


def test_cells_of_spans_are_never_sorted(spark):
    """A span is many cells, so they go through a hash table; spans too wide or far off for one bigint take the same way."""
    rng = random.Random(7)
    far = 1 << 60
    for starts, widths in (((0, 300), (0, 3, 40)), ((-far, 0, 1 << 40), (0, 5, 1 << 20, 1 << 40, far))):
        spans = [(rng.choice("ab"), s, s + rng.choice(widths), k) for k, s in enumerate(rng.choice(starts) + rng.randrange(-30, 30) for _ in range(80))]
        spans += [(k, lo, hi, i + 1000) for k, lo, hi, i in spans[::2]] + [(k, lo, hi, -1 - i) for k, lo, hi, i in spans[::3]]
        points = [(k, rng.choice("abc"), rng.choice(starts) + rng.randrange(-60, 400)) for k in range(150)]
        s = spark.createDataFrame(spans, "k string, lo bigint, hi bigint, id int")
        got = intervals.innermost(spark.createDataFrame(points, "id int, k string, at bigint"), s, ["k"], "at", "lo", "hi", ["id"])
        plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
        cut = [k for k, line in enumerate(plan) if "Generate explode(filter(" in line]
        above = [next(line for line in reversed(plan[:k]) if "Aggregate" in line or "Sort" in line) for k in cut]
        assert cut and all("HashAggregate" in line for line in above), above
        inside = [[(-lo, hi, i) for kk, lo, hi, i in spans if kk == k and lo <= at <= hi] for _, k, at in points]
        assert sorted((r.id, r["__span"].id if r["__span"] else None) for r in got.collect()) == [(p[0], min(c)[2] if c else None) for p, c in zip(points, inside)]


def token_rows(streams):
    return [(s, k, t, line, "statement" if stated else "expression") for s, toks in streams.items() for k, (t, line, stated) in enumerate(toks)]


def random_streams(rng, alphabet, count, block):
    """Streams of copied, changed and repeated blocks."""
    blocks = [[rng.choice(alphabet) for _ in range(rng.randrange(block // 2, block * 2))] for _ in range(3)]
    out = {}
    for s in range(count):
        toks = []
        for _ in range(rng.randrange(0, 5)):
            b = list(rng.choice(blocks))
            if rng.random() < 0.4:
                b[rng.randrange(len(b))] = "changed"
            toks += b + [f"own{rng.random()}"] * rng.randrange(0, 2)
        out[s] = [(t, 1 + k // 4, rng.random() < 0.3) for k, t in enumerate(toks)]
    return out


@pytest.mark.parametrize(("seed", "alphabet", "size", "lines", "strict"), [(1, "abcdefghijklmnop", 6, 2, True), (2, "abcdefghijklmnop", 7, 3, False), (3, "ab", 5, 1, True), (4, "abc", 8, 2, False), (5, "abcdefghijklmnop", 1, 1, True)])
def test_clones_are_those_of_taking_pairs_one_by_one(spark, seed, alphabet, size, lines, strict):
    rng = random.Random(seed)
    streams = random_streams(rng, alphabet, 8, 12)
    want = {(n, tuple(places)) for n, places in plain.tile(streams, size, lines, strict, 2, 20)}
    df = spark.createDataFrame(token_rows(streams), "file_id int, seq int, text string, line int, nesting string").repartition(3)
    got = {}
    for r in clones.clones(df, size, lines, strict, 2, 20).collect():
        assert (r.start_line, r.end_line) == (streams[r.file_id][r["at"]][1], streams[r.file_id][r["at"] + r.length - 1][1])
        got.setdefault((r.length, tuple(r.clone)), []).append((r.file_id, r["at"]))
    assert {(n, tuple(sorted(p))) for (n, _), p in got.items()} == want and len(got) == len(want)


@pytest.mark.parametrize(("seed", "alphabet", "size", "high"), [(1, "abcdefghijklmnop", 6, 20), (3, "ab", 5, 9), (4, "abc", 8, 4)])
def test_stretches_hold_the_pairs_and_tile_alike(spark, seed, alphabet, size, high):
    """A row for each run of pairs, not for each pair, and the same clones; windows beyond the band break runs."""
    streams = random_streams(random.Random(seed), alphabet, 8, 12)
    df = spark.createDataFrame([(s, [t[0] for t in toks]) for s, toks in streams.items()], "s int, t array<string>").repartition(3)
    found = ngram.repeating(df, "s", F.col("t"), size).cache()
    pairs = clones.maximal_pairs(clones.window_pairs(ngram.windows(df, "s", "t", size), "s", 2, high), df, "s", "t", size)
    runs = clones.stretches(found, df, "s", "t", size, 2, high).cache()
    want = sorted(map(tuple, pairs.collect()))
    assert sorted(map(tuple, clones.unfolded(runs).collect())) == want and runs.count() < len(want)
    got = {}
    for r in clones.tile(runs).collect():
        got.setdefault((r.length, tuple(r.clone)), []).append((r.s, r["at"]))
    assert sorted((n, tuple(sorted(p))) for (n, _), p in got.items()) == sorted((n, tuple(p)) for n, p in plain.tile(streams, size, 1, True, 2, high))


@pytest.mark.parametrize("size", [1, 5, 50])
def test_repeating_windows_lack_none_that_occurs_twice(spark, size):
    rng = random.Random(size)
    copied = [rng.choice("abcdefgh") for _ in range(120)]
    rows = [(s, None if s == 5 else [rng.choice("abcdefgh") for _ in range(n)] + copied[:m]) for s, (n, m) in enumerate([(0, 0), (0, 1), (400, 90), (300, 120), (0, 0), (0, 0), (900, 0), (30, 51)])]
    df = spark.createDataFrame(rows, "s int, t array<string>").repartition(2)
    seen = {}
    for s, t in rows:
        for k in range(len(t or []) - size + 1):
            seen.setdefault(tuple(t[k : k + size]), []).append((s, k))
    got = ngram.repeating(df, "s", F.col("t"), size).collect()
    places = [(r.s, r["at"]) for r in got]
    assert len(places) == len(set(places)) and set(places) >= {p for v in seen.values() if len(v) > 1 for p in v}
    assert size < 50 or len(places) < sum(map(len, seen.values())) / 2
    keys = {}
    for r in got:
        keys.setdefault(tuple(rows[r.s][1][r["at"] : r["at"] + size]), set()).add(tuple(r.key))
    assert all(len(v) == 1 for v in keys.values()) and len({next(iter(v)) for v in keys.values()}) == len(keys)


def test_common_prefix(spark):
    rng = random.Random(7)
    base = [rng.choice("ab") for _ in range(300)]
    streams = {0: base, 1: base[:250] + ["x"] + base[251:], 2: ["a"] * 200, 3: [], 4: ["a"]}
    asked = [(0, k, 1, k) for k in range(0, 301, 7)] + [(2, 0, 2, 1), (2, 5, 2, 190), (3, 0, 4, 0), (4, 0, 4, 1), (2, 0, 4, 0)]
    df = spark.createDataFrame([(k, v) for k, v in streams.items()], "s int, t array<string>")
    got = clones.common_prefix(spark.createDataFrame(asked, "sa int, a int, sb int, b int"), df, "s", "t").collect()

    def lcp(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    assert {tuple(r) for r in got} == {(sa, a, sb, b, lcp(streams[sa][a:], streams[sb][b:])) for sa, a, sb, b in asked}


@pytest.mark.parametrize("size", [1, 2, 5, 8, 50])
def test_windows_are_the_runs(spark, size):
    rng = random.Random(size)
    rows = [(s, [rng.choice("ab") for _ in range(n)], [rng.random() < 0.05 for _ in range(n)]) for s, n in enumerate([0, 1, size - 1, size, size + 1, 150, 150])]
    df = spark.createDataFrame(rows, "s int, t array<string>, f array<boolean>")
    for flag in (None, "f"):
        want = {(s, k, tuple(t[k : k + size])) for s, t, f in rows for k in range(len(t) - size + 1) if flag is None or any(f[k : k + size])}
        got = ngram.windows(df, "s", "t", size, flag).collect()
        keys = {}
        for r in got:
            keys.setdefault(tuple(rows[r.s][1][r["at"] : r["at"] + size]), set()).add(tuple(r.key))
        assert sorted((r.s, r["at"]) for r in got) == sorted((s, k) for s, k, _ in want)
        assert all(len(v) == 1 for v in keys.values()) and len({next(iter(v)) for v in keys.values()}) == len(keys)


def shaped(rng, kind):
    """Edges of graphs that contraction, trimming and colouring meet: paths, rings, trees, tangles joined by chains."""
    if kind == "sparse":
        return [(rng.randrange(60), rng.randrange(60)) for _ in range(70)]
    if kind == "dense":
        return [(rng.randrange(30), rng.randrange(30)) for _ in range(140)]
    if kind == "rings":
        e = [(k, k + 1) for k in range(0, 40)] + [(40, 0)] + [(50 + k, 50 + (k + 1) % 7) for k in range(7)] + [(3, 50), (70, 71), (71, 70), (80, 80)]
        return e + [(90 + k, 91 + k) for k in range(9)] + [(99, 90), (92, 96), (12, 12)]
    if kind == "tree":
        return [(rng.randrange(k), k) for k in range(1, 80)] + [(79, 0)] * (rng.random() < 0.5)
    e = [(k, k + 1) for k in range(100)] + [(k + 200, k + 201) for k in range(30)]
    return e + [(rng.randrange(100), rng.randrange(100)) for _ in range(6)] + [(100, 200), (230, rng.randrange(100)), (50, 300), (300, 301), (400, 20)]


@pytest.mark.parametrize(("kind", "seed"), [("sparse", 1), ("dense", 3), ("rings", 4), ("tree", 5), ("chains", 6)])
def test_components_and_ranks(spark, kind, seed):
    edges = shaped(random.Random(seed), kind)
    df = spark.createDataFrame(edges + edges[:3] + [(None, 1), (2, None)], "src int, dst int").repartition(3)
    found = graph.strong_components(df).collect()
    want = plain.components(edges)
    least = {}
    for r in found:
        least[r.component] = min(least.get(r.component, r.node), r.node)
    assert len(found) == len(want) and {r.node: least[r.component] for r in found} == want
    named = spark.createDataFrame([(n, c) for n, c in want.items()], "node int, component int")
    got = graph.component_ranks(df.dropna(), named).collect()
    assert {r.component: r["rank"] for r in got} == plain.ranks(edges) and len(got) == len(set(want.values()))


def test_long_paths_take_few_rounds(spark, monkeypatch):
    """A path, a ring and a comb of 100,000 nodes."""
    n = 100_000
    ids = spark.range(n)
    shuffled = (F.col("id") * 7_919) % n
    path = ids.where(f"id < {n - 1}").select(shuffled.alias("src"), ((F.col("id") + 1) * 7_919 % n).alias("dst"))
    ring = ids.select(shuffled.alias("src"), ((F.col("id") + 1) * 7_919 % n).alias("dst"))
    rounds = []
    kept = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or kept(df))
    assert graph.strong_components(path).select("component").distinct().count() == n and len(rounds) < 40
    rounds.clear()
    assert graph.strong_components(ring).select("component").distinct().count() == 1 and len(rounds) < 40
    rounds.clear()
    ranks = graph.component_ranks(path, ids.select(F.col("id").alias("node"), F.col("id").alias("component")))
    assert ranks.agg(F.max("rank"), F.count_distinct("rank")).first() == (n - 1, n) and len(rounds) < 40


def test_cycles_are_those_of_every_path():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(2, 9)
        order = {k: rng.sample([j for j in range(n) if j != k], rng.randrange(0, min(4, n))) for k in range(n)}
        most = rng.choice([1, 3, 25, 10_000])
        assert graph.simple_cycles(order, most) == plain.cycles(order, most)


def test_ladder_of_many_paths_stays_fast():
    """Every rung doubles the paths; most of them lead nowhere."""
    n = 5_000
    order = {2 * k + s: [2 * k + 2, 2 * k + 3] for k in range(n - 1) for s in (0, 1)} | {2 * n - 2: [0], 2 * n - 1: []}
    began = time.perf_counter()
    got = graph.simple_cycles(order, 25)
    assert len(got) == 25 and len({tuple(c) for c in got}) == 25 and all(len(c) == n for c in got)
    # No way back to the start from the side that the search tries first.
    dead = {0: [1, 10_000]} | {k: [min(2 * (k // 2) + 2, 9_998), min(2 * (k // 2) + 3, 9_999)] for k in range(1, 9_998)} | {9_998: [9_999], 9_999: [9_998], 10_000: [0, 1]}
    assert graph.simple_cycles(dead, 25) == [[0, 10_000], [9_998, 9_999]]
    assert time.perf_counter() - began < 20


def test_as_of(spark):
    rng = random.Random(11)
    right = [(rng.choice("ab"), rng.randrange(-300, 300), k) for k in range(60)] + [(None, 5, 900), ("a", None, 901)]
    left = [(k, rng.choice(["a", "b", "c", None]), rng.randrange(-400, 400)) for k in range(300)] + [(300, "a", None), (5, "a", 3), (5, "a", 3)]
    got = intervals.as_of(spark.createDataFrame(left, "id int, k string, at bigint").repartition(3), spark.createDataFrame(right, "k string, at bigint, v int"), ["k"], "at", ["v"], bits=4)

    def want(k, at):
        held = [(x, v) for kk, x, v in right if at is not None and x is not None and kk == k and x <= at]
        return max(held)[1] if held else None

    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, k, at, want(k, at))) for i, k, at in left)


def test_globs(spark):
    rng = random.Random(12)
    parts = ["a", "ab", "test_", "x.y", "src", "(z)", "b+", "é"]
    names = sorted({"/".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(1, 4))) for _ in range(200)}) + ["", "a\nb"]
    globs = sorted({"".join(rng.choice([*parts, "*", "**/", "**", "?", "/", "src/"]) for _ in range(rng.randrange(1, 6))) for _ in range(300)}) + ["*", "**", "", "?", "a*b"]
    n = spark.createDataFrame([(x,) for x in [*names, None, names[0]]], "n string")
    g = spark.createDataFrame([(x,) for x in [*globs, None, globs[0]]], "g string")
    for crossing in (True, False):
        got = globs_op.matching(n, "n", g, "g", crossing)
        want = {(x, p) for x in names for p in globs if re.search(glob_regex(p, crossing).replace("^", "\\A", 1)[:-1] + "\\Z", x, re.S)}
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert not globs_op.matching(n, "n", g.where("false"), "g").count()


def test_closure_gives_least_hops(spark):
    rng = random.Random(13)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(110)] + [(None, 3), (3, None), (200, 201), (201, 200)]
    hops, front = {0: 0, 5: 0, 300: 0}, [0, 5]
    while front:
        front = sorted({b for a, b in edges if a in front and b is not None} - set(hops))
        hops |= dict.fromkeys(front, max(hops.values()) + 1)
    seeds = spark.createDataFrame([(0,), (5,), (5,), (300,), (None,)], "s int")
    got = graph.closure(spark.createDataFrame(edges, "src int, dst int"), seeds).collect()
    assert {r.node: r.hops for r in got} == hops and len(got) == len(hops)
