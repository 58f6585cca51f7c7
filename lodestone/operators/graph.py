"""Graphs as edge tables: components, ranks, bounded cycles and closures.

Paths are shortened before they are walked. A node with one way in and one way
out is spliced out by pointer doubling, so a path or a ring of any length takes
as many rounds as its length has binary digits, and what is left is coloured with
pointers that jump along colours found so far.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written as cut


def _doubled(pointers: DataFrame, most: int | None = None) -> DataFrame:
    """``pointers`` (node, to, far, least, open) followed to their ends.

    ``to`` is a node of the table as long as ``open``. Each round follows every
    pointer as far again as it reached so far; ``far`` adds up and ``least`` is
    the least on the way. With ``most`` nodes in all, what is open once a pointer
    reaches that far is a ring.
    """
    reach = 1
    while not pointers.where("open").isEmpty() and (most is None or reach <= most):
        by = pointers.select(F.col("node").alias("__n"), F.col("to").alias("__to"), F.col("far").alias("__far"), F.col("least").alias("__least"), F.col("open").alias("__open"))
        moved = pointers.where("open").join(by, F.col("to") == F.col("__n")).select("node", F.col("__to").alias("to"), (F.col("far") + F.col("__far")).alias("far"), F.least("least", "__least").alias("least"), F.col("__open").alias("open"))
        pointers = cut(pointers.where("not open").union(moved))
        reach *= 2
    return pointers


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, color): the least node, in an order of hashes, that reaches each node of ``edges`` (src, dst), itself included.

    A colour's own colour reaches all that the colour reaches, so every round
    takes a step along the edges and a jump along the colours; hashes leave no
    long paths of falling labels, over which only steps would help.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = cut(nodes.withColumn("c", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))))
    while True:
        none = F.lit(None).cast(labels.schema["c"].dataType)
        to = labels.select(F.col("node").alias("k"), "c")
        push = edges.join(to, F.col("src") == F.col("k")).select(F.col("dst").alias("node"), "c", none.alias("old"))
        jump = labels.where("c.n <> node").select("node", F.col("c.n").alias("k")).join(to, "k").select("node", "c", none.alias("old"))
        new = cut(labels.select("node", "c", F.col("c").alias("old")).union(push).union(jump).groupBy("node").agg(F.min("c").alias("c"), F.max("old").alias("old")))
        labels = new.select("node", "c")
        if new.where("c < old").isEmpty():
            return labels.select("node", F.col("c.n").alias("color"))


def _contracted(e: DataFrame, degrees: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splice out the nodes with one way in and one way out.

    Returns (edges without them, (node, last) of the spliced nodes, (last, u, w)
    of their chains: from u over the chain to w). A ring of such nodes has no
    last; ``last`` is null then and u its least node.
    """
    mid = degrees.where("ins = 1 and outs = 1").select("node")
    by = lambda name, flag: mid.select(F.col("node").alias(name), F.lit(True).alias(flag))
    marked = cut(e.join(by("src", "sm"), "src", "left").join(by("dst", "dm"), "dst", "left").select("src", "dst", F.coalesce("sm", F.lit(False)).alias("sm"), F.coalesce("dm", F.lit(False)).alias("dm")))
    start = cut(marked.where("sm").select(F.col("src").alias("node"), F.when(F.col("dm"), F.col("dst")).otherwise(F.col("src")).alias("to"), F.lit(1).cast("bigint").alias("far"), F.col("src").alias("least"), F.col("dm").alias("open")))
    pointers = _doubled(start, start.count())
    spliced = pointers.select("node", F.when(~F.col("open"), F.col("to")).alias("last"), "least")
    first = marked.where("dm and not sm").select(F.col("dst").alias("node"), F.col("src").alias("u")).join(spliced, "node").select("last", "u")
    chains = first.join(marked.where("sm and not dm").select(F.col("src").alias("last"), F.col("dst").alias("w")), "last").select("last", "u", "w")
    kept = marked.where("not sm and not dm").select("src", "dst").union(chains.where("u <> w").select("u", "w")).distinct()
    return kept, spliced, chains


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): strongly connected components, named by a member; a node outside every cycle is its own.

    As long as it shrinks the graph much, nodes with nothing before or after them
    go and chains of nodes with one way in and one way out are spliced out: such a
    node is in the component of both ends of its chain or in none. Then rounds of
    colouring: the least node that reaches a node colours it, and the nodes of a
    colour that reach back to its namesake are that node's component. Self-loops
    count as no edge.
    """
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()
    nodes = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    e = cut(e.where("src <> dst"))
    found, levels = [], []
    n = e.count()
    while n:
        while n:
            ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("dst", F.lit(1), F.lit(0)))
            degrees = cut(ends.groupBy("node").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs")))
            rest = e
            if not degrees.where("ins = 1 and outs = 1").isEmpty():
                rest, spliced, chains = _contracted(e, degrees)
                levels.append((cut(spliced.where("last is not null").select("node", "last")), cut(chains)))
                found.append(spliced.where("last is null").select("node", F.col("least").alias("component")))
            live = degrees.where("ins > 0 and outs > 0").select("node")
            e = cut(rest.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
            before, n = n, e.count()
            if 4 * n > 3 * before:
                break
        if not n:
            break
        color = _least_reaching(e)
        tinted = cut(e.join(color.select(F.col("node").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("b")), "dst").where("a = b").select("src", "dst"))
        # The namesake is the least of its colour, so what reaches it has it for its colour backwards too.
        back = _least_reaching(tinted.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        alone = color.where("node = color").select("node", F.col("node").alias("component"))
        settled = cut(back.join(color, ["node", "color"]).select("node", F.col("color").alias("component")).union(alone).distinct())
        found.append(settled)
        e = cut(tinted.join(settled.select(F.col("node").alias("src")), "src", "left_anti").join(settled.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        n = e.count()
    out = cut(reduce(DataFrame.union, found)) if found else None
    for spliced, chains in reversed(levels):
        if out is None:
            same = chains.where("u = w").select("last", F.col("u").alias("component"))
        else:
            of = lambda name, c: out.select(F.col("node").alias(name), F.col("component").alias(c))
            ended = chains.join(of("u", "cu"), "u", "left").join(of("w", "cw"), "w", "left")
            same = ended.select("last", F.coalesce("cu", "u").alias("component"), F.coalesce("cw", "w").alias("cw")).where("component = cw").drop("cw")
        inner = spliced.join(same, "last").select("node", "component")
        out = cut(inner if out is None else out.union(inner))  # each level asks it twice
    if out is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_ranks(edges: DataFrame, components: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, rank): length of the longest chain of components above each one; 0 for those that nothing points at.

    A component with one component above it ranks one behind it, however far
    that is from a component with none or several: pointer doubling finds that one
    and the distance, and longest distances between what is left become the new
    edges. What cannot be shortened so is relaxed from the components that
    changed, in as many rounds as its longest path has edges.
    """
    a = components.select(F.col("node").alias("src"), F.col("component").alias("a"))
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    dag = cut(e.join(a, "src").join(b, "dst").where("a <> b").select("a", "b").distinct().withColumn("far", F.lit(1).cast("bigint")))
    shortened = []
    while True:
        one = cut(dag.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("to"), F.min("far").alias("far")).where("n = 1").select(F.col("b").alias("node"), "to", "far"))
        if one.isEmpty():
            break
        inner = one.join(one.select(F.col("node").alias("to"), F.lit(True).alias("open")), "to", "left").select("node", "to", "far", F.col("node").alias("least"), F.coalesce("open", F.lit(False)).alias("open"))
        pointers = cut(_doubled(cut(inner)).select("node", "to", "far"))
        shortened.append(pointers)
        rest = dag.join(pointers.select(F.col("node").alias("b")), "b", "left_anti").join(pointers.select(F.col("node").alias("a"), "to", F.col("far").alias("more")), "a", "left")
        dag = cut(rest.groupBy(F.coalesce("to", "a").alias("a"), "b").agg(F.max(F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
    ranks = components.select("component").distinct()
    for pointers in shortened:
        ranks = ranks.join(pointers.select(F.col("node").alias("component")), "component", "left_anti")
    ranks = cut(ranks.withColumn("rank", F.lit(0).cast("bigint")))
    front = ranks
    while not dag.isEmpty() and not front.isEmpty():
        push = dag.join(front, F.col("a") == F.col("component")).groupBy(F.col("b").alias("component")).agg(F.max(F.col("rank") + F.col("far")).alias("new"))
        both = cut(ranks.join(push, "component", "left").select("component", F.greatest("rank", "new").alias("rank"), (F.coalesce("new", F.lit(0)) > F.col("rank")).alias("moved")))
        ranks, front = both.select("component", "rank"), both.where("moved").select("component", "rank")
    for pointers in reversed(shortened):
        ranks = cut(ranks.union(pointers.join(ranks.withColumnRenamed("component", "to"), "to").select(F.col("node").alias("component"), F.col("rank") + F.col("far"))))
    return ranks.select("component", F.col("rank").cast("int").alias("rank"))


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", root: str = "root", most: int = 500) -> DataFrame:
    """(root, node): what each root reaches over one edge or more, nearest first; a root visits ``most`` nodes exactly, itself among them, and of equally near ones the lesser."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    front = cut(roots.select(F.col(root).alias("root"), F.col(root).alias("node")).distinct())
    visited, steps = front, []
    # How many nodes a root has visited goes along with its front.
    done = front.withColumn("n", F.lit(1)).select("root", "n")
    while not front.isEmpty():
        step = cut(front.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct())
        steps.append(step)
        new = step.join(visited, ["root", "node"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy("node")))
        front = cut(new.join(done, "root").where(F.col("k") + F.col("n") <= most).select("root", "node", F.max(F.col("k") + F.col("n")).over(Window.partitionBy("root")).alias("n")))
        done = front.select("root", "n").distinct()
        front = front.select("root", "node")
        visited = visited.union(front)
    return reduce(DataFrame.union, steps).distinct() if steps else edges.sparkSession.createDataFrame([], visited.schema)


def closure(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", most: int | None = None, nulls: bool = False) -> DataFrame:
    """(node, hops): the one column of ``seeds`` and all that it reaches, with the least number of edges to each, ``most`` at most; nulls reach nothing, and are reached only with ``nulls``.

    A round steps from the nodes that the last one found, so an edge is taken
    once, and ends when it finds none. Edges are written once for all rounds.
    """
    e = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where(F.col("src").isNotNull() & (F.col("dst").isNotNull() | F.lit(nulls))).distinct())
    front = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).where(F.col("node").isNotNull() | F.lit(nulls)).distinct().withColumn("hops", F.lit(0)))
    found, done = front, 0
    while (most is None or done < most) and not front.isEmpty():
        step = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        front = cut(step.join(found.select(F.col("node").alias("__n")), F.col("node").eqNullSafe(F.col("__n")), "left_anti"))
        found, done = found.union(front), done + 1
    return found


def tangles(order: dict) -> list[list]:
    """Strongly connected components of two nodes or more, by depth-first search without recursion."""
    index: dict = {}
    low: dict = {}
    held: list = []
    inside: set = set()
    out = []
    for root in order:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        held.append(root)
        inside.add(root)
        work = [(root, iter(order[root]))]
        while work:
            node, targets = work[-1]
            for t in targets:
                if t not in order:
                    continue
                if t not in index:
                    index[t] = low[t] = len(index)
                    held.append(t)
                    inside.add(t)
                    work.append((t, iter(order[t])))
                    break
                if t in inside:
                    low[node] = min(low[node], index[t])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(held.pop())
                    inside.difference_update(part)
                    if len(part) > 1:
                        out.append(part)
    return out


def cycles_from(start: object, order: dict, most: int) -> list[list]:
    """Up to ``most`` simple cycles through ``start``, in the order of a depth-first search that tries a node's targets as given.

    A node from which the search did not come back to ``start`` stays blocked
    until a node that it points at is left with success (Johnson, 1975), so between two
    cycles every edge is tried at most twice.
    """
    out: list[list] = []
    path, blocked = [start], {start}
    freed_by: dict = {}
    closed: set = set()
    work = [(start, iter(order[start]))]

    def unblock(node: object) -> None:
        todo = [node]
        while todo:
            x = todo.pop()
            if x in blocked:
                blocked.discard(x)
                todo += freed_by.pop(x, ())

    while work:
        node, targets = work[-1]
        for t in targets:
            if t == start:
                out.append(list(path))
                if len(out) >= most:
                    return out
                closed.update(path)
            elif t in order and t not in blocked:
                path.append(t)
                blocked.add(t)
                closed.discard(t)
                work.append((t, iter(order[t])))
                break
        else:
            work.pop()
            path.pop()
            if node in closed:
                unblock(node)
            else:
                for t in order[node]:
                    if t in order:
                        freed_by.setdefault(t, set()).add(node)
    return out


def simple_cycles(order: dict, most: int) -> list[list]:
    """Up to ``most`` simple cycles of a graph. order: node to its targets, in the order to try them. All cycles through the least node come first, then that node goes.

    Takes time in proportion to nodes and edges for each cycle that is found.
    """
    out: list[list] = []
    left = {k: list(v) for k, v in order.items()}
    while len(out) < most:
        parts = tangles(left)
        if not parts:
            break
        # Only what lies on a cycle can be a start; the least such node is in one of the parts.
        start = min(min(p) for p in parts)
        part = set(next(p for p in parts if start in p))
        out += cycles_from(start, {k: left[k] for k in part}, most - len(out))
        on = {k for p in parts for k in p} - {start}
        left = {k: [t for t in v if t in on] for k, v in left.items() if k in on}
    return out


def bounded_cycles(edges: DataFrame, components: DataFrame, order: str, most: int = 25, shortest: bool = True) -> DataFrame:
    """(component, members, cycle): simple cycles of each component of two nodes or more, as arrays of nodes.

    ``order`` is the column of ``edges`` (src, dst) by which a node's targets are
    tried. With ``shortest`` a component gives only its shortest cycle, the one
    of the least first node among equals. Enumeration stops at ``most`` cycles a
    component and takes at most ``most`` passes over its edges, which are one
    task's.
    """
    kind = edges.schema["src"].dataType.simpleString()
    a = components.select(F.col("node").alias("src"), F.col("component"))
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    inner = edges.select("src", "dst", F.col(order).alias("ord")).join(a, "src").join(b, "dst").where("component = other and src <> dst")
    # Of several edges to a target the first counts.
    inner = inner.groupBy("component", "src", "dst").agg(F.min("ord").alias("ord"))

    def enumerate_cycles(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "ord", "dst"])
        graph: dict = {}
        for s, d in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
            graph.setdefault(s, []).append(d)
        cycles = simple_cycles(graph, most)
        if shortest and cycles:
            cycles = [min(cycles, key=lambda c: (len(c), c[0]))]
        return pd.DataFrame({"component": [pdf["component"].iloc[0]] * len(cycles), "members": [len(graph)] * len(cycles), "cycle": cycles})

    return inner.groupBy("component").applyInPandas(enumerate_cycles, f"component {kind}, members int, cycle array<{kind}>")
