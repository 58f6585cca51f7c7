"""Joins that anti, semi, prefix, suffix and interval conditions turn into.

Prefix and suffix conditions are rewritten by exploding the parts of a name, so
each of them is a hash or merge join on equality and never compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

from ..functions.columns import prefixes, suffixes


def without_match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` that ``right`` does not name; null keys equal null keys."""
    return _null_safe(left, right, on, "left_anti")


def with_match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return _null_safe(left, right, on, "left_semi")


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    keys = right.select(*(F.col(k).alias(f"__{k}") for k in on)).distinct()
    cond = None
    for k in on:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        cond = c if cond is None else cond & c
    return left.join(keys, cond, how)


def seen_elsewhere(rows: DataFrame, key: list[str] | str, site: str) -> DataFrame:
    """(key, least, greatest) of the sites that use a key.

    Some site other than x uses the key exactly if the least or the greatest
    differs from x, so excluding oneself takes two values instead of a join of
    all users of a key with each other.
    """
    key = [key] if isinstance(key, str) else key
    return rows.groupBy(*key).agg(F.min(site).alias("least"), F.max(site).alias("greatest"))


def unreferenced_elsewhere(defs: DataFrame, refs: DataFrame, key: str, site: str) -> DataFrame:
    """Definitions whose key no other site uses."""
    sites = seen_elsewhere(refs, key, site)
    return defs.join(sites, key, "left").where(F.col("least").isNull() | (F.col("least") == F.col(site)) & (F.col("greatest") == F.col(site))).drop("least", "greatest")


def named(members: DataFrame, name: str, names: DataFrame, heads: DataFrame | None = None, shortest: int = 1) -> DataFrame:
    """``members`` with __named: whether ``names`` (one column) holds the name or ``heads`` (one column) holds a beginning of it."""
    exact = names.select(F.col(names.columns[0]).alias("__k")).distinct().withColumn("__exact", F.lit(True))
    out = members.join(exact, F.col(name) == F.col("__k"), "left").drop("__k")
    flag = F.coalesce("__exact", F.lit(False))
    if heads is not None:
        keys = members.select(name).distinct()
        size = F.length(name)
        at = F.when(size >= shortest, F.sequence(F.lit(shortest), size))
        tried = keys.select(F.col(name).alias("__n"), F.explode(F.transform(at, lambda k: F.substring(F.col(name), F.lit(1), k))).alias("__h"))
        hit = tried.join(heads.select(F.col(heads.columns[0]).alias("__h")).distinct(), "__h").select("__n").distinct().withColumn("__head", F.lit(True))
        out = out.join(hit, F.col(name) == F.col("__n"), "left").drop("__n")
        flag = flag | F.coalesce("__head", F.lit(False))
        return out.withColumn("__named", flag).drop("__exact", "__head")
    return out.withColumn("__named", flag).drop("__exact")


def covered_by(df: DataFrame, name: str, table: DataFrame, prefix: str) -> DataFrame:
    """Pairs of a row and a table row whose prefix covers the name."""
    keys = df.select(name).where(F.col(name).isNotNull()).distinct()
    tried = keys.select(F.col(name).alias("__n"), F.explode(prefixes(F.col(name))).alias("__p"))
    hits = tried.join(table.withColumn("__p", F.col(prefix)), "__p").drop("__p")
    return df.join(hits, F.col(name) == F.col("__n")).drop("__n")


def files_ending_with(files: DataFrame, path: str, endings: DataFrame, ending: str, most: int | None = None) -> DataFrame:
    """(files..., ending) for paths that are the ending or end with ``/`` and it; endings that fit more than ``most`` files are dropped whole."""
    tried = files.withColumn("__s", F.explode(suffixes(F.col(path))))
    hits = tried.join(endings.select(F.col(ending).alias("__s")).distinct(), "__s").withColumnRenamed("__s", ending)
    if most is None:
        return hits
    few = hits.groupBy(ending).count().where(F.col("count") <= most).select(ending)
    return hits.join(few, ending, "left_semi")


def longest_prefix(df: DataFrame, path: str, scopes: DataFrame, directory: str, sep: str = "/") -> DataFrame:
    """Each row with its deepest scope, the last scope of equally deep ones; scope columns are null where none contains the path. The empty directory contains every path."""
    keys = df.select(path).distinct()
    above = F.concat(F.array(F.lit("")), prefixes(F.col(path), sep))
    tried = keys.select(F.col(path).alias("__n"), F.explode(above).alias("__d"))
    order = F.struct(F.length("__d").alias("len"), *([F.col("scope_id")] if "scope_id" in scopes.columns else []))
    hits = tried.join(scopes.withColumn("__d", F.col(directory)), "__d")
    best = hits.groupBy("__n").agg(F.max_by(F.struct(*scopes.columns), order).alias("__s")).select("__n", "__s.*")
    return df.join(best, F.col(path) == F.col("__n"), "left").drop("__n")


def first_match(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule whose condition holds."""
    out = F.lit(otherwise).cast("string")
    for name, cond in reversed(rules):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def layer_ranks(modules: DataFrame, module: str, layers: DataFrame) -> DataFrame:
    """(module, rank): the first rank, not the most specific prefix, that covers the module. layers: rank, prefix."""
    return covered_by(modules.select(module).distinct(), module, layers, "prefix").groupBy(module).agg(F.min("rank").alias("rank"))


def layer_violations(edges: DataFrame, layers: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges from a lower layer up to a higher one, with both ranks."""
    names = edges.select(F.col(src).alias("m")).union(edges.select(F.col(dst))).distinct()
    ranks = layer_ranks(names, "m", layers)
    a, b = ranks.select(F.col("m").alias(src), F.col("rank").alias("from_rank")), ranks.select(F.col("m").alias(dst), F.col("rank").alias("to_rank"))
    return edges.join(a, src).join(b, dst).where("to_rank < from_rank")


def denied(edges: DataFrame, deny: DataFrame, allow: DataFrame, key: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges that a rule denies: the first rule, then its first denied prefix. deny: rule, from, deny_pos, deny; allow: rule, allow."""
    starts = covered_by(edges, src, deny.select("rule", "from", "deny_pos", "deny"), "from")
    tried = covered_by(starts, dst, deny.select(F.col("deny").alias("__deny")).distinct(), "__deny").where(F.col("__deny") == F.col("deny")).drop("__deny")
    waived = covered_by(edges.select(dst).distinct(), dst, allow, "allow").select(dst, "rule").distinct()
    left = tried.join(waived, [dst, "rule"], "left_anti")
    w = Window.partitionBy(*key).orderBy("rule", "deny_pos")
    return left.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def reconcile(declared: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    """(on..., status): ``unused`` if only declared, ``undeclared`` if only used, else ``matched``; once per key."""
    both = declared.select(*on, F.lit(True).alias("d")).union(used.select(*on, F.lit(False)))
    return reconciled(both, F.col("d"), ~F.col("d"), on)


def reconciled(rows: DataFrame, declares: Column, uses: Column, on: list[str]) -> DataFrame:
    """``reconcile`` of rows of one table, which is read once: those that declare their key and those that use it."""
    agg = rows.groupBy(*on).agg(F.max(declares).alias("d"), F.max(uses).alias("u"))
    return agg.select(*on, F.when(~F.col("u"), "unused").when(~F.col("d"), "undeclared").otherwise("matched").alias("status"))


def outermost(df: DataFrame, group: list[str], start: str, end: str, tie: list[str]) -> DataFrame:
    """``df`` with __enclosed: whether an earlier span of the group, in order of start, ends no sooner."""
    w = Window.partitionBy(*group).orderBy(F.col(start), *(F.col(t) for t in tie)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__enclosed", F.coalesce(F.max(end).over(w) >= F.col(end), F.lit(False)))


def new_since(now: DataFrame, before: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key, nulls included, the baseline does not hold."""
    return without_match(now, before, on)


def touching(df: DataFrame, path: str, chain: str | None, changed: DataFrame, on: str) -> DataFrame:
    """Rows whose own path, or any path of their chain (an array), is among the changed ones."""
    every = F.array(path) if chain is None else F.array_distinct(F.concat(F.array(path), F.coalesce(chain, F.expr("cast(array() as array<string>)"))))
    keyed = cut(df.withColumn("__id", F.monotonically_increasing_id()))
    hit = keyed.select("__id", F.explode(every).alias("__p")).join(changed.select(F.col(on).alias("__p")).distinct(), "__p", "left_semi").select("__id").distinct()
    return keyed.join(hit, "__id", "left_semi").drop("__id")
