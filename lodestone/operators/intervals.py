"""Interval containment as equality joins over power-of-two cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _shifted(x: Column, k: Column) -> Column:
    """floor(x / 2**k), for negative numbers too."""
    return F.call_function("shiftright", x, k)


def dyadic_cover(start: Column, end: Column, levels: int = 62) -> Column:
    """The fewest cells (level, cell) that together are the whole numbers from ``start`` to ``end``: at most two of a level.

    Cell c of level k holds c * 2**k up to (c + 1) * 2**k - 1. A level gives its
    first cell where that is an odd one, and its last where that is an even one,
    as long as there is something between the ends.
    """

    def cells(k: Column) -> Column:
        low, high = -_shifted(-start, k), _shifted(end + 1, k)
        first = F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), F.struct(k.alias("level"), low.alias("cell")))
        last = F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), F.struct(k.alias("level"), (high - 1).alias("cell")))
        return F.array(first, last)

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), cells))
    return F.filter(every, lambda c: c.isNotNull())


def innermost(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, tie: list[str]) -> DataFrame:
    """``points`` with __span, the innermost span of the same key that holds ``at``: that of the greatest start, then the least end, then the least ``tie``; null where none does.

    Spans are whole numbers, both ends included; one that ends before it starts,
    or has a null end or key, holds nothing. Every span is cut into power-of-two
    cells. All spans of a cell hold the whole cell, so each cell keeps its best
    span before anything is joined, and a point looks up one cell of each level:
    rows grow with points and spans, however many overlap. Until the best is
    known a span is one number, which orders start and end, so that cells go
    through a hash table and are not sorted; the span of the least ``tie`` among
    those of one number, uncut, is looked up last.
    """
    k = [F.col(c) for c in key]
    lo, hi = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    given = spans.where(lo <= hi).dropna(subset=key)
    widest, least, most = given.agg(F.max(hi - lo + 1), F.min(lo), F.max(lo)).first()
    if not widest:
        return points.withColumn("__span", F.lit(None).cast(spans.select(F.struct(*spans.columns)).schema[0].dataType))
    # A greater start is better, then a lesser end; below 2**126, so a decimal holds what a bigint does not.
    number = "bigint" if (max(-least, most, 0) + 1) * widest < 1 << 63 else "decimal(38,0)"
    rank = -lo.cast(number) * F.lit(widest).cast(number) + (hi - lo)
    names = [f"__k{j}" for j in range(len(key))]
    ranked = given.select(F.struct(*spans.columns).alias("span"), lo.alias("lo"), hi.alias("hi"), *(c.alias(n) for c, n in zip(k, names)), rank.alias("rank"), F.struct(*tie).alias("tie"))
    levels = int(widest).bit_length()
    cut = ranked.select(*names, "rank", F.explode(dyadic_cover(F.col("lo"), F.col("hi"), levels - 1)).alias("c"))
    best = cut.groupBy(*names, F.col("c.level").alias("level"), F.col("c.cell").alias("cell")).agg(F.min("rank").alias("rank"))
    where = F.col(at).cast("bigint")
    asked = points.select(where.alias("at"), *(c.alias(n) for c, n in zip(k, names))).where(where.isNotNull()).distinct()
    looks = asked.withColumn("level", F.explode(F.array(*map(F.lit, range(levels))))).withColumn("cell", F.expr("shiftright(at, level)"))
    found = looks.join(best, [*names, "level", "cell"]).groupBy(*names, "at").agg(F.min("rank").alias("rank"))
    held = ranked.groupBy(*names, "rank").agg(F.min_by("span", "tie").alias("__span"))
    told = found.join(held, [*names, "rank"]).drop("rank").withColumnRenamed("at", "__at")
    on = where == F.col("__at")
    for c, n in zip(k, names):
        on = on & (c == F.col(n))
    return points.join(told, on, "left").drop("__at", *names)


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, carry: list[str], bits: int = 16) -> DataFrame:
    """``left`` with ``carry``: those columns of the last row of ``right`` of the same key whose ``at`` is no greater; null where there is none.

    ``at`` is a whole number in both; of rows of ``right`` at one place the one of
    the greatest ``carry`` counts, and null keys equal null keys. Both tables are
    laid into one order and the last value goes along it, by stretches of 2**bits
    numbers, so a key of any size is many tasks' work; what a stretch starts with
    comes from the one row that each stretch before it hands on.
    """
    last = F.struct(*(F.col(c) for c in carry))
    r = right.where(F.col(at).isNotNull()).groupBy(*key, at).agg(F.max(last).alias("__last"))
    rows = left.withColumn("__last", F.lit(None).cast(r.schema["__last"].dataType)).withColumn("__asks", F.lit(True))
    rows = rows.unionByName(r.withColumn("__asks", F.lit(False)), allowMissingColumns=True)
    rows = rows.withColumn("__part", F.call_function("shiftright", F.col(at).cast("bigint"), F.lit(bits)))
    held = r.withColumn("__part", F.call_function("shiftright", F.col(at).cast("bigint"), F.lit(bits))).groupBy(*key, "__part").agg(F.max_by("__last", at).alias("__held"))
    # A stretch with questions and no row of its own takes part in the handing on as well.
    parts = held.unionByName(left.select(*key, F.call_function("shiftright", F.col(at).cast("bigint"), F.lit(bits)).alias("__part")).distinct(), allowMissingColumns=True)
    parts = parts.groupBy(*key, "__part").agg(F.first("__held", ignorenulls=True).alias("__held"))
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    handed = parts.select(*(F.col(k).alias(f"__k{j}") for j, k in enumerate(key)), F.col("__part").alias("__p"), F.last("__held", ignorenulls=True).over(before).alias("__carried"))
    inside = Window.partitionBy(*key, "__part").orderBy(F.col(at), "__asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.withColumn("__last", F.last("__last", ignorenulls=True).over(inside)).where("__asks")
    on = F.col("__part").eqNullSafe(F.col("__p"))
    for j, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{j}"))
    told = told.join(handed, on, "left").withColumn("__last", F.when(F.col(at).isNotNull(), F.coalesce("__last", "__carried")))
    return told.select(*left.columns, *(F.col("__last")[c].alias(c) for c in carry))
