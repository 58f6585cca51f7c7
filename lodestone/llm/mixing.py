"""Mixing sources to target weights by Pareto order sampling.

Everything here is DataFrame functions. A source whose target is r times its
words gives floor(r) certain whole copies of every document. What is left, R
words, is drawn: a document of s words has the inclusion probability p = c * s,
where c is the number at which the expected words are R; documents whose p would
reach 1 are certain too and c is found for the rest. Documents are ranked by
random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the
first of them are selected until their words come nearest to what is left, so
the size of the sample is fixed in words. ``u`` is a hash of the document, so
reruns agree.

No source is ordered in one task: ranks are cut into bins, words are summed by
(source, bin), the bin that holds the boundary is found from those sums, and only
inside it are distinct ranks summed and compared. Inclusion probabilities come
from the words by (source, size), one row for each size that occurs. Sources
themselves, one row each, are put in order in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = "[\\x20\\x09-\\x0D]+"
#: Above this many sources the targets are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000
BIN_BITS = 12
U_BITS = 48


def word_count(text: Column) -> Column:
    """Number of runs of visible characters; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), WHITE)
    edges = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - edges).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn. A target stops
    at ``most`` times its source's size; the excess is reshared by weight until
    none is above. In order of size over weight the capped sources come first,
    so one running sum finds where the caps end.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cases = F.lit(weights[-1])
    for k, w in enumerate(weights[:-1]):
        cases = F.when(F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) == k, w).otherwise(cases)
    s = sizes.withColumn("w", cases.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "source", "source_size", "w", "cap",
        (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        F.sum("w").over(rest).alias("rest"),
    )
    s = s.withColumn("level", F.col("left") / F.col("rest")).withColumn("capped", F.col("w") * F.col("level") > F.col("cap")).withColumn("n", F.row_number().over(order))
    s = s.withColumn("open", F.min(F.when(~F.col("capped"), F.struct("n", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * F.col("open")).alias("target"))


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, as an integer up to 2**U_BITS in the same order; null where the probability is 0 or 1."""
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when((p > 0) & (p < 1), F.floor(q / (1 + q) * float(1 << U_BITS)).cast("bigint"))


def inclusion(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, top, slope, rest): documents of more than ``top`` words are certain, others have p = slope * size; ``rest`` is the words left to draw.

    rows: (source, size); targets: (source, remainder). From the greatest size
    down, the first at which slope * size stays below 1 with all greater ones
    certain. Where there is none every document is certain and the row is missing.
    """
    wide = F.col("size").cast("decimal(18,0)")
    n = rows.where("size > 0").groupBy("source", "size").agg(F.sum("size").alias("words"), F.sum(wide * wide).alias("square"))
    t = targets.select(F.col("source").alias("s"), "remainder")
    n = n.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    above = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = n.select("source", "size", (F.col("remainder") - F.coalesce(F.sum("words").over(above), F.lit(0))).alias("rest"), F.sum("square").over(upto).cast("double").alias("squares"))
    n = n.withColumn("slope", F.col("rest") / F.col("squares")).where(F.col("slope") * F.col("size") < 1)
    return n.groupBy("source").agg(F.max(F.struct("size", "slope", "rest")).alias("m")).select("source", F.col("m.size").alias("top"), "m.slope", "m.rest")


def boundary(ranked: DataFrame, bins: int = 1 << BIN_BITS) -> DataFrame:
    """(source, cutoff): of (source, key, size, remainder) the last ``key`` that is selected.

    key: an integer below 2**U_BITS in rank order. The cutoff is the key at which
    the words selected so far come nearest to the remainder (the lower of two
    equally near); -1 selects nothing.
    """
    shift = U_BITS - BIN_BITS
    summed = ranked.groupBy("source", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("words"), F.max("remainder").alias("remainder"))
    w = Window.partitionBy("source").orderBy("bin")
    bound = summed.withColumn("upto", F.sum("words").over(w)).where(F.col("upto") >= F.col("remainder"))
    first = bound.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("base"))).alias("b")).select("source", "b.bin", "b.base")
    first = first.select(F.col("source").alias("s"), F.col("bin").alias("b"), "base")
    near = ranked.join(first, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("key", shift) == F.col("b"))).select("source", "key", "size", "remainder", "base", F.col("b").alias("bin"))
    keys = near.groupBy("source", "key").agg(F.sum("size").alias("words"), F.max("remainder").alias("remainder"), F.max("base").alias("base"), F.max("bin").alias("bin"))
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("key"))
    # Selecting nothing of the bin is one of the choices.
    choices = keys.select("source", "key", F.abs(upto - F.col("remainder")).alias("off")).union(keys.select("source", (F.shiftleft("bin", shift) - 1).alias("key"), F.abs(F.col("base") - F.col("remainder")).alias("off")))
    return choices.groupBy("source").agg(F.min_by("key", F.struct("off", "key")).alias("cutoff"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, p, copies, taken: how often each row of ``docs`` is taken; p is the inclusion probability of the copy that is drawn.

    A null text has size 0 and a document of size 0 takes 0 words; the null
    source is a source of its own, last in order. Rows equal in id and text have
    the same rank and are taken or left together. An empty table gives an empty
    result. Other columns are ignored.
    """
    name, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), name.cast("string"), text)), 1, U_BITS // 4), 16, 10).cast("bigint")
    rows = cut(docs.select(name.alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), key.alias("key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    targets = cut(targets.withColumn("certain", F.floor(ratio)).withColumn("remainder", F.col("target") - F.col("certain") * F.col("source_size")))
    small = targets.count() <= BROADCAST_SOURCES
    hint = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    drawn = inclusion(rows, targets).withColumnRenamed("source", "i")
    t = cut(targets.join(drawn, F.col("source").eqNullSafe(F.col("i")), "left").drop("i", "remainder").withColumnRenamed("source", "s"))
    joined = rows.join(hint(t), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    p = F.when(F.col("size") > F.coalesce("top", F.lit(0)), 1.0).otherwise(F.col("slope") * F.col("size"))
    ranked = joined.withColumn("p", F.when(F.col("size") > 0, p).otherwise(0.0)).withColumn("rank", pareto_rank((F.col("key") + 0.5) / float(1 << U_BITS), F.col("p")))
    cuts = boundary(ranked.where("rank is not null").select("source", F.col("rank").alias("key"), "size", F.col("rest").alias("remainder"))).withColumnRenamed("source", "s")
    out = ranked.join(hint(cuts), F.col("source").eqNullSafe(F.col("s")), "left")
    more = (F.col("p") >= 1) | F.coalesce(F.col("rank") <= F.col("cutoff"), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("certain") + more.cast("bigint")).otherwise(F.lit(0)).cast("bigint")
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "p", "copies", (F.col("size") * F.col("copies")).alias("taken"))


#: The same mix in DuckDB: capped targets by one running sum, inclusion odds by size, then the nearest cut of the rank order of each source.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR), text)), 1, 12) AS BIGINT) AS key
  FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM s),
o AS (SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS n FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
                sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN w * level > cap THEN cap ELSE w * (SELECT arg_min(level, n) FROM l WHERE NOT w * level > cap) END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0 END AS ratio FROM t),
j AS (SELECT d.*, source_size, target, floor(ratio) AS certain, target - floor(ratio) * source_size AS remainder
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
z AS (SELECT source, size, max(remainder) AS remainder, sum(size) AS words, sum(CAST(size AS HUGEINT) * size) AS square FROM j WHERE size > 0 GROUP BY source, size),
y AS (SELECT source, size, remainder - coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             CAST(sum(square) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS squares FROM z),
i AS (SELECT source, max(size) AS top, arg_max(rest / squares, size) AS slope, arg_max(rest, size) AS rest FROM y WHERE rest / squares * size < 1 GROUP BY source),
pr AS (SELECT j.*, rest, CASE WHEN size = 0 THEN 0 WHEN size > coalesce(top, 0) THEN 1 ELSE slope * size END AS p, (key + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
      FROM j LEFT JOIN i ON j.source IS NOT DISTINCT FROM i.source),
q AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM pr),
k AS (SELECT *, CAST(floor(odds / (1 + odds) * 281474976710656.0::DOUBLE) AS BIGINT) AS rank FROM q),
g AS (SELECT source, rank, sum(size) AS words, max(rest) AS rest FROM k WHERE rank IS NOT NULL GROUP BY source, rank),
up AS (SELECT source, rank, rest, sum(words) OVER (PARTITION BY source ORDER BY rank) AS upto FROM g),
c AS (SELECT source, arg_min(rank, (off, rank)) AS cutoff FROM (
        SELECT source, rank, abs(upto - rest) AS off FROM up UNION ALL SELECT source, -1, rest FROM up) GROUP BY source)
SELECT doc_id, size, k.source_size, k.target,
       CAST(CASE WHEN size > 0 THEN size * (certain + CASE WHEN p >= 1 OR rank <= cutoff THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM k LEFT JOIN c ON k.source IS NOT DISTINCT FROM c.source
"""
