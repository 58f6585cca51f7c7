"""Filter interaction audit: what each filter of a chain removes, in every order.

A document's verdicts are one bit for each filter it fails. Documents are counted
by (part, mask) first, so that whatever follows is as large as the number of
mask cells and not as the table. The cells are unpivoted against the steps of all
orders in long form; a running bit-or over the steps before tells which cells an
order has removed already, conditional sums give the counts of a step, and a
window over the steps of one filter its total over all orders.

Copies of a text are found by hash without joining them with each other: rows
are counted by (hash, cell, id), then by (hash, cell) with the least id, and only
the few rows of a hash, one for each cell that it occurs in, share a window.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import WHITE, word_count

#: The copy filter; the others look at one text alone.
COPY = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of A to D over a text that is not null."""
    words = word_count(text)
    # An edge of white space gives an empty part, which is no word.
    distinct = F.size(F.array_remove(F.array_distinct(F.split(text, WHITE)), ""))
    return {
        "A": words < 200,
        "B": 100 * distinct.cast("bigint") < 50 * words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 3 * F.length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail; bit k is set where the k-th letter of ABCDE fails."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    mask = F.lit(0)
    for k, cond in enumerate(text_filters(text).values()):
        mask = mask.bitwiseOR(F.when(cond, 1 << k).otherwise(0))
    # Null ids match no label; the partition spreads them.
    name = F.col(f"`{id_col}`")
    rows = docs.select(
        name.alias("id"), F.when(name.isNull(), F.spark_partition_id()).otherwise(-1).alias("salt"),
        F.unhex(F.sha2(text, 256)).alias("hash"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), mask.alias("mask"),
    )
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(flags.withColumn("salt", F.lit(-1)), ["id", "salt"], "left")
    cell = ["part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    # The join has dealt rows by (id, salt), so this one moves none.
    each = rows.groupBy("id", "salt", "hash", *cell).agg(F.count("*").alias("n"))
    held = each.groupBy("hash", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("hash"))
    held = held.withColumn("fresh", F.when(first, F.col("at_least")).otherwise(0) + F.col("unnamed"))
    copy = 1 << len(text_filters(text))
    either = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))))
    split = held.select("part", "good", "toxic", either.alias("c")).where("c.n > 0")
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), F.sum(F.col("good") * F.col("c.n")).alias("good"), F.sum(F.col("toxic") * F.col("c.n")).alias("toxic"))


def audit_orders(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order and step of (part, mask, n, good, toxic): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Every permutation of ``letters``, whose k-th letter is bit k of the mask, is
    applied from left to right.
    """
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(letters))))
    long = cells.withColumn("filter_order", orders).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).where("letter <> ''")
    long = long.withColumn("bit", F.expr(f"shiftleft(1, instr('{letters}', letter) - 1)")).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    failing, gone = F.col("fails") != 0, F.col("earlier") != 0

    def total(cond: Column, of: str = "n") -> Column:
        return F.sum(F.when(cond, F.col(of)).otherwise(0)).cast("bigint")

    steps = long.groupBy("part", "filter_order", "letter", F.expr("cast(at + 1 as int)").alias("step")).agg(
        total(~failing & ~gone).alias("kept"), total(failing & ~gone).alias("removed"), total(failing & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(failing & ~gone, "good").alias("good_lost"), total(failing & ~gone, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the filters A to E in all 120 orders.

    A null text counts as empty, a null part as the empty string. Rows that
    repeat count each. A row fails E if a smaller id has its text; a null id is
    neither smaller than another nor larger, and has no label. A document with
    several labels has a flag that any of them sets. Other columns are ignored;
    an empty table gives no row.
    """
    return audit_orders(mask_cells(docs, labels, id_col, text_col, part_col))


#: The same audit in DuckDB, document by document.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM {docs}),
t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM {labels} GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
        CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END ||
        CASE WHEN first_id < t.doc_id THEN 'E' ELSE '' END AS fails
      FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
m AS (SELECT *, contains(fails, x) AS failing, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND before <> '' AND fails <> '' AS gone FROM g, s),
r AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS removed,
        coalesce(sum(n) FILTER (failing AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails,
        coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""
