"""Benchmark decontamination: words of documents that lie in a benchmark n-gram.

Everything here is DataFrame functions. The benchmark's windows of n words are a
small table of a checked size. Each window has one anchor, its longest word
(ties: the lesser); a document's words are scanned for anchors with a hash set,
and only the windows around an anchor are written out and joined, by their full
text, with the broadcast windows. Every window holds its anchor, so none is
missed; equality of the text is the verification. A benchmark over the bound
takes another way: all windows of all documents are shuffled and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed import numbered
from .store import cut

#: Everything that is no word once A-Z are lower case: ASCII but digits and a-z.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of what is broadcast: windows, and anchors in the hash set.
MAX_WINDOWS = 500_000
MAX_ANCHORS = 20_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 8) -> DataFrame:
    """(item, k, win, anchor): distinct windows of n words; an item of fewer words, but not none, is one window of k words."""
    w = bench.select(F.col(f"`{id_col}`").alias("item"), words(F.col(f"`{text_col}`")).alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(n))
    at = w.select("item", "w", k.alias("k"), F.explode(F.sequence(F.lit(1), F.size("w") - k + 1)).alias("s"))
    part = F.slice("w", F.col("s"), F.col("k"))
    anchor = F.element_at(F.array_sort(F.transform(part, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("x")))), 1)["x"]
    return at.select("item", "k", F.array_join(part, " ").alias("win"), anchor.alias("anchor")).distinct()


def _starts(w: Column, anchors: list[str], lengths: list[int]) -> Column:
    """Starts (1-based) and lengths of all windows that hold an anchor."""
    at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(anchors), i + 1)), lambda i: i.isNotNull())

    def around(k: int) -> Column:
        near = F.transform(at, lambda i: F.sequence(F.greatest(i - (k - 1), F.lit(1)), i))
        return F.transform(F.array_distinct(F.flatten(near)), lambda s: F.struct(s.alias("s"), F.lit(k).alias("k")))

    found = [around(k) for k in lengths]
    return F.filter(F.concat(*found), lambda x: x["s"] + x["k"] - 1 <= F.size(w))


def _all_starts(w: Column, k: int) -> Column:
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda s: s + (k - 1) <= F.size(w))
    return F.transform(at, lambda s: F.struct(s.alias("s"), F.lit(k).alias("k")))


def find_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 8, max_windows: int = MAX_WINDOWS, max_anchors: int = MAX_ANCHORS) -> DataFrame:
    """Per row of ``docs``: _row, id, n_words, spans (array of start and end word, end exclusive, merged) and items.

    Null and empty texts have no words and no hits; repeated rows are judged
    each; an item found in a document counts once however often it occurs. Null
    item ids are not listed in items. An empty benchmark hits nothing.
    """
    windows = cut(benchmark_windows(bench, item_col, item_text, n))
    size = windows.agg(F.count("*").alias("n"), F.count_distinct("anchor").alias("a"), F.collect_set("k").alias("k")).first()
    lengths = sorted(size.k) or [n]
    base = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("id"), words(F.col(f"`{text_col}`")).alias("w"))
    small = size.n <= max_windows
    if small and size.a <= max_anchors:
        anchors = [r.anchor for r in windows.select("anchor").distinct().collect()]
        starts = _starts(F.col("w"), anchors, lengths) if anchors else F.expr("cast(array() as array<struct<s:int,k:int>>)")
    else:
        starts = F.concat(*(_all_starts(F.col("w"), k) for k in lengths))
    cand = base.select("_row", "id", F.size("w").cast("bigint").alias("n_words"), F.explode_outer(F.transform(starts, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), F.array_join(F.slice(F.col("w"), x["s"], x["k"]), " ").alias("win")))).alias("c"))
    cand = cand.select("_row", "id", "n_words", F.col("c.s").alias("s"), F.col("c.k").alias("k"), F.col("c.win").alias("win"))
    named = windows.groupBy("win", "k").agg(F.collect_set(F.col("item").cast("string")).alias("of")).withColumn("hit", F.lit(True))
    hits = cand.join(F.broadcast(named) if small else named, ["win", "k"], "left")
    first = F.when(F.col("hit"), F.struct(F.col("s").alias("s"), (F.col("s") + F.col("k")).alias("e")))
    grouped = hits.groupBy("_row").agg(F.any_value("id").alias("id"), F.any_value("n_words").alias("n_words"), F.array_sort(F.collect_list(first)).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("of")))).alias("items"))
    empty = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    last = lambda a: F.element_at(a, -1)
    grow = lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["e"] >= x["s"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.get(a, F.size(a) - 1)["s"].alias("s"), F.greatest(F.get(a, F.size(a) - 1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(a, F.array(x)))
    return grouped.select("_row", "id", "n_words", F.when(F.size("found") > 0, F.aggregate("found", empty, grow)).otherwise(empty).alias("spans"), "items")


def decontaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_items: int = 2, **options) -> DataFrame:
    """``docs`` without the rows in which ``min_items`` items or more occur; all columns as they were, whatever their names.

    Rows are matched by id and text, so rows equal in both are judged alike. Null
    and empty texts stay; empty tables of documents or items remove nothing.
    """
    src = numbered(docs)
    name, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    keyed = src.select(F.struct(name.alias("id"), F.xxhash64(text).alias("h")).alias("_key"), text.alias("_text"))
    bad = find_hits(keyed, bench, "_key", "_text", **options).where(F.size("items") >= min_items).select(F.col("id.id").alias("id"), F.col("id.h").alias("h")).distinct()
    return src.join(bad, name.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("h")), "left_anti").toDF(*docs.columns)


def removed_spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, words, kept): each document's words and those outside every hit span."""
    hits = find_hits(docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).alias("_key"), F.col(f"`{text_col}`").alias("_text")), bench, "_key", "_text", **options)
    w = words(F.col("id.t"))
    return hits.select(F.col("id.id").alias("id"), w.alias("words"), F.filter(w, lambda x, i: ~F.exists("spans", lambda s: (i + 1 >= s["s"]) & (i + 1 < s["e"]))).alias("kept"))


def digest(hits: DataFrame, min_items: int = 2) -> DataFrame:
    """The columns of the decontamination query."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + (x["e"] - x["s"]))
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"),
    )


#: The same query in DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[s:s + least(len(w), 8) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, lens WHERE len(w) >= k)),
h AS (SELECT dw.r, dw.s, dw.k, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
