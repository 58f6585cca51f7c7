"""Connected components of an edge table, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the component's least node.

    Alternates the large-star and small-star steps on an edge table, so each
    round moves as many rows as there are edges and the number of rounds grows
    with the logarithm of the longest path; they end when a round changes nothing. Each round is cut in the shared
    folder. Self-loops are allowed and keep a lone node in the result; null
    nodes are dropped.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e = e.where("u <> v")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == (now.n, now.s):
            break
        state = (now.n, now.s)
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("r")), "node", "left").select("node", F.coalesce("r", "node").alias("root"))
