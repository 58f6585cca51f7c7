"""Modules that import each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import FactSet, finding
from ..operators import graph
from .dead_code import ordered

MAX_CYCLES = 25


def analyze(facts: FactSet, deferred: bool = False, all_cycles: bool = False) -> DataFrame:
    """One finding for the shortest cycle of each tangle, or one for each cycle. Type-only imports never count; deferred ones if asked for."""
    kinds = ["runtime", "deferred"] if deferred else ["runtime"]
    files = facts.files.where("reported").select("file_id", "path", F.coalesce("module", "path").alias("name"), "module")
    i = facts.imports.where(F.col("kind").isin(*kinds)).where("src_file <> target_file")
    i = i.join(files.select(F.col("file_id").alias("src_file")), "src_file", "left_semi")
    # The first import of each target stands for the edge, after the kind has been looked at.
    first = i.groupBy(F.col("src_file").alias("src"), F.col("target_file").alias("dst")).agg(F.min(F.struct("seq", "line", "column")).alias("at"))
    edges = first.select("src", "dst", F.col("at.seq").alias("seq"), "at.line", "at.column")
    comps = graph.strong_components(edges)
    found = graph.bounded_cycles(edges, comps, "seq", MAX_CYCLES, shortest=not all_cycles)
    found = found.withColumn("n", F.size("cycle")).withColumn("cycle_id", F.xxhash64("cycle"))
    hops = found.select("cycle_id", "members", "n", "cycle", F.posexplode("cycle").alias("k", "src")).withColumn("dst", F.col("cycle")[F.pmod(F.col("k") + 1, F.col("n"))])
    hops = hops.join(edges, ["src", "dst"]).join(files.withColumnRenamed("file_id", "src"), "src")
    place = F.struct("path", "module", "line", "column")
    chains = hops.groupBy("cycle_id").agg(F.any_value("members").alias("members"), F.any_value("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "name", place.alias("place")))).alias("c"))
    names = F.concat(F.col("c.name"), F.array(F.col("c.name")[0]))
    joined = F.array_join(names, " -> ")
    members = F.lit(None) if all_cycles else F.col("members")
    message = F.when(members > F.col("n"), F.concat(F.lit("import cycle among "), members, F.lit(" modules, shortest: "), joined)).otherwise(F.concat(F.lit("import cycle: "), joined))
    head = F.col("c")[0]["place"]
    rows = chains.select(F.lit("circular-import").alias("rule"), head["path"].alias("path"), head["module"].alias("module"), head["line"].alias("line"), head["column"].alias("column"), F.lit("high").alias("confidence"), message.alias("message"), F.col("c.place").alias("chain"))
    return ordered(finding(rows).dropDuplicates(["path", "line", "column", "message"]))
