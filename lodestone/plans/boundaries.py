"""Imports that cross declared layers or break deny rules, and a proposal of layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Boundaries
from ..facts import FactSet, finding
from ..functions import columns as C
from ..operators import graph, joins
from .dead_code import ordered
from .rules.places import in_root_directory


def _edges(facts: FactSet) -> DataFrame:
    f = facts.files
    a = f.where("reported").select(F.col("file_id").alias("src_file"), "path", F.col("module").alias("src"))
    b = f.select(F.col("file_id").alias("target_file"), F.col("module").alias("dst"))
    return facts.imports.join(a, "src_file").join(b, "target_file").where("src is not null and dst is not null and src <> dst")


def analyze(facts: FactSet, config: Boundaries) -> DataFrame:
    spark = facts.spark
    edges = _edges(facts)
    if not config.check_type_only:
        edges = edges.where("kind <> 'type-only'")
    edges = edges.select("path", "src", "dst", "line", "column").distinct()
    pairs = edges.select("src", "dst").distinct()
    layers = spark.createDataFrame([(r, p) for r, ps in enumerate(config.layers) for p in ps], "rank int, prefix string")
    titles = spark.createDataFrame([(r, "|".join(ps)) for r, ps in enumerate(config.layers)], "rank int, title string")
    up = joins.layer_violations(pairs, layers)
    up = up.join(titles.toDF("from_rank", "a"), "from_rank").join(titles.toDF("to_rank", "b"), "to_rank")
    up = up.select("src", "dst", F.concat(F.lit("layer `"), "a", F.lit("` may not depend on the layer above it, `"), "b", F.lit("`")).alias("rule_text"))
    deny = spark.createDataFrame([(k, r.source, p, d) for k, r in enumerate(config.rules) for p, d in enumerate(r.deny)], "rule int, `from` string, deny_pos int, deny string")
    allow = spark.createDataFrame([(k, a) for k, r in enumerate(config.rules) for a in r.allow], "rule int, allow string")
    no = joins.denied(pairs, deny, allow, ["src", "dst"]).select("src", "dst", F.concat(F.lit("`"), "from", F.lit("` may not import `"), "deny", F.lit("`")).alias("rule_text"))
    # A layer violation comes before any rule.
    broken = up.union(no.join(up, ["src", "dst"], "left_anti"))
    hits = edges.join(broken, ["src", "dst"])
    # A statement counts once, for the deepest module it names; a file and a module once, where it first names it.
    statement = Window.partitionBy("path", "line", "column").orderBy(C.depth(F.col("dst")).desc(), "dst")
    once = hits.withColumn("n", F.row_number().over(statement)).where("n = 1")
    entry = Window.partitionBy("path", "src", "dst").orderBy("line", "column")
    once = once.withColumn("n", F.row_number().over(entry)).where("n = 1")
    message = F.concat(F.lit("`"), "src", F.lit("` imports `"), "dst", F.lit("`: "), "rule_text")
    rows = once.select(F.lit("boundary-violation").alias("rule"), "path", F.col("src").alias("module"), "line", "column", F.lit("high").alias("confidence"), message.alias("message"), F.col("src").alias("from_module"), F.col("dst").alias("to_module"), "rule_text")
    return ordered(finding(rows))


def suggest(facts: FactSet) -> tuple[DataFrame, DataFrame]:
    """(layers: rank, packages) from the top down, and (tangles: packages) that import each other. Packages are the first two parts of a module."""
    rel, name = F.col("rel_path"), C.file_name(F.col("rel_path"))
    f = facts.files.where("reported").where(~in_root_directory(rel) & ~name.rlike(r"^test_.*\.py$|_test\.py$|^__main__\.py$|^conftest\.py$") & ~F.coalesce(rel.rlike(r"(?:^|/)tests?(?:/|$)"), F.lit(False)))
    parts = F.split("module", r"\.")
    f = f.where(F.size(parts) >= 2).select("file_id", F.array_join(F.slice(parts, 1, 2), ".").alias("package"))
    i = facts.imports.where("kind = 'runtime'").select(F.col("src_file").alias("file_id"), "target_file")
    e = i.join(f.withColumnRenamed("package", "src"), "file_id").join(f.select(F.col("file_id").alias("target_file"), F.col("package").alias("dst")), "target_file").where("src <> dst").select("src", "dst").distinct()
    alone = f.select(F.col("package").alias("src"), F.col("package").alias("dst")).distinct()
    comps = graph.strong_components(e.union(alone))
    ranks = graph.component_ranks(e, comps)
    members = comps.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("packages"))
    tangles = members.where(F.size("packages") > 1).select("packages").orderBy("packages")
    layers = comps.join(ranks, "component").groupBy("rank").agg(F.array_sort(F.collect_list("node")).alias("packages")).orderBy("rank")
    return layers, tangles


def layers_toml(layers: DataFrame, tangles: DataFrame) -> str:
    """The proposal as configuration text."""
    rows = [list(r.packages) for r in layers.orderBy("rank").collect()]
    lines = ["layers = ["]
    for ps in rows:
        lines.append("    " + (f'"{ps[0]}"' if len(ps) == 1 else "[" + ", ".join(f'"{p}"' for p in ps) + "]") + ",")
    lines.append("]")
    lines += [f"# tangled: {', '.join(r.packages)}" for r in tangles.collect()]
    return "\n".join(lines) + "\n"
