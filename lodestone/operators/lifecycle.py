"""From findings to a report: baseline, changed files, confidence, in that order."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import CONFIDENCE
from . import joins

KEY = ["rule", "path", "symbol", "owner", "line"]
SCHEMA_VERSION = 1


def relative(root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.col("path").startswith(root), F.substring(F.col("path"), len(root) + 1, 1 << 20)).otherwise(F.col("path"))


def baseline_keys(findings: DataFrame, root: str = "") -> DataFrame:
    """What identifies a finding between runs: rule, relative path, a name, its owner; a line only for comments and copies."""
    rule = F.col("rule")
    name = F.when(rule.isin("circular-import", "unused-file", "unused-suppression", "duplicate-code"), None).otherwise(F.coalesce("symbol", "function", "to_module", "distribution"))
    line = F.when(rule.isin("unused-suppression", "duplicate-code"), F.col("line"))
    path = relative(root) if root else F.col("path")
    return findings.select("rule", path.alias("path"), name.alias("symbol"), "owner", line.alias("line"))


def apply_baseline(findings: DataFrame, baseline: DataFrame, root: str = "") -> DataFrame:
    """Findings that the baseline does not hold."""
    keyed = findings.withColumn("__k", F.struct(*(c for c in _columns(root))))
    flat = keyed.select("*", *(F.col(f"__k.{k}").alias(f"__{k}") for k in KEY))
    known = baseline.select(*(F.col(k).alias(f"__{k}") for k in KEY))
    return joins.without_match(flat, known, [f"__{k}" for k in KEY]).drop("__k", *(f"__{k}" for k in KEY))


def _columns(root: str) -> list[Column]:
    rule = F.col("rule")
    name = F.when(rule.isin("circular-import", "unused-file", "unused-suppression", "duplicate-code"), None).otherwise(F.coalesce("symbol", "function", "to_module", "distribution"))
    return [rule.alias("rule"), (relative(root) if root else F.col("path")).alias("path"), name.alias("symbol"), F.col("owner").alias("owner"), F.when(rule.isin("unused-suppression", "duplicate-code"), F.col("line")).alias("line")]


def write_baseline(findings: DataFrame, root: str = "") -> str:
    """The baseline as a JSON document, sorted and without repeats."""
    import json

    rows = baseline_keys(findings, root).distinct().orderBy(*KEY).collect()
    return json.dumps({"schema_version": SCHEMA_VERSION, "findings": [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]}, indent=2)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.option("multiLine", True).schema("schema_version int, findings array<struct<rule:string,path:string,symbol:string,owner:string,line:int>>").json(path)
    return doc.select(F.explode("findings").alias("f")).select("f.*")


def since(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings in changed files (one column: path), or with a changed file in their chain."""
    return joins.touching(findings.withColumn("__paths", F.col("chain.path")), "path", "__paths", changed.toDF("__changed"), "__changed").drop("__paths")


def changed_files(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """Files that differ from ``ref`` or are untracked, as absolute paths."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True, text=True).stdout.splitlines()
    names = sorted({*run("diff", "--name-only", "--relative", ref), *run("ls-files", "--others", "--exclude-standard")})
    return spark.createDataFrame([(f"{root.rstrip('/')}/{n}",) for n in names], "path string")


def min_confidence(findings: DataFrame, least: str) -> DataFrame:
    """Findings at least as sure as ``least``; high is the surest."""
    return findings.where(F.col("confidence").isin(*CONFIDENCE[: CONFIDENCE.index(least) + 1]))


def finalise(findings: DataFrame, baseline: DataFrame | None = None, changed: DataFrame | None = None, least: str = "low", root: str = "") -> DataFrame:
    if baseline is not None:
        findings = apply_baseline(findings, baseline, root)
    if changed is not None:
        findings = since(findings, changed)
    return min_confidence(findings, least)
