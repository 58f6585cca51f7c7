"""Complexity, rolled up from functions to files, packages and the project."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from ..facts import FactSet, finding
from ..functions import columns as C

#: Texts of layout tokens, which are no vocabulary (fixed values).
LAYOUT = ("\\n", "\\t", "\\d")
WORST = 10


@dataclass
class Health:
    findings: DataFrame
    files: DataFrame
    packages: DataFrame
    project: DataFrame

    def worst_files(self, n: int = WORST) -> DataFrame:
        return self.files.orderBy("score", "maintainability", F.split("path", "/")).limit(n)


def strict_text(tokens: DataFrame) -> DataFrame:
    """Tokens as written, layout by placeholder."""
    text = F.when(F.col("kind") == "newline", "\\n").when(F.col("kind") == "indent", "\\t").when(F.col("kind") == "dedent", "\\d").otherwise(F.col("text"))
    return tokens.withColumn("text", text)


def analyze(facts: FactSet, limits: Limits | None = None) -> Health:
    t = (limits or Limits()).__dict__
    files = facts.files.where("reported").select("file_id", "path", "module")
    m = facts.function_metrics.join(files, "file_id")
    hot = (F.col("cognitive") > 0) & ((F.col("cyclomatic") > t["cyclomatic"]) | (F.col("cognitive") > t["cognitive"]))
    w = F.greatest("lines", F.lit(1)).cast("bigint")
    m = m.withColumn("w", w).withColumn("pw", C.penalty(F.col("cyclomatic"), F.col("cognitive"), F.col("lines"), F.col("parameters"), t) * w).withColumn("hot", hot)
    segments = F.split("module", r"\.")
    m = m.withColumn("package", F.when(F.size(segments) >= 2, F.array_join(F.slice(segments, 1, 2), ".")))
    sums = (F.sum("pw").alias("pw"), F.sum("w").alias("w"), F.count("*").alias("functions"), F.count_if("hot").alias("hotspots"), F.max("cyclomatic").alias("max_cyclomatic"), F.max("cognitive").alias("max_cognitive"), F.sum("cyclomatic").alias("cyc"), F.sum("lines").alias("lines"))
    per_file = m.groupBy("file_id", "path", "module", "package").agg(*sums)
    voc = strict_text(facts.tokens).where(~F.col("text").isin(*LAYOUT)).groupBy("file_id").agg(F.count("*").alias("n"), F.count_distinct("text").alias("distinct"))
    scored = per_file.join(voc, "file_id", "left")
    mi = F.round(C.maintainability(F.coalesce("n", F.lit(0)), F.coalesce("distinct", F.lit(0)), F.col("cyc"), F.col("lines"))).cast("int")
    score = C.score(F.col("pw"), F.col("w"))
    by_file = scored.select("path", "module", score.alias("score"), mi.alias("maintainability"), "functions", "hotspots")
    # Packages and the project are sums of the files' sums.
    up = (F.sum("pw").alias("pw"), F.sum("w").alias("w"), F.sum("functions").alias("functions"), F.sum("hotspots").alias("hotspots"))
    packages = per_file.where("package is not null").groupBy("package").agg(*up).select("package", score.alias("score"), "functions", "hotspots").orderBy("score", "package")
    project = per_file.agg(*up, F.max("max_cyclomatic").alias("max_cyclomatic"), F.max("max_cognitive").alias("max_cognitive"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    project = project.select(score.alias("score"), C.grade(score).alias("grade"), zero("functions"), zero("hotspots"), zero("max_cyclomatic"), zero("max_cognitive"))
    name = F.concat_ws(".", "owner", "name")
    message = F.format_string("function `%s` has cyclomatic complexity %d and cognitive complexity %d over %d lines", name, "cyclomatic", "cognitive", "lines")
    rows = m.where("hot").select(F.lit("complex-function").alias("rule"), "path", "module", "line", "column", F.lit("high").alias("confidence"), message.alias("message"), name.alias("function"), "cyclomatic", "cognitive", "lines", "parameters", "max_nesting")
    findings = finding(rows).orderBy(F.desc("cognitive"), F.split("path", "/"), "line", "column")
    return Health(findings, by_file, packages, project)
