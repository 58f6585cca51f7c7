"""Runs of code that are copies of each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..facts import FactSet, finding
from ..functions import columns as C
from ..operators import clones
from .dead_code import ordered

MIN_TOKENS, MIN_LINES = 50, 5


@dataclass
class Duplication:
    findings: DataFrame
    summary: DataFrame


def token_text(mode: str) -> Column:
    """The text by which tokens are compared: as written (strict), names alike (mild), names and literals alike (weak)."""
    kind = F.col("kind")
    out = F.when(kind == "newline", "\\n").when(kind == "indent", "\\t").when(kind == "dedent", "\\d")
    if mode != "strict":
        out = out.when(kind == "name", "$name")
    if mode == "weak":
        out = out.when(kind == "literal", "$literal")
    return out.otherwise(F.col("text"))


def analyze(facts: FactSet, mode: str = "mild", min_tokens: int = MIN_TOKENS, min_lines: int = MIN_LINES) -> Duplication:
    files = facts.files.where("reported").select("file_id", "path", "module")
    tokens = facts.tokens.join(files.select("file_id"), "file_id", "left_semi").select("file_id", "seq", token_text(mode).alias("text"), "line", "nesting")
    places = clones.clones(tokens, min_tokens, min_lines, strict=mode == "strict").join(files, "file_id").persist()
    w = Window.partitionBy("clone").orderBy("file_id", "at")
    p = places.withColumn("k", F.row_number().over(w) - 1)
    shown = F.concat(F.coalesce("module", "path"), F.lit(":"), F.col("start_line"))
    other = F.struct("path", "module", F.col("start_line").alias("line"), F.lit(1).alias("column"), "end_line")
    g = p.groupBy("clone", "length").agg(F.array_sort(F.collect_list(F.struct("k", shown.alias("shown"), other.alias("o")))).alias("c"))
    head, rest = F.col("c")[0]["o"], F.slice("c", 2, F.size("c"))
    lines = head["end_line"] - head["line"] + 1
    where = F.array_join(rest["shown"], ", ")
    start = F.concat(lines, F.lit(" lines ("), F.col("length"), F.lit(" tokens) duplicated "))
    message = F.when(F.size(rest) == 1, F.concat(start, F.lit("at "), where)).otherwise(F.concat(start, F.lit("in "), F.size(rest), F.lit(" other places: "), where))
    rows = g.select(
        F.lit("duplicate-code").alias("rule"), head["path"].alias("path"), head["module"].alias("module"), head["line"].alias("line"), F.lit(1).alias("column"), F.lit("high").alias("confidence"),
        message.alias("message"), lines.alias("lines"), F.col("length").alias("tokens"), head["end_line"].alias("end_line"), rest["o"].alias("others"),
    )
    # Lines of the union of all spans of a file: merged first, so no line is written out.
    o = Window.partitionBy("file_id").orderBy("start_line", F.desc("end_line"))
    before = F.max("end_line").over(o.rowsBetween(Window.unboundedPreceding, -1))
    covered = places.withColumn("before", before).select(F.greatest(F.col("end_line") - F.greatest(F.col("start_line") - 1, F.coalesce("before", F.lit(0))), F.lit(0)).alias("n"))
    total = tokens.groupBy("file_id").agg(F.max_by("line", "seq").alias("last")).agg(F.coalesce(F.sum("last"), F.lit(0)).alias("total_lines"))
    dup = covered.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicated_lines"))
    count = places.select("clone").distinct().agg(F.count("*").alias("clones"))
    summary = total.crossJoin(dup).crossJoin(count).withColumn("tenths_percent", C.tenths(F.col("duplicated_lines"), F.col("total_lines")))
    return Duplication(ordered(finding(rows)), summary)
