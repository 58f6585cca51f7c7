"""Findings as text, JSON, SARIF, annotations, tables and snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.lifecycle import relative
from .rulebook import RULES

SUBJECTS = {"dead-code": "dead code", "cycles": "import cycles", "health": "hotspots", "dupes": "duplicated code", "boundaries": "boundary violations", "deps": "dependency problems", "fix": "dead code to remove"}


def location() -> Column:
    return F.concat_ws(":", "path", "line", "column")


def human(findings: DataFrame, kind: str, files: int, kept: DataFrame | None = None, scope: str = "") -> str:
    lines = [r.t for r in findings.select(F.concat(location(), F.lit("  "), "message").alias("t")).collect()]
    n = len(lines)
    if kept is not None:
        rows = kept.select(F.concat(F.concat_ws(":", "path", "line", "column"), F.lit("  `"), "symbol", F.lit("` kept by "), "plugin", F.lit(": "), "why").alias("t")).collect()
        if rows:
            lines += ["", "Kept by plugins:", *(r.t for r in rows)]
    lines.append(f"\n{n} finding(s) in {files} files{scope}." if n else f"No {SUBJECTS[kind]} found in {files} files{scope}.")
    return "\n".join(lines) + "\n"


def human_health(health, files: int) -> str:
    lines = [r.t for r in health.findings.select(F.concat(location(), F.lit("  "), "message").alias("t")).collect()]
    worst = [r for r in health.worst_files().collect() if r.score < 100 or r.maintainability < 20][:5]
    if worst:
        lines += ["", "Files needing attention:"]
        lines += [f"  {r.module or r.path}: score {r.score}, maintainability {r.maintainability}, {r.hotspots} hotspot(s) in {r.functions} function(s)" for r in worst]
    p = health.project.first()
    lines.append(f"\nHealth score {p.score}/100 ({p.grade}) across {files} files; {p.hotspots} hotspot(s).")
    return "\n".join(lines) + "\n"


def to_json(findings: DataFrame, kind: str, summary: dict | None = None) -> str:
    """One compact document; columns that are null are left out."""
    rows = [json.loads(r) for r in findings.toJSON().collect()]
    return json.dumps({"schema_version": 1, "kind": kind, "summary": (summary or {}) | {"findings": len(rows)}, "findings": rows}, separators=(",", ":"))


def sarif(findings: DataFrame, root: str = "", tool: str = "lodestone", version: str = "0") -> str:
    results = []
    for r in findings.withColumn("uri", relative(root) if root else F.col("path")).collect():
        region = {"startLine": r.line, "startColumn": r.column} if r.line is not None else {}
        results.append({
            "ruleId": r.rule, "level": "note" if r.confidence == "low" else "warning", "message": {"text": r.message},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.uri, "uriBaseId": "%SRCROOT%"}, "region": region}}], "properties": {"confidence": r.confidence},
        })
    driver = {"name": tool, "version": version, "rules": [{"id": k, "shortDescription": {"text": v}} for k, v in RULES.items()]}
    run = {"tool": {"driver": driver}, "originalUriBaseIds": {"%SRCROOT%": {"uri": f"file://{root.rstrip('/')}/"}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]})


def annotations(findings: DataFrame, root: str = "", tool: str = "lodestone") -> DataFrame:
    """One workflow command for each finding (column: value)."""
    at = F.when(F.col("line").isNotNull(), F.concat(F.lit(",line="), "line", F.lit(",col="), "column")).otherwise("")
    return findings.select(F.concat(F.lit("::"), F.when(F.col("confidence") == "low", "notice").otherwise("warning"), F.lit(" file="), relative(root) if root else F.col("path"), at, F.lit(f",title={tool} "), "rule", F.lit("::"), "message").alias("value"))


def markdown(findings: DataFrame, files: int, root: str = "", tool: str = "lodestone", marker: bool = False) -> str:
    path = relative(root) if root else F.col("path")
    row = F.concat(F.lit("| `"), "rule", F.lit("` | `"), F.concat_ws(":", path, "line"), F.lit("` | "), F.replace("message", F.lit("|"), F.lit("\\|")), F.lit(" | "), "confidence", F.lit(" |"))
    rows = [r.t for r in findings.select(row.alias("t")).collect()]
    head = f"<!-- {tool} -->\n" if marker else ""
    if not rows:
        return f"{head}**{tool}**: no findings in {files} files.\n"
    return head + "\n".join([f"**{tool}**: {len(rows)} finding(s) in {files} files.\n", "| Rule | Location | Finding | Confidence |", "| --- | --- | --- | --- |", *rows]) + "\n"


def steady(message: Column) -> Column:
    """A message without what is no property of the code."""
    return F.regexp_replace(message, r"(?s) it arrives through `.*$", " it arrives through a declared dependency")


def snapshot(findings: DataFrame, header: dict[str, object], root: str = "") -> str:
    """Header counts, a rule, then sorted tab-separated lines: rule, confidence, place, name, message. Which dependency brings in another depends on what is installed, so messages do not say."""
    place = F.concat_ws(":", relative(root) if root else F.col("path"), "line", "column")
    cols = ["rule", "confidence", place, F.coalesce("symbol", "function", F.lit("-")), steady(F.col("message"))]
    rows = [tuple(r) for r in findings.select(*cols).collect()]
    return "\n".join([*(f"{k}={v}" for k, v in header.items()), "--", *("\t".join(map(str, r)) for r in sorted(rows))]) + "\n"
