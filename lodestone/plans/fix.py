"""What could be removed, and the text that stays."""

from __future__ import annotations

import difflib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..facts import FINDING, FactSet
from ..functions.rewrite import prune_imports, remove_block
from ..operators import joins

NOT_DEFINITION = "not a definition"
NOT_REMOVABLE = "not a removable definition"
WRONG_LEVEL = "definition is not at module or class level"
WOULD_EMPTY = "removing it would leave the class body empty"


@dataclass
class Plan:
    """deletions: path; edits: path, removed, old, new, diff; skipped: findings with a reason."""

    deletions: DataFrame
    edits: DataFrame
    skipped: DataFrame

    def acted_on(self, findings: DataFrame) -> DataFrame:
        """The findings that the plan takes care of."""
        keys = ["rule", "path", "line", "column", "message"]
        return joins.without_match(findings, self.skipped, keys)


def plan(facts: FactSet, findings: DataFrame) -> Plan:
    files = facts.files.where("reported").select("file_id", "path")
    gone = findings.where("rule = 'unused-file'").select("path").distinct()
    rest = findings.join(gone, "path", "left_anti").join(files, "path", "left")
    d = facts.deletables.select("file_id", F.col("name").alias("symbol"), "line", "column", "start", "end", "would_be_empty", F.col("seq").alias("d_seq"))
    hit = rest.join(d, ["file_id", "symbol", "line", "column"], "left")
    reason = F.when(F.col("file_id").isNull(), NOT_REMOVABLE).when(F.col("symbol").isNull(), NOT_DEFINITION).when(F.col("line").isNull(), F.lit(None)).when(F.col("start").isNull(), WRONG_LEVEL).when(F.col("would_be_empty"), WOULD_EMPTY)
    hit = hit.withColumn("reason", reason)
    chosen = hit.where("reason is null and start is not null").select("file_id", "path", "symbol", "start", "end", "d_seq").distinct()
    kept = joins.outermost(chosen, ["file_id"], "start", "end", ["d_seq"]).where("not __enclosed")
    spans = kept.groupBy("file_id", "path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "symbol"))).alias("spans"))
    work = spans.join(facts.sources, "file_id")

    def rewrite(batches):
        for pdf in batches:
            out = []
            for path, text, spans in zip(pdf["path"], pdf["text"], pdf["spans"], strict=True):
                new = text
                for s in sorted(spans, key=lambda s: -s["start"]):
                    new = remove_block(new, s["start"], s["end"])
                removed = b"".join(text.encode()[s["start"] : s["end"]] + b"\n" for s in spans).decode()
                new = prune_imports(new, removed)
                diff = "".join(difflib.unified_diff(text.splitlines(True), new.splitlines(True), f"a/{path.lstrip('/')}", f"b/{path.lstrip('/')}", n=3))
                out.append((path, [s["symbol"] for s in spans], text, new, diff))
            yield pd.DataFrame(out, columns=["path", "removed", "old", "new", "diff"])

    edits = work.select("path", "text", "spans").mapInPandas(rewrite, "path string, removed array<string>, old string, new string, diff string")
    columns = [c.strip().split(" ")[0] for c in FINDING.replace("struct<path:string,module:string,line:int,column:int,end_line:int>", "x").replace("struct<path:string,module:string,line:int,column:int>", "x").split(",")]
    skipped = hit.where("reason is not null")
    # A finding of an edited file that fits no span is taken care of with the file.
    lone = hit.where("reason is null and start is null").join(spans.select("path"), "path", "left_anti").withColumn("reason", F.lit(NOT_REMOVABLE))
    w = Window.partitionBy("rule", "path", "line", "column", "message").orderBy("reason")
    every = skipped.unionByName(lone).withColumn("n", F.row_number().over(w)).where("n = 1")
    return Plan(gone, edits, every.select(*columns, "reason"))


def apply(plan: Plan, dry_run: bool = False) -> list[str]:
    """Write the edits and delete the files of a plan on this machine; returns what was or would be done."""
    import os

    done = []
    for r in plan.deletions.orderBy("path").collect():
        done.append(f"delete {r.path}")
        if not dry_run:
            os.remove(r.path)
    for r in plan.edits.orderBy("path").collect():
        done.append(r.diff)
        if not dry_run:
            with open(r.path, "w", encoding="utf-8", newline="") as f:
                f.write(r.new)
    return done
