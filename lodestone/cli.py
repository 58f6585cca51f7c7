"""Command line: ``python -m lodestone.cli dead-code PATH`` and its siblings."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .operators import lifecycle
from .plans import boundaries, cycles, dead_code, deps, dupes, fix, health
from .rulebook import RULES
from .sources import manifests
from .sources.project import project_facts, read_sources, slowest, template_names


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("dead-code", "cycles", "health", "dupes", "boundaries", "deps", "fix"):
        s = sub.add_parser(name)
        s.add_argument("path", nargs="?", default=".")
        s.add_argument("--format", choices=("human", "json", "sarif", "github", "markdown", "pr-comment", "snapshot"), default="human")
        s.add_argument("--exclude", action="append", default=[])
        s.add_argument("--baseline")
        s.add_argument("--write-baseline")
        s.add_argument("--since")
        s.add_argument("--min-confidence", choices=("high", "medium", "low"), default="medium" if name == "fix" else "low")
        s.add_argument("--site-packages")
        s.add_argument("--config", help="a manifest to take settings from instead of the project's own")
        s.add_argument("--timings", action="store_true")
        if name in ("dead-code", "fix"):
            s.add_argument("--no-plugins", action="store_true")
        if name == "dead-code":
            s.add_argument("--show-kept", action="store_true")
        if name == "cycles":
            s.add_argument("--include-deferred", action="store_true")
            s.add_argument("--all-cycles", action="store_true")
        if name == "dupes":
            s.add_argument("--mode", choices=("strict", "mild", "weak"), default="mild")
            s.add_argument("--min-tokens", type=int, default=dupes.MIN_TOKENS)
            s.add_argument("--min-lines", type=int, default=dupes.MIN_LINES)
        if name == "boundaries":
            s.add_argument("--suggest", action="store_true")
        if name == "fix":
            s.add_argument("--dry-run", action="store_true")
            s.add_argument("--only", action="append", default=[])
    return p


def emit(findings: DataFrame, kind: str, how: str, files: int, root: str, kept: DataFrame | None = None) -> str:
    if how == "json":
        return sinks.to_json(findings, kind, {"files_scanned": files}) + "\n"
    if how == "sarif":
        return sinks.sarif(findings, root) + "\n"
    if how == "github":
        return "".join(r.value + "\n" for r in sinks.annotations(findings, root).collect())
    if how in ("markdown", "pr-comment"):
        return sinks.markdown(findings, files, root, marker=how == "pr-comment")
    if how == "snapshot":
        return sinks.snapshot(findings, {"files_scanned": files, "findings": findings.count()}, root)
    return sinks.human(findings, kind, files, kept)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a = parser().parse_args(argv)
    out = out or sys.stdout
    marks = [("start", time.perf_counter())]
    mark = lambda name: marks.append((name, time.perf_counter()))
    try:
        spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
        root = manifests.find_root(a.path)
        found = manifests.manifests(root)
        own = manifests.read_directory(a.config)[1] if a.config else next((m for d, _, m in found if d == root), None)
        config = manifests.settings(root, own)
        config.exclude = (*config.exclude, *a.exclude)
        config.plugins = config.plugins and not getattr(a, "no_plugins", False)
        if a.command == "boundaries" and not a.suggest and config.boundaries is None:
            raise ValueError("no boundaries are configured")
        if bad := set(getattr(a, "only", [])) - set(RULES):
            raise ValueError(f"unknown rules: {', '.join(sorted(bad))}")
        owners, requires = manifests.distributions(spark, a.site_packages) if a.site_packages else (None, None)
        facts = project_facts(read_sources(spark, root, config.notebooks), root, config, owners, template_names(spark, root))
        facts = facts.with_tables(**manifests.tables(spark, found), **({"dist_requires": requires} if requires is not None else {}))
        mark("facts")
        for r in facts.resolutions.where("resolution <> 'semantic'").orderBy("path").collect():
            print(f"warning: {r.path}: {'took too long and is left out' if r.resolution == 'abandoned' else 'only its names are read'}", file=sys.stderr)
        files = facts.files.where("reported").count()
        kept = None
        if a.command in ("dead-code", "fix"):
            report = dead_code.analyze(facts, config)
            findings, kept = report.findings, report.kept if getattr(a, "show_kept", False) else None
        elif a.command == "cycles":
            findings = cycles.analyze(facts, a.include_deferred, a.all_cycles)
        elif a.command == "health":
            report = health.analyze(facts, config.limits)
            findings = report.findings
        elif a.command == "dupes":
            findings = dupes.analyze(facts, a.mode, a.min_tokens, a.min_lines).findings
        elif a.command == "deps":
            findings = deps.analyze(facts, config, root)
        elif a.suggest:
            out.write(boundaries.layers_toml(*boundaries.suggest(facts)))
            return 0
        else:
            findings = boundaries.analyze(facts, config.boundaries)
        if a.write_baseline:
            with open(a.write_baseline, "w", encoding="utf-8") as f:
                f.write(lifecycle.write_baseline(findings, root))
        base = lifecycle.read_baseline(spark, a.baseline) if a.baseline else None
        changed = lifecycle.changed_files(spark, root, a.since) if a.since else None
        findings = dead_code.ordered(lifecycle.finalise(findings, base, changed, a.min_confidence, root))
        mark("analysis")
        if a.command == "fix":
            if a.only:
                findings = findings.where(F.col("rule").isin(*a.only))
            plan = fix.plan(facts, findings)
            if a.format != "human":
                out.write(emit(plan.acted_on(findings), "fix", a.format, files, root))
            for line in fix.apply(plan, a.dry_run):
                if a.format == "human":
                    out.write(line if line.endswith("\n") else line + "\n")
            code = 0 if a.format == "human" else int(findings.count() > 0)
        elif a.command == "health" and a.format == "human":
            out.write(sinks.human_health(report, files))
            code = int(findings.count() > 0)
        else:
            out.write(emit(findings, a.command, a.format, files, root, kept))
            code = int(findings.count() > 0)
        mark("output")
        if a.timings:
            for (_, t0), (name, t1) in zip(marks, marks[1:], strict=False):
                print(f"{name}: {t1 - t0:.2f} s", file=sys.stderr)
            slow = slowest(facts).first()
            if slow:
                print(f"slowest file: {slow.path}, {slow.seconds:.2f} s", file=sys.stderr)
        return 0 if a.write_baseline else code
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
