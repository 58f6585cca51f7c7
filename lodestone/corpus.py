"""Golden snapshots of whole projects: take them, compare them, and pin what they were taken from."""

from __future__ import annotations

import difflib
import hashlib
import io
import json
import os

from pyspark.sql import SparkSession

from . import cli

ANALYSES = ("dead-code", "cycles", "health", "dupes", "deps")
LOCK = "corpus.lock.json"


def snapshots(spark: SparkSession, root: str, analyses: tuple[str, ...] = ANALYSES) -> dict[str, str]:
    """The snapshot text of each analysis of a project."""
    out = {}
    for name in analyses:
        text = io.StringIO()
        if cli.main([name, root, "--format", "snapshot"], spark, text) == 2:
            raise ValueError(f"{name} failed on {root}")
        out[name] = text.getvalue()
    return out


def _path(folder: str, project: str, analysis: str) -> str:
    return os.path.join(folder, project, f"{analysis}.txt")


def update(spark: SparkSession, project: str, root: str, folder: str, analyses: tuple[str, ...] = ANALYSES) -> None:
    """Write the snapshots of a project and pin its sources."""
    for name, text in snapshots(spark, root, analyses).items():
        os.makedirs(os.path.join(folder, project), exist_ok=True)
        with open(_path(folder, project, name), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    pins = locked(folder) | {project: fingerprint(root)}
    with open(os.path.join(folder, LOCK), "w", encoding="utf-8") as f:
        json.dump(dict(sorted(pins.items())), f, indent=2)


def check(spark: SparkSession, project: str, root: str, folder: str, analyses: tuple[str, ...] = ANALYSES) -> dict[str, str]:
    """What differs from the kept snapshots, as unified diffs by analysis. Other sources than those that were pinned are an error."""
    if locked(folder).get(project) != fingerprint(root):
        raise ValueError(f"{project} is not what its snapshots were taken from")
    out = {}
    for name, new in snapshots(spark, root, analyses).items():
        path = _path(folder, project, name)
        old = ""
        if os.path.exists(path):
            with open(path, encoding="utf-8", newline="") as f:
                old = f.read()
        if old != new:
            out[name] = "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), "kept", "now"))
    return out


def locked(folder: str) -> dict[str, str]:
    path = os.path.join(folder, LOCK)
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def fingerprint(root: str) -> str:
    """A hash of the names and contents of a project's Python files and manifests."""
    h = hashlib.sha256()
    for d, subs, names in os.walk(root):
        subs[:] = sorted(s for s in subs if not s.startswith("."))
        for n in sorted(names):
            if n.endswith((".py", ".pyi", ".toml", ".cfg", ".ini", ".txt")):
                with open(os.path.join(d, n), "rb") as f:
                    h.update(f"{os.path.relpath(os.path.join(d, n), root)}\0".encode() + hashlib.sha256(f.read()).digest())
    return h.hexdigest()
