"""Project manifests and tool settings, read on the driver: they are a handful of small files."""

from __future__ import annotations

import ast
import configparser
import os
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..config import Boundaries, Config, DenyRule, Limits, TestCollection

#: Files that declare a project (fixed values).
MANIFESTS = ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt")
#: Directories that hold no manifest of the project (fixed values).
SKIPPED = frozenset((".git", ".hg", ".venv", "venv", "env", ".env", "node_modules", "__pycache__", ".tox", ".nox", "build", "dist", "site-packages", "tests", "test", ".eggs"))


def normalized(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name.strip().lower()).strip("-")


def requirement(text: str) -> str | None:
    """The distribution that a requirement names, or None for an option or an address without a name."""
    text = text.split("#")[0].strip()
    m = re.match(r"[A-Za-z0-9._-]+", text)
    return normalized(m[0]) if m and not text.startswith("-") and "://" not in text.split("@")[0] else None


@dataclass
class Manifest:
    """What a manifest declares. dependencies: (name, group kind, group name); entry points: (kind, module, attribute)."""

    name: str | None = None
    dependencies: list[tuple[str, str, str | None]] = field(default_factory=list)
    entry_points: list[tuple[str, str, str | None]] = field(default_factory=list)
    tool: dict = field(default_factory=dict)

    def declare(self, text: str, kind: str = "main", group: str | None = None) -> None:
        if name := requirement(text):
            self.dependencies.append((name, kind, group))

    def enter(self, kind: str, target: str) -> None:
        """``module:attribute.more [extra]``: the module and the attribute's first part."""
        module, _, attr = target.split("[")[0].strip().partition(":")
        if module.strip():
            self.entry_points.append((kind, module.strip(), attr.strip().split(".")[0] or None))


def find_root(path: str) -> str:
    """The directory itself if it has a legacy manifest, else the nearest one above with any manifest, else itself."""
    path = os.path.abspath(path)
    has = lambda d, names: any(os.path.exists(os.path.join(d, n)) for n in names)
    if has(path, MANIFESTS[1:]) and not has(path, MANIFESTS[:1]):
        return path
    at = path
    while True:
        if has(at, MANIFESTS):
            return at
        up = os.path.dirname(at)
        if up == at:
            return path
        at = up


def read_pyproject(text: str, tool: str = "lodestone") -> Manifest:
    doc = tomllib.loads(text)
    project, out = doc.get("project", {}), Manifest()
    poetry = doc.get("tool", {}).get("poetry", {})
    name = project.get("name") or poetry.get("name")
    out.name = normalized(name) if name else None
    for d in project.get("dependencies", []):
        out.declare(d)
    for group, items in project.get("optional-dependencies", {}).items():
        for d in items:
            out.declare(d, "optional", group)
    groups = doc.get("dependency-groups", {})

    def members(group: str, seen: frozenset) -> list[str]:
        if group in seen:
            return []
        found = []
        for d in groups.get(group, []):
            found += [d] if isinstance(d, str) else members(d.get("include-group", ""), seen | {group})
        return found

    for group in groups:
        for d in members(group, frozenset()):
            out.declare(d, "group", group)
    for d in poetry.get("dependencies", {}):
        if d != "python":
            out.declare(d)
    for d in poetry.get("dev-dependencies", {}):
        out.declare(d, "group", "dev")
    for group, table in poetry.get("group", {}).items():
        for d in table.get("dependencies", {}):
            out.declare(d, "group", group)
    for kind, table in (("script", project.get("scripts", {})), ("gui", project.get("gui-scripts", {})), ("script", poetry.get("scripts", {}))):
        for target in table.values():
            if isinstance(target, str):
                out.enter(kind, target)
    for table in (*project.get("entry-points", {}).values(), *poetry.get("plugins", {}).values()):
        for target in table.values():
            out.enter("plugin", target)
    out.tool = doc.get("tool", {}).get(tool, {})
    out.tool = {**out.tool, "pytest": doc.get("tool", {}).get("pytest", {}).get("ini_options", {})}
    return out


def _entry_lines(out: Manifest, text: str) -> None:
    kind = "plugin"
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("["):
            kind = {"console_scripts": "script", "gui_scripts": "gui"}.get(line.strip("[]"), "plugin")
        elif "=" in line:
            out.enter(kind, line.split("=", 1)[1])


def read_setup_py(text: str) -> Manifest:
    """Literal arguments of the ``setup()`` call."""
    out = Manifest()
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return out
    for call in (n for n in ast.walk(tree) if isinstance(n, ast.Call) and (getattr(n.func, "id", None) == "setup" or getattr(n.func, "attr", None) == "setup")):
        args = {}
        for k in call.keywords:
            try:
                args[k.arg] = ast.literal_eval(k.value)
            except ValueError:
                continue
        if isinstance(args.get("name"), str):
            out.name = normalized(args["name"])
        for d in args.get("install_requires") or ():
            out.declare(d)
        extras = args.get("extras_require")
        for group, items in (extras if isinstance(extras, dict) else {}).items():
            for d in [items] if isinstance(items, str) else items:
                out.declare(d, "optional", group)
        points = args.get("entry_points")
        if isinstance(points, str):
            _entry_lines(out, points)
        elif isinstance(points, dict):
            for group, items in points.items():
                for line in [items] if isinstance(items, str) else items:
                    _entry_lines(out, f"[{group}]\n{line}")
    return out


def read_setup_cfg(text: str) -> Manifest:
    out, ini = Manifest(), configparser.ConfigParser(interpolation=None, strict=False)
    try:
        ini.read_string(text)
    except configparser.Error:
        return out
    if ini.has_option("metadata", "name"):
        out.name = normalized(ini.get("metadata", "name"))
    for line in ini.get("options", "install_requires", fallback="").splitlines():
        out.declare(line)
    if ini.has_section("options.entry_points"):
        for group, lines in ini.items("options.entry_points"):
            _entry_lines(out, f"[{group}]\n{lines}")
    return out


def read_requirements(directory: str) -> Manifest:
    """Requirement files of a directory, with what they include; the group is the file's stem."""
    out, seen = Manifest(), set()

    def read(path: str, kind: str, group: str | None) -> None:
        path = os.path.normpath(path)
        if path in seen or not os.path.isfile(path):
            return
        seen.add(path)
        with open(path, encoding="utf-8", errors="replace") as f:
            for line in f:
                if m := re.match(r"\s*(?:-r|--requirement)[\s=]+(\S+)", line):
                    read(os.path.join(os.path.dirname(path), m[1]), kind, group)
                else:
                    out.declare(line, kind, group)

    read(os.path.join(directory, "requirements.txt"), "main", None)
    names = sorted(n for n in os.listdir(directory) if re.fullmatch(r"requirements[-_].*\.txt", n)) if os.path.isdir(directory) else []
    sub = os.path.join(directory, "requirements")
    names += [f"requirements/{n}" for n in sorted(os.listdir(sub)) if n.endswith(".txt")] if os.path.isdir(sub) else []
    for n in names:
        stem = os.path.basename(n)[:-4]
        read(os.path.join(directory, n), "group", re.sub(r"^requirements[-_]", "", stem))
    return out


def read_directory(directory: str, tool: str = "lodestone") -> tuple[str, Manifest] | None:
    """(manifest path, manifest) of a directory; legacy dependencies count only where pyproject has none, entry points always."""

    def text(name: str) -> str | None:
        path = os.path.join(directory, name)
        if not os.path.isfile(path):
            return None
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()

    out, path = Manifest(), None
    if (t := text("pyproject.toml")) is not None:
        out, path = read_pyproject(t, tool), "pyproject.toml"
    for name, read in (("setup.py", read_setup_py), ("setup.cfg", read_setup_cfg)):
        if (t := text(name)) is not None:
            legacy = read(t)
            path = path or name
            out.name = out.name or legacy.name
            out.entry_points += legacy.entry_points
            out.dependencies = out.dependencies or legacy.dependencies
    if not out.dependencies:
        legacy = read_requirements(directory)
        if legacy.dependencies:
            out.dependencies, path = legacy.dependencies, path or "requirements.txt"
    return (os.path.join(directory, path), out) if path else None


def manifests(root: str, tool: str = "lodestone") -> list[tuple[str, str, Manifest]]:
    """(directory, path, manifest) below a root, sorted, the root first."""
    out = []
    for d, subs, _ in os.walk(root):
        subs[:] = sorted(s for s in subs if s not in SKIPPED)
        if got := read_directory(d, tool):
            out.append((d, *got))
    return sorted(out, key=lambda x: (x[0] != root, x[0]))


def tables(spark: SparkSession, found: list[tuple[str, str, Manifest]]) -> dict[str, DataFrame]:
    """The fact tables scopes, dependencies and entry_points."""
    scopes = [(k, path, d, m.name) for k, (d, path, m) in enumerate(found)]
    deps = [(k, n, *d) for k, (_, _, m) in enumerate(found) for n, d in enumerate(m.dependencies)]
    points = sorted({p for _, _, m in found for p in m.entry_points}, key=str)
    return {
        "scopes": spark.createDataFrame(scopes, "scope_id int, manifest_path string, directory string, name string"),
        "dependencies": spark.createDataFrame(deps, "scope_id int, seq int, name string, group_kind string, group_name string"),
        "entry_points": spark.createDataFrame(points, "kind string, module string, attribute string"),
    }


def pytest_settings(root: str, ini_options: dict) -> TestCollection:
    """How tests are collected: ``pytest.ini`` before pyproject before ``tox.ini`` before ``setup.cfg``."""

    def section(name: str, part: str) -> dict | None:
        ini = configparser.ConfigParser(interpolation=None, strict=False)
        try:
            ini.read(os.path.join(root, name), encoding="utf-8")
        except configparser.Error:
            return None
        return dict(ini.items(part)) if ini.has_section(part) else None

    found = section("pytest.ini", "pytest") or ini_options or section("tox.ini", "pytest") or section("setup.cfg", "tool:pytest") or {}
    words = lambda v: tuple(v.split() if isinstance(v, str) else v)
    d = TestCollection()
    return TestCollection(words(found.get("python_files", d.files)), words(found.get("python_classes", d.classes)), words(found.get("python_functions", d.functions)))


_KNOWN = {"exclude", "ignore-names", "public-modules", "library-packages", "ignored-dependencies", "plugins", "notebooks", "boundaries", "limits", "pytest"}


def boundaries(table: dict) -> Boundaries:
    """Layers by preset or by list (a string or a list for each rank), and rules; nothing at all is an error."""
    if table.get("preset") == "hexagonal":
        out = Boundaries.hexagonal(table["root"])
    else:
        out = Boundaries(layers=tuple((r,) if isinstance(r, str) else tuple(r) for r in table.get("layers", [])))
    out.rules = tuple(DenyRule(r["from"], tuple(r.get("deny", [])), tuple(r.get("allow", []))) for r in table.get("rules", []))
    out.check_type_only = bool(table.get("check-type-only", False))
    if not out.layers and not out.rules:
        raise ValueError("boundaries: neither layers nor rules")
    return out


def settings(root: str, manifest: Manifest | None) -> Config:
    """Settings of the tool's table; unknown keys are an error."""
    tool = dict(manifest.tool) if manifest else {}
    if unknown := set(tool) - _KNOWN:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    c = Config(tests=pytest_settings(root, tool.get("pytest", {})))
    for key in ("exclude", "ignore-names", "public-modules", "library-packages"):
        setattr(c, key.replace("-", "_"), tuple(tool.get(key, ())))
    c.ignored_dependencies = tuple(map(normalized, tool.get("ignored-dependencies", ())))
    c.plugins, c.notebooks = tool.get("plugins", True), tool.get("notebooks", False)
    c.boundaries = boundaries(tool["boundaries"]) if "boundaries" in tool else None
    c.limits = Limits(**tool.get("limits", {}))
    return c


def distributions(spark: SparkSession, site_packages: str) -> tuple[DataFrame, DataFrame]:
    """((top_level, dist), (dist, requires)) from the metadata of what is installed below a directory."""
    from pyspark.sql import functions as F

    from ..functions import columns as C

    read = lambda name: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(site_packages).where(F.col("path").contains(".dist-info/")).select(F.regexp_extract("path", r"([^/]+)-[^/-]+\.dist-info/", 1).alias("d"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    dist = C.normalized_distribution(F.col("d")).alias("dist")
    tops = read("top_level.txt").where("trim(line) <> ''").select(F.trim("line").alias("top_level"), dist)
    files = read("RECORD").select(F.regexp_extract("line", r"^([A-Za-z_][A-Za-z0-9_]*)(?:/|\.py,)", 1).alias("top_level"), dist).where("top_level <> ''").distinct()
    owners = tops.union(files.join(tops.select("dist").distinct(), "dist", "left_anti").select("top_level", "dist"))
    needs = read("METADATA").where(F.col("line").startswith("Requires-Dist:") & ~F.col("line").rlike(r"extra\s*=="))
    requires = needs.select(dist, C.normalized_distribution(C.requirement_name(F.substring_index("line", ":", -1))).alias("requires"))
    return owners.distinct(), requires.distinct()
