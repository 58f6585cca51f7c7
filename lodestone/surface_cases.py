"""Readers, scanners, conditions, sinks and fixes on small inputs, as driver queries.

What a query must give is written by hand as SQL beside it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import examples, sinks
from .config import Config
from .facts import FactSet, finding
from .functions import columns as C
from .functions.scan import Scan
from .functions.tokens import deletables, suppressions
from .operators import lifecycle
from .plans import boundaries, fix, health
from .plans.rules import base as B
from .plans.rules import places
from .queries import query
from .rulebook import RULES
from .sources import manifests
from .sources.project import _scanner, project_facts, slowest, uses_by_definition

#: A project of manifests beside this module.
PROJECT = Path(__file__).with_name("example_project")


def rows(columns: str, values: Iterable[tuple]) -> str:
    """The rows as SQL."""

    def text(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, int | float):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    values = list(values)
    names = [c.split()[0] for c in columns.split(", ")]
    casts = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", "))
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(text, v)) + ')' for v in values)}) AS t({', '.join(names)})"


def frame(spark: SparkSession, columns: str, values: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(values), columns.replace(" VARCHAR", " string").replace(" BIGINT", " bigint").replace(" INTEGER", " int").replace(" BOOLEAN", " boolean").replace(" DOUBLE", " double"))


# Conditions on names and places

PLACES = "path VARCHAR, root BOOLEAN, data BOOLEAN, typing BOOLEAN, vendored BOOLEAN, tool BOOLEAN"
PLACE_ROWS = [
    ("examples/run.py", True, False, False, False, False), ("a/toolbox/x.py", True, False, False, False, False), ("example.py", False, False, False, False, False), ("a/hooks/b/x.py", True, False, False, False, False),
    ("tests/data/x.py", False, True, False, False, False), ("a/test/b/cases/x.py", False, True, False, False, False), ("data/x.py", False, False, False, False, False), ("a/testdata/x.py", False, True, False, False, False),
    ("tests/typing/x.py", False, False, True, False, False), ("typing_tests/x.py", False, False, True, False, False), ("typing/x.py", False, False, False, False, False),
    ("a/vendor/x.py", False, False, False, True, False), ("a/vendors/x.py", False, False, False, False, False), ("a/b.conf.py", False, False, False, False, True), ("a/hook-x.py", False, False, False, False, True), ("a/conf.py", False, False, False, False, False),
]


@query(rows(PLACES, PLACE_ROWS))
def code_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return spark.createDataFrame([(r[0],) for r in PLACE_ROWS], "path string").select("path", places.in_root_directory(p).alias("root"), places.in_test_data(p).alias("data"), places.in_typing_tests(p).alias("typing"), places.vendored(p).alias("vendored"), places.tool_config(p).alias("tool"))


GLOBS = "value VARCHAR, excluded BOOLEAN, ignored BOOLEAN, collected BOOLEAN"
GLOB_ROWS = [
    ("old/a.py", True, False, False), ("old/b/c.py", True, False, False), ("new/old.py", False, False, False), ("gen/a_pb2.py", True, False, False), ("x/gen/a_pb2.py", False, False, False),
    ("legacy_name", False, True, False), ("a_legacy_name", False, False, False), ("test_x", False, False, True), ("tests", False, False, True), ("my_spec", False, False, True), ("my_specs", False, False, False),
]


@query(rows(GLOBS, GLOB_ROWS))
def code_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return spark.createDataFrame([(r[0],) for r in GLOB_ROWS], "value string").select("value", C.matches_any(v, ("old", "gen/*_pb2.py")).alias("excluded"), C.matches_any(v, ("legacy_*",), crossing=False).alias("ignored"), B.head_or_glob(v, ("test", "*_spec")).alias("collected"))


# Scans

METRICS = """class C:
    @dec
    def m(self, a, /, b, *c, d=1, **e):
        def inner(x):
            return x
        for i in a:
            if i and b:
                continue
            elif d:
                break
            else:
                return inner
        return self.m

    async def n(self):
        async with self as y, y:
            assert y
        return [k for k in y if k] or (1 if y else 2)


def walk(x):
    match x:
        case 1:
            while x:
                x = walk(x)
        case _:
            try:
                pass
            except ValueError:
                pass
    return lambda z: 1 if z else 2
"""


@query(rows("name VARCHAR, owner VARCHAR, line INTEGER, lines INTEGER, parameters INTEGER, cyclomatic INTEGER, cognitive INTEGER, max_nesting INTEGER", [
    ("m", "C", 3, 11, 6, 5, 6, 2), ("inner", None, 4, 2, 1, 1, 0, 0), ("n", "C", 15, 4, 1, 7, 2, 1), ("walk", None, 21, 11, 1, 6, 8, 2),
]))
def code_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = project_facts(frame(spark, "path VARCHAR, text VARCHAR", [("/p/m.py", METRICS)]), "/p")
    return f.function_metrics.select("name", "owner", "line", "lines", "parameters", "cyclomatic", "cognitive", "max_nesting")


IMPORTS = """import sys
from typing import TYPE_CHECKING
import os.path as p

NEW = sys.version_info >= (3, 12)
if TYPE_CHECKING:
    from . import types
else:
    import later
if NEW:
    import tomllib
else:
    import tomli
def f():
    from .deep import thing
"""


@query(rows("module VARCHAR, attr VARCHAR, kind VARCHAR, condition VARCHAR", [
    ("sys", None, "runtime", "always"), ("typing", "TYPE_CHECKING", "runtime", "always"), ("os.path", None, "runtime", "always"), ("pkg", "types", "type-only", "always"), ("later", None, "type-only", "always"),
    ("tomllib", None, "runtime", "version"), ("tomli", None, "runtime", "version"), ("pkg.deep", "thing", "deferred", "always"),
]))
def code_import_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scan(IMPORTS, "pkg.mod", False)
    return frame(spark, "module VARCHAR, attr VARCHAR, kind VARCHAR, condition VARCHAR", [(i["module"], i["attr"], i["kind"], i["condition"]) for i in s.facts["imports"]])


STRINGS = """NAMES = ["pkg.mod.attr", "pkg.mod:main.run", "a b.c", "tools/run.py", "word"]
load(f"pkg.sub.{x}", "other.%s", "visit_%s", "ab_{}")
getattr(x, "named")
globals()
"""


@query(rows("kind VARCHAR, value VARCHAR", [
    ("dotted", "pkg.mod.attr"), ("dotted", "pkg.mod.main.run"), ("path", "tools/run.py"), ("package", "pkg.sub"), ("package", "other"), ("prefix", "visit_"), ("prefix", "ab_"),
    ("name", "word"), ("name", "named"), ("globals", "true"),
]))
def code_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scan(STRINGS, "m", False)
    found = [("dotted", x["name"]) for x in s.facts["strings"]] + [("path", x) for x in s.facts["path_literals"]] + [("package", x) for x in s.facts["package_wide"]] + [("prefix", x) for x in s.facts["attr_prefixes"]]
    found += [("name", x) for x in s.facts["attr_names"]] + ([("globals", "true")] if s.reads_globals else [])
    return frame(spark, "kind VARCHAR, value VARCHAR", found)


TARGETS = """A = 1
b, (c, *d) = 1, (2, 3)
e: int
f: int = 2
for g in []:
    h = 1
with x as i:
    pass
(j := 3)

class K:
    L = 1
    m: int

    def n(self, o):
        self.p = self.q = o
        self.L = 2
        other.r = 1

        def inner():
            self.s = 1

    @staticmethod
    def t(u):
        u.v = 1
"""


@query(rows("name VARCHAR, kind VARCHAR, owner VARCHAR", [
    ("A", "constant", None), ("b", "variable", None), ("c", "variable", None), ("d", "variable", None), ("f", "variable", None), ("h", "variable", None), ("K", "class", None),
    ("L", "constant", "K"), ("n", "method", "K"), ("inner", "function", "n"), ("t", "method", "K"), ("p", "field", "K"), ("q", "field", "K"), ("s", "field", "K"),
]))
def code_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scan(TARGETS, "m", False).facts["symbols"]
    return frame(spark, "name VARCHAR, kind VARCHAR, owner VARCHAR", [(x["name"], x["kind"], None if x["parent_ordinal"] is None else s[x["parent_ordinal"]]["name"]) for x in s])


COMMENTS = "a = 1  # lodestone: ignore\nb = 2  #lodestone:ignore[ unused-class , nonsense ]\nc = 3  # lodestone: ignore[nonsense]\nd = '# lodestone: ignore'\n## lodestone: ignore-file\ne = 5  # lodestone: ignored\n"


@query(rows("line INTEGER, scope VARCHAR, rules VARCHAR", [(1, "all", ""), (2, "rules", "unused-class"), (5, "file", "")]))
def code_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, "line INTEGER, scope VARCHAR, rules VARCHAR", [(a, b, ",".join(c)) for a, b, c in suppressions(COMMENTS, tuple(RULES))])


REMOVABLE = "X = 1\nif X:\n    Y = 2\n\n@dec\ndef f():\n    pass\n\nclass C:\n    def only(self):\n        pass\n\nclass D:\n    z: int = 1\n    def g(self):\n        pass\n"


@query(rows("name VARCHAR, block VARCHAR, would_be_empty BOOLEAN", [
    ("X", "X = 1\n", False), ("f", "@dec\ndef f():\n    pass\n", False), ("C", "class C:\n    def only(self):\n        pass\n", False), ("only", "    def only(self):\n        pass\n", True),
    ("D", "class D:\n    z: int = 1\n    def g(self):\n        pass\n", False), ("z", "    z: int = 1\n", False), ("g", "    def g(self):\n        pass\n", False),
]))
def code_deletables(spark: SparkSession, sf_dir: str) -> DataFrame:
    import ast

    found = deletables(ast.parse(REMOVABLE), REMOVABLE)
    return frame(spark, "name VARCHAR, block VARCHAR, would_be_empty BOOLEAN", [(d[0], REMOVABLE.encode()[d[3] : d[4]].decode(), d[5]) for d in found])


# Names across files

LINKED = {
    "/p/core.py": "def made():\n    return 1\n\n\ndef unused():\n    return 2\n",
    "/p/core.pyi": "def made() -> int: ...\ndef only_here() -> int: ...\n",
    "/p/main.py": "from core import made\n\nmade()\nINSTALLED = ['corsheaders', 'xx', 'plain words', 'rest_framework.authtoken']\n",
    "/p/broken.py": "from core import unused\n\nunused(\n",
    "/p/conftest.py": "import pytest\n\n\n@pytest.fixture\ndef basket():\n    return []\n\n\n@pytest.fixture\ndef shadowed():\n    return 0\n\n\n@pytest.fixture\ndef forgotten():\n    return 0\n",
    "/p/shop/test_shop.py": "import pytest\n\n\n@pytest.fixture\ndef shadowed():\n    return 1\n\n\ndef test_it(basket, shadowed):\n    assert basket\n\n\ndef helper(forgotten):\n    return forgotten\n",
    "/p/ring_a.py": "from ring_b import nothing\n",
    "/p/ring_b.py": "from ring_a import nothing\n\nnothing()\n",
}


def linked(spark: SparkSession, hops: int) -> FactSet:
    """Facts of these files and of a chain of imports."""
    chain = {f"/p/hop{k}.py": f"from hop{k + 1} import target\n" for k in range(hops)} | {f"/p/hop{hops}.py": "def target():\n    return 1\n"}
    dists = frame(spark, "top_level VARCHAR, dist VARCHAR", [("corsheaders", "django-cors-headers"), ("rest_framework", "djangorestframework"), ("pytest", "pytest"), ("xx", "xx")])
    return project_facts(frame(spark, "path VARCHAR, text VARCHAR", (LINKED | chain).items()), "/p", Config(), dists)


@query(rows("definition VARCHAR, place VARCHAR, used_in VARCHAR", [
    ("made", "core.py", "main.py"), ("unused", "core.py", "broken.py"), ("basket", "conftest.py", "shop/test_shop.py"), ("shadowed", "shop/test_shop.py", "shop/test_shop.py"), *(("target", "hop12.py", f"hop{k}.py") for k in range(12)),
]))
def code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of definitions in other files, of fixtures by parameters, and of what a stub declares; by chains of imports of any length."""
    f = linked(spark, 12)
    names, use = f.files.select(F.col("file_id").alias("def_file"), F.col("rel_path").alias("place")), f.files.select(F.col("file_id").alias("use_file"), F.col("rel_path").alias("used_in"))
    defs = f.symbols.select(F.col("file_id").alias("def_file"), F.col("name_start").alias("def_start"), F.col("name").alias("definition"))
    got = f.refs.join(defs, ["def_file", "def_start"]).join(names, "def_file").join(use, "use_file")
    return got.select("definition", "place", "used_in").distinct()


@query(rows("definition VARCHAR, uses BIGINT, files BIGINT", [("made", 2, 1), ("unused", 3, 1), ("basket", 1, 1), ("shadowed", 1, 1), ("target", 2, 2)]))
def code_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = linked(spark, 2)
    defs = f.symbols.select(F.col("file_id").alias("def_file"), F.col("name_start").alias("def_start"), F.col("name").alias("definition"))
    return uses_by_definition(f.refs).join(defs, ["def_file", "def_start"]).select("definition", "uses", "files")


@query(rows("top_level VARCHAR, place VARCHAR, dist VARCHAR", [("corsheaders", "main.py", "django-cors-headers"), ("rest_framework", "main.py", "djangorestframework"), ("pytest", "conftest.py", "pytest"), ("pytest", "shop/test_shop.py", "pytest")]))
def code_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External modules in use, those that only a string names among them."""
    f = linked(spark, 2)
    return f.ext_imports.join(f.files, "file_id").select("top_level", F.col("rel_path").alias("place"), F.array_join("distributions", ",").alias("dist")).distinct()


@query(rows("path VARCHAR, resolution VARCHAR", [("/q/a.py", "semantic"), ("/q/b.py", "unparsed"), ("/q/c.py", "by-name"), ("/q/d.py", "abandoned")]))
def code_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that does not parse or takes too long gives its names only; one that takes too long even so gives nothing."""
    import pandas as pd

    from .functions import scan
    from .sources import project

    class Slow:
        def __init__(self, text: str, *more: object):
            if "slow" in text:
                raise TimeoutError
            scan.Scan.__init__(self, text, *more)

    def run(batches):
        whole, names = project.Scan, project.names_only

        def slow_names(text, *more):
            if "slowest" in text:
                raise TimeoutError
            return names(text, *more)

        project.Scan, project.names_only = type("S", (scan.Scan,), {"__init__": Slow.__init__}), slow_names
        try:
            for out in _scanner("/q", "lodestone")(batches):
                yield pd.DataFrame(out[["path", "resolution"]])
        finally:
            project.Scan, project.names_only = whole, names

    src = frame(spark, "path VARCHAR, text VARCHAR", [("/q/a.py", "x = 1\n"), ("/q/b.py", "def (:\n"), ("/q/c.py", "slow = 1\n"), ("/q/d.py", "slowest = 1\n")])
    return src.mapInPandas(run, "path string, resolution string")


@query(rows("path VARCHAR", [("/r/b.py",)]))
def code_slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = FactSet.from_rows(spark, resolutions=[{"file_id": k, "path": f"/r/{p}.py", "resolution": "semantic", "seconds": s} for k, (p, s) in enumerate([("a", 0.1), ("b", 0.9), ("c", 0.3)])])
    return slowest(f).select("path")


# Manifests


@query(rows("manifest VARCHAR, project VARCHAR, dependency VARCHAR, group_kind VARCHAR, group_name VARCHAR", [
    *(("pyproject.toml", "shop-app", *x) for x in [("pyyaml", "main", None), ("requests", "main", None), ("uvloop", "optional", "fast"), ("ruff", "group", "lint"), ("ruff", "group", "dev"), ("pytest", "group", "dev"), ("sphinx", "group", "docs")]),
    ("legacy/setup.cfg", None, "django", "main", None), ("legacy/setup.cfg", None, "mypy", "main", None), ("sub/setup.cfg", "shop-sub", "attrs", "main", None), ("sub/setup.cfg", "shop-sub", "numpy", "main", None),
    ("requirements.txt", None, "click", "group", "more"), ("requirements.txt", None, "flask", "group", "base"),
]))
def code_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifests of a tree declare; the last two rows are those of the requirement files of its top alone."""
    found = [(str(Path(path).relative_to(PROJECT)), m.name, *d) for _, path, m in manifests.manifests(str(PROJECT)) for d in m.dependencies]
    found += [("requirements.txt", None, *d) for d in manifests.read_requirements(str(PROJECT)).dependencies]
    return frame(spark, "manifest VARCHAR, project VARCHAR, dependency VARCHAR, group_kind VARCHAR, group_name VARCHAR", found)


@query(rows("kind VARCHAR, module VARCHAR, attribute VARCHAR", [("script", "shop.cli", "main"), ("plugin", "shop.csv_plugin", None), ("gui", "shop.gui", "show"), ("script", "shop_sub.main", "go")]))
def code_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.tables(spark, manifests.manifests(str(PROJECT)))["entry_points"]


@query(rows("setting VARCHAR, value VARCHAR", [
    ("exclude", "old/**"), ("ignore_names", "legacy_*"), ("ignored_dependencies", "ruff"), ("tests.files", "check_*.py"), ("tests.classes", "Test"), ("legacy.functions", "check"),
    ("layers", "shop.api|shop.core,shop.store"), ("rules", "shop.core!requests?requests.models"), ("check_type_only", "True"), ("hexagonal", "x.adapters,x.api,x.infrastructure,x.infra|x.application,x.services|x.domain"), ("empty", "boundaries: neither layers nor rules"),
]))
def code_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = manifests.settings(str(PROJECT), manifests.read_directory(str(PROJECT))[1])
    ranks = lambda b: "|".join(",".join(r) for r in b.layers)
    try:
        manifests.boundaries({})
        empty = ""
    except ValueError as e:
        empty = str(e)
    b = c.boundaries
    found = [(k, ",".join(getattr(c, k))) for k in ("exclude", "ignore_names", "ignored_dependencies")]
    found += [("tests.files", ",".join(c.tests.files)), ("tests.classes", ",".join(c.tests.classes)), ("legacy.functions", ",".join(manifests.pytest_settings(str(PROJECT / "legacy"), {}).functions))]
    found += [("layers", ranks(b)), ("rules", "".join(f"{r.source}!{','.join(r.deny)}?{','.join(r.allow)}" for r in b.rules)), ("check_type_only", str(b.check_type_only)), ("hexagonal", ranks(manifests.boundaries({"preset": "hexagonal", "root": "x"}))), ("empty", empty)]
    return frame(spark, "setting VARCHAR, value VARCHAR", found)


@query(rows("path VARCHAR, root VARCHAR", [("sub", "sub"), ("legacy", "legacy"), ("requirements", "."), (".", ".")]))
def code_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory that a path belongs to, by its manifests."""
    return frame(spark, "path VARCHAR, root VARCHAR", [(p, str(Path(manifests.find_root(str(PROJECT / p))).relative_to(PROJECT))) for p in ("sub", "legacy", "requirements", ".")])


# Sinks

FOUND = [
    ("unused-function", "/r/a.py", 3, 5, "low", "function `f|g` is never used", "f"),
    ("missing-dependency", "/r/b.py", 1, 8, "medium", "`x` is imported but `x` is not a declared dependency; it arrives through `y`", None),
    ("unused-file", "/r/c.py", None, None, "medium", "file `c` is never imported or run", None),
]


def found(spark: SparkSession) -> DataFrame:
    return finding(frame(spark, "rule VARCHAR, path VARCHAR, line INTEGER, column INTEGER, confidence VARCHAR, message VARCHAR, symbol VARCHAR", FOUND))


def lines(spark: SparkSession, text: str) -> DataFrame:
    return frame(spark, "n INTEGER, line VARCHAR", [(k, x) for k, x in enumerate(text.split("\n"))])


@query(rows("n INTEGER, line VARCHAR", enumerate([
    "/r/a.py:3:5  function `f|g` is never used", "/r/b.py:1:8  `x` is imported but `x` is not a declared dependency; it arrives through `y`", "/r/c.py  file `c` is never imported or run", "", "Kept by plugins:",
    "/r/k.py:7:1  `k` kept by flask: view method", "", "3 finding(s) in 9 files.", "",
])))
def code_sink_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = frame(spark, "path VARCHAR, module VARCHAR, symbol VARCHAR, line INTEGER, column INTEGER, plugin VARCHAR, why VARCHAR", [("/r/k.py", "k", "k", 7, 1, "flask", "view method")])
    return lines(spark, sinks.human(found(spark), "dead-code", 9, kept))


@query(rows("n INTEGER, line VARCHAR", [(0, '{"schema_version":1,"kind":"deps","summary":{"files_scanned":9,"findings":2},"findings":[{"rule":"unused-function","path":"/r/a.py","line":3,"column":5,"confidence":"low","message":"function `f|g` is never used","symbol":"f"},{"rule":"unused-file","path":"/r/c.py","confidence":"medium","message":"file `c` is never imported or run"}]}')]))
def code_sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sinks.to_json(found(spark).where("rule <> 'missing-dependency'"), "deps", {"files_scanned": 9}))


@query(rows("rule VARCHAR, level VARCHAR, uri VARCHAR, start_line INTEGER, start_column INTEGER, rules INTEGER", [("unused-function", "note", "a.py", 3, 5, 14), ("missing-dependency", "warning", "b.py", 1, 8, 14), ("unused-file", "warning", "c.py", None, None, 14)]))
def code_sink_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = json.loads(sinks.sarif(found(spark), "/r"))["runs"][0]
    place = lambda r: r["locations"][0]["physicalLocation"]
    return frame(spark, "rule VARCHAR, level VARCHAR, uri VARCHAR, start_line INTEGER, start_column INTEGER, rules INTEGER", [(r["ruleId"], r["level"], place(r)["artifactLocation"]["uri"], place(r)["region"].get("startLine"), place(r)["region"].get("startColumn"), len(run["tool"]["driver"]["rules"])) for r in run["results"]])


@query(rows("value VARCHAR", [
    ("::notice file=a.py,line=3,col=5,title=lodestone unused-function::function `f|g` is never used",), ("::warning file=b.py,line=1,col=8,title=lodestone missing-dependency::`x` is imported but `x` is not a declared dependency; it arrives through `y`",),
    ("::warning file=c.py,title=lodestone unused-file::file `c` is never imported or run",),
]))
def code_sink_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.annotations(found(spark), "/r")


@query(rows("n INTEGER, line VARCHAR", enumerate([
    "<!-- lodestone -->", "**lodestone**: 1 finding(s) in 9 files.", "", "| Rule | Location | Finding | Confidence |", "| --- | --- | --- | --- |", "| `unused-function` | `a.py:3` | function `f\\|g` is never used | low |", "",
])))
def code_sink_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sinks.markdown(found(spark).where("confidence = 'low'"), 9, "/r", marker=True))


@query(rows("n INTEGER, line VARCHAR", enumerate([
    "files_scanned=9", "--", "missing-dependency\tmedium\tb.py:1:8\t-\t`x` is imported but `x` is not a declared dependency; it arrives through a declared dependency", "unused-file\tmedium\tc.py\t-\tfile `c` is never imported or run",
    "unused-function\tlow\ta.py:3:5\tf\tfunction `f|g` is never used", "",
])))
def code_sink_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sinks.snapshot(found(spark), {"files_scanned": 9}, "/r"))


@query(rows("rule VARCHAR, path VARCHAR, symbol VARCHAR, line INTEGER", [("missing-dependency", "b.py", None, None), ("unused-file", "c.py", None, None), ("unused-function", "a.py", "f", None)]))
def code_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a written baseline holds."""
    doc = json.loads(lifecycle.write_baseline(found(spark).union(found(spark)), "/r"))
    return frame(spark, "rule VARCHAR, path VARCHAR, symbol VARCHAR, line INTEGER", [tuple(x.get(k) for k in ("rule", "path", "symbol", "line")) for x in doc["findings"]])


@query(rows("rule VARCHAR", [("missing-dependency",)]))
def code_finalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline, then changed files, then confidence."""
    base = frame(spark, "rule VARCHAR, path VARCHAR, symbol VARCHAR, owner VARCHAR, line INTEGER", [("unused-file", "c.py", None, None, None)])
    changed = frame(spark, "path VARCHAR", [("/r/a.py",), ("/r/b.py",), ("/r/c.py",)])
    return lifecycle.finalise(found(spark), base, changed, "medium", "/r").select("rule")


@query(rows("n INTEGER, line VARCHAR", enumerate(["layers = [", '    ["shop.api", "shop.core", "shop.domain", "shop.left", "shop.lost", "shop.maze", "shop.rates", "shop.right"],', "]", "# tangled: shop.api, shop.domain", "# tangled: shop.core, shop.rates", ""])))
def code_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers that the example's imports suggest, as settings."""
    return lines(spark, boundaries.layers_toml(*boundaries.suggest(examples.facts(spark))))


# Fixes

BEFORE = "import os\nimport json as j, sys\nfrom a import (b,\n    c)\n\n\ndef dead():\n    return os.name, j, c\n\n\n\ndef live():\n    return sys, b\n\n\nclass Box:\n    def only(self):\n        return 1\n"
AFTER = "import sys\nfrom a import b\n\n\n\ndef live():\n    return sys, b\n\n\nclass Box:\n    def only(self):\n        return 1\n"


@query(rows("path VARCHAR, removed VARCHAR, new VARCHAR, reason VARCHAR", [("/f/m.py", "dead", AFTER, None), ("/f/m.py", "only", None, fix.WOULD_EMPTY), ("/f/m.py", "nowhere", None, fix.WRONG_LEVEL), ("/f/gone.py", None, None, None)]))
def code_fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and the imports that only they used go; what cannot go has a reason; unused files go whole."""
    f = project_facts(frame(spark, "path VARCHAR, text VARCHAR", [("/f/m.py", BEFORE), ("/f/gone.py", "x = 1\n")]), "/f")
    at = [("unused-function", "/f/m.py", 7, 5, "high", "x", "dead"), ("unused-method", "/f/m.py", 17, 9, "high", "y", "only"), ("unused-function", "/f/m.py", 99, 1, "high", "z", "nowhere"), ("unused-file", "/f/gone.py", None, None, "high", "w", None)]
    plan = fix.plan(f, finding(frame(spark, "rule VARCHAR, path VARCHAR, line INTEGER, column INTEGER, confidence VARCHAR, message VARCHAR, symbol VARCHAR", at)))
    none = F.lit(None).cast("string")
    edits = plan.edits.select("path", F.array_join("removed", ",").alias("removed"), "new", none.alias("reason"))
    return edits.union(plan.skipped.select("path", "symbol", none, "reason")).union(plan.deletions.select("path", none, none, none))


@query(rows("module VARCHAR, score INTEGER, hotspots BIGINT", [("shop.maze", 86, 1)]))
def code_worst_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = health.analyze(examples.facts(spark), examples.CONFIG.limits)
    return h.worst_files().where("score < 100").select("module", F.col("score").cast("int").alias("score"), "hotspots")

