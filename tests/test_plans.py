"""The analyses on hand-made facts and on the example project."""

import pytest

from lodestone import examples
from lodestone.config import Boundaries, Config, DenyRule, Limits
from lodestone.facts import FactSet
from lodestone.operators import graph, joins, lifecycle
from lodestone.plans import boundaries, cycles, dead_code, deps, health
from lodestone.queries import ORACLE_SQL, QUERIES

from . import plain


def file(k, path, **more):
    module = path.removesuffix(".py").replace("/__init__", "").replace("/", ".")
    return {"file_id": k, "path": f"/r/{path}", "rel_path": path, "module": module, "main_guard": False, "exports": [], "reads_globals": False, "reported": True} | more


def symbol(f, k, name, kind="function", parent=None, **more):
    at = 100 * k
    return {"file_id": f, "ordinal": k, "name": name, "kind": kind, "parent_ordinal": parent, "decorators": [], "bases": [], "class_keywords": [], "name_start": at + 10, "name_end": at + 20, "full_start": at, "full_end": at + 90, "line": 10 * k + 1, "column": 5, "full_line": 10 * k + 1} | more


def decorator(name, module=None, call="called", keywords=()):
    return {"name": name, "keywords": list(keywords), "module": module, "provenance": "unknown", "call": call}


def edge(src, dst, seq=1, kind="runtime", line=1, names="explicit"):
    return {"src_file": src, "seq": seq, "target_file": dst, "line": line, "column": 1, "kind": kind, "names": names}


def test_verdicts(spark):
    f = FactSet.from_rows(
        spark,
        files=[file(0, "pkg/a.py", exports=["exported"]), file(1, "pkg/b.py"), file(2, "docs/conf.py"), file(3, "pkg/test_x.py"), file(4, "pkg/models.py")],
        symbols=[
            symbol(0, 0, "used"), symbol(0, 1, "recursive"), symbol(0, 2, "external"), symbol(0, 3, "exported"), symbol(0, 4, "_private"), symbol(0, 5, "__dunder__"), symbol(0, 6, "Klass", "class"),
            symbol(0, 7, "called_somewhere", "method", 6), symbol(0, 8, "lonely", "method", 6), symbol(0, 9, "_mine", "field", 6), symbol(0, 10, "prop", "property", 6, decorators=[decorator("prop.setter")]),
            symbol(0, 11, "route", decorators=[decorator("app.get")]), symbol(0, 12, "lookalike", decorators=[decorator("app.get", "pkg.own")]), symbol(0, 13, "quiet"), symbol(0, 14, "asked"), symbol(0, 15, "local_var", "function", 0),
            symbol(0, 16, "handler", decorators=[decorator("registry.add")]), symbol(0, 17, "visit_x", "method", 6), symbol(0, 18, "over", "method", 6),
            symbol(2, 0, "project"), symbol(3, 0, "test_it"), symbol(3, 1, "helper"), symbol(4, 0, "Thing", "class", bases=["models.Model"]),
        ],
        refs=[{"def_file": 0, "def_start": 10, "use_file": 1, "use_start": 5, "use_end": 9}, {"def_file": 0, "def_start": 110, "use_file": 0, "use_start": 150, "use_end": 159}, {"def_file": 0, "def_start": 210, "use_file": None, "use_start": None, "use_end": None}, {"def_file": 0, "def_start": 1310, "use_file": 0, "use_start": 1350, "use_end": 1355}],
        attr_names=[{"name": "called_somewhere"}, {"name": "asked"}], attr_prefixes=[{"prefix": "visit_"}], overrides=[{"file_id": 0, "ordinal": 18}],
        suppressions=[{"file_id": 0, "seq": 0, "line": 131, "scope_kind": "all", "rules": []}, {"file_id": 0, "seq": 1, "line": 1, "scope_kind": "all", "rules": []}, {"file_id": 0, "seq": 2, "line": 41, "scope_kind": "rules", "rules": ["unused-class"]}],
        imports=[edge(1, 0), edge(1, 3), edge(1, 4), edge(0, 1)],
    )
    v = {(r.file_id, r.name): (r.verdict, r.reason.plugin if r.reason else None) for r in dead_code.verdicts(f, Config()).collect()}
    assert v == {
        (0, "used"): ("used", None), (0, "recursive"): ("dead", None), (0, "external"): ("used", None), (0, "exported"): ("kept", "python"), (0, "_private"): ("dead", None), (0, "Klass"): ("dead", None),
        (0, "called_somewhere"): ("used", None), (0, "lonely"): ("dead", None), (0, "_mine"): ("dead", None), (0, "route"): ("kept", "fastapi"), (0, "lookalike"): ("dead", None), (0, "quiet"): ("suppressed", None),
        (0, "asked"): ("dead", None), (0, "handler"): ("dead", None), (0, "visit_x"): ("used", None), (0, "over"): ("kept", "python"), (2, "project"): ("kept", "python"), (3, "test_it"): ("kept", "pytest"), (3, "helper"): ("dead", None), (4, "Thing"): ("kept", "django"),
    }
    report = dead_code.analyze(f, Config())
    got = {r.symbol or f"line {r.line}": (r.rule, r.confidence) for r in report.findings.collect()}
    assert got == {
        "recursive": ("unused-function", "medium"), "_private": ("unused-function", "high"), "Klass": ("unused-class", "medium"), "lonely": ("unused-method", "low"), "_mine": ("unused-attribute", "medium"),
        "lookalike": ("unused-function", "low"), "asked": ("unused-function", "low"), "handler": ("unused-function", "low"), "helper": ("unused-function", "medium"), "line 1": ("unused-suppression", "high"), "line 41": ("unused-suppression", "high"),
    }


def test_cycles(spark):
    files = [file(k, f"p/{c}.py") for k, c in enumerate("abcdef")]
    e = [edge(0, 1), edge(1, 2), edge(2, 0), edge(1, 0, seq=2, line=7), edge(3, 4), edge(4, 3, kind="deferred"), edge(5, 5), edge(4, 5, kind="type-only"), edge(5, 4)]
    f = FactSet.from_rows(spark, files=files, imports=e)
    assert [r.message for r in cycles.analyze(f).collect()] == ["import cycle among 3 modules, shortest: p.a -> p.b -> p.a"]
    assert [r.message for r in cycles.analyze(f, deferred=True).collect()][1:] == ["import cycle: p.d -> p.e -> p.d"]
    assert len(cycles.analyze(f, all_cycles=True).collect()) == 2


def test_reach_stops_at_the_bound(spark):
    """A root and the nearest others are visited, no more; what they point at is reached."""
    e = [(0, k) for k in range(1, 6)] + [(k, 10 * k + j) for k in range(1, 6) for j in range(3)] + [(10, 0), (30, 99)]
    edges, roots = spark.createDataFrame(e, "src int, dst int"), spark.createDataFrame([(0,), (98,)], "root int")
    got = lambda most: {r.node for r in graph.reachable(edges, roots, most=most).collect()}
    assert got(1) == {1, 2, 3, 4, 5} and got(3) == {1, 2, 3, 4, 5, 10, 11, 12, 20, 21, 22}
    assert got(500) == {0, 99, *range(1, 6), *(10 * k + j for k in range(1, 6) for j in range(3))}


def test_simple_cycles_stop():
    full = {k: [j for j in range(8) if j != k] for k in range(8)}
    got = graph.simple_cycles(full, 25)
    assert len(got) == 25 and len({tuple(c) for c in got}) == 25 and all(c[0] == min(c) for c in got)


def test_health(spark):
    m = lambda f, k, cyc, cog, lines, params: {"file_id": f, "seq": k, "name": f"f{k}", "owner": None, "line": k + 1, "column": 5, "lines": lines, "parameters": params, "cyclomatic": cyc, "cognitive": cog, "max_nesting": 1}
    f = FactSet.from_rows(spark, files=[file(0, "pkg/a/x.py"), file(1, "pkg/a/y.py"), file(2, "solo.py")], function_metrics=[m(0, 0, 14, 22, 80, 3), m(0, 1, 30, 60, 200, 9), m(1, 0, 2, 1, 10, 1), m(2, 0, 203, 0, 5, 0)])
    h = health.analyze(f, Limits())
    assert [(r.function, r.cognitive) for r in h.findings.collect()] == [("f1", 60), ("f0", 22)]
    p = h.packages.collect()
    assert [(r.package, r.functions, r.hotspots) for r in p] == [("pkg.a", 3, 2)]
    # Penalties by hand: 20+21+15 = 56 over 80 lines, 100 over 200, 0 over 10, 100 over 5.
    assert p[0].score == 100 - (56 * 80 + 100 * 200) // 290
    project = h.project.first()
    assert (project.score, project.grade, project.max_cyclomatic) == (100 - (56 * 80 + 100 * 200 + 100 * 5) // 295, "F", 203)
    empty = health.analyze(FactSet.from_rows(spark, files=[file(0, "a.py")])).project.first()
    assert (empty.score, empty.functions) == (100, 0)


BLOCK = [f"t{k}" for k in range(15)]


def stream(*parts):
    return [(t, 1 + k // 3, True) for k, t in enumerate([x for p in parts for x in p])]


@pytest.mark.parametrize(
    ("streams", "size", "lines", "expected"),
    [
        ({0: stream("xyz", BLOCK), 1: stream(BLOCK, "qrs")}, 10, 3, [(15, [(0, 3), (1, 0)])]),
        ({0: stream(BLOCK), 1: stream(BLOCK), 2: stream("abc", BLOCK)}, 10, 3, [(15, [(0, 0), (1, 0), (2, 3)])]),
        ({0: stream(BLOCK, "___", BLOCK)}, 10, 3, [(15, [(0, 0), (0, 18)])]),
        ({0: stream(BLOCK), 1: stream(BLOCK)}, 20, 3, []),
        ({0: stream(BLOCK), 1: stream(BLOCK)}, 10, 20, []),
        ({0: [(t, k, False) for k, (t, _, _) in enumerate(stream(BLOCK))], 1: [(t, k, False) for k, (t, _, _) in enumerate(stream(BLOCK))]}, 10, 3, []),
    ],
)
def test_tiling(streams, size, lines, expected):
    assert plain.tile(streams, size, lines, strict=False) == expected


def test_boundaries(spark):
    names = ["app/api/r.py", "app/domain/m.py", "app/util.py", "other/x.py"]
    files = [file(k, n) for k, n in enumerate(names)]
    e = [edge(1, 0, 1, line=3), edge(1, 0, 2, line=9), edge(0, 1), edge(0, 2, kind="type-only"), edge(1, 2, 3, line=5), edge(3, 2, line=2), edge(1, 3, 4, "deferred", 6)]
    f = FactSet.from_rows(spark, files=files, imports=e)
    conf = Boundaries(layers=(("app.api",), ("app.domain", "other")), rules=(DenyRule("app", ("app.util", "other"), ("other.y",)), DenyRule("app.domain", ("other",))))
    got = [(r.path, r.line, r.to_module, r.rule_text) for r in boundaries.analyze(f, conf).collect()]
    assert got == [
        ("/r/app/domain/m.py", 3, "app.api.r", "layer `app.domain|other` may not depend on the layer above it, `app.api`"),
        ("/r/app/domain/m.py", 5, "app.util", "`app` may not import `app.util`"),
        ("/r/app/domain/m.py", 6, "other.x", "`app` may not import `other`"),
    ]
    conf.check_type_only = True
    assert ("/r/app/api/r.py", 1, "app.util", "`app` may not import `app.util`") in [(r.path, r.line, r.to_module, r.rule_text) for r in boundaries.analyze(f, conf).collect()]
    layers, tangles = boundaries.suggest(f)
    assert [r.packages for r in tangles.collect()] == [["app.api", "app.domain"]]
    assert boundaries.layers_toml(layers, tangles).startswith("layers = [\n")


def test_deps(spark):
    f = FactSet.from_rows(
        spark,
        files=[file(0, "backend/a.py"), file(1, "scripts/t.py")],
        scopes=[{"scope_id": 0, "manifest_path": "/r/pyproject.toml", "directory": "/r", "name": "mine"}, {"scope_id": 1, "manifest_path": "/r/backend/pyproject.toml", "directory": "/r/backend", "name": "back"}],
        dependencies=[{"scope_id": s, "seq": k, "name": n, "group_kind": g, "group_name": h} for k, (s, n, g, h) in enumerate([(0, "ruff", "main", None), (0, "mine", "optional", "all"), (1, "pyyaml", "main", None), (1, "fastapi", "main", None), (1, "lonely", "optional", "x"), (1, "lonely", "group", "y")])],
        ext_imports=[{"file_id": a, "seq": k, "top_level": t, "line": k + 1, "column": 1, "origin": o, "distributions": d, "condition": c} for k, (a, t, o, d, c) in enumerate([(0, "yaml", "unresolved", [], "always"), (0, "starlette", "site-packages", ["starlette"], "always"), (0, "fastapi", "site-packages", ["fastapi"], "always"), (1, "nowhere", "unresolved", [], "always"), (1, "guarded", "unresolved", [], "version"), (1, "yaml", "site-packages", ["pyyaml"], "always")])],
        dist_requires=[{"dist": "fastapi", "requires": "starlette"}],
    )
    got = {(r.rule, r.path, r.distribution or r.modules[0], r.confidence) for r in deps.analyze(f).collect()}
    assert got == {
        ("unused-dependency", "/r/backend/pyproject.toml", "lonely", "low"), ("missing-dependency", "/r/backend/a.py", "starlette", "low"),
        ("unresolved-import", "/r/scripts/t.py", "nowhere", "low"), ("missing-dependency", "/r/scripts/t.py", "pyyaml", "medium"),
    }


def test_lifecycle(spark, tmp_path):
    from lodestone.facts import finding

    rows = [("unused-function", "/r/a.py", 3, "low", "f", None), ("unused-function", "/r/b.py", 9, "high", "g", "C"), ("duplicate-code", "/r/b.py", 4, "high", None, None), ("unused-file", "/r/c.py", None, "medium", None, None)]
    f = finding(spark.createDataFrame(rows, "rule string, path string, line int, confidence string, symbol string, owner string"))
    path = tmp_path / "base.json"
    path.write_text(lifecycle.write_baseline(f.where("line is null or line <> 4"), "/r"))
    moved = f.selectExpr("rule", "path", "line + 1 as line", "confidence", "symbol", "owner")
    left = lifecycle.apply_baseline(finding(moved), lifecycle.read_baseline(spark, str(path)), "/r")
    assert [(r.rule, r.line) for r in left.collect()] == [("duplicate-code", 5)]
    assert {r.path for r in lifecycle.min_confidence(f, "medium").collect()} == {"/r/b.py", "/r/c.py"}
    changed = spark.createDataFrame([("/r/a.py",)], "path string")
    assert [r.path for r in lifecycle.since(f, changed).collect()] == ["/r/a.py"]


def test_spans_inside_earlier_ones_go(spark):
    rows = [(1, 0, 100, 0), (1, 0, 100, 1), (1, 10, 50, 2), (1, 90, 120, 3), (1, 95, 110, 4), (2, 5, 6, 5)]
    got = joins.outermost(spark.createDataFrame(rows, "g int, a int, b int, k int"), ["g"], "a", "b", ["k"]).where("not __enclosed")
    assert sorted(r.k for r in got.collect()) == [0, 3, 5]


@pytest.mark.parametrize("name", ["code_dead_code", "code_cycles", "code_boundaries", "code_deps"])
def test_example_project(spark, name):
    import duckdb

    got = QUERIES[name](spark, "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duckdb.sql(ORACLE_SQL[name]).fetchall()))
    assert examples.SOURCES
