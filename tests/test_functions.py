"""Syntax functions: metrics, tokens, rewriting, suppression comments."""

import ast

import pytest

from lodestone.functions.metrics import measure
from lodestone.functions.rewrite import prune_imports, remove_block
from lodestone.functions.scan import Scan, module_of
from lodestone.functions.tokens import clone_tokens, deletables, suppressions
from lodestone.rulebook import RULES
from lodestone.sources.manifests import boundaries, normalized, read_pyproject, read_requirements, read_setup_cfg, read_setup_py, requirement


def metrics(source):
    return measure(ast.parse(source), source)


@pytest.mark.parametrize(
    ("body", "cyclomatic", "cognitive", "nesting"),
    [
        ("    return x\n", 1, 0, 0),
        ("    if x:\n        return 1\n    elif x > 2:\n        return 2\n    elif x > 3:\n        return 3\n    else:\n        return 4\n", 4, 4, 1),
        ("    if x:\n        return 1\n    else:\n        if x > 2:\n            return 2\n", 3, 4, 2),
        ("    for a in x:\n        while a:\n            if a:\n                pass\n", 4, 6, 3),
        ("    for a in x:\n        pass\n    else:\n        pass\n", 2, 2, 1),
        ("    match x:\n        case 1:\n            pass\n        case 2 if x:\n            pass\n        case _:\n            pass\n", 4, 1, 1),
        ("    try:\n        pass\n    except ValueError:\n        pass\n    finally:\n        pass\n", 2, 1, 1),
        ("    with x as y, y:\n        assert y\n", 3, 0, 0),
        ("    return x and x or x\n", 3, 2, 0),
        ("    return [a for a in x if a if a > 1]\n", 4, 0, 0),
        ("    return lambda: 1 if x else 2\n", 2, 2, 2),
        ("    return f(x - 1)\n", 1, 1, 0),
        ("    def g():\n        if x:\n            pass\n    return g\n", 1, 0, 0),
        ("    return f'{1 if x else 2}'\n", 1, 0, 0),
    ],
)
def test_complexity(body, cyclomatic, cognitive, nesting):
    m = metrics("def f(x):\n" + body)[0]
    assert (m.cyclomatic, m.cognitive, m.max_nesting) == (cyclomatic, cognitive, nesting)


def test_owner_and_order():
    src = "class C:\n    @dec\n    async def m(self, *a, k=1, **kw):\n        def inner():\n            pass\n\ndef top(): pass\n"
    got = metrics(src)
    assert [m.qualified for m in got] == ["C.m", "inner", "top"]
    assert got[0].parameters == 4 and (got[0].line, got[0].column, got[0].lines) == (3, 15, 3)


def test_tokens():
    src = '"""Doc."""\nimport os\nx = [1, "a"]  # note\n\nif x:\n    y(2)\n'
    got = clone_tokens(src, ast.parse(src))
    assert not any(t[1] in ("import", "os") or "Doc" in t[1] for t in got)
    assert [(t[1], t[3]) for t in got if t[2] == 3][:4] == [("x", "statement"), ("=", "statement"), ("[", "expression"), ("1", "expression")]
    assert [t[0] for t in got if t[2] == 6][0] == "indent"


def test_deletables():
    src = "X = 1\n\n@dec\ndef f():\n    pass\n\nclass C:\n    def only(self):\n        pass\n"
    got = {d[0]: d for d in deletables(ast.parse(src), src)}
    assert src.encode()[got["f"][3] : got["f"][4]] == b"@dec\ndef f():\n    pass\n"
    assert got["only"][5] and not got["C"][5]


def test_suppression_grammar():
    src = "a = 1  # lodestone: ignore\nb = 2  #lodestone:ignore[ unused-class , nonsense ]\nc = 3  # lodestone: ignore[nonsense]\nd = 4  # lodestone: ignorefoo\ne = 5  # lodestone: ignore [unused-file]\n# lodestone: ignore-file\n"
    assert suppressions(src, tuple(RULES)) == [(1, "all", []), (2, "rules", ["unused-class"]), (5, "rules", ["unused-file"]), (6, "file", [])]


def test_rewriting():
    src = "import os\n\n\ndef a():\n    pass\n\n\ndef b():\n    pass\n"
    start = src.index("def a")
    assert remove_block(src, start, start + len("def a():\n    pass\n")) == "import os\n\n\ndef b():\n    pass\n"
    assert prune_imports("import os\nimport json as j, sys\n\nprint(sys)\n", "def a():\n    return os.x(j)\n") == "import sys\n\nprint(sys)\n"
    assert prune_imports("import os\n\nprint(1)\n", "def d():\n    pass\n") == "import os\n\nprint(1)\n"
    assert prune_imports("import (\n", "x") == "import (\n"


def test_scan():
    s = Scan("import os\nfrom . import b as c\nfrom .d import *\n\ndef f(os, q):\n    return os.x, c.y, 'pkg.mod.attr', getattr(q, 'zed')\n", "p.m", False)
    assert [(i["module"], i["attr"]) for i in s.facts["imports"]] == [("os", None), ("p", "b"), ("p.d", "*")]
    assert [u["name"] for u in s.facts["uses"]] == ["c.y", "getattr"]
    assert s.facts["strings"][0]["name"] == "pkg.mod.attr" and {"x", "y", "zed"} <= set(s.facts["attr_names"])
    assert module_of("src/a/__init__.py") == "a" and module_of("a-b/c.py") is None


def test_manifests(tmp_path):
    m = read_pyproject('[project]\nname = "My_App"\ndependencies = ["A.b>=1", "c[x]; python_version>\'3\'"]\n[project.optional-dependencies]\ndev = ["d"]\n[dependency-groups]\nall = [{include-group = "t"}, "e"]\nt = ["f"]\n[project.scripts]\ngo = "my.app:main.run"\n')
    assert m.name == "my-app" and m.dependencies == [("a-b", "main", None), ("c", "main", None), ("d", "optional", "dev"), ("f", "group", "all"), ("e", "group", "all"), ("f", "group", "t")]
    assert m.entry_points == [("script", "my.app", "main")]
    assert read_setup_py("from setuptools import setup\nsetup(name='x', install_requires=['a'], extras_require={'t': 'b'}, entry_points={'console_scripts': ['q = m:f']})").entry_points == [("script", "m", "f")]
    assert read_setup_cfg("[options]\ninstall_requires =\n  a\n  b>1\n[options.entry_points]\ngui_scripts =\n  g = n:h\n").dependencies == [("a", "main", None), ("b", "main", None)]
    (tmp_path / "requirements.txt").write_text("a==1\n-r requirements-dev.txt\n# no\n-e .\n")
    (tmp_path / "requirements-dev.txt").write_text("b\n-r requirements.txt\n")
    assert read_requirements(str(tmp_path)).dependencies == [("a", "main", None), ("b", "main", None)]
    assert requirement("git+https://x/y") is None and normalized("A__b..C-") == "a-b-c"
    with pytest.raises(ValueError):
        boundaries({})
    assert boundaries({"preset": "hexagonal", "root": "r"}).layers[2] == ("r.domain",)
