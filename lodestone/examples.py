"""A small project on which the analyses run end to end, and their driver queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Boundaries, Config, DenyRule
from .facts import FactSet
from .plans import boundaries, cycles, dead_code, deps, dupes, fix, health
from .queries import QUERIES, query
from .sources.project import project_facts

_BLOCK = "\n".join(f"    total = total + rate * {k}\n    if total > limit:\n        total = limit - {k}" for k in range(4))
SOURCES = {
    "/shop/shop/__init__.py": "from shop.core import order\n\n__all__ = ['order']\n",
    "/shop/shop/core.py": "import json\n\nimport yaml\n\nfrom shop.rates import rate as current\n\n\ndef order(n):\n    return current(n)\n\n\ndef forgotten():\n    return json.dumps({})\n\n\nclass Basket:\n    limit = 3\n\n    def total(self):\n        return self.limit\n\n\ndef countdown(n):\n    return countdown(n - 1)\n",
    "/shop/shop/rates.py": "import shop.core\n\nimport requests_cache\n\n_hidden = 1\nSILENT = 2  # lodestone: ignore\nseen = 3  # lodestone: ignore\n\n\ndef rate(n):\n    return shop.core, seen, n, requests_cache\n",
    "/shop/shop/lost.py": "def alone():\n    return 1\n",
    "/shop/shop/api/routes.py": "from app import router\nfrom shop.domain.model import Model\n\n\n@router.get('/x')\ndef listing():\n    return Model()\n",
    "/shop/shop/domain/model.py": "import shop.api.routes\n\n\nclass Model:\n    def price(self):\n        return shop.api.routes\n\n\nclass Special(Model):\n    def price(self):\n        return 2\n",
    "/shop/shop/maze.py": "def maze(a, b, c, d, e, f):\n" + "".join(f"{'    ' * k}if a > {k}:\n" for k in range(1, 6)) + "                        return b and c or d and e or f\n    return None\n",
    "/shop/shop/left.py": f"def left(total, rate, limit):\n{_BLOCK}\n    return total\n\n\nleft(1, 2, 3)\n",
    "/shop/shop/right.py": f"def right(total, rate, limit):\n{_BLOCK}\n    return total\n\n\nright(1, 2, 3)\n",
    "/shop/main.py": "from shop import order\nimport shop.left\nimport shop.right\nimport shop.maze\n\nif __name__ == '__main__':\n    order(1), shop.maze.maze(1, 2, 3, 4, 5, 6)\n",
    "/shop/tests/test_core.py": "import pytest\nfrom shop.core import order\n\n\ndef test_order():\n    assert order(1)\n",
}
CONFIG = Config(boundaries=Boundaries(layers=(("shop.api",), ("shop.domain",)), rules=(DenyRule("shop.core", ("shop.rates",)),)))
FINDING_COLUMNS = ("rule", "path", "line", "confidence", "message")


def facts(spark: SparkSession) -> FactSet:
    f = project_facts(spark.createDataFrame(list(SOURCES.items()), "path string, text string"), "/shop", CONFIG, spark.createDataFrame([("yaml", "pyyaml"), ("requests_cache", "requests-cache"), ("pytest", "pytest")], "top_level string, dist string"))
    rows = {
        "scopes": [{"scope_id": 0, "manifest_path": "/shop/pyproject.toml", "directory": "/shop", "name": "shop"}],
        "dependencies": [{"scope_id": 0, "seq": k, "name": n, "group_kind": g, "group_name": h} for k, (n, g, h) in enumerate([("pyyaml", "main", None), ("leftover", "main", None), ("requests", "main", None), ("extra", "optional", "x"), ("pytest", "group", "dev")])],
        "dist_requires": [{"dist": "requests", "requires": "urllib3"}, {"dist": "leftover", "requires": "middle"}, {"dist": "middle", "requires": "requests-cache"}],
    }
    more = FactSet.from_rows(spark, **rows)
    return f.with_tables(**{k: getattr(more, k) for k in rows})


def _golden(rows: list[tuple]) -> str:
    """The expected findings as SQL."""
    text = lambda v: "CAST(NULL AS INTEGER)" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({', '.join(FINDING_COLUMNS)})"


DEAD = [
    ("unused-class", "/shop/shop/core.py", 16, "medium", "class `Basket` is never used"),
    ("unused-method", "/shop/shop/core.py", 19, "low", "method `Basket.total` is never used"),
    ("unused-function", "/shop/shop/core.py", 12, "medium", "function `forgotten` is never used"),
    ("unused-function", "/shop/shop/core.py", 23, "medium", "function `countdown` is never used"),
    ("unused-variable", "/shop/shop/rates.py", 5, "high", "variable `_hidden` is never used"),
    ("unused-suppression", "/shop/shop/rates.py", 7, "high", "suppression comment silences nothing"),
    ("unused-file", "/shop/shop/lost.py", None, "medium", "file `shop.lost` is never imported or run"),
    ("unused-class", "/shop/shop/domain/model.py", 9, "medium", "class `Special` is never used"),
    ("unused-method", "/shop/shop/domain/model.py", 5, "low", "method `Model.price` is never used"),
]


@query(_golden(DEAD))
def code_dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_code.analyze(facts(spark), CONFIG).findings.select(*FINDING_COLUMNS)


CYCLES = [
    ("circular-import", "/shop/shop/__init__.py", 1, "high", "import cycle among 3 modules, shortest: shop -> shop.core -> shop"),
    ("circular-import", "/shop/shop/api/routes.py", 2, "high", "import cycle: shop.api.routes -> shop.domain.model -> shop.api.routes"),
]


@query(_golden(CYCLES))
def code_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.analyze(facts(spark)).select(*FINDING_COLUMNS)


HEALTH = [("complex-function", "/shop/shop/maze.py", 1, "high", "function `maze` has cyclomatic complexity 10 and cognitive complexity 18 over 8 lines")]


@query(_golden(HEALTH))
def code_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.analyze(facts(spark), CONFIG.limits).findings.select(*FINDING_COLUMNS)


@query("SELECT 'shop.api' AS package, 100 AS score, CAST(1 AS BIGINT) AS functions, CAST(0 AS BIGINT) AS hotspots UNION ALL SELECT 'shop.core', 100, 4, 0 UNION ALL SELECT 'shop.domain', 100, 2, 0 UNION ALL SELECT 'shop.left', 100, 1, 0 UNION ALL SELECT 'shop.lost', 100, 1, 0 UNION ALL SELECT 'shop.maze', 86, 1, 1 UNION ALL SELECT 'shop.rates', 100, 1, 0 UNION ALL SELECT 'shop.right', 100, 1, 0 UNION ALL SELECT 'tests.test_core', 100, 1, 0")
def code_package_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.analyze(facts(spark), CONFIG.limits).packages


DUPES = [("duplicate-code", "/shop/shop/left.py", 1, "high", "17 lines (113 tokens) duplicated at shop.right:1")]


@query(_golden(DUPES))
def code_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dupes.analyze(facts(spark)).findings.select(*FINDING_COLUMNS)


BROKEN = [
    ("boundary-violation", "/shop/shop/core.py", 5, "high", "`shop.core` imports `shop.rates`: `shop.core` may not import `shop.rates`"),
    ("boundary-violation", "/shop/shop/domain/model.py", 1, "high", "`shop.domain.model` imports `shop.api.routes`: layer `shop.domain` may not depend on the layer above it, `shop.api`"),
]


@query(_golden(BROKEN))
def code_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.analyze(facts(spark), CONFIG.boundaries).select(*FINDING_COLUMNS)


@query("SELECT 'shop.api,shop.domain' AS tangle UNION ALL SELECT 'shop.core,shop.rates'")
def code_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.suggest(facts(spark))[1].select(F.array_join("packages", ",").alias("tangle"))


DEPS = [
    ("unused-dependency", "/shop/pyproject.toml", None, "medium", "dependency `leftover` is never imported"),
    ("unused-dependency", "/shop/pyproject.toml", None, "medium", "dependency `requests` is never imported"),
    ("unused-dependency", "/shop/pyproject.toml", None, "low", "dependency `extra` (optional-dependencies.x) is never imported"),
    ("missing-dependency", "/shop/shop/rates.py", 3, "low", "`requests_cache` is imported but `requests-cache` is not a declared dependency; it arrives through `leftover`"),
    ("unresolved-import", "/shop/shop/api/routes.py", 1, "low", "import `app` resolves to nothing on the search path"),
]


@query(_golden(DEPS))
def code_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.analyze(facts(spark), CONFIG).select(*FINDING_COLUMNS)


_LEFT = {
    "/shop/shop/core.py": ("forgotten,Basket,countdown", "import yaml\n\nfrom shop.rates import rate as current\n\n\ndef order(n):\n    return current(n)\n"),
    "/shop/shop/rates.py": ("_hidden", "import shop.core\n\nimport requests_cache\n\nSILENT = 2  # lodestone: ignore\nseen = 3  # lodestone: ignore\n\n\ndef rate(n):\n    return shop.core, seen, n, requests_cache\n"),
    "/shop/shop/domain/model.py": ("Special", "import shop.api.routes\n\n\nclass Model:\n    def price(self):\n        return shop.api.routes\n"),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{r}', '{n}')" for p, (r, n) in _LEFT.items()) + ") AS t(path, removed, new)")
def code_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits that the dead code of the example calls for."""
    f = facts(spark)
    found = dead_code.analyze(f, CONFIG).findings.where("confidence <> 'low'")
    return fix.plan(f, found).edits.select("path", F.array_join("removed", ",").alias("removed"), "new")


__all__ = ["QUERIES", "facts"]
