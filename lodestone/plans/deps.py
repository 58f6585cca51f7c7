"""Declared dependencies against imports, by the nearest manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..facts import FactSet, finding
from ..functions import columns as C
from ..operators import graph, joins
from .dead_code import ordered

# Distributions that are run, loaded by configuration, or imported under another name.
TOOLS = (
    "bandit", "black", "build", "bump2version", "bumpversion", "cibuildwheel", "codespell", "commitizen", "coverage", "flake8", "gunicorn", "hatch",
    "hypercorn", "ipdb", "ipykernel", "ipython", "isort", "jupyter", "jupyterlab", "maturin", "mkdocs", "mkdocs-material", "mypy", "pdm", "poetry",
    "poethepoet", "pyinstaller", "pylint", "pyupgrade", "sphinx", "notebook", "nox", "pip", "pip-tools", "pre-commit", "pyright", "pytest",
    "pytest-asyncio", "pytest-cov", "pytest-mock", "pytest-xdist", "ruff", "setuptools", "tox", "twine", "ty", "uv", "uvicorn", "wheel",
)
CONFIGURED = (
    "aiosqlite", "asyncpg", "cx-oracle", "email-validator", "httptools", "mysqlclient", "oracledb", "pg8000", "psycopg", "psycopg-binary", "psycopg-c",
    "psycopg2", "psycopg2-binary", "pymysql", "pyodbc", "python-multipart", "uvloop", "watchfiles",
)
ALIASES = {
    "attrs": "attr", "beautifulsoup4": "bs4", "google-cloud-storage": "google", "opencv-python": "cv2", "pillow": "PIL", "psycopg2-binary": "psycopg2",
    "pyjwt": "jwt", "python-dateutil": "dateutil", "python-dotenv": "dotenv", "pyyaml": "yaml", "scikit-learn": "sklearn", "sqlalchemy": "sqlalchemy",
}
MAX_VISITED = 500
#: The scope of files outside every manifest where there is none at all.
NO_SCOPE = -1


def _scoped(facts: FactSet) -> DataFrame:
    """External imports with the scope of their file: the deepest manifest above it, else the first one, else none."""
    files = facts.files.where("reported").select("file_id", "path", "module")
    scopes = facts.scopes.select("scope_id", "directory")
    placed = joins.longest_prefix(files, "path", scopes, "directory")
    first = facts.scopes.agg(F.coalesce(F.min("scope_id"), F.lit(NO_SCOPE)).alias("first"))
    placed = placed.crossJoin(F.broadcast(first)).select("file_id", "path", "module", F.coalesce("scope_id", "first").alias("scope_id"))
    return facts.ext_imports.join(placed, "file_id")


def analyze(facts: FactSet, config: Config | None = None, root: str = "") -> DataFrame:
    config = config or Config()
    imports = _scoped(facts).withColumn("order", F.struct(F.split("path", "/").alias("p"), "seq")).persist()
    declared = facts.dependencies.select("scope_id", "name", "seq", "group_kind", "group_name")
    names = declared.select("scope_id", "name").distinct()
    spread = imports.withColumn("backed", (F.col("origin") == "site-packages") & (F.size("distributions") > 0))
    # Metadata says who provides a module; without it, declared names that look like the module do.
    by_metadata = spread.where("backed").withColumn("dist", F.explode("distributions"))
    alias = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    guesses = names.select("scope_id", F.col("name").alias("dist"), F.explode(F.array_distinct(F.array_compact(F.array(F.lower(F.translate("name", "-", "_")), F.lower(alias[F.col("name")]))))).alias("guess"))
    rest = spread.where("not backed").withColumn("guess", F.lower("top_level"))
    guessed = rest.select("scope_id", "guess").distinct().join(guesses, ["scope_id", "guess"]).groupBy("scope_id", "guess").agg(F.min("dist").alias("dist"))
    rest = rest.join(guessed, ["scope_id", "guess"], "left")
    used = by_metadata.select("scope_id", F.col("dist").alias("name")).union(rest.where("dist is not null").select("scope_id", F.col("dist"))).distinct()

    ignored = [d.lower() for d in config.ignored_dependencies]
    tool = F.col("name").isin(*TOOLS, *CONFIGURED, *ignored) | F.col("name").rlike("^types-|-stubs$|^pytest-")
    scopes = facts.scopes.select("scope_id", "manifest_path", F.col("name").alias("own"))
    unused = declared.where(~tool).join(used, ["scope_id", "name"], "left_anti").join(scopes, "scope_id").where(~F.col("name").eqNullSafe(F.col("own")))
    w = Window.partitionBy("scope_id", "name").orderBy("seq")
    unused = unused.withColumn("n", F.row_number().over(w)).where("n = 1")
    group = F.when(F.col("group_kind") == "optional", F.concat(F.lit(" (optional-dependencies."), "group_name", F.lit(")"))).when(F.col("group_kind") == "group", F.concat(F.lit(" (dependency-groups."), "group_name", F.lit(")"))).otherwise("")
    unused_rows = unused.select(
        F.lit("unused-dependency").alias("rule"), F.col("manifest_path").alias("path"), F.when(F.col("group_kind") == "main", "medium").otherwise("low").alias("confidence"),
        F.concat(F.lit("dependency `"), "name", F.lit("`"), group, F.lit(" is never imported")).alias("message"), F.col("name").alias("distribution"), F.expr("cast(array() as array<string>)").alias("modules"),
    )

    missing = by_metadata.join(names.withColumnRenamed("name", "dist"), ["scope_id", "dist"], "left_anti").join(scopes, "scope_id", "left").where(~F.col("own").eqNullSafe(C.normalized_distribution(F.col("dist"))))
    missing = missing.groupBy("scope_id", "dist").agg(F.array_sort(F.collect_set("top_level")).alias("modules"), F.min_by(F.struct("path", "module", "line", "column"), "order").alias("at"))
    # The least declared name, in order of names, whose requirements reach the distribution.
    reach = graph.reachable(facts.dist_requires.toDF("src", "dst"), names.select(F.col("name").alias("root")).distinct(), most=MAX_VISITED)
    carriers = names.join(reach.withColumnRenamed("root", "name"), "name").groupBy("scope_id", F.col("node").alias("dist")).agg(F.min("name").alias("carrier"))
    missing = missing.join(carriers, ["scope_id", "dist"], "left")
    text = F.concat(F.lit("`"), F.array_join("modules", "`, `"), F.lit("` is imported but `"), "dist", F.lit("` is not a declared dependency"))
    missing_rows = missing.select(
        F.lit("missing-dependency").alias("rule"), "at.path", "at.module", "at.line", "at.column", F.when(F.col("carrier").isNull(), "medium").otherwise("low").alias("confidence"),
        F.when(F.col("carrier").isNull(), text).otherwise(F.concat(text, F.lit("; it arrives through `"), "carrier", F.lit("`"))).alias("message"), F.col("dist").alias("distribution"), "modules",
    )

    lost = rest.where("dist is null and origin = 'unresolved' and condition = 'always'").join(scopes, "scope_id", "left").where(~F.col("own").eqNullSafe(C.normalized_distribution(F.col("top_level"))))
    lost = lost.groupBy("scope_id", "top_level").agg(F.min_by(F.struct("path", "module", "line", "column"), "order").alias("at"))
    lost_rows = lost.select(
        F.lit("unresolved-import").alias("rule"), "at.path", "at.module", "at.line", "at.column", F.lit("low").alias("confidence"),
        F.concat(F.lit("import `"), "top_level", F.lit("` resolves to nothing on the search path")).alias("message"), F.lit("").alias("distribution"), F.array("top_level").alias("modules"),
    )
    return ordered(finding(unused_rows).unionByName(finding(missing_rows)).unionByName(finding(lost_rows)))
