"""Conventions of the language, of entry points and of test runners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...config import Config
from ...functions import columns as C
from . import base as B
from .places import in_root_directory, in_test_data, in_typing_tests, vendored

#: Decorators that turn a class body into a schema, and where they come from (fixed values).
SCHEMA_DECORATORS = ("dataclass", "define", "frozen", "mutable", "attrs", "s")
SCHEMA_PACKAGES = ("dataclasses", "attr", "attrs", "pydantic.dataclasses", "msgspec")
#: Bases whose members are read as a whole (fixed values); so is any name that ends in Enum.
SCHEMA_BASES = ("Flag", "NamedTuple", "TypedDict", "Protocol")
#: Inner classes that frameworks read as configuration (fixed values).
INNER_CLASSES = ("Meta", "Config")
#: Methods that test runners call (fixed values).
LIFECYCLE = ("setup_method", "teardown_method", "setup_class", "teardown_class", "setup", "teardown", "setUp", "tearDown", "setUpClass", "tearDownClass", "setUpTestData", "runTest")
#: Fixtures of plugins that projects override by name (fixed values).
PLUGIN_FIXTURES = ("event_loop", "event_loop_policy", "anyio_backend", "celery_config", "celery_app", "celery_worker_parameters", "celery_includes", "django_db_setup", "django_db_modify_db_settings")


def python(config: Config) -> list[B.Rule]:
    owner = F.col("owner")
    schema_name = lambda b: b.endswith("Enum") | b.isin(*SCHEMA_BASES)
    schema = owner.isNotNull() & (B.decorated(SCHEMA_DECORATORS, SCHEMA_PACKAGES, on=owner["decorators"]) | B.any_base(owner["bases"], schema_name) | F.exists("ancestors", lambda a: schema_name(C.last_segment(a))))
    public = F.lit(False)
    for p in config.public_modules:
        public |= F.coalesce(C.covers(F.lit(p), F.col("module")), F.lit(False))
    return [
        ("overload stub", B.decorated(("overload",), ("typing", "typing_extensions"))),
        ("named in __all__", B.top_level & F.array_contains("exports", B.name)),
        ("public name of an API module", B.top_level & ~C.is_private(B.name) & public),
        ("documentation settings", (B.file_name == "conf.py") & C.under_starting(B.path, "doc") & B.top_level),
        ("settings script of a tool", (F.col("role") == "tool-config") & B.top_level),
        ("file named by a string", (F.col("role") == "loaded-by-path") & B.top_level),
        ("scripts, examples or documentation", in_root_directory(B.path)),
        ("data of tests", in_test_data(B.path)),
        ("read by a type checker", in_typing_tests(B.path)),
        ("vendored code", vendored(B.path)),
        ("module reads its own globals()", B.top_level & F.col("reads_globals")),
        ("HTTP method handler", B.is_method & B.name.startswith("do_") & B.ancestor_in("http.server")),
        ("registered by a base class", B.is_class & F.col("registered")),
        ("field of a schema class", B.is_attribute & schema),
        ("field of an inner configuration class", B.is_attribute & owner.isNotNull() & owner["nested"] & owner["name"].isin(*INNER_CLASSES)),
    ]


def entry_points(config: Config) -> list[B.Rule]:
    return [("entry point of the manifest", F.col("is_entry_point"))]


def pytest(config: Config) -> list[B.Rule]:
    tests = config.tests
    collected, collected_class = B.head_or_glob(B.name, tests.functions), B.head_or_glob(B.name, tests.classes)
    test_case = B.ancestor_in("unittest", "django.test")
    own_base = F.exists("ancestors", lambda a: F.arrays_overlap(F.slice(F.split(a, r"\."), 1, F.size(F.split(a, r"\.")) - 1), F.array(F.lit("test"), F.lit("tests"), F.lit("testing"))))
    in_file = F.col("in_test_file")
    fixture = F.exists("decorators", lambda d: C.last_segment(d["name"]) == "fixture")
    return [
        ("conftest.py", B.file_name == "conftest.py"),
        ("collected test", in_file & B.kind.isin("function", "method") & collected),
        ("collected test class", in_file & B.is_class & collected_class),
        ("named like a test class", in_file & B.is_class & B.name.rlike("(?:Test|Tests|TestCase)$")),
        ("descends from a test base of the project", in_file & B.is_class & own_base),
        ("hook of a test's life cycle", in_file & B.is_method & B.name.isin(*LIFECYCLE)),
        ("test method of a TestCase", B.is_method & test_case & (collected | B.name.isin(*LIFECYCLE))),
        ("unittest marker", B.top_level & (B.name == "__unittest")),
        ("marks of a test module", B.top_level & (B.name == "pytestmark")),
        ("TestCase class", B.is_class & test_case),
        ("test method collected through a subclass", B.is_method & collected & C.under(B.path, "tests", "test")),
        ("hook of the test runner", B.is_function & B.name.startswith("pytest_")),
        ("automatic fixture", B.with_keyword("autouse", "fixture")),
        ("fixture under another name", B.with_keyword("name", "fixture")),
        ("fixture asked for by a parameter", F.col("requested") & fixture),
        ("overrides a plugin's fixture", B.name.isin(*PLUGIN_FIXTURES) & fixture),
        ("hook implementation", B.decorated(("hookimpl",), ("pytest", "_pytest"), receiver=True)),
    ]
