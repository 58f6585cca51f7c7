"""Places in a tree whose files are run, loaded or copied rather than imported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import columns as C

#: Files that are run or loaded by convention (fixed values).
ROOT_FILES = ("__init__.py", "__main__.py", "conftest.py", "conf.py", "setup.py", "manage.py", "wsgi.py", "asgi.py", "noxfile.py", "tasks.py")
#: Beginnings of directories whose files are run directly (fixed values).
ROOT_DIRECTORIES = ("bench", "bin", "dev", "doc", "e2e", "example", "hook", "prof", "sample", "script", "tool")
#: Directories of data below a tests directory, and those that say so anywhere (fixed values).
DATA_DIRECTORIES = ("data", "fixtures", "testdata", "test_data", "helper_tools", "tools", "scripts", "inputs", "outputs", "cases", "samples", "snapshots", "targets", "support")
SELF_DESCRIBING = ("testdata", "test_data", "test-data", "tests_data")
#: Directories that only a type checker reads (fixed values).
TYPING_DIRECTORIES = ("typing", "typechecking", "type_checking")
#: Directories of third-party code (fixed values).
VENDOR_DIRECTORIES = ("_vendor", "vendor", "_vendored", "vendored", "third_party", "thirdparty")


def in_root_directory(path: Column) -> Column:
    return C.under_starting(path, *ROOT_DIRECTORIES)


def _below_tests(path: Column, names: tuple[str, ...]) -> Column:
    return path.rlike(r"(?:^|/)tests?/(?:.*/)?(?:" + "|".join(names) + ")/")


def in_test_data(path: Column) -> Column:
    return C.under(path, *SELF_DESCRIBING) | _below_tests(path, DATA_DIRECTORIES)


def in_typing_tests(path: Column) -> Column:
    return C.under(path, "typing_tests", "typing-tests") | _below_tests(path, TYPING_DIRECTORIES)


def vendored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_DIRECTORIES)))


def tool_config(path: Column) -> Column:
    return C.file_name(path).endswith(".conf.py") | C.file_name(path).startswith("hook-")
