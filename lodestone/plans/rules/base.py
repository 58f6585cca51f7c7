"""What a keep rule may look at, as columns of the candidate table.

A candidate row has the symbol's own columns, ``nested``, ``owner`` (the class
around it, or null), ``complete`` and ``ancestors``, ``role``, ``registered``,
``requested``, ``reads_globals``, ``exports``, ``module``, ``rel_path`` and
``in_test_file``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import columns as C

Rule = tuple[str, Column]

_COLUMNS = {
    "name": lambda: F.col("name"),
    "kind": lambda: F.col("kind"),
    "path": lambda: F.col("rel_path"),
    "top_level": lambda: ~F.col("nested"),
    "is_class": lambda: F.col("kind") == "class",
    "is_method": lambda: F.col("kind") == "method",
    "is_function": lambda: F.col("kind") == "function",
    "is_attribute": lambda: F.col("nested") & F.col("kind").isin("field", "constant"),
    "file_name": lambda: C.file_name(F.col("rel_path")),
    "parent": lambda: C.parent_name(F.col("rel_path")),
}


def __getattr__(key: str) -> Column:
    """Columns of a candidate, made when asked for: a Column needs a session, an import does not."""
    if key in _COLUMNS:
        return _COLUMNS[key]()
    raise AttributeError(key)


def in_package(c: Column, packages: tuple[str, ...]) -> Column:
    return c.rlike("^(?:" + "|".join(map(re.escape, packages)) + r")(?:\.|$)")


def decorated(names: tuple[str, ...], packages: tuple[str, ...] = (), receiver: bool = False, on: Column | None = None) -> Column:
    """A decorator has one of the names, hangs on an object if ``receiver``, and comes from one of the packages as far as that is known."""

    def fits(d: Column) -> Column:
        out = C.last_segment(d["name"]).isin(*names)
        if receiver:
            out &= d["name"].contains(".")
        if packages:
            out &= d["module"].isNull() | in_package(d["module"], packages)
        return out

    return F.coalesce(F.exists(F.col("decorators") if on is None else on, fits), F.lit(False))


def with_keyword(keyword: str, last: str) -> Column:
    return F.exists("decorators", lambda d: (C.last_segment(d["name"]) == last) & F.array_contains(d["keywords"], keyword))


def ancestor_in(*packages: str) -> Column:
    return F.exists("ancestors", lambda a: in_package(a, packages))


def any_base(bases: Column, test) -> Column:
    return F.coalesce(F.exists(bases, lambda b: test(C.last_segment(b))), F.lit(False))


def descends(packages: tuple[str, ...], bases: tuple[str, ...]) -> Column:
    """An ancestor from the packages, or, where ancestry is incomplete, a base of one of the names."""
    return ancestor_in(*packages) | ~F.col("complete") & any_base(F.col("bases"), lambda b: b.isin(*bases))


def attribute_of(packages: tuple[str, ...], bases: tuple[str, ...]) -> Column:
    owner = F.col("owner")
    return _COLUMNS["is_attribute"]() & owner.isNotNull() & (ancestor_in(*packages) | ~F.col("complete") & any_base(owner["bases"], lambda b: b.isin(*bases)))


def head_or_glob(c: Column, patterns: tuple[str, ...]) -> Column:
    """A pattern without glob characters is a beginning, another one a whole name."""
    heads = [p for p in patterns if not re.search(r"[*?\[]", p)]
    globs = [p for p in patterns if p not in heads]
    out = F.lit(False)
    if heads:
        out |= c.rlike("^(?:" + "|".join(map(re.escape, heads)) + ")")
    if globs:
        out |= C.matches_any(c, globs, crossing=False)
    return out
