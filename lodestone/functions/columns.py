"""Scalar functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence levels from the surest; a filter keeps ranks up to its own.
CONFIDENCE = ("high", "medium", "low")


def prefixes(c: Column, sep: str = ".") -> Column:
    """Every leading part of a separated name, shortest first: a, a.b, a.b.c."""
    parts = F.split(c, re.escape(sep))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))


def suffixes(c: Column, sep: str = "/") -> Column:
    """Every trailing part of a separated path, longest first."""
    parts = F.split(c, re.escape(sep))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), sep))


def covers(prefix: Column, name: Column) -> Column:
    """The name is the prefix or lies below it."""
    return (name == prefix) | F.startswith(name, F.concat(prefix, F.lit(".")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directories(path: Column) -> Column:
    """Components of a path without its last one."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def parent_dir(path: Column) -> Column:
    return F.array_join(directories(path), "/")


def parent_name(path: Column) -> Column:
    return F.get(F.reverse(directories(path)), F.lit(0))


def under(path: Column, *names: str) -> Column:
    """Some directory above the file has one of the names."""
    return F.arrays_overlap(directories(path), F.array(*map(F.lit, names)))


def under_starting(path: Column, *heads: str) -> Column:
    return F.exists(directories(path), lambda d: d.rlike("^(" + "|".join(map(re.escape, heads)) + ")"))


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def depth(c: Column) -> Column:
    return F.size(F.split(c, r"\.")) - 1


def is_dunder(c: Column) -> Column:
    return (F.length(c) > 4) & c.startswith("__") & c.endswith("__")


def is_private(c: Column) -> Column:
    """A leading underscore that is no dunder's."""
    return c.startswith("_") & ~is_dunder(c)


def normalized_distribution(c: Column) -> Column:
    """Lower case, runs of ``-_.`` as one ``-``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[-_.]+", "-"), "^-|-$", "")


def requirement_name(c: Column) -> Column:
    return F.regexp_extract(F.ltrim(c), "^[A-Za-z0-9._-]+", 0)


def is_identifier(c: Column) -> Column:
    return c.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def glob_regex(glob: str, crossing: bool = True) -> str:
    """A path glob as a regular expression: ``**`` crosses directories, ``*`` and ``?`` do not. A pattern without ``*`` also matches what lies below it."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + ("[^/]*" if crossing else ".*"), i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$" if "*" in glob or not crossing else f"^{out}(?:/.*)?$"


def matches_any(c: Column, globs: list[str] | tuple[str, ...], crossing: bool = True) -> Column:
    return c.rlike("|".join(glob_regex(g, crossing) for g in globs)) if globs else F.lit(False)


def path_order(path: Column) -> list[Column]:
    """Order by path components, not by the string."""
    return [F.split(path, "/").asc()]


def penalty(cyclomatic: Column, cognitive: Column, lines: Column, parameters: Column, limits: dict[str, int]) -> Column:
    """At most 100: 5 a point of cyclomatic and 3 of cognitive complexity over the limit, half a point a line, 5 a parameter."""
    over = lambda c, k: F.greatest(c - limits[k], F.lit(0))
    return F.least(F.lit(100), 5 * over(cyclomatic, "cyclomatic") + 3 * over(cognitive, "cognitive") + F.floor(over(lines, "lines") / 2) + 5 * over(parameters, "parameters")).cast("bigint")


def score(weighted: Column, weight: Column) -> Column:
    """100 less the weighted mean penalty, in whole points; 100 where nothing has weight."""
    return F.coalesce(100 - F.when(weight > 0, F.floor(weighted / weight)), F.lit(100)).cast("int")


def grade(c: Column) -> Column:
    return F.when(c >= 90, "A").when(c >= 80, "B").when(c >= 70, "C").when(c >= 60, "D").otherwise("F")


def maintainability(tokens: Column, distinct: Column, cyclomatic: Column, lines: Column) -> Column:
    """The maintainability index on 0..100 from Halstead volume, complexity and lines."""
    volume = F.greatest(tokens * F.log2(F.greatest(distinct, F.lit(1)).cast("double")), F.lit(1.0))
    raw = (171 - 5.2 * F.log(volume) - 0.23 * cyclomatic - 16.2 * F.log(F.greatest(lines, F.lit(1)).cast("double"))) * 100 / 171
    return F.greatest(F.least(raw, F.lit(100.0)), F.lit(0.0))


def tenths(part: Column, whole: Column) -> Column:
    """A share in tenths of a percent, rounded down; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(0).cast("bigint")
