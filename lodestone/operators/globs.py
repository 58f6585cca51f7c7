"""Many path globs against many names, as an equality join on literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest literal by which a pattern is looked up.
ANCHOR = 8


def _marked(glob: Column) -> Column:
    """A glob with one mark for each wildcard, read from the left: ``**/`` is one only after an even number of stars."""
    out = F.regexp_replace(glob, r"(?<!\*)((?:\*\*)*)\*\*/", "$1\x01")
    for mark, wild in (("\x02", "**"), ("\x03", "*"), ("\x04", "?")):
        out = F.replace(out, F.lit(wild), F.lit(mark))
    return out


def regex(glob: Column, crossing: bool = True) -> Column:
    """A column of globs as regular expressions: ``**`` crosses directories, ``*`` and ``?`` do not; a glob without ``*`` also holds what lies below it. Without ``crossing`` a ``*`` passes every character and nothing below counts."""
    out = F.regexp_replace(_marked(glob), r"([\\.+^$(){}|\[\]])", r"\\$1")
    for mark, means in (("\x01", "(?:.*/)?"), ("\x02", ".*"), ("\x03", "[^/]*" if crossing else ".*"), ("\x04", "[^/]")):
        out = F.replace(out, F.lit(mark), F.lit(means))
    end = F.when(glob.contains("*") | F.lit(not crossing), "\\z").otherwise("(?:/.*)?\\z")
    return F.concat(F.lit("(?s)^"), out, end)


def anchor(glob: Column) -> Column:
    """The beginning of the longest run of a glob that every match holds as it is; the first of equally long ones."""
    runs = F.split(_marked(glob), "[\x01-\x04]+")
    longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.substring(longest, 1, ANCHOR)


def matching(names: DataFrame, name: str, patterns: DataFrame, pattern: str, crossing: bool = True) -> DataFrame:
    """(name, pattern): every distinct name with every distinct glob that holds it; nulls hold and are held by nothing.

    A glob is looked up by its longest literal, which a name must contain, so a
    name meets the globs of its own substrings and not all of them. A glob of
    wildcards only meets every name, as it must.
    """
    globs = patterns.select(F.col(pattern).alias("__g")).where("__g is not null").distinct().select("__g", anchor(F.col("__g")).alias("__a"), regex(F.col("__g"), crossing).alias("__r"))
    lengths = sorted(r[0] for r in globs.select(F.length("__a")).distinct().collect())  # at most ANCHOR + 1
    known = names.select(F.col(name).alias("__n")).where("__n is not null").distinct()

    def pieces(n: int) -> Column:
        if not n:
            return F.array(F.lit(""))
        at = F.when(F.length("__n") >= n, F.sequence(F.lit(1), F.length("__n") - (n - 1))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(at, lambda i: F.substring(F.col("__n"), i, F.lit(n)))

    if not lengths:
        return known.where("false").select(F.col("__n").alias(name), F.col("__n").alias(pattern))
    asked = known.select("__n", F.explode(F.array_distinct(F.flatten(F.array(*map(pieces, lengths))))).alias("__a"))
    hits = asked.join(globs, "__a").where(F.expr("__n rlike __r"))
    return hits.select(F.col("__n").alias(name), F.col("__g").alias(pattern))
