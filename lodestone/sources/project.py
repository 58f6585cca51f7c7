"""From source files to fact tables: scan every file once, then resolve names by joins."""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..facts import DECORATOR, FactSet
from ..functions import columns as C
from ..functions.scan import STDLIB, Scan, module_of, names_only
from ..rulebook import RULES
from ..storage import cut

#: Seconds for one file before only its names are read, and again before it is left out.
FILE_BUDGET = 20
MAX_ANCESTORS = 64

_PLACE = "line:int,column:int"
SCANNED = f"""path string, rel_path string, module string, text string, exports array<string>, main_guard boolean, reads_globals boolean, resolution string, seconds double,
symbols array<struct<ordinal:int,name:string,kind:string,parent_ordinal:int,decorators:array<struct<name:string,keywords:array<string>,call:string,maker:string>>,bases:array<string>,open_base:boolean,class_keywords:array<string>,name_start:int,name_end:int,full_start:int,full_end:int,{_PLACE},full_line:int>>,
imports array<struct<seq:int,module:string,attr:string,level:int,kind:string,condition:string,start:int,end:int,{_PLACE}>>,
aliases array<struct<name:string,module:string,attr:string,top:boolean>>, makers array<struct<name:string,callee:string>>, uses array<struct<name:string,start:int,end:int>>,
strings array<struct<name:string,start:int,end:int,{_PLACE}>>, words array<struct<name:string,{_PLACE}>>, params array<struct<name:string,start:int,end:int>>, attr_names array<string>, attr_prefixes array<string>, param_names array<string>, path_literals array<string>, package_wide array<string>,
metrics array<struct<name:string,owner:string,line:int,column:int,lines:int,parameters:int,cyclomatic:int,cognitive:int,max_nesting:int>>,
tokens array<struct<kind:string,text:string,line:int,nesting:string>>, deletables array<struct<name:string,line:int,column:int,start:int,end:int,would_be_empty:boolean>>,
suppressions array<struct<line:int,scope_kind:string,rules:array<string>>>"""


@contextmanager
def _budget(seconds: int) -> Iterator[None]:
    """Stops what takes longer, where signals can be had."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_: object) -> None:
        raise TimeoutError

    old = signal.signal(signal.SIGALRM, stop)
    signal.alarm(seconds)
    try:
        yield
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, old)


def _scanner(root: str, marker: str):
    lists = ("symbols", "imports", "aliases", "makers", "uses", "strings", "words", "params", "attr_names", "attr_prefixes", "param_names", "path_literals", "package_wide", "metrics", "tokens", "deletables", "suppressions")

    def one(path: str, text: str) -> dict:
        rel = path.removeprefix(root.rstrip("/") + "/") if root else path
        module = module_of(rel)
        row: dict = {"path": path, "rel_path": rel, "module": module, "text": text, "exports": [], "main_guard": False, "reads_globals": False, "resolution": "semantic"}
        package, began = rel.endswith("/__init__.py") or rel in ("__init__.py", "__init__.pyi"), time.perf_counter()
        try:
            with _budget(FILE_BUDGET):
                s = Scan(text, module, package, tuple(RULES), marker)
            row |= {"exports": s.exports, "main_guard": s.main_guard, "reads_globals": s.reads_globals, **s.facts}
            row["metrics"] = [m.__dict__ for m in s.metrics]
            row["tokens"] = [dict(zip(("kind", "text", "line", "nesting"), t, strict=True)) for t in s.tokens]
            row["deletables"] = [dict(zip(("name", "line", "column", "start", "end", "would_be_empty"), d, strict=True)) for d in s.deletables]
            row["suppressions"] = [{"line": a, "scope_kind": b, "rules": c} for a, b, c in s.suppressions]
        except (TimeoutError, SyntaxError, ValueError, RecursionError, IndexError) as e:
            # What a file names stays in use even where its structure cannot be had.
            row["resolution"] = "by-name" if isinstance(e, TimeoutError) else "unparsed"
            try:
                with _budget(FILE_BUDGET):
                    row |= names_only(text, module, package)
            except TimeoutError:
                row["resolution"] = "abandoned"
        row["seconds"] = time.perf_counter() - began
        for k in lists:
            row.setdefault(k, [])
        return row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(p, t if t is not None else "") for p, t in zip(pdf["path"], pdf["text"], strict=True)])

    return run


def read_sources(spark: SparkSession, root: str, notebooks: bool = False) -> DataFrame:
    """(path, text) of every Python file below a directory; notebooks as the text of their code cells if asked for."""
    glob = "*.{py,pyi,ipynb}" if notebooks else "*.{py,pyi}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    text = F.decode("content", "UTF-8")
    cells = F.from_json(text, "cells array<struct<cell_type:string,source:array<string>>>")["cells"]
    code = F.array_join(F.transform(F.filter(cells, lambda c: c["cell_type"] == "code"), lambda c: F.array_join(c["source"], "")), "\n")
    path = F.regexp_replace("path", "^file:/*", "/")
    return raw.select(path.alias("path"), F.when(path.endswith(".ipynb"), code).otherwise(text).alias("text"))


def template_names(spark: SparkSession, root: str) -> DataFrame:
    """Identifiers inside template tags of files below a ``templates`` directory, up to 1 MiB each (column: name)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{html,htm,txt,xml,jinja,jinja2,j2}").load(root)
    text = raw.where(F.col("path").contains("/templates/") & (F.col("length") <= 1 << 20)).select(F.decode("content", "UTF-8").alias("t"))
    tags = text.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?s)\{\{(.*?)\}\}|\{%(.*?)%\}"), 0)).alias("tag"))
    return tags.select(F.explode(F.regexp_extract_all("tag", F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)).alias("name")).distinct()


def dense_ids(df: DataFrame, by: str, name: str) -> DataFrame:
    """Ids from 0 in order of ``by``, counted inside range partitions and shifted by the sizes of those before."""
    ranged = cut(df.repartitionByRange(by).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").count()
    shift = sizes.withColumn("__o", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__o")
    n = F.row_number().over(Window.partitionBy("__p").orderBy(by)) - 1
    return ranged.join(F.broadcast(shift), "__p").withColumn(name, (n + F.col("__o")).cast("int")).drop("__p", "__o")


def scan_project(sources: DataFrame, root: str, config: Config | None = None) -> DataFrame:
    """One row for each file with everything that one pass over it finds, cut in the checkpoint folder."""
    config = config or Config()
    scanned = sources.mapInPandas(_scanner(root, config.marker), SCANNED)
    excluded = C.matches_any(F.col("rel_path"), config.exclude)
    ids = dense_ids(scanned, "path", "file_id")
    return cut(ids.withColumn("reported", ~F.col("path").endswith(".pyi") & ~excluded))


def _each(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    return rows.select("file_id", *keep, F.explode(column).alias("x")).select("file_id", *keep, "x.*")


def project_facts(sources: DataFrame, root: str = "", config: Config | None = None, distributions: DataFrame | None = None, extra_names: DataFrame | None = None) -> FactSet:
    """All tables of a project. distributions: (top_level, dist) of what is installed; extra_names: attribute names from elsewhere, such as templates."""
    rows = scan_project(sources, root, config)
    files = rows.select("file_id", "path", "rel_path", "module", "main_guard", "exports", "reads_globals", "reported")
    modules = files.where("module is not null").groupBy("module").agg(F.min_by("file_id", F.struct(F.col("path").endswith(".pyi"), "file_id")).alias("target")).cache()
    symbols = _each(rows, "symbols").cache()
    aliases = rows.select("file_id", "module", F.explode("aliases").alias("a")).select("file_id", "module", F.col("a.name").alias("name"), F.col("a.module").alias("to"), F.col("a.attr").alias("attr")).cache()

    # What only some analyses need is built when one of them asks.
    @cache
    def resolved() -> tuple[DataFrame, DataFrame]:
        return _resolve(rows, symbols, aliases, modules)

    @cache
    def inheritance() -> tuple[DataFrame, DataFrame, DataFrame]:
        named = symbols.join(rows.select("file_id", "module"), "file_id").withColumn("qualified", F.concat_ws(".", "module", "name"))
        return tuple(cut(t) for t in _ancestry(named, resolved()[1]))

    listed = lambda name: rows.select("file_id", F.posexplode(name).alias("seq", "x")).select("file_id", "seq", "x.*")
    words = lambda column, name: rows.select(F.explode(column).alias(name)).distinct()
    tables = {
        "files": files, "symbols": lambda: _final_symbols(symbols, _decorator_origin(rows, symbols, aliases, modules, distributions)), "refs": lambda: resolved()[0],
        "imports": lambda: _imports(rows, modules), "ext_imports": lambda: _external(rows, modules, distributions),
        "ancestry": lambda: inheritance()[0], "overrides": lambda: inheritance()[1], "registered": lambda: inheritance()[2],
        "attr_names": _net(rows, extra_names), "attr_prefixes": words("attr_prefixes", "prefix"), "param_names": words("param_names", "name"), "path_literals": words("path_literals", "literal"),
        "suppressions": listed("suppressions"), "function_metrics": listed("metrics"), "tokens": listed("tokens"), "deletables": listed("deletables"), "sources": rows.select("file_id", "text"),
        "resolutions": rows.select("file_id", "path", "resolution", "seconds"),
    }
    return FactSet(rows.sparkSession, tables)


def _net(rows: DataFrame, extra: DataFrame | None) -> DataFrame:
    names = rows.select(F.explode("attr_names").alias("name"))
    return (names if extra is None else names.union(extra)).distinct()


def _resolve(rows: DataFrame, symbols: DataFrame, aliases: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, bases): every use of a project definition, and the resolved bases of classes (file_id, ordinal, base_file, base_ordinal, name).

    A use is a module and a chain of names. Each round takes one step: to a
    member of the module, a submodule, the target of an import in it, or of a
    wildcard import in it; a chain that takes none of them leaves the project.
    """
    top = symbols.where("parent_ordinal is null").groupBy("file_id", "name").agg(F.collect_list(F.struct("ordinal", "name_start")).alias("defs"))
    home = rows.select("file_id", F.coalesce("module", F.concat(F.lit("#"), "path")).alias("home"))
    members = top.join(home, "file_id").select(F.col("home").alias("module"), F.col("name").alias("head"), F.col("file_id").alias("def_file"), "defs").cache()
    links = aliases.where("attr is not null or name <> '*'").join(home, "file_id").where("name <> '*'").select(F.col("home").alias("module"), F.col("name").alias("head"), F.col("to").alias("l_to"), "attr").distinct().cache()
    wild = aliases.where("name = '*'").join(home, "file_id").select(F.col("home").alias("module"), F.col("to").alias("w_to")).distinct().cache()
    known = modules.select(F.col("module").alias("sub")).withColumn("is_module", F.lit(True)).cache()

    split = lambda c: F.split(c, r"\.")
    uses = _each(rows, "uses").join(home, "file_id").select(F.col("file_id").alias("use_file"), F.col("start").alias("use_start"), F.col("end").alias("use_end"), F.lit(-1).alias("cls"), F.col("home").alias("module"), split("name").alias("chain"))
    imported = rows.select("file_id", F.explode("imports").alias("i")).where("i.attr is not null and i.attr <> '*'").select("file_id", F.col("i.start"), F.col("i.end"), F.lit(-1), F.col("i.module"), F.array("i.attr"))
    # A dotted string names a definition by the longest module it begins with.
    said = _each(rows, "strings").select("file_id", "start", "end", F.lit(-1), F.lit(""), split("name"))
    classes = symbols.where("kind = 'class'").select("file_id", "ordinal", "name_start", "name_end", F.posexplode("bases").alias("pos", "base")).join(home, "file_id")
    based = classes.select("file_id", F.col("pos"), F.lit(0), F.col("ordinal"), "home", split("base"))
    state = cut(uses.union(imported).union(said).union(based).distinct())
    found, outside, seen, hop = None, None, None, 0
    while True:
        head, rest = F.col("chain")[0], F.slice("chain", 2, F.size("chain"))
        step = state.where(F.size("chain") > 0).withColumn("head", head).join(members, ["module", "head"], "left")
        # A name that is both defined and imported in a module may mean either.
        left = cut(step.withColumn("sub", F.when(F.col("module") == "", head).otherwise(F.concat_ws(".", "module", "head"))).join(known, "sub", "left").join(links, ["module", "head"], "left").join(wild, "module", "left"))
        hit = left.where("defs is not null").select("use_file", "use_start", "use_end", "cls", "def_file", F.explode("defs").alias("d"), "chain").select("use_file", "use_start", "use_end", "cls", "def_file", F.col("d.ordinal").alias("def_ordinal"), F.col("d.name_start").alias("def_start"), "chain")
        open_ = F.col("defs").isNull() | F.col("l_to").isNotNull()
        sub_to = F.when(F.col("is_module"), F.struct(F.col("sub").alias("module"), rest.alias("chain")))
        link_to = F.when(F.col("l_to").isNotNull(), F.struct(F.col("l_to").alias("module"), F.when(F.col("attr").isNull(), rest).otherwise(F.concat(F.array("attr"), rest)).alias("chain")))
        wild_to = F.when(F.col("w_to").isNotNull() & F.col("l_to").isNull() & F.col("defs").isNull(), F.struct(F.col("w_to").alias("module"), F.col("chain")))
        options = F.array_compact(F.array(link_to, sub_to, wild_to))
        next_ = left.where(open_).select("use_file", "use_start", "use_end", "cls", "module", "chain", F.explode_outer(options).alias("n"))
        lost = next_.where("n is null and cls >= 0").select("use_file", "use_start", "cls", F.concat_ws(".", F.when(~F.col("module").startswith("#") & (F.col("module") != ""), F.col("module")), F.array_join("chain", ".")).alias("name"), (F.lit(hop) > 0).alias("imported"))
        state2 = next_.where("n is not null").select("use_file", "use_start", "use_end", "cls", "n.module", "n.chain").distinct()
        # Imports may lead in circles, so a state that was met before goes no further.
        seen = state if seen is None else seen.union(state)
        state = cut(state2.join(seen, state2.columns, "left_anti"))
        found = hit if found is None else found.union(hit)
        outside = lost if outside is None else outside.union(lost)
        hop += 1
        if state.isEmpty():
            break
    refs = found.where("cls < 0").select("def_file", "def_start", "use_file", "use_start", "use_end").union(_fixtures(rows, symbols)).distinct()
    refs = _implemented(refs, rows, symbols)
    inner = found.where("cls >= 0 and size(chain) = 1").select(F.col("use_file").alias("file_id"), F.col("cls").alias("ordinal"), F.col("def_file").alias("base_file"), F.col("def_ordinal").alias("base_ordinal"), F.lit(None).cast("string").alias("name"), F.lit(True).alias("known"))
    outer = outside.select(F.col("use_file").alias("file_id"), F.col("cls").alias("ordinal"), F.lit(None).cast("int").alias("base_file"), F.lit(None).cast("int").alias("base_ordinal"), "name", "imported")
    return refs, inner.union(outer).distinct()


def _fixtures(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """References of parameters of tests and fixtures to the fixture that they name: one of the same file, else that of the nearest conftest.py above."""
    asked = _each(rows, "params", "rel_path").select(F.col("file_id").alias("use_file"), F.col("start").alias("use_start"), F.col("end").alias("use_end"), "name", C.parent_dir(F.col("rel_path")).alias("dir"))
    is_fixture = F.exists("decorators", lambda d: C.last_segment(d["name"]) == "fixture")
    own = symbols.where(F.col("kind").isin("function", "method") & is_fixture).join(rows.select("file_id", "rel_path"), "file_id")
    own = own.select(F.col("file_id").alias("def_file"), F.col("name_start").alias("def_start"), "name", C.parent_dir(F.col("rel_path")).alias("def_dir"), (C.file_name(F.col("rel_path")) == "conftest.py").alias("shared"))
    here = asked.join(own.drop("def_dir", "shared"), (F.col("use_file") == F.col("def_file")) & (asked["name"] == own["name"])).select("use_file", "use_start", "use_end", "def_file", "def_start", F.lit(1 << 20).alias("depth"))
    # A directory lies below itself, those above it, and the root.
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    up = asked.withColumn("def_dir", F.explode(F.array_distinct(above)))
    there = up.join(own.where("shared").drop("shared"), ["def_dir", "name"]).select("use_file", "use_start", "use_end", "def_file", "def_start", F.length("def_dir").alias("depth"))
    nearest = Window.partitionBy("use_file", "use_start").orderBy(F.desc("depth"))
    every = here.union(there).withColumn("n", F.rank().over(nearest)).where("n = 1")
    return every.select("def_file", "def_start", "use_file", "use_start", "use_end")


def _implemented(refs: DataFrame, rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """``refs`` with what is declared in a stub moved to the definition of that name in the file it stands for."""
    stem = F.regexp_replace("path", r"\.pyi?$", "")
    stubs = rows.where(F.col("path").endswith(".pyi")).select(F.col("file_id").alias("stub"), stem.alias("stem"))
    pairs = stubs.join(rows.where(F.col("path").endswith(".py")).select(F.col("file_id").alias("real"), stem.alias("stem")), "stem")
    if pairs.isEmpty():
        return refs
    real = symbols.groupBy(F.col("file_id").alias("real"), "name").agg(F.max_by("name_start", "ordinal").alias("real_start"))
    declared = symbols.select(F.col("file_id").alias("stub"), F.col("name_start").alias("stub_start"), "name")
    moved = pairs.join(declared, "stub").join(real, ["real", "name"]).select(F.col("stub").alias("def_file"), F.col("stub_start").alias("def_start"), "real", "real_start")
    out = refs.join(moved, ["def_file", "def_start"], "left")
    return out.select(F.coalesce("real", "def_file").alias("def_file"), F.coalesce("real_start", "def_start").alias("def_start"), "use_file", "use_start", "use_end").distinct()


_STD = tuple(sorted(STDLIB - {"antigravity", "this", "idlelib", "turtledemo", "test", "__main__"}))


def _stdlib_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of standard classes, as the running interpreter has them."""
    import builtins
    import importlib

    for pdf in batches:
        out = []
        for name in pdf["name"]:
            module, _, cls = name.rpartition(".")
            try:
                obj = getattr(importlib.import_module(module) if module and module.split(".")[0] in _STD else builtins, cls, None)
            except ImportError:
                obj = None
            if isinstance(obj, type):
                names = [f"{c.__module__}.{c.__qualname__}" for c in obj.__mro__ if c is not object]
                out.append((name, names, sorted(set(dir(obj)) - set(dir(object)))))
        yield pd.DataFrame(out, columns=["name", "names", "members"])


def _ancestry(symbols: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ancestry, overrides, registered) of classes and, by their class, of members."""
    classes = symbols.where("kind = 'class'").select("file_id", "ordinal", "qualified", F.coalesce("open_base", F.lit(False)).alias("open_base"))
    edges = bases.where("base_file is not null").select("file_id", "ordinal", "base_file", "base_ordinal").distinct().cache()
    front = edges.withColumn("level", F.lit(1))
    up = front
    while True:
        step = front.select("file_id", "ordinal", "level", F.col("base_file").alias("f"), F.col("base_ordinal").alias("o")).join(edges.toDF("f", "o", "base_file", "base_ordinal"), ["f", "o"]).select("file_id", "ordinal", "base_file", "base_ordinal", (F.col("level") + 1).alias("level")).distinct()
        front = cut(step.join(up, ["file_id", "ordinal", "base_file", "base_ordinal"], "left_anti"))
        if front.isEmpty():
            break
        up = cut(up.union(front))
    me = classes.select("file_id", "ordinal", F.col("file_id").alias("base_file"), F.col("ordinal").alias("base_ordinal"), F.lit(0).alias("level"))
    every = up.union(me).groupBy("file_id", "ordinal", "base_file", "base_ordinal").agg(F.min("level").alias("level"))
    outside = bases.where("base_file is null and name is not null").select(F.col("file_id").alias("base_file"), F.col("ordinal").alias("base_ordinal"), "name", "known")
    std = outside.select("name").distinct().mapInPandas(_stdlib_members, "name string, names array<string>, members array<string>").cache()
    far = every.join(outside, ["base_file", "base_ordinal"]).join(std, "name", "left")
    far_names = far.groupBy("file_id", "ordinal").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("names", F.array("name"))))).alias("far"), F.count_if(F.col("names").isNull()).alias("lost"), F.flatten(F.collect_list(F.coalesce("members", F.expr("cast(array() as array<string>)")))).alias("far_members"))
    return _ancestry_tables(symbols, classes, every, far_names)


def _ancestry_tables(symbols: DataFrame, classes: DataFrame, every: DataFrame, far_names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    names = classes.select(F.col("file_id").alias("base_file"), F.col("ordinal").alias("base_ordinal"), "qualified", F.col("open_base").alias("open"))
    near = every.join(names, ["base_file", "base_ordinal"])
    own = (F.col("file_id") == F.col("base_file")) & (F.col("ordinal") == F.col("base_ordinal"))
    # The nearest first; a walk up a hierarchy gives up after so many classes.
    ranked = F.array_sort(F.collect_set(F.when(~own, F.struct("level", "qualified"))))
    near = near.groupBy("file_id", "ordinal").agg(ranked["qualified"].alias("near"), F.max("open").alias("open"))
    a = near.join(far_names, ["file_id", "ordinal"], "left")
    of_class = a.select("file_id", "ordinal", (~F.col("open") & (F.coalesce("lost", F.lit(0)) == 0)).alias("complete"), F.slice(F.array_distinct(F.concat("near", F.coalesce("far", F.expr("cast(array() as array<string>)")))), 1, MAX_ANCESTORS).alias("names"))
    members = symbols.where("parent_ordinal is not null").select("file_id", "ordinal", "name", "parent_ordinal")
    inherited = members.join(of_class.withColumnRenamed("ordinal", "parent_ordinal"), ["file_id", "parent_ordinal"]).select("file_id", "ordinal", "complete", "names")
    ancestry = of_class.union(inherited)
    above = every.where(~own).select("file_id", F.col("ordinal").alias("parent_ordinal"), "base_file", "base_ordinal")
    theirs = members.select(F.col("file_id").alias("base_file"), F.col("parent_ordinal").alias("base_ordinal"), "name")
    near_over = members.join(above.join(theirs, ["base_file", "base_ordinal"]).select("file_id", "parent_ordinal", "name").distinct(), ["file_id", "parent_ordinal", "name"], "left_semi").select("file_id", "ordinal")
    far_over = members.join(far_names.select("file_id", F.col("ordinal").alias("parent_ordinal"), "far_members"), ["file_id", "parent_ordinal"]).where(F.array_contains("far_members", F.col("name"))).select("file_id", "ordinal")
    hooks = members.where("name = '__init_subclass__'").select(F.col("file_id").alias("base_file"), F.col("parent_ordinal").alias("base_ordinal")).distinct()
    registered = every.where(~own).join(hooks, ["base_file", "base_ordinal"], "left_semi").select("file_id", "ordinal").distinct()
    return ancestry, near_over.union(far_over).distinct(), registered


def _decorator_origin(rows: DataFrame, symbols: DataFrame, aliases: DataFrame, modules: DataFrame, distributions: DataFrame | None) -> DataFrame:
    """(file_id, ordinal, pos, module): where a decorator, or the call that made the object it hangs on, is defined.

    Only what resolves has a module: the project's own, the standard library's,
    or one that an installed distribution provides. An object of another project
    file is followed to the call that made it there, one step.
    """
    known = modules.select(F.col("module").alias("m"), F.col("target"))
    tops = rows.sparkSession.createDataFrame([(t,) for t in _STD], "top string")
    if distributions is not None:
        tops = tops.union(distributions.select("top_level")).distinct()
    links = aliases.where("name <> '*'").groupBy("file_id", F.col("name").alias("head")).agg(F.min(F.struct("to", "attr")).alias("l")).select("file_id", "head", "l.to", "l.attr")
    links = links.join(known, F.col("to") == F.col("m"), "left").drop("m").join(tops, F.split("to", r"\.")[0] == F.col("top"), "left")
    links = links.select("file_id", "head", "to", "attr", "target", (F.col("target").isNotNull() | F.col("top").isNotNull()).alias("resolved"))
    made = rows.select(F.col("file_id").alias("target"), F.explode("makers").alias("k")).select("target", F.col("k.name").alias("attr"), F.split("k.callee", r"\.")[0].alias("callee"))
    there = links.select(F.col("file_id").alias("target"), F.col("head").alias("callee"), F.col("to").alias("made_in"), F.col("resolved").alias("made_resolved"))
    far = made.join(there, ["target", "callee"])
    links = links.join(far, ["target", "attr"], "left")
    module = F.when(F.col("made_in").isNotNull(), F.when(F.col("made_resolved"), F.col("made_in"))).when(F.col("resolved"), F.col("to"))
    links = links.select("file_id", "head", module.alias("module"), F.lit(True).alias("linked"))
    own = symbols.where("parent_ordinal is null").select("file_id", F.col("name").alias("head")).distinct().join(rows.select("file_id", F.col("module").alias("home")), "file_id")
    d = symbols.select("file_id", "ordinal", F.posexplode("decorators").alias("pos", "d")).select("file_id", "ordinal", "pos", F.split(F.coalesce("d.maker", "d.name"), r"\.")[0].alias("head"))
    got = d.join(links, ["file_id", "head"], "left").join(own, ["file_id", "head"], "left")
    return got.select("file_id", "ordinal", "pos", F.when(F.col("linked"), F.col("module")).otherwise(F.col("home")).alias("module")).where("module is not null")


def _final_symbols(symbols: DataFrame, origin: DataFrame) -> DataFrame:
    per = origin.groupBy("file_id", "ordinal").agg(F.map_from_entries(F.collect_list(F.struct("pos", "module"))).alias("from"))
    first = lambda m: F.split(m, r"\.")[0]

    def full(d, i):
        m = F.try_element_at("from", i)
        origin_ = F.when(m.isNull(), "unknown").when(first(m).isin(*_STD), "stdlib").otherwise("package")
        return F.struct(d["name"].alias("name"), d["keywords"].alias("keywords"), m.alias("module"), origin_.alias("provenance"), d["call"].alias("call"))

    out = symbols.join(per, ["file_id", "ordinal"], "left")
    return out.withColumn("decorators", F.transform("decorators", full).cast(f"array<{DECORATOR}>")).drop("from", "open_base")


def _imports(rows: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges to every module an import names: ``a.b.c`` to a, a.b and a.b.c, ``from a import b`` to a and, where it is one, a.b; strings and computed names give deferred ones."""
    i = rows.select("file_id", F.explode("imports").alias("i")).select("file_id", "i.*")
    whole = F.when(F.col("attr").isNull() | (F.col("attr") == "*"), F.col("module")).otherwise(F.concat_ws(".", "module", "attr"))
    named = i.select("file_id", "seq", "line", "column", "kind", F.when(F.col("attr") == "*", F.col("module")).alias("leaf"), F.explode(C.prefixes(whole)).alias("m"))
    named = named.select("file_id", "seq", "line", "column", "kind", F.when(F.col("leaf") == F.col("m"), "wildcard").otherwise("explicit").alias("names"), "m")
    said = _each(rows, "strings").select("file_id", F.lit(1 << 20).alias("seq"), "line", "column", F.lit("deferred").alias("kind"), F.lit("explicit").alias("names"), F.explode(C.prefixes(F.col("name"))).alias("m"))
    edges = named.union(said).join(modules.withColumnRenamed("module", "m"), "m")
    wide = rows.select("file_id", F.explode("package_wide").alias("package"))
    below = modules.select("target", F.explode(C.prefixes(F.col("module"))).alias("package"))
    wide = wide.join(below, "package").select("file_id", F.lit(1 << 21).alias("seq"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.lit("deferred").alias("kind"), F.lit("explicit").alias("names"), "target")
    return edges.select("file_id", "seq", "line", "column", "kind", "names", "target").union(wide).select(F.col("file_id").alias("src_file"), "seq", F.col("target").alias("target_file"), "line", "column", "kind", "names")


def _external(rows: DataFrame, modules: DataFrame, distributions: DataFrame | None) -> DataFrame:
    """Absolute imports of what is neither standard nor the project's own, with the distributions that provide it."""
    own = modules.select(F.split("module", r"\.")[0].alias("top_level")).distinct()
    i = rows.select("file_id", F.explode("imports").alias("i")).select("file_id", "i.*").where("level = 0").select("file_id", "seq", "line", "column", "condition", F.split("module", r"\.")[0].alias("top_level"))
    if distributions is not None:
        # A distribution that a string names, as in a list of installed applications, is in use.
        said = _each(rows, "words").unionByName(_each(rows, "strings").select("file_id", "name", "line", "column")).select("file_id", F.lit(1 << 22).alias("seq"), "line", "column", F.lit("always").alias("condition"), F.split("name", r"\.")[0].alias("top_level"))
        i = i.union(said.where("length(top_level) >= 3").join(distributions.select("top_level"), "top_level", "left_semi").select(i.columns))
    i = i.where(~F.col("top_level").isin(*STDLIB) & ~F.col("top_level").startswith("__") & (F.col("top_level") != "")).join(own, "top_level", "left_anti")
    none = F.expr("cast(array() as array<string>)")
    if distributions is None:
        i = i.withColumn("distributions", none).withColumn("origin", F.lit("unresolved"))
    else:
        by = distributions.groupBy("top_level").agg(F.array_sort(F.collect_set("dist")).alias("distributions"))
        i = i.join(by, "top_level", "left").withColumn("origin", F.when(F.col("distributions").isNull(), "unresolved").otherwise("site-packages")).withColumn("distributions", F.coalesce("distributions", none))
    return i.select("file_id", "seq", "top_level", "line", "column", "origin", "distributions", "condition")


def slowest(facts: FactSet) -> DataFrame:
    """(path, seconds) of the file that took longest to scan."""
    return facts.resolutions.agg(F.max(F.struct("seconds", "path")).alias("m")).where("m is not null").select("m.path", "m.seconds")


def uses_by_definition(refs: DataFrame) -> DataFrame:
    """(def_file, def_start, uses, files, first_file, first_start): references turned around. Counts and the first use stand for the list, so a definition that everything uses is one row."""
    return refs.groupBy("def_file", "def_start").agg(F.count("*").alias("uses"), F.count_distinct("use_file").alias("files"), F.min(F.struct("use_file", "use_start")).alias("f")).select("def_file", "def_start", "uses", "files", F.col("f.use_file").alias("first_file"), F.col("f.use_start").alias("first_start"))
