"""Definitions and files that nothing refers to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..facts import FactSet, finding
from ..functions import columns as C
from ..operators import graph, joins
from ..storage import cut
from . import rules
from .rules import base as B
from .rules.places import ROOT_FILES, in_root_directory, tool_config

#: Names that make a file a settings module (fixed values).
CORE_SETTINGS = ("INSTALLED_APPS", "DATABASES", "SECRET_KEY", "ROOT_URLCONF", "MIDDLEWARE")
#: File names that as literals name nothing in particular, and files a literal may fit at most (fixed values).
GENERIC_LITERALS = ("__init__.py", "__main__.py", "conftest.py", "setup.py")
MAX_LITERAL_FILES = 16
NOUNS = {"unused-function": "function", "unused-class": "class", "unused-variable": "variable", "unused-method": "method", "unused-attribute": "attribute"}


@dataclass
class Report:
    """Findings (sorted by path components and position), what was kept and why, and one row of counts."""

    findings: DataFrame
    kept: DataFrame
    summary: DataFrame


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.split("path", "/"), F.struct("line", "column"), "rule", "message")


def settings_files(facts: FactSet) -> DataFrame:
    """Files that define core settings, siblings of only assignments, and whatever those import by wildcard."""
    files = facts.files.where("reported").select("file_id", C.parent_dir(F.col("rel_path")).alias("dir"), C.file_name(F.col("rel_path")).alias("name"), (F.size(F.split("rel_path", "/")) > 0).alias("has_dir"))
    top = facts.symbols.where("parent_ordinal is null")
    core = files.join(top.where(F.col("name").isin(*CORE_SETTINGS)).select("file_id").distinct(), "file_id", "left_semi")
    busy = top.where(~F.col("kind").isin("variable", "constant", "import")).select("file_id").distinct()
    siblings = files.where("name <> '__init__.py'").join(core.select("dir").distinct(), "dir", "left_semi").join(busy, "file_id", "left_anti")
    seeds = core.select("file_id").union(siblings.select("file_id")).distinct()
    wild = facts.imports.where("names = 'wildcard'").select(F.col("src_file").alias("src"), F.col("target_file").alias("dst"))
    pulled = graph.reachable(wild, seeds.withColumnRenamed("file_id", "root"), most=1 << 30)
    return seeds.union(pulled.select(F.col("node").alias("file_id"))).distinct()


def file_roles(facts: FactSet) -> DataFrame:
    """(file_id, role): the first role that fits; files without one are left out. Found once for a set of facts."""
    if "_roles" not in vars(facts):
        facts._roles = cut(_file_roles(facts))
    return facts._roles


def _file_roles(facts: FactSet) -> DataFrame:
    files = facts.files.where("reported").select("file_id", "rel_path", "module")
    rel = F.col("rel_path")
    parent, grand = C.parent_dir(rel), C.parent_dir(C.parent_dir(rel))
    owners = files.where(C.parent_name(rel) == "versions").select(grand.alias("dir")).distinct()
    env = files.where(C.file_name(rel) == "env.py").join(owners, parent == F.col("dir"), "left_semi").select("file_id")
    scripts = files.where(C.parent_name(rel) == "versions").select("file_id")
    literals = facts.path_literals.select(F.regexp_replace("literal", r"^(?:\./)+", "").alias("literal")).where(F.col("literal").contains("/") | ~F.col("literal").isin(*GENERIC_LITERALS)).distinct()
    by_path = joins.files_ending_with(files, "rel_path", literals, "literal", MAX_LITERAL_FILES).select("file_id").distinct()
    mark = lambda df, role: df.distinct().withColumn(role, F.lit(True))
    out = files
    for df, role in ((settings_files(facts), "a"), (env.union(scripts), "b"), (by_path, "c")):
        out = out.join(mark(df, role), "file_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    integration = yes(F.col("module").rlike(r"^(?:homeassistant\.components|custom_components)\."))
    role = joins.first_match([("django-settings", yes(F.col("a"))), ("migration-script", yes(F.col("b"))), ("integration", integration), ("loaded-by-path", yes(F.col("c"))), ("tool-config", tool_config(rel))])
    return out.select("file_id", role.alias("role")).where("role is not null")


def candidate_rule() -> Column:
    """The rule that an unused symbol breaks, or null."""
    kind, nested = F.col("kind"), F.col("parent_ordinal").isNotNull()
    accessor = F.coalesce(F.exists("decorators", lambda d: C.last_segment(d["name"]).isin("setter", "deleter", "getter")), F.lit(False))
    top = F.when(kind == "function", "unused-function").when(kind == "class", "unused-class").when(kind.isin("variable", "constant"), "unused-variable")
    member = F.when(kind.isin("method", "property") & ~accessor, "unused-method").when(kind.isin("field", "constant"), "unused-attribute")
    return F.when(C.is_dunder(F.col("name")), None).when(nested, member).otherwise(top)


def used(facts: FactSet, symbols: DataFrame) -> DataFrame:
    """``symbols`` with is_used: a reference from outside its own definition, or for members any attribute of its name.

    References of a definition are summed up in one row: the least and greatest
    file, and the least start and greatest end inside the definition's own file,
    tell whether any reference lies outside.
    """
    r = facts.refs
    same = F.col("use_file") == F.col("def_file")
    agg = r.groupBy(F.col("def_file").alias("file_id"), F.col("def_start").alias("name_start")).agg(
        F.count_if(F.col("use_file").isNull()).alias("r_ext"), F.count_if(~same).alias("r_other"),
        F.min(F.when(same, F.col("use_start"))).alias("r_low"), F.max(F.when(same, F.col("use_end"))).alias("r_high"),
    )
    member = F.col("kind").isin("method", "property") | B.is_attribute
    net = joins.named(symbols.join(agg, ["file_id", "name_start"], "left"), "name", facts.attr_names, facts.attr_prefixes)
    outside = (F.col("r_ext") > 0) | (F.col("r_other") > 0) | (F.col("r_low") < F.col("full_start")) | (F.col("r_high") > F.col("full_end"))
    out = net.withColumn("is_used", F.coalesce(outside, F.lit(False)) | member & F.col("__named")).withColumnRenamed("__named", "as_attribute")
    return out.drop("r_ext", "r_other", "r_low", "r_high")


def confidence() -> Column:
    registering = F.coalesce(F.exists("decorators", lambda d: ~F.coalesce(d["provenance"] == "stdlib", F.lit(False)) & (d["name"].contains(".") | F.coalesce(d["call"] == "called", F.lit(False)))), F.lit(False))
    private, nested = C.is_private(F.col("name")), F.col("nested")
    return F.when(registering, "low").when(~nested & F.col("as_attribute"), "low").when(~nested & private, "high").when(nested & ~private, "low").otherwise("medium")


def _candidates(facts: FactSet, config: Config) -> DataFrame:
    files = facts.files.where("reported").select("file_id", "path", "rel_path", "module", "exports", "reads_globals")
    s = facts.symbols.withColumn("rule", candidate_rule()).where("rule is not null").withColumn("nested", F.col("parent_ordinal").isNotNull())
    ignored = C.matches_any(F.col("name"), config.ignore_names, crossing=False)
    s = used(facts, s.join(files, "file_id")).withColumn("ignored", ignored)
    parents = facts.symbols.select(
        "file_id", F.col("ordinal").alias("parent_ordinal"), F.col("name").alias("owner_name"),
        F.when(F.col("kind") == "class", F.struct("name", "decorators", "bases", "class_keywords", F.col("parent_ordinal").isNotNull().alias("nested"))).alias("owner"),
    )
    s = s.join(parents, ["file_id", "parent_ordinal"], "left")
    none = F.expr("cast(array() as array<string>)")
    asked = F.col("kind").isin("class", "method") | B.is_attribute
    s = s.join(facts.ancestry.withColumnRenamed("names", "ancestors"), ["file_id", "ordinal"], "left")
    s = s.withColumn("complete", F.coalesce(asked & F.col("complete"), F.lit(False))).withColumn("ancestors", F.coalesce(F.when(asked, F.col("ancestors")), none))
    flag = lambda df, name: df.select("file_id", "ordinal").distinct().withColumn(name, F.lit(True))
    s = s.join(flag(facts.overrides, "is_override"), ["file_id", "ordinal"], "left").join(flag(facts.registered, "registered"), ["file_id", "ordinal"], "left")
    s = s.join(file_roles(facts), "file_id", "left")
    s = s.join(facts.param_names.select("name").distinct().withColumn("requested", F.lit(True)), "name", "left")
    ep = facts.entry_points.where("attribute is not null").select("module", F.col("attribute").alias("name")).distinct().withColumn("is_entry_point", F.lit(True))
    s = s.join(ep, ["module", "name"], "left")
    for c in ("is_override", "registered", "requested", "is_entry_point", "reads_globals"):
        s = s.withColumn(c, F.coalesce(c, F.lit(False)))
    return s.withColumn("in_test_file", C.matches_any(C.file_name(F.col("rel_path")), config.tests.files, crossing=False)).withColumn("exports", F.coalesce("exports", none)).withColumn("decorators", F.coalesce("decorators", F.expr("cast(array() as array<struct<name:string,keywords:array<string>,module:string,provenance:string,call:string>>)")))


def verdicts(facts: FactSet, config: Config | None = None) -> DataFrame:
    """Every candidate with its verdict: ignored, used, kept, suppressed or dead, in that order of precedence."""
    config = config or Config()
    s = _candidates(facts, config).withColumn("reason", rules.keep_reason(config))
    per_file = facts.suppressions.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line", "scope_kind", "rules"))).alias("comments"))
    s = s.join(per_file, "file_id", "left")
    fits = F.filter("comments", lambda x: (x["scope_kind"] == "file") | ((x["scope_kind"] == "all") | F.array_contains(x["rules"], F.col("rule"))) & ((x["line"] == F.col("line")) | (x["line"] == F.col("full_line") - 1)))
    s = s.withColumn("silenced_by", F.get(fits, F.lit(0))["line"]).drop("comments")
    verdict = F.when(F.col("ignored"), "ignored").when(F.col("is_used"), "used").when(F.col("reason").isNotNull(), "kept").when(F.col("silenced_by").isNotNull(), "suppressed").otherwise("dead")
    return s.withColumn("verdict", verdict)


def unused_files(facts: FactSet, config: Config, kept: DataFrame) -> DataFrame:
    """Files that nothing imports, runs or loads: file_id, path, module, rel_path, suppressed."""
    files = facts.files.where("reported")
    imported = facts.imports.join(files.select(F.col("file_id").alias("src_file")), "src_file", "left_semi").where("src_file <> target_file").select(F.col("target_file").alias("file_id"))
    rel = F.col("rel_path")
    name = C.file_name(rel)
    root = F.col("main_guard") | name.isin(*ROOT_FILES) | in_root_directory(rel) | C.matches_any(name, config.tests.files, crossing=False) | C.under(rel, "tests", "test") | F.coalesce(C.parent_name(rel).isin("templatetags", "versions"), F.lit(False)) | tool_config(rel) | (name == "env.py") & C.under(rel, "alembic", "migrations")
    out = files.where(~F.coalesce(root, F.lit(False)))
    for gone in (imported, file_roles(facts).select("file_id"), kept.select("file_id")):
        out = out.join(gone.distinct(), "file_id", "left_anti")
    entry = facts.entry_points.select("module").where("module is not null").distinct()
    out = out.join(entry, "module", "left_anti")
    silent = facts.suppressions.where("scope_kind = 'file'").select("file_id").distinct().withColumn("suppressed", F.lit(True))
    return out.join(silent, "file_id", "left").select("file_id", "path", "module", "rel_path", F.coalesce("suppressed", F.lit(False)).alias("suppressed"))


def analyze(facts: FactSet, config: Config | None = None) -> Report:
    config = config or Config()
    v = verdicts(facts, config).persist()
    kept = v.where("verdict = 'kept'")
    message = F.concat(F.element_at(F.create_map(*(F.lit(x) for kv in NOUNS.items() for x in kv)), F.col("rule")), F.lit(" `"), F.concat_ws(".", "owner_name", "name"), F.lit("` is never used"))
    dead = v.where("verdict = 'dead'").select("rule", "path", "module", "line", "column", confidence().alias("confidence"), message.alias("message"), F.col("name").alias("symbol"), F.col("owner_name").alias("owner"))
    # A comment that silenced nothing; comments on kept or used symbols are among them.
    whole = facts.suppressions.where("scope_kind = 'file'").select("file_id").distinct()
    busy = v.where("verdict = 'suppressed'").select("file_id", F.col("silenced_by").alias("line")).distinct()
    files = facts.files.where("reported").select("file_id", "path", "module")
    stale = facts.suppressions.where("scope_kind <> 'file'").join(whole, "file_id", "left_anti").join(busy, ["file_id", "line"], "left_anti").join(files, "file_id")
    stale = stale.select(F.lit("unused-suppression").alias("rule"), "path", "module", "line", F.lit(1).alias("column"), F.lit("high").alias("confidence"), F.lit("suppression comment silences nothing").alias("message"))
    lost = unused_files(facts, config, kept)
    library = F.lit(False)
    for p in config.library_packages:
        library |= F.coalesce(C.covers(F.lit(p), F.col("module")), F.lit(False))
    lone = lost.where("not suppressed").select(
        F.lit("unused-file").alias("rule"), "path", "module", F.when(library, "low").otherwise("medium").alias("confidence"),
        F.concat(F.lit("file `"), F.coalesce("module", C.file_name(F.col("path"))), F.lit("` is never imported or run")).alias("message"),
    )
    rest = finding(dead).unionByName(finding(stale)).join(lone.select("path"), "path", "left_anti")
    findings = rest.select(*finding(lone).columns).unionByName(finding(lone))
    counts = v.agg(F.count("*").alias("symbols_checked"), F.count_if(F.col("verdict") == "kept").alias("symbols_kept"), F.count_if(F.col("verdict") == "ignored").alias("symbols_ignored"), F.count_if(F.col("verdict") == "suppressed").alias("silenced"))
    other = findings.agg(F.count("*").alias("findings")).crossJoin(lost.agg(F.count_if("suppressed").alias("s"))).crossJoin(facts.files.agg(F.count_if("reported").alias("files_scanned")))
    summary = counts.crossJoin(other).select("files_scanned", "symbols_checked", "symbols_kept", "symbols_ignored", (F.col("silenced") + F.col("s")).alias("suppressed"), "findings")
    shown = kept.select("path", "module", F.col("name").alias("symbol"), "line", "column", "reason.plugin", "reason.why")
    return Report(ordered(findings), shown.orderBy(F.split("path", "/"), "line", "column"), summary)
