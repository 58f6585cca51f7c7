"""Fact tables about a code base: what extraction yields and every analysis reads."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECORATOR = "struct<name:string,keywords:array<string>,module:string,provenance:string,call:string>"

#: Columns of each table. Offsets are bytes, half-open; lines and columns count from 1.
SCHEMAS: dict[str, str] = {
    "files": "file_id int, path string, rel_path string, module string, main_guard boolean, exports array<string>, reads_globals boolean, reported boolean",
    "symbols": f"file_id int, ordinal int, name string, kind string, parent_ordinal int, decorators array<{DECORATOR}>, bases array<string>, class_keywords array<string>, name_start int, name_end int, full_start int, full_end int, line int, column int, full_line int",
    "refs": "def_file int, def_start int, use_file int, use_start int, use_end int",
    "imports": "src_file int, seq int, target_file int, line int, column int, kind string, names string",
    "ext_imports": "file_id int, seq int, top_level string, line int, column int, origin string, distributions array<string>, condition string",
    "attr_names": "name string",
    "attr_prefixes": "prefix string",
    "param_names": "name string",
    "path_literals": "literal string",
    "dist_requires": "dist string, requires string",
    "ancestry": "file_id int, ordinal int, complete boolean, names array<string>",
    "overrides": "file_id int, ordinal int",
    "registered": "file_id int, ordinal int",
    "suppressions": "file_id int, seq int, line int, scope_kind string, rules array<string>",
    "function_metrics": "file_id int, seq int, name string, owner string, line int, column int, lines int, parameters int, cyclomatic int, cognitive int, max_nesting int",
    "tokens": "file_id int, seq int, kind string, text string, line int, nesting string",
    "deletables": "file_id int, seq int, name string, line int, column int, start int, end int, would_be_empty boolean",
    "sources": "file_id int, text string",
    "resolutions": "file_id int, path string, resolution string, seconds double",
    "scopes": "scope_id int, manifest_path string, directory string, name string",
    "dependencies": "scope_id int, seq int, name string, group_kind string, group_name string",
    "entry_points": "kind string, module string, attribute string",
}


class FactSet:
    """Tables by name, each a DataFrame or a function that builds it when it is first asked for; a table that was not given is empty."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]]):
        self.spark = spark
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self.spark.createDataFrame([], SCHEMAS[name])
        if not isinstance(self._tables[name], DataFrame):
            self._tables[name] = self._tables[name]()
        return self._tables[name]

    @classmethod
    def from_rows(cls, spark: SparkSession, **rows: Iterable[dict]) -> FactSet:
        """Tables from dictionaries; a column that a row leaves out is null."""
        from pyspark.sql.types import _parse_datatype_string

        tables = {}
        for name, values in rows.items():
            schema = _parse_datatype_string(SCHEMAS[name])
            tables[name] = spark.createDataFrame([tuple(v.get(c) for c in schema.names) for v in values], schema)
        return cls(spark, tables)

    def with_tables(self, **tables: DataFrame) -> FactSet:
        return FactSet(self.spark, self._tables | tables)


#: Columns of every finding; those of other kinds of finding are null.
PLACE = "struct<path:string,module:string,line:int,column:int>"
FINDING = f"""rule string, path string, module string, line int, column int, confidence string, message string,
symbol string, owner string, chain array<{PLACE}>, lines int, tokens int, end_line int,
others array<struct<path:string,module:string,line:int,column:int,end_line:int>>, distribution string, modules array<string>,
from_module string, to_module string, rule_text string, function string, cyclomatic int, cognitive int, parameters int, max_nesting int"""


def finding(df: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of a finding."""
    from pyspark.sql.types import _parse_datatype_string

    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(FINDING)))
