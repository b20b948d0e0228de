"""Registration of the core's queries, and cleaned base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions that the SQL of several queries starts with.
CTE = {
    "syms": """syms AS (
        SELECT DISTINCT canonical_id, display_name, lower(trim(kind)) AS kind, class, workspace_id, document_path, span_start,
               span_end, start_line, start_column, end_line, end_column, test_rule FROM symbols WHERE canonical_id IS NOT NULL)""",
    "occs": """occs AS (
        SELECT DISTINCT id, symbol_id, document_path, span_start, span_end, start_line, start_column, role, rule,
               enclosing_id, locality FROM occurrences WHERE id IS NOT NULL)""",
    "edges": """edges AS (
        SELECT DISTINCT CASE d.kind WHEN 'module' THEN 'imports' WHEN 'type' THEN 'type_hierarchy' ELSE 'uses' END AS kind,
               o.enclosing_id AS src, o.symbol_id AS dst
        FROM occs o JOIN syms d ON d.canonical_id = o.symbol_id JOIN syms s ON s.canonical_id = o.enclosing_id
        WHERE o.role = 'reference')""",
}


def with_ctes(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(CTE[n] for n in names)


def query(sql: str | None = None, name: str | None = None):
    """Register a query (spark, folder) -> DataFrame, with its SQL where there is one."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return put


_SYMBOL_COLUMNS = ["canonical_id", "display_name", "class", "workspace_id", "document_path", "span_start", "span_end", "start_line", "start_column", "end_line", "end_column", "test_rule"]


def symbols(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Symbols once each, without the texts unless asked for; kinds in one spelling."""
    rows = table(spark, d, "symbols").where("canonical_id IS NOT NULL")
    return rows.select(*_SYMBOL_COLUMNS, F.lower(F.trim("kind")).alias("kind"), *more).dropDuplicates(["canonical_id"])


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences once each."""
    rows = table(spark, d, "occurrences").where("id IS NOT NULL")
    return rows.select("id", "symbol_id", "document_path", "span_start", "span_end", "start_line", "start_column", "role", "rule", "enclosing_id", "locality").dropDuplicates(["id"])
