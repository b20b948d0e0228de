"""Queries over the tables of a build, on sources made from the symbols' names so that SQL knows what has to come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.build import derive
from lodestrata.plans.base import query, symbols, with_ctes
from lodestrata.runtime import materialize

_PYTHON = "class Base:\n    def run(self):\n        return 1\n\nclass {n}(Base):\n    def run(self):\n        return helper()\n\ndef helper():\n    '''Helps a bit.'''\n    return unknown(2)\n"
_RUST = "#[test]\nfn check() { helper(3); }\ntrait Tr { fn go(&self); }\nstruct {n};\nimpl Tr for {n} { fn go(&self) {} }\n"

#: (document, n, text) of every symbol with a plain name; each second one lies in a folder of tests.
_SOURCES = f""", src AS (
        SELECT DISTINCT CASE WHEN length(display_name) % 2 = 0 THEN 'tests/' ELSE 'src/' END || replace(replace(canonical_id, '::', '_'), '#', '_') || regexp_extract(document_path, '\\.(rs|py)$') AS doc, display_name AS n
        FROM syms WHERE regexp_matches(display_name, '^[A-Za-z_]\\w*$') AND regexp_matches(document_path, '\\.(rs|py)$') AND display_name NOT IN ('Base', 'run', 'helper', 'check', 'Tr', 'go'))
    , texts AS (SELECT doc, n, doc LIKE '%.py' AS py, replace(CASE WHEN doc LIKE '%.py' THEN '{_PYTHON.replace("'", "''")}' ELSE '{_RUST}' END, '{{n}}', n) AS text, 'w::' || replace(regexp_replace(doc, '\\.[a-z]+$', ''), '/', '::') || '::' AS base FROM src)"""

#: Declarations in order, with kind and container: (name, kind, container).
_DECLARED = """, decl AS (
        SELECT doc, base, n, py, unnest(CASE WHEN py THEN [
            {'id': 'Base', 'kind': 'type', 'up': ''}, {'id': 'run#0', 'kind': 'function', 'up': 'Base'}, {'id': n, 'kind': 'type', 'up': ''}, {'id': 'run#1', 'kind': 'function', 'up': n}, {'id': 'helper', 'kind': 'function', 'up': ''}]
        ELSE [{'id': 'check', 'kind': 'function', 'up': ''}, {'id': 'Tr', 'kind': 'trait', 'up': ''}, {'id': 'go#0', 'kind': 'function', 'up': 'Tr'}, {'id': n, 'kind': 'type', 'up': ''}, {'id': 'go#1', 'kind': 'function', 'up': ''}] END) AS d FROM texts)"""


def _sources(spark, d) -> DataFrame:
    s = symbols(spark, d).where(F.col("display_name").rlike(r"^[A-Za-z_]\w*$") & F.col("document_path").rlike(r"\.(rs|py)$") & ~F.col("display_name").isin("Base", "run", "helper", "check", "Tr", "go"))
    doc = F.concat(F.when(F.length("display_name") % 2 == 0, "tests/").otherwise("src/"), F.replace(F.replace("canonical_id", F.lit("::"), F.lit("_")), F.lit("#"), F.lit("_")), F.regexp_extract("document_path", r"\.(rs|py)$", 0))
    text = F.when(F.col("document_path").endswith(".py"), F.lit(_PYTHON)).otherwise(F.lit(_RUST))
    return materialize(s.select(doc.alias("document_path"), F.replace(text, F.lit("{n}"), F.col("display_name")).alias("text")).distinct(), "sources")


def _occurrences(texts: DataFrame) -> DataFrame:
    """In Python the call of helper, and the same symbol at another name; in Rust the type at its impl."""
    base = F.concat(F.lit("w::"), F.replace(F.regexp_replace("document_path", r"\.[a-z]+$", ""), F.lit("/"), F.lit("::")), F.lit("::"))
    helper, name = F.concat(base, F.lit("helper")), F.regexp_extract("text", r"struct (\w+);", 1)

    def one(symbol, at, length):
        return F.struct(symbol.alias("symbol_id"), at.cast("int").alias("span_start"), (at + length).cast("int").alias("span_end"), F.lit("reference").alias("role"))

    place = lambda x: F.position(F.lit(x), F.col("text")) - 1
    python = F.array(one(helper, place("helper()"), F.lit(6)), one(helper, place("unknown("), F.lit(7)))
    rust = F.array(one(F.concat(base, name), place("for ") + 4, F.length(name)))
    return texts.select("document_path", F.explode(F.when(F.col("document_path").endswith(".py"), python).otherwise(rust)).alias("x")).select("document_path", "x.*")


def _built(spark, d, name: str) -> DataFrame:
    texts = _sources(spark, d)
    targets = texts.where("document_path LIKE '%.rs'").select(F.col("document_path").alias("target"), F.col("document_path").alias("root"), F.when(F.col("document_path").startswith("tests/"), "test").otherwise("lib").alias("unit"))
    return derive("w", texts, _occurrences(texts), targets)[name]


@query(with_ctes("syms") + _SOURCES + " SELECT doc AS document_path, sha256(text) AS content_hash FROM texts")
def built_source_files(spark, d):
    return _built(spark, d, "source_files")


@query(
    with_ctes("syms")
    + _SOURCES
    + _DECLARED
    + """ SELECT base || d.id AS canonical_id, d.kind AS kind, CASE WHEN NOT py AND d.id = 'check' THEN 'test_attribute' WHEN doc LIKE 'tests/%' THEN 'test_directory' END AS test_rule,
        CASE WHEN d.id = 'helper' THEN 'def helper():' WHEN d.id = 'Base' THEN 'class Base:' WHEN d.id LIKE 'run#%' THEN 'def run(self):' WHEN py THEN 'class ' || n || '(Base):'
            WHEN d.id = 'check' THEN 'fn check()' WHEN d.id = 'Tr' THEN 'trait Tr' WHEN d.id LIKE 'go#%' THEN 'fn go(&self)' ELSE 'struct ' || n END AS signature_text,
        CASE WHEN d.id = 'helper' THEN 'def helper():' || chr(10) || '''''''Helps a bit.''''''' END AS documented FROM decl"""
)
def built_symbols(spark, d):
    rows = _built(spark, d, "symbols")
    return rows.select("canonical_id", "kind", "test_rule", "signature_text", F.when(F.col("interface_text") != F.col("signature_text"), F.col("interface_text")).alias("documented"))


@query(
    with_ctes("syms")
    + _SOURCES
    + _DECLARED
    + """ SELECT 'contains' AS kind, base || d.up AS src, base || d.id AS dst FROM decl WHERE d.up <> ''
    UNION ALL SELECT 'type_hierarchy', base || n, base || CASE WHEN py THEN 'Base' ELSE 'Tr' END FROM texts
    UNION ALL SELECT 'overrides', base || CASE WHEN py THEN 'run#1' ELSE 'go#1' END, base || CASE WHEN py THEN 'run#0' ELSE 'go#0' END FROM texts
    UNION ALL SELECT 'uses', base || 'run#1', base || 'helper' FROM texts WHERE py"""
)
def built_edges(spark, d):
    return _built(spark, d, "edges")


@query(
    with_ctes("syms")
    + _SOURCES
    + """ SELECT base || CASE WHEN py THEN 'helper' ELSE n END AS symbol_id, doc AS document_path, CAST(strpos(text, CASE WHEN py THEN 'helper()' ELSE 'for ' || n END) - 1 + CASE WHEN py THEN 0 ELSE 4 END AS INT) AS span_start,
        'exact' AS rule, CASE WHEN py THEN base || 'run#1' END AS enclosing_id FROM texts"""
)
def built_occurrences(spark, d):
    return _built(spark, d, "occurrences").select("symbol_id", "document_path", "span_start", "rule", "enclosing_id")


@query(with_ctes("syms") + _SOURCES + " SELECT doc AS document_path, CAST(strpos(text, 'unknown(') - 1 AS INT) AS span_start, 'helper' AS name, 'unknown' AS found, 'text_mismatch' AS outcome FROM texts WHERE py")
def built_discrepancies(spark, d):
    return _built(spark, d, "discrepancies").select("document_path", "span_start", "name", "found", "outcome")


@query(with_ctes("syms") + _SOURCES + " SELECT base || 'helper' AS symbol_id, count(*) AS discrepancies FROM texts WHERE py GROUP BY 1")
def built_discrepancy_symbols(spark, d):
    return _built(spark, d, "discrepancy_symbols").groupBy("symbol_id").agg(F.count(F.lit(1)).alias("discrepancies"))


@query(with_ctes("syms") + _SOURCES + " SELECT doc AS document_path, CASE WHEN py THEN 'unknown' ELSE 'helper' END AS name, CAST(strpos(text, CASE WHEN py THEN 'unknown(' ELSE 'helper(' END) - 1 AS INT) AS start FROM texts")
def built_unresolved_calls(spark, d):
    return _built(spark, d, "unresolved_calls").select("document_path", "name", "start")


@query(with_ctes("syms") + _SOURCES + " SELECT base || CASE WHEN py THEN 'run' ELSE 'go' END AS base, CAST(2 AS BIGINT) AS members, base || CASE WHEN py THEN 'run#0' ELSE 'go#0' END AS first_id FROM texts")
def built_duplicate_keys(spark, d):
    return _built(spark, d, "duplicate_keys")


@query(with_ctes("syms") + _SOURCES + " SELECT doc AS document, CASE WHEN doc LIKE 'tests/%' THEN 'test' ELSE 'lib' END AS unit FROM texts WHERE NOT py")
def built_document_units(spark, d):
    return _built(spark, d, "document_units")


@query(with_ctes("syms") + _SOURCES + " SELECT outcome, CASE outcome WHEN 'aligned' THEN (SELECT count(*) FROM texts) WHEN 'text_mismatch' THEN (SELECT count(*) FROM texts WHERE py) ELSE 0 END AS count FROM (SELECT unnest(['aligned', 'text_mismatch', 'semantic_only', 'duplicate_ambiguous']) AS outcome)")
def built_outcomes(spark, d):
    """Accepted and refused places add up to all."""
    return _built(spark, d, "outcome_counts")


@query(with_ctes("syms") + _SOURCES + _DECLARED + " SELECT base || d.id AS symbol_id, string_split(regexp_replace(d.id, '#[0-9]$', ''), '_')[1] <> '' AS named FROM decl")
def built_passages(spark, d):
    """Every declaration here says more than its name, so each has a passage."""
    return _built(spark, d, "semantic_corpus").select("symbol_id", (F.length("render") > 0).alias("named"))
