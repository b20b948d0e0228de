"""Queries over tokens, keys, fingerprints and facts of sources made from the symbols' names, so that SQL knows them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import clones, experiment, impact, syntax
from lodestrata.plans.base import query, symbols, with_ctes
from lodestrata.plans.trials import _TRIALS, _trials
from lodestrata.runtime import materialize, table

_NAMED = """, src AS (SELECT canonical_id, display_name AS n, regexp_extract(document_path, '\\.(rs|py)$') AS ext FROM syms WHERE regexp_matches(display_name, '^[A-Za-z_]\\w*$') AND regexp_matches(document_path, '\\.(rs|py)$') AND display_name <> 'call')"""

_CODE = "{n} = {n} + 1 - 2 * call ( 3 , {n} , 4 , 5 , 1 )"
_WORDS = _CODE.split(" ")
#: How identifiers and literals are replaced consistently.
_REPLACED = {"{n}": "identifier0", "call": "identifier1", "1": "literal0", "2": "literal1", "3": "literal2", "4": "literal3", "5": "literal4"}
_KINDS = ["identifier" if w in ("{n}", "call") else "literal" if w.isdigit() else "other" for w in _WORDS]


def _part(text: str) -> str:
    """SQL for a token's length and spelling as they are hashed, in hex."""
    value = "n" if text == "{n}" else f"'{text}'"
    return f"printf('%02x', octet_length(encode({value}))) || '00000000000000' || hex(encode({value}))"


def _hash(words: list[str]) -> str:
    return "sha256(unhex(" + " || ".join(_part(w) for w in words) + "))"


def _sources(spark, d):
    s = symbols(spark, d).where(F.col("display_name").rlike(r"^[A-Za-z_]\w*$") & F.col("document_path").rlike(r"\.(rs|py)$") & (F.col("display_name") != "call"))
    ext = F.regexp_extract("document_path", r"\.(rs|py)$", 0)
    return s.select("canonical_id", F.concat("canonical_id", ext).alias("document_path"), F.col("display_name").alias("n"))


def _code(spark, d):
    return _sources(spark, d).select("canonical_id", "document_path", F.replace(F.lit(_CODE), F.lit("{n}"), F.col("n")).alias("span_text"))


@query(
    with_ctes("syms")
    + _NAMED
    + ", w AS (SELECT canonical_id, n, unnest(range(1, 21)) AS i, ["
    + ", ".join("n" if w == "{n}" else f"'{w}'" for w in _WORDS)
    + "] AS words FROM src) SELECT canonical_id, CAST(i - 1 AS INT) AS ordinal, ["
    + ", ".join(f"'{k}'" for k in _KINDS)
    + "][i] AS kind, words[i] AS text, CAST(CASE WHEN i = 1 THEN 0 ELSE length(array_to_string(words[:i - 1], ' ')) + 1 END AS INT) AS start FROM w"
)
def spelled_tokens(spark, d):
    return clones.spelled_tokens(_code(spark, d))


@query(with_ctes("syms") + _NAMED + f" SELECT canonical_id, {_hash(_WORDS)} AS formatting_key, {_hash([_REPLACED.get(w, w) for w in _WORDS])} AS substitution_key, CAST(20 AS INT) AS token_count FROM src")
def keys_of_templates(spark, d):
    """Both clone keys of one line of code in which only a name differs."""
    return clones.keyed(_code(spark, d))


_RUNS = [[k if k != "other" else w for k, w in zip(_KINDS, _WORDS)][i : i + 16] for i in range(5)]
_SIGNED = "CAST(CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END AS BIGINT)"
_LITTLE = " || ".join(f"substring(h, {2 * k + 1}, 2)" for k in range(7, -1, -1))


@query(
    with_ctes("syms")
    + _NAMED
    + ", runs AS (SELECT unnest(range(0, 5)) AS i, unnest(["
    + ", ".join(_hash(r) for r in _RUNS)
    + f"]) AS h), nums AS (SELECT i, CAST('0x' || {_LITTLE} AS UBIGINT) AS u FROM runs), signed AS (SELECT i, {_SIGNED} AS hash FROM nums), pick AS (SELECT * FROM signed ORDER BY hash, i DESC LIMIT 1)"
    + " SELECT canonical_id, hash, CAST(i AS INT) AS token_ordinal FROM src CROSS JOIN pick"
)
def fingerprints_of_templates(spark, d):
    """The rightmost least of the five runs of sixteen tokens, whatever the name."""
    return clones.fingerprints(_code(spark, d))


# --- facts of sources -----------------------------------------------------------

_PYTHON = '"""Module words."""\nimport os as {n}_os\nfrom .pkg import thing as t\nclass {n}(pkg.Base, Other):\n    attr = 1\n    def go(self):\n        return self.client.call({n}_os.path())\n'
_RUST = '//! Module words.\n//! More.\nmod inner;\n#[path="x.rs"]\nmod pathed;\nuse a::b as {n}_b;\n#[cfg(test)]\nmod tests { #[test] fn check() { b.go(1); } }\nimpl<T> Tr<T> for {n}<T> { fn run(&self) {} }\nstruct {n};\nconst LIMIT: u8 = 1;\n'
#: (fact, name, detail, text at its place) of each.
_FACTS = {
    ".py": [
        ("import", "os", None, "os as {n}_os"), ("alias", "{n}_os", "os", "os as {n}_os"), ("relative_import", "thing", ".pkg", "thing as t"), ("alias", "t", "thing", "thing as t"), ("declaration", "{n}", "type", "{n}"),
        ("base", "{n}", "pkg.Base", "pkg.Base"), ("base", "{n}", "Other", "Other"), ("binding", "{n}", "attr", "attr = 1"), ("binding", "{n}", "go", "def go(self):\n        return self.client.call({n}_os.path())"),
        ("declaration", "go", "function", "go"), ("call", "call", "self.client", "call"), ("call", "path", "{n}_os", "path"), ("module_documentation", "", "Module words.", '"""Module words."""'),
    ],
    ".rs": [
        ("module_documentation", "", "Module words.\nMore.", "//! Module words.\n//! More."), ("declaration", "inner", "module", "inner"), ("module_file", "inner", None, "inner"), ("declaration", "pathed", "module", "pathed"),
        ("module_file", "pathed", 'path="x.rs"', "pathed"), ("alias", "{n}_b", "b", "b as {n}_b"), ("declaration", "tests", "module", "tests"), ("test_module", "tests", None, "tests"), ("declaration", "check", "function", "check"),
        ("test_attribute", "check", None, "check"), ("call", "go", "b", "go"), ("impl", "{n}<T>", "Tr<T>", "Tr<T> for {n}<T>"), ("declaration", "run", "function", "run"), ("declaration", "{n}", "type", "{n}"), ("declaration", "LIMIT", "constant", "LIMIT"),
    ],
}


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(
    with_ctes("syms")
    + _NAMED
    + ", f(ext, fact, name, detail, said) AS (VALUES "
    + ", ".join(f"('{e}', {', '.join(_quoted(x) for x in row)})" for e, rows in _FACTS.items() for row in rows)
    + ") SELECT canonical_id || src.ext AS document_path, fact, replace(name, '{n}', n) AS name, replace(detail, '{n}', n) AS detail, replace(said, '{n}', n) AS said FROM src JOIN f ON f.ext = src.ext"
)
def facts_of_templates(spark, d):
    """Everything a small source of each language declares, calls, imports and says, with the text at its place."""
    rows = _sources(spark, d)
    text = F.when(F.col("document_path").endswith(".py"), F.lit(_PYTHON)).otherwise(F.lit(_RUST))
    files = materialize(rows.select("document_path", F.replace(text, F.lit("{n}"), F.col("n")).alias("text")), "templates")
    facts = syntax.extract(files).join(files, "document_path")
    return facts.select("document_path", "fact", "name", "detail", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("said"))


# --- places and estimates -------------------------------------------------------

@query(
    """WITH f AS (SELECT canonical_id, string_split(min(span_text), chr(10)) AS l FROM symbols WHERE span_text IS NOT NULL GROUP BY 1), x AS (SELECT canonical_id, l, unnest(range(1, len(l) + 1)) AS i FROM f)
    SELECT canonical_id AS document_path, CAST(i AS INT) AS line, CASE WHEN i = 1 THEN 0 ELSE octet_length(encode(array_to_string(l[:i - 1], chr(10)))) + 1 END AS start FROM x"""
)
def line_starts(spark, d):
    """The byte each line of each text starts at."""
    files = table(spark, d, "symbols").where("span_text IS NOT NULL AND canonical_id IS NOT NULL").groupBy(F.col("canonical_id").alias("document_path")).agg(F.min("span_text").alias("text"))
    return impact.line_starts(files, bytes_=True)


@query(
    _TRIALS
    + """, c AS (SELECT CAST(instance_id % 2 = 0 AS VARCHAR) AS "group", count(*) FILTER (t_hit > b_hit) AS b, count(*) FILTER (t_hit < b_hit) AS c, count(*) AS n FROM pairs WHERE excluded IS NULL GROUP BY 1)
    SELECT "group", n, round((b - c) / n, 6) AS difference, 1.96 AS z_low, -1.96 AS z_high, 1.645 AS z_inner FROM c"""
)
def score_intervals(spark, d):
    """The ends of the score interval of each group's difference are those where the statistic is the level's quantile."""
    paired = experiment.pairs(experiment.latest_attempts(_trials(spark, d)), ["value", "hit"]).withColumn("even", F.col("instance_id") % 2 == 0)
    found = experiment.group_estimates(paired, "even", "hit", "value")
    counts = paired.where("excluded IS NULL").groupBy(F.col("even").cast("string").alias("group")).agg(F.count_if(F.col("t_hit") > F.col("b_hit")).alias("b"), F.count_if(F.col("t_hit") < F.col("b_hit")).alias("c"))

    def z(b, c, n, at):
        import pandas as pd

        return pd.Series([experiment.tango_z(int(w), int(x), int(y), float(v)) for w, x, y, v in zip(b, c, n, at)])

    statistic = F.pandas_udf(z, "double")
    rows = found.join(counts, "group")
    return rows.select("group", "n", F.round("difference", 6).alias("difference"), *[F.round(statistic("b", "c", "n", at), digits).alias(name) for name, at, digits in (("z_low", "low", 2), ("z_high", "high", 2), ("z_inner", "inner_low", 3))])
