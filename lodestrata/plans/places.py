"""Queries over what the syntax around a place says, on sources built from the tables so that SQL knows the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import alignment, places, status
from lodestrata.plans.base import query, symbols, with_ctes
from lodestrata.runtime import materialize, table

#: A Rust source around each symbol's name, the marks in it, and what is there:
#: (mark, its occurrence from 1, its length, name, kind, role, facts of the place, rule).
_RUST = "mod outer { use a::walk::{self, c}; impl<T> Tr<T> for {n}<T> where T: X { fn f(&self) -> Self { super::super::x(..3); 1..=4; a + b; y += 2; -z; v[0]; self::q(); w?; for i in v {} } } }"
_MARKS = [
    ("self", 1, 4, "walk", "module", "reference", {"use_terminal": "walk"}, "use_list_self"),
    ("Self", 1, 4, "{n}", "type", "reference", {"impl_type": "{n}<T>", "impl_trait": "Tr<T>"}, "self_keyword"),
    ("Self", 1, 4, "x::Tr<U>", "type", "reference", {}, "self_keyword"),
    ("Self", 1, 4, "Other", "type", "reference", {}, None),
    ("super", 1, 5, "up", "module", "reference", {"super_depth": "1"}, None),
    ("super", 2, 5, "up", "module", "reference", {"super_depth": "2"}, "super_keyword"),
    ("..", 1, 2, "RangeTo<i32>", "type", "reference", {"range_type": "RangeTo"}, "range_literal"),
    ("..=", 1, 3, "RangeInclusive", "type", "reference", {"range_type": "RangeInclusive"}, "range_literal"),
    ("..=", 1, 3, "Range", "type", "reference", {}, None),
    (" + ", 1, 1, "add", "method", "reference", {"construct": "binary +"}, "operator_desugar"),
    ("+=", 1, 2, "add_assign", "method", "reference", {"construct": "compound +="}, "operator_desugar"),
    ("-z", 1, 1, "neg", "method", "reference", {"construct": "unary -"}, "operator_desugar"),
    ("-z", 1, 1, "sub", "method", "reference", {}, None),
    ("[0", 1, 1, "index_mut", "method", "reference", {"construct": "index"}, "operator_desugar"),
    ("?;", 1, 1, "branch", "method", "reference", {"construct": "try"}, "operator_desugar"),
    ("for i", 1, 3, "into_iter", "method", "reference", {"construct": "for"}, "operator_desugar"),
    ("(..3", 1, 1, "call_once", "method", "reference", {"construct": "call"}, "operator_desugar"),
    ("self::", 1, 4, "outer", "module", "reference", {}, "self_name"),
    ("x(", 1, 1, "x", "function", "reference", {"path_head": "super"}, "exact"),
    ("walk", 1, 4, "other", "module", "reference", {"path_head": "a"}, None),
    ("{n}", 1, 0, "{n}", "type", "definition", {"path_head": "{n}"}, "exact"),
]
#: The same for Python.
_PYTHON = "import pkg.{n} as s\nfrom .{n} import q\nif __name__ == '__main__':\n    pkg.{n}.run()\n"
_PY_MARKS = [
    ("pkg.{n}", 1, 4, "{n}", "module", "reference", {}, "module_name"),
    (".{n} import", 1, 1, "{n}", "module", "reference", {}, "module_name"),
    ("pkg.{n}.run", 1, -8, "{n}", "module", "reference", {}, "module_name"),
    ("__name__", 1, 8, "{n}", "module", "reference", {}, "self_name"),
    ("q\n", 1, 1, "q", "function", "reference", {}, "exact"),
    ("__main__", 1, 8, "{n}", "module", "reference", {}, None),
    ("import", 1, -6, "{n}", "module", "definition", {}, "module_marker"),
    ("import", 1, 6, "q", "function", "reference", {}, None),
]


def _probes(language: str) -> list[tuple]:
    out = []
    for k, (mark, nth, length, name, kind, role, facts, rule) in enumerate(_MARKS if language == "rs" else _PY_MARKS):
        out.append((k, mark, nth, length, name, kind, role, facts, rule))
    return out


def _sources(spark, d) -> DataFrame:
    """(canonical_id, n, document_path, text) of every symbol with a plain name."""
    s = symbols(spark, d).where(F.col("document_path").isNotNull() & F.col("display_name").rlike(r"^[A-Za-z_]\w*$"))
    rust = F.col("document_path").endswith(".rs")
    text = F.when(rust, F.replace(F.lit(_RUST), F.lit("{n}"), F.col("display_name"))).otherwise(F.replace(F.lit(_PYTHON), F.lit("{n}"), F.col("display_name")))
    return s.where(rust | F.col("document_path").endswith(".py")).select("canonical_id", F.col("display_name").alias("n"), F.concat("canonical_id", F.when(rust, F.lit(".rs")).otherwise(F.lit(".py"))).alias("document_path"), text.alias("text"))


def _nth(text, mark, nth: int):
    """The place of the nth occurrence of ``mark``, from 0."""
    place = F.lit(0)
    for _ in range(nth):
        place = F.position(mark, text, place + 1)
    return place - 1


def _occurrences(spark, d) -> DataFrame:
    base = materialize(_sources(spark, d), "sources")
    parts = []
    for language in ("rs", "py"):
        rows = base.where(F.col("document_path").endswith("." + language))
        named = lambda x: F.replace(F.lit(x), F.lit("{n}"), F.col("n"))
        probes = []
        for k, mark, nth, length, name, kind, role, _, _ in _probes(language):
            at = _nth(F.col("text"), named(mark), nth)
            # a length of 0 is the name's own; less than 0 counts from the end of the first dotted part, or marks no width
            end = at + (F.length("n") if length == 0 else F.lit(length))
            if length == 1 and mark.startswith(".{n}"):
                end = at + F.length("n") + 1
            if length == 4 and mark == "pkg.{n}":
                end = at + F.length("n") + 4
            if length == -8:
                end = at + 3
            if length == -6:
                at, end = F.lit(0), F.lit(0)
            if mark == " + ":
                at, end = at + 1, at + 2
            probes.append(F.struct(F.lit(k).alias("probe"), at.cast("int").alias("span_start"), end.cast("int").alias("span_end"), named(name).alias("name"), F.lit(kind).alias("kind"), F.lit(role).alias("role")))
        parts.append(rows.select("canonical_id", "n", "document_path", "text", F.explode(F.array(*probes)).alias("x")))
    all_ = parts[0].unionByName(parts[1])
    return all_.select("canonical_id", "n", "document_path", "text", F.concat_ws(" ", "canonical_id", F.col("x.probe").cast("string")).alias("occurrence_id"), "x.*")


def _facts(occ: DataFrame) -> DataFrame:
    return materialize(places.place_facts(occ, occ.select("document_path", "text")), "place-facts")


_WHERE = """, src AS (SELECT canonical_id, display_name AS n, document_path FROM syms WHERE regexp_matches(display_name, '^[A-Za-z_]\\w*$') AND regexp_matches(document_path, '\\.(rs|py)$'))"""


def _values(column) -> str:
    rows = []
    for language in ("rs", "py"):
        for probe in _probes(language):
            value = column(probe)
            if value is not None:
                rows.append(f"('{language}', {probe[0]}, " + ", ".join("NULL" if v is None else "'" + v + "'" for v in value) + ")")
    return ", ".join(rows)


_FACT_NAMES = ["impl_type", "impl_trait", "use_terminal", "super_depth", "range_type", "construct", "path_head"]


@query(
    with_ctes("syms")
    + _WHERE
    + ", p(language, probe, "
    + ", ".join(_FACT_NAMES)
    + ") AS (VALUES "
    + _values(lambda p: [p[7].get(k) for k in _FACT_NAMES] if p[7] else None)
    + ") SELECT canonical_id, probe, "
    + ", ".join(f"replace({k}, '{{n}}', n) AS {k}" for k in _FACT_NAMES)
    + " FROM src JOIN p ON document_path LIKE '%.' || language"
)
def place_facts(spark, d):
    """What lies around marked places of a Rust source; of each place the facts that its probe asks for."""
    occ = _occurrences(spark, d)
    asked = {f"{k}": list(f) for k, *_, f, _ in _probes("rs") if f}
    facts = _facts(occ.where("document_path LIKE '%.rs'")).withColumn("super_depth", F.col("super_depth").cast("string"))
    probe = F.substring_index("occurrence_id", " ", -1)
    shown = [F.when(probe.isin([k for k, f in asked.items() if c in f]), F.col(c)).alias(c) for c in _FACT_NAMES]
    rows = facts.where(probe.isin(list(asked)))
    return rows.select(F.expr("substring(document_path, 1, length(document_path) - 3)").alias("canonical_id"), probe.cast("int").alias("probe"), *shown)


def _aligned(spark, d) -> DataFrame:
    occ = materialize(_occurrences(spark, d), "occurrences")
    rust = F.col("document_path").endswith(".rs")
    mine = F.array(F.lit("top"), F.lit("mid"))
    rows = occ.select(
        "occurrence_id", "document_path", "name", "kind", "role", F.concat(F.lit("symbol "), "name").alias("symbol_id"), F.lit("pack-age").alias("package"), F.concat(F.lit("pkg."), "n").alias("dotted_name"),
        # two steps above outer lies top; outer itself is the place's own module
        F.when(F.col("name") == "outer", F.array(F.lit("top"), F.lit("mid"), F.lit("outer"))).when(F.col("name") == "up", F.array(F.lit("top"))).when(~rust, F.array(F.lit("pkg"), F.col("n"))).alias("segments"),
        F.when(rust, mine).otherwise(F.array(F.lit("pkg"), F.col("n"))).alias("module_segments"),
    )
    return alignment.align_at_places(rows, _facts(occ))


_RULES = ", p(language, probe, rule) AS (VALUES " + _values(lambda p: [p[8]]) + ")"


@query(with_ctes("syms") + _WHERE + _RULES + " SELECT canonical_id || ' ' || probe AS occurrence_id, rule, CASE WHEN rule IS NULL THEN 'text_mismatch' ELSE 'aligned' END AS outcome FROM src JOIN p ON document_path LIKE '%.' || language")
def aligned_places(spark, d):
    return _aligned(spark, d).select("occurrence_id", "rule", "outcome")


@query(
    with_ctes("syms")
    + _WHERE
    + _RULES
    + ", r AS (SELECT rule FROM src JOIN p ON document_path LIKE '%.' || language WHERE rule IS NOT NULL) SELECT v AS rule, count(r.rule) AS count FROM (SELECT unnest(["
    + ", ".join(f"'{r}'" for r in status.ALIGNMENT_RULES)
    + "]) AS v) LEFT JOIN r ON r.rule = v GROUP BY 1"
)
def alignment_accounts(spark, d):
    """Places accepted by each rule, the rules that accepted none included."""
    return alignment.accounts(materialize(_aligned(spark, d), "aligned"))[0]


@query(r"SELECT DISTINCT canonical_id, lower(replace(regexp_replace(signature_text, '\s+', '', 'g'), ',)', ')')) AS signature FROM symbols WHERE signature_text IS NOT NULL AND span_text IS NOT NULL AND lower(trim(kind)) IN ('function', 'method')")
def declaration_tiers(spark, d):
    """The heads of functions as read from their texts, where the tables have one too; some texts are laid out anew, so blanks and letter case are left out."""
    rows = table(spark, d, "symbols").where("signature_text IS NOT NULL AND span_text IS NOT NULL AND lower(trim(kind)) IN ('function', 'method')").dropDuplicates(["canonical_id"])
    head = F.lower(F.replace(F.regexp_replace("signature_text", r"\s+", ""), F.lit(",)"), F.lit(")")))
    return places.declaration_tiers(rows.select("canonical_id", "document_path", "span_text")).select("canonical_id", head.alias("signature"))


@query(
    with_ctes("syms")
    + _WHERE
    + """ SELECT canonical_id || ' ' || p AS occurrence_id, CASE WHEN length(n) % 3 > 0 THEN 'twin 0 of ' || n END AS symbol_id, CASE WHEN length(n) % 3 > 0 AND p = 20 THEN 'exact' END AS rule,
        CASE WHEN length(n) % 3 = 0 THEN 'duplicate_ambiguous' WHEN p = 20 THEN 'aligned' ELSE 'text_mismatch' END AS outcome
    FROM src, (SELECT unnest([0, 20]) AS p) WHERE document_path LIKE '%.rs'"""
)
def aligned_groups(spark, d):
    """Names that several documents define: one twin lies at the source's parent, or two; of two places one spells the name."""
    occ = materialize(_occurrences(spark, d).where("document_path LIKE '%.rs' AND probe IN (0, 20)"), "occurrences")
    none = F.lit(None).cast("array<string>")
    refs = occ.select("occurrence_id", F.col("n").alias("descriptor"), "document_path", "role", F.lit("p").alias("package"), F.lit(None).cast("string").alias("dotted_name"), none.alias("segments"), none.alias("module_segments"))
    names = occ.select("n").distinct()
    count = F.when(F.length("n") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    twins = names.select("n", F.explode(count).alias("k")).select(F.col("n").alias("descriptor"), F.lit("root").alias("document_path"), F.concat(F.lit("twin "), F.col("k").cast("string"), F.lit(" of "), "n").alias("symbol_id"), F.col("n").alias("name"), F.lit("type").alias("kind"))
    parents = occ.select(F.col("document_path").alias("document"), F.lit("root").alias("parent")).distinct()
    return alignment.join_group(refs, twins, parents, _facts(occ))
