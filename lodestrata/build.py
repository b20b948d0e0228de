"""A whole index from sources: declarations, edges, passages, clone evidence, published as one build."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import without_rank
from lodestrata.operators import alignment, clones, graph, identity, intervals, places, similarity, status, syntax, units
from lodestrata.runtime import materialize
from lodestrata.sources import files as sources
from lodestrata.sources import store


@dataclass(frozen=True)
class Parameters:
    """What changes results; kept with the build and read back by its readers."""

    kgram: int = clones.KGRAM
    window: int = clones.WINDOW

    def guaranteed_length(self) -> int:
        """The shortest shared run that is always found."""
        return self.window + self.kgram - 1


def declared_symbols(workspace: str, texts: DataFrame, facts: DataFrame) -> DataFrame:
    """Symbols of all declarations, with identities, spans and texts.

    The identity is workspace, path without extension and name; equal ones get
    their rank by place.
    """
    rows = facts.where("fact = 'declaration'").select("document_path", F.col("name").alias("display_name"), F.col("detail").alias("kind"), F.col("start").alias("name_start"), F.col("outer_start").alias("span_start"), F.col("outer_end").alias("span_end"))
    path = F.replace(F.regexp_replace("document_path", r"\.[^./]*$", ""), F.lit("/"), F.lit("::"))
    rows = rows.withColumn("base", F.concat_ws("::", F.lit(workspace), path, "display_name"))
    named = identity.disambiguate(rows, "base", [F.col("span_start"), F.col("span_end")], "canonical_id").drop("base")
    text = F.substring(F.col("text"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    start = F.size(F.split(F.substring(F.col("text"), F.lit(1), F.col("span_start")), "\n", -1))
    full = named.join(texts, "document_path").withColumn("span_text", text).withColumn("start_line", start)
    end = F.col("start_line") + F.size(F.split("span_text", "\n", -1)) - 1
    return full.withColumn("end_line", end).withColumn("class", F.lit("in_workspace")).withColumn("workspace_id", F.lit(workspace)).drop("text")


def _named_types(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """``refs`` (document_path, name, …) with ``type``: the type or trait of that name in the same document, else the only one of the workspace; others are dropped."""
    types = symbols.where(F.col("kind").isin("type", "trait")).select("document_path", F.col("display_name").alias("name"), "canonical_id")
    near = types.groupBy("document_path", "name").agg(F.min("canonical_id").alias("_near"), F.count(F.lit(1)).alias("_k")).where("_k = 1").drop("_k")
    only = types.groupBy("name").agg(F.min("canonical_id").alias("_only"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    found = refs.join(near, ["document_path", "name"], "left").join(only, "name", "left").withColumn("type", F.coalesce("_near", "_only"))
    return found.where("type IS NOT NULL").drop("_near", "_only")


def _hierarchy(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """(src, dst, language): a class and its base, a type and the trait it implements, where both are of the workspace."""
    simple = lambda c: F.element_at(F.split(F.regexp_replace(c, r"[<\[(][\s\S]*$", ""), r"::|\."), -1)
    bases = facts.where("fact = 'base'").select("document_path", simple(F.col("detail")).alias("name"), F.col("name").alias("own"), F.lit("python").alias("language"))
    impls = facts.where("fact = 'impl' AND detail IS NOT NULL").select("document_path", simple(F.col("detail")).alias("name"), simple(F.col("name")).alias("own"), F.lit("rust").alias("language"))
    up = _named_types(symbols, bases.unionByName(impls)).select("document_path", F.col("own").alias("name"), F.col("type").alias("dst"), "language")
    return _named_types(symbols, up).select(F.col("type").alias("src"), "dst", "language").where("src <> dst").distinct()


def _methods(symbols: DataFrame, facts: DataFrame, contains: DataFrame) -> DataFrame:
    """(container, name, method): functions of a class, a trait or an impl's type."""
    kinds = symbols.select(F.col("canonical_id").alias("src"), "kind")
    inside = contains.join(kinds.where(F.col("kind").isin("type", "trait")), "src").select(F.col("src").alias("container"), F.col("dst").alias("canonical_id"))
    own = symbols.where("kind = 'function'").select("canonical_id", F.col("display_name").alias("name"), "document_path", "span_start", "span_end")
    held = own.join(inside, "canonical_id").select("container", "name", F.col("canonical_id").alias("method"))
    simple = F.element_at(F.split(F.regexp_replace("name", r"<[\s\S]*$", ""), "::"), -1)
    blocks = _named_types(symbols, facts.where("fact = 'impl'").select("document_path", simple.alias("name"), "outer_start", "outer_end"))
    left = blocks.select("document_path", F.col("type").alias("a"), F.col("outer_start").cast("long").alias("a_start"), F.col("outer_end").cast("long").alias("a_end"))
    right = own.select("document_path", F.struct("canonical_id", "name").alias("b"), F.col("span_start").cast("long").alias("b_start"), F.col("span_end").cast("long").alias("b_end"))
    impl = intervals.overlapping(left, right).where("a_start <= b_start AND b_end <= a_end").select(F.col("a").alias("container"), F.col("b.name").alias("name"), F.col("b.canonical_id").alias("method"))
    return held.unionByName(impl).distinct()


def _test_rules(symbols: DataFrame, facts: DataFrame, declared: DataFrame) -> DataFrame:
    marked = facts.where("fact = 'test_attribute'").select("document_path", F.col("outer_start").alias("span_start"))
    attributed = symbols.join(marked, ["document_path", "span_start"], "left_semi").select("canonical_id")
    gated = facts.where("fact = 'test_module'").select("document_path", F.col("outer_start").alias("start"), F.col("outer_end").alias("end"))
    return units.classify_tests(symbols, attributed, gated, declared)


def derive(workspace: str, texts: DataFrame, occurrences: DataFrame | None = None, targets: DataFrame | None = None, parameters: Parameters = Parameters()) -> dict[str, DataFrame]:
    """All tables of an index over ``texts`` (document_path, text).

    ``occurrences`` (document_path, symbol_id, span_start, span_end, role) are
    held against the texts: those a rule accepts become the table of
    occurrences and carry dependence edges, the others become discrepancies.
    ``targets`` (target, root, unit) assign documents to units.
    """
    facts = materialize(syntax.extract(texts), "facts")
    declared = units.declared_by(facts.where("fact = 'module_file'").select(F.col("document_path").alias("document"), "name", F.nullif(F.regexp_extract("detail", r'^path="(.*)"$', 1), F.lit("")).alias("path")), texts)
    named = declared_symbols(workspace, texts, facts)
    plain = materialize(named.join(places.declaration_tiers(named), "canonical_id", "left"), "declared")
    symbols = materialize(plain.join(_test_rules(plain, facts, declared), "canonical_id", "left"), "symbols")
    spans = symbols.select("canonical_id", "document_path", F.col("span_start").cast("long").alias("start"), F.col("span_end").cast("long").alias("end"), "kind")
    contains = materialize(intervals.parents(spans, "canonical_id").select(F.lit("contains").alias("kind"), F.col("parent").alias("src"), F.col("child").alias("dst")), "contains")
    hierarchy = materialize(_hierarchy(symbols, facts), "hierarchy")
    methods = materialize(_methods(symbols, facts, contains), "methods")
    looked = units.look_through_overrides(methods.withColumnRenamed("container", "type"), hierarchy.where("language = 'python'").select(F.col("src").alias("type"), F.col("dst").alias("base")))
    edges = [
        contains, hierarchy.select(F.lit("type_hierarchy").alias("kind"), "src", "dst"),
        looked.select(F.lit("overrides").alias("kind"), "src", "dst"), graph.override_edges(methods, hierarchy.where("language = 'rust'")),
    ]
    keys = clones.keyed(symbols).withColumnsRenamed({"formatting_key": "clone_formatting_key", "substitution_key": "clone_substitution_key", "token_count": "clone_token_count"})
    out = {
        "source_files": sources.hashed(texts),
        "symbols": symbols.join(keys, "canonical_id", "left"),
        "duplicate_keys": status.duplicated(symbols.withColumn("base", without_rank(F.col("canonical_id"))), ["base"]),
        "semantic_corpus": similarity.passages(symbols).withColumnRenamed("canonical_id", "symbol_id"),
        "clone_fingerprints": clones.fingerprints(symbols, parameters.kgram, parameters.window),
    }
    if targets is not None:
        out["document_units"] = identity.assign_units(targets.select("target", "unit").distinct(), units.target_reach(targets, declared))
    covered = None
    if occurrences is not None:
        given = occurrences.where("document_path IS NOT NULL AND symbol_id IS NOT NULL")
        # one name for each place, the same however often the table is read
        key = F.concat_ws("\x1f", "document_path", F.col("span_start").cast("string"), F.col("span_end").cast("string"), "symbol_id", "role")
        given = given.withColumn("occurrence_id", F.sha2(key, 256)).dropDuplicates(["occurrence_id"])
        known = symbols.select(F.col("canonical_id").alias("symbol_id"), "kind")
        given = materialize(given.select("occurrence_id", "document_path", "symbol_id", "span_start", "span_end", "role").join(known, "symbol_id", "left"), "given")
        nothing, none = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
        asked = given.withColumns({"name": F.element_at(F.split(without_rank(F.col("symbol_id")), "::"), -1), "package": F.lit(workspace), "dotted_name": none, "segments": nothing, "module_segments": nothing})
        aliases = facts.where("fact = 'alias'").select("document_path", F.col("name").alias("alias"), F.element_at(F.split("detail", r"::|\."), -1).alias("name"))
        aligned = alignment.align_at_places(asked, places.place_facts(given, texts), aliases)
        judged = materialize(aligned.select("occurrence_id", "rule", "outcome", "found", "name").join(given, "occurrence_id"), "judged")
        taken = judged.where("rule IS NOT NULL").withColumn("point", F.col("span_start").cast("long"))
        held = intervals.innermost(taken.select("occurrence_id", "document_path", "point"), spans, "occurrence_id", "canonical_id").withColumnRenamed("canonical_id", "enclosing_id")
        placed = materialize(taken.join(held, "occurrence_id", "left").select("occurrence_id", "symbol_id", "document_path", "span_start", "span_end", "role", "rule", "enclosing_id"), "placed")
        edges.append(graph.reference_edges(placed, symbols.select("canonical_id", "kind")))
        refused = judged.where("rule IS NULL").select(F.col("occurrence_id").alias("discrepancy_id"), "document_path", "span_start", "name", "found", "outcome", "symbol_id")
        members = symbols.select(F.lit(None).cast("string").alias("duplicate_group"), F.col("canonical_id").alias("symbol_id"))
        out |= {
            "occurrences": placed,
            "discrepancies": refused.drop("symbol_id"),
            "discrepancy_symbols": units.discrepancy_links(refused.withColumn("duplicate_group", F.lit(None).cast("string")), members),
            "alignment_counts": status.counted_by(judged.where("rule IS NOT NULL"), "rule", status.ALIGNMENT_RULES),
            "outcome_counts": status.counted_by(judged, "outcome", status.JOIN_OUTCOMES),
        }
        covered = placed
    if covered is None:
        covered = facts.where("false").select("document_path", F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    out["unresolved_calls"] = syntax.unresolved_calls(facts, covered)
    out["edges"] = graph.edge_set(*edges)
    return out


def build(spark: SparkSession, root: str, target: str, workspace: str, extension: str = "py", occurrences: DataFrame | None = None, parameters: Parameters = Parameters(), targets: DataFrame | None = None) -> str | None:
    """Index the sources below ``root`` into the store ``target``; null where its build is current.

    ``extension`` is one, or several with commas between. See ``derive`` for the
    tables and for ``occurrences`` and ``targets``.
    """
    scans = [sources.scan_sources(spark, root, x.strip()) for x in extension.split(",")]
    texts = scans[0]
    for s in scans[1:]:
        texts = texts.unionByName(s)
    texts = materialize(texts, "sources")
    facts_now = {"content": status.layered_digest(sources.hashed(texts), "document_path", "content_hash"), "kgram": parameters.kgram, "window": parameters.window, "workspace": workspace}
    before = store.manifest(spark, target)
    if before is not None and before["facts"] == facts_now:
        return None
    return store.publish(spark, target, derive(workspace, texts, occurrences, targets, parameters), facts_now)
