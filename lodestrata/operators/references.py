"""What an answer on references carries beside its rows, and what a change takes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.graph import closure


def last_component(name):
    """A name's part behind its last ``::`` or ``.``."""
    return F.element_at(F.split(name, r"[.:]"), -1)


def reference_groups(symbols: DataFrame, calls: DataFrame, uses: DataFrame) -> DataFrame:
    """(canonical_id, name, unresolved_calls, unconfirmed_uses) of every symbol.

    ``calls`` has the names of unresolved calls, which a symbol's last name
    component is held against; ``uses`` has symbol_id and discrepancy_id.
    """
    named = calls.groupBy("name").agg(F.count(F.lit(1)).alias("c"))
    linked = uses.select("symbol_id", "discrepancy_id").distinct().groupBy(F.col("symbol_id").alias("canonical_id")).agg(F.count(F.lit(1)).alias("u"))
    rows = symbols.select("canonical_id", last_component(F.col("display_name")).alias("name")).join(named, "name", "left").join(linked, "canonical_id", "left")
    return rows.select("canonical_id", "name", F.coalesce("c", F.lit(0)).alias("unresolved_calls"), F.coalesce("u", F.lit(0)).alias("unconfirmed_uses"))


def reference_content(occurrences: DataFrame, contents: DataFrame, modules: DataFrame) -> DataFrame:
    """Occurrences with ``content``: of the declaration around them, else of their document's module.

    ``contents`` has canonical_id and content; ``modules`` document_path and canonical_id.
    """
    own = contents.select(F.col("canonical_id").alias("shown_id"), "content")
    rows = occurrences.join(modules.select("document_path", F.col("canonical_id").alias("module_id")), "document_path", "left")
    return rows.withColumn("shown_id", F.coalesce("enclosing_id", "module_id")).join(own, "shown_id", "left").drop("module_id")


def override_relations(methods: DataFrame, overrides: DataFrame, reference_counts: DataFrame) -> DataFrame:
    """(method, overridden_by, overridden_by_references, overrides, overrides_references), each transitively.

    ``methods`` has method; ``overrides`` src and dst (src overrides dst);
    ``reference_counts`` node and references. A method in a circle doesn't count itself.
    """
    reach = closure(overrides)

    def part(me: str, other: str, name: str) -> DataFrame:
        counted = reach.select(F.col(me).alias("method"), F.col(other).alias("n")).join(reference_counts.select(F.col("node").alias("n"), "references"), "n", "left")
        return counted.groupBy("method").agg(F.count(F.lit(1)).alias(name), F.coalesce(F.sum("references"), F.lit(0)).alias(f"{name}_references"))

    rows = methods.select("method").distinct().join(part("node", "start", "overridden_by"), "method", "left").join(part("start", "node", "overrides"), "method", "left")
    names = ["overridden_by", "overridden_by_references", "overrides", "overrides_references"]
    return rows.select("method", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def revert_changes(files: DataFrame, changes: DataFrame, before: DataFrame) -> DataFrame:
    """(document_path, text) as it was ahead of ``changes`` (before, after): paths after go, those before come back.

    ``before`` has the texts of the earlier side; a path it lacks is left out.
    """
    gone = changes.where("after IS NOT NULL").select(F.col("after").alias("document_path")).distinct()
    back = changes.where("before IS NOT NULL").select(F.col("before").alias("document_path")).distinct()
    kept = files.select("document_path", "text").join(gone, "document_path", "left_anti").join(back, "document_path", "left_anti")
    return kept.unionByName(before.select("document_path", "text").join(back, "document_path", "left_semi"))


def drop_whole_file_spans(spans: DataFrame, files: DataFrame) -> DataFrame:
    """Spans (document_path, start, end, …) but those from a document's first character to its last that is not blank."""
    solid = files.select("document_path", F.length(F.rtrim(F.regexp_replace("text", r"\s+$", ""))).alias("_solid"))
    return spans.join(solid, "document_path", "left").where(~((F.col("start") == 0) & F.coalesce(F.col("end") >= F.col("_solid"), F.lit(False)))).drop("_solid")


def reused_vectors(passages: DataFrame, earlier: DataFrame, vectors: DataFrame) -> DataFrame:
    """(symbol_id, ordinal, embedding) of passages whose render is as it was, so that it needs no new vector.

    ``passages`` and ``earlier`` have symbol_id and render, ``vectors`` those of
    the earlier build: symbol_id, ordinal, embedding.
    """
    same = passages.select("symbol_id", "render").join(earlier.select("symbol_id", "render"), ["symbol_id", "render"], "left_semi").select("symbol_id").distinct()
    return vectors.join(same, "symbol_id", "left_semi").select("symbol_id", "ordinal", "embedding")


def passage_vectors(chunks: DataFrame) -> DataFrame:
    """(passage, vectors): the vectors of each passage (passage, ordinal, embedding) in the order of its chunks."""
    per = chunks.groupBy("passage").agg(F.array_sort(F.collect_list(F.struct("ordinal", "embedding"))).alias("v"))
    return per.select("passage", F.transform("v", lambda x: x["embedding"]).alias("vectors"))
