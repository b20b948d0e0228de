"""What makes a similar symbol related, and passages of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import module_path_words, own_documentation, split_words
from lodestrata.runtime import materialize

#: Relation labels in their order (fixed values).
LABELS = ["uses_subject", "used_by_subject", "tests_subject", "type_family"]


def labelled(pairs: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``pairs`` (subject, candidate) with labels: how the candidate is related to the subject.

    uses_subject: it depends on the subject; used_by_subject: the other way;
    tests_subject: it depends on the subject from a test; type_family: they
    belong to different types that are neighbours in the hierarchy or share a
    supertype of the workspace. A symbol belongs to itself where it is a type,
    else to the type that contains it. Only the given pairs are looked at, so a
    supertype of very many types makes no pairs.
    """
    # both are read several times
    pairs, edges = materialize(pairs.select("subject", "candidate"), "pairs"), materialize(edges.select("kind", "src", "dst").distinct(), "edges")
    uses = edges.where("kind <> 'contains'").select(F.col("src").alias("candidate"), F.col("dst").alias("subject")).distinct().withColumn("u", F.lit(True))
    used = edges.where("kind <> 'contains'").select(F.col("src").alias("subject"), F.col("dst").alias("candidate")).distinct().withColumn("v", F.lit(True))
    tests = symbols.select(F.col("canonical_id").alias("candidate"), F.col("test_rule").isNotNull().alias("t"))
    family = in_type_family(pairs, edges, symbols).withColumn("f", F.lit(True))
    rows = pairs.join(uses, ["subject", "candidate"], "left").join(used, ["subject", "candidate"], "left").join(tests, "candidate", "left").join(family, ["subject", "candidate"], "left")
    flags = [F.col("u"), F.col("v"), F.col("u") & F.col("t"), F.col("f")]
    return rows.select("subject", "candidate", F.array_compact(F.array(*[F.when(f, F.lit(n)) for f, n in zip(flags, LABELS)])).alias("labels"))


def exclude(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Rows that carry none of the labels; done before paging."""
    return rows.where(~F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels]))) if labels else rows


def contributes(display_name, signature, interface, span_text):
    """Whether a symbol says more than its own name."""
    return span_text.isNotNull() & ~((span_text == display_name) & (F.coalesce(signature, display_name) == display_name) & (F.coalesce(interface, display_name) == display_name))


def passages(symbols: DataFrame) -> DataFrame:
    """(canonical_id, render): name words, kind, path words, signature, documentation and content, a line each.

    ``symbols`` has canonical_id, display_name, kind, signature_text,
    interface_text and span_text. Types and modules give their interface in
    place of their content. Symbols that say no more than their name are left out.
    """
    content = F.when(F.col("kind").isin("type", "module", "trait"), F.col("interface_text")).otherwise(F.col("span_text"))
    parts = [
        F.array_join(split_words(F.col("display_name")), " "), F.col("kind"), F.nullif(F.array_join(module_path_words(F.col("canonical_id")), " "), F.lit("")),
        F.col("signature_text"), own_documentation(F.coalesce("signature_text", F.lit("")), F.col("interface_text")), content,
    ]
    kept = symbols.where(contributes(F.col("display_name"), F.col("signature_text"), F.col("interface_text"), F.col("span_text")))
    return kept.select("canonical_id", F.concat_ws("\n", *parts).alias("render")).dropDuplicates(["canonical_id"])


def in_type_family(pairs: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Those of ``pairs`` (subject, candidate) whose types differ and are neighbours in the hierarchy or share a supertype of the workspace."""
    from lodestrata.operators.graph import declaring_type

    if "kind" in symbols.columns:
        types = declaring_type(symbols, edges.where("kind = 'contains'"))
    else:  # symbols of no stated kind each stand for their own type
        types = symbols.select(F.col("canonical_id").alias("node"), F.col("canonical_id").alias("type"))
    kin = edges.where("kind = 'type_hierarchy'").select("src", "dst").distinct()
    typed = pairs.select("subject", "candidate").distinct().join(types.select(F.col("node").alias("subject"), F.col("type").alias("a")), "subject").join(types.select(F.col("node").alias("candidate"), F.col("type").alias("b")), "candidate").where("a <> b")
    near = typed.join(kin.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(kin.select("dst", "src")).distinct(), ["a", "b"], "left_semi")
    inner = symbols.where("class = 'in_workspace'").select(F.col("canonical_id").alias("up")) if "class" in symbols.columns else symbols.select(F.col("canonical_id").alias("up"))
    up = kin.select(F.col("src").alias("a"), F.col("dst").alias("up")).join(inner, "up", "left_semi")
    shared = typed.join(up, "a").join(up.select(F.col("a").alias("b"), "up"), ["b", "up"], "left_semi")
    return near.select("subject", "candidate").union(shared.select("subject", "candidate")).distinct()


def with_certainty(candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """``candidates`` (query, id, …) with certainty: exact or variant where they are clones of the query, else null.

    ``keys`` has id, formatting_key and substitution_key. Clones meet by key, so
    only they are looked up, not every candidate's keys.
    """
    known = keys.where("substitution_key IS NOT NULL").select("id", F.col("formatting_key").alias("f"), F.col("substitution_key").alias("s"))
    asked = candidates.select("query").distinct()
    mine = known.join(asked, known.id == asked["query"]).select("query", F.col("f").alias("fq"), "s")
    clones = mine.join(known, "s").where("id <> query").select("query", "id", F.when(F.col("fq").eqNullSafe(F.col("f")), "exact").otherwise("variant").alias("certainty"))
    return candidates.join(clones, ["query", "id"], "left")


def _class_of(certainty):
    return F.when(certainty == "exact", 0).when(certainty == "variant", 1).otherwise(2)


def certain_first(ranked: DataFrame, keys: DataFrame) -> DataFrame:
    """(query, id, place, certainty) of fused candidates (query, id, place), exact clones of the subject first, then variants, then all others; within a class the fused order stays."""
    rows = with_certainty(ranked.select("query", "id", F.col("place").alias("fused")), keys)
    w = Window.partitionBy("query").orderBy(_class_of(F.col("certainty")), "fused")
    return rows.select("query", "id", F.row_number().over(w).alias("place"), "certainty")


def first_rows(scored: DataFrame, keys: DataFrame) -> DataFrame:
    """(query, id): the first row of each query by certainty, then fused score (query, id, score), then id; found by one aggregation."""
    rows = with_certainty(scored, keys)
    best = F.min(F.struct(_class_of(F.col("certainty")).alias("c"), (-F.col("score")).alias("s"), F.col("id").alias("id")))
    return rows.groupBy("query").agg(best.alias("m")).select("query", F.col("m.id").alias("id"))
