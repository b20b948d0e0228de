"""From what a user writes to symbols: names, fragments, qualified suffixes, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case for A to Z only, as SQL's LIKE folds it."""
    return F.translate(c, _UPPER, _LOWER)


def find(symbols: DataFrame, fragment: str) -> DataFrame:
    """Symbols whose name holds ``fragment``; ASCII letters in either case, no wildcards."""
    return symbols.where(F.instr(ascii_lower(F.col("display_name")), ascii_lower_text(fragment)) > 0).orderBy("canonical_id")


def ascii_lower_text(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def suffixes(symbols: DataFrame, separator: str = "::") -> DataFrame:
    """(canonical_id, suffix): every suffix of an identity that starts at a separator, and the whole."""
    parts = F.split("canonical_id", separator)
    whole = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator))
    return symbols.select("canonical_id", F.explode(whole).alias("suffix"))


def resolve(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(reference, outcome, tier, candidates, canonical_id) for each different reference.

    The first tier that has a candidate decides: 1 the exact identity; 2, with
    ``::`` in the reference, identities that end in it at a separator (one that
    is exactly workspace and reference stands alone); 3, with a dot, the same
    with dots for separators, among symbols of that short name; 4 the short name.
    One candidate is ``unique`` and named, several are ``ambiguous``, none is
    ``absent``. All tiers are equi-joins on derived keys.
    """
    refs = references.select("reference").where("reference IS NOT NULL").distinct()
    ids = symbols.select("canonical_id", "display_name", "workspace_id")
    exact = refs.join(ids.select(F.col("canonical_id").alias("reference"), "canonical_id"), "reference").select("reference", F.lit(1).alias("tier"), "canonical_id")
    tails = suffixes(ids)
    qualified = refs.where(F.instr("reference", "::") > 0)
    tail = qualified.join(tails.withColumnRenamed("suffix", "reference"), "reference").join(ids.select("canonical_id", "workspace_id"), "canonical_id")
    full = tail.withColumn("full", F.col("canonical_id") == F.concat_ws("::", "workspace_id", "reference"))
    alone = full.groupBy("reference").agg(F.max("full").alias("any_full"))
    tier2 = full.join(alone, "reference").where(~F.col("any_full") | F.col("full")).select("reference", F.lit(2).alias("tier"), "canonical_id")
    dotted = refs.where((F.instr("reference", "::") == 0) & (F.instr("reference", ".") > 0)).withColumn("suffix", F.replace("reference", F.lit("."), F.lit("::")))
    tier3 = dotted.join(tails, "suffix").select("reference", F.lit(3).alias("tier"), "canonical_id")
    tier4 = refs.where(F.instr("reference", "::") == 0).join(ids.select(F.col("display_name").alias("reference"), "canonical_id"), "reference").select("reference", F.lit(4).alias("tier"), "canonical_id")
    every = exact.unionByName(tier2).unionByName(tier3).unionByName(tier4)
    per_tier = every.groupBy("reference", "tier").agg(F.countDistinct("canonical_id").alias("candidates"), F.min("canonical_id").alias("canonical_id"))
    first = per_tier.groupBy("reference").agg(F.min(F.struct("tier", "candidates", "canonical_id")).alias("m"))
    out = refs.join(first, "reference", "left")
    n = F.coalesce("m.candidates", F.lit(0))
    outcome = F.when(n == 0, "absent").when(n == 1, "unique").otherwise("ambiguous")
    return out.select("reference", outcome.alias("outcome"), F.col("m.tier").alias("tier"), n.alias("candidates"), F.when(n == 1, F.col("m.canonical_id")).alias("canonical_id"))
