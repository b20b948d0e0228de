"""Accounts of an index: counts by rule, discrepancies, freshness, differences, digests."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Closed vocabularies (fixed values).
ALIGNMENT_RULES = "exact crate_root operator_desugar module_span self_keyword module_name self_name module_marker import_alias range_literal use_list_self super_keyword".split()
LOCALITY_RULES = "defining_document module_chain target_metadata unit_membership declaration_scope".split()
JOIN_OUTCOMES = "aligned text_mismatch semantic_only duplicate_ambiguous".split()
TEST_RULES = "test_attribute test_configuration test_file test_directory".split()
FRESHNESS = "fresh stale_content stale_version stale_environment".split()


def counted_by(rows: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """(column, count) for every member of a vocabulary, 0 where it does not occur; other values are left out."""
    words = rows.sparkSession.createDataFrame([(w,) for w in vocabulary], f"{column} string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return words.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("count"))


def summary_with_exemplar(rows: DataFrame, keys: list[str], document: str, order: list, exemplar: list[str], most: int | None = 50) -> DataFrame:
    """Groups with their size, number of documents and first row; the largest ``most`` groups.

    Order: size descending, then the keys. The first row is least by ``order``.
    ``None`` for all groups.
    """
    struct_ = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"e_{c}") for c in exemplar])
    # distinct documents through a first level per (keys, document), so a large group is spread by document
    first = rows.groupBy(*keys, document).agg(F.count(F.lit(1)).alias("n"), F.min(struct_).alias("m"))
    out = first.groupBy(*keys).agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"), F.min("m").alias("m"))
    out = out.select(*keys, "occurrences", "documents", *[F.col(f"m.e_{c}").alias(f"first_{c}") for c in exemplar])
    return out if most is None else out.orderBy(F.col("occurrences").desc(), *[F.col(k).asc_nulls_first() for k in keys]).limit(most)


def file_differences(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change): added, removed or changed between two tables; equal rows do not appear."""
    a = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).where("change IS NOT NULL")


def stale_reasons(indexed: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, reasons, state): content, version, environment in this order; fresh where nothing differs.

    Both sides have key, content, version and environment; a missing current row
    is stale in all of them.
    """
    a = indexed.select(key, *[F.col(c).alias(f"i_{c}") for c in ("content", "version", "environment")])
    b = current.select(key, *[F.col(c).alias(f"c_{c}") for c in ("content", "version", "environment")])
    reasons = F.array_compact(F.array(*[F.when(~F.col(f"i_{c}").eqNullSafe(F.col(f"c_{c}")), F.lit(f"stale_{c}")) for c in ("content", "version", "environment")]))
    return a.join(b, key, "left").select(key, reasons.alias("reasons")).select(key, "reasons", F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit("fresh")).alias("state"))


def _digest(pdf: pd.DataFrame) -> pd.DataFrame:
    h = hashlib.sha256()
    for path, text in sorted(zip(pdf["path"], pdf["text"])):
        for part in (path.encode(), text.encode()):
            h.update(struct.pack("<Q", len(part)))
            h.update(part)
    return pd.DataFrame({"group": [pdf["group"].iloc[0]], "digest": [h.hexdigest()]})


def content_digest(files: DataFrame, group: str, path: str, text: str) -> DataFrame:
    """(group, digest): SHA-256 over each group's paths and texts in path order, lengths put first.

    The order of rows does not matter. A group is hashed by one task, since the
    hash is one series by definition; pass hashes of texts for ``text`` where
    groups are large.
    """
    rows = files.where(F.col(group).isNotNull() & F.col(path).isNotNull()).select(F.col(group).cast("string").alias("group"), F.col(path).alias("path"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.groupBy("group").applyInPandas(_digest, "group string, digest string")


def layered_digest(files: DataFrame, path: str, text: str, parts: int = 4096) -> str:
    """One SHA-256 for a whole corpus, whatever the order of its rows: of the digests of ``parts`` groups of paths, so no task reads all of it.

    Rows without path are left out; empty input gives the digest of nothing.
    """
    rows = files.where(F.col(path).isNotNull()).withColumn("_part", F.pmod(F.xxhash64(path), F.lit(parts)))
    found = content_digest(rows, "_part", path, text).collect()  # at most ``parts`` rows
    h = hashlib.sha256()
    for r in sorted(found, key=lambda r: int(r["group"])):
        h.update(f"{r['group']}:{r['digest']}\n".encode())
    return h.hexdigest()


def duplicated(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, members, first_id): keys that two or more symbols share."""
    out = symbols.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.min("canonical_id").alias("first_id"))
    return out.where("members > 1")
