"""From changed regions to the declarations they touch and everything that depends on those."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.graph import dependents
from lodestrata.operators.intervals import minimal, overlapping


def line_starts(files: DataFrame, bytes_: bool = False) -> DataFrame:
    """(document_path, line, start): where each line begins, in characters or in bytes of UTF-8; LF ends a line."""
    size = F.octet_length if bytes_ else F.length
    parts = F.split("text", "\n", -1)
    rows = files.select("document_path", F.posexplode(parts).alias("k", "piece"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("document_path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("document_path", (F.col("k") + 1).alias("line"), F.coalesce(F.sum(size("piece") + 1).over(w), F.lit(0)).alias("start"))


def seeds_of_regions(regions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(region_id, canonical_id, grade) of the declarations that changed line regions touch.

    ``regions`` has region_id, document_path, start (first line, from 1) and
    count; a count of 0 is an insertion behind line ``start`` and touches that
    line. ``symbols`` has canonical_id, document_path, start_line and end_line.
    Of the declarations a region overlaps the innermost stay; an insertion
    doesn't touch declarations that end on the line it follows. Declarations
    spanning a whole region exactly are ``exact``, others ``approximate``.
    """
    lines = regions.select("region_id", "document_path", F.greatest(F.col("start"), F.lit(1)).alias("first"), (F.col("count") == 0).alias("insertion"), F.greatest(F.col("count"), F.lit(1)).alias("n"))
    left = lines.select("document_path", F.struct("region_id", "insertion", "first", "n").alias("a"), F.col("first").cast("long").alias("a_start"), (F.col("first") + F.col("n")).cast("long").alias("a_end"))
    right = symbols.where("document_path IS NOT NULL").select("document_path", F.col("canonical_id").alias("b"), F.col("start_line").cast("long").alias("b_start"), (F.col("end_line") + 1).cast("long").alias("b_end"))
    met = overlapping(left, right, 64).select(F.col("a.region_id").alias("region_id"), "document_path", F.col("b").alias("canonical_id"), F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.col("a.insertion").alias("insertion"), F.col("a.first").alias("first"), F.col("a.n").alias("n"))
    # an insertion behind a declaration's last line lies outside it
    met = met.where(~(F.col("insertion") & (F.col("end") - 1 == F.col("first"))))
    inner = minimal(met, "canonical_id", ["region_id"], 64)
    exact = (F.col("start") == F.col("first")) & (F.col("end") == F.col("first") + F.col("n")) & ~F.col("insertion")
    return inner.select("region_id", "canonical_id", F.when(exact, "exact").otherwise("approximate").alias("grade")).distinct()


def impact(regions: DataFrame, symbols: DataFrame, edges: DataFrame, horizon: int = 20) -> tuple[DataFrame, DataFrame]:
    """(seeds, dependents): what the regions touch, and all that depends on it, nearest first."""
    seeds = seeds_of_regions(regions, symbols)
    return seeds, dependents(edges, seeds.select(F.col("canonical_id").alias("node")), horizon)


def seed_outcome(regions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(region_id, outcome): seeded or no_indexed_symbol_touched."""
    hit = seeds.select("region_id").distinct().withColumn("hit", F.lit(True))
    return regions.select("region_id").distinct().join(hit, "region_id", "left").select("region_id", F.when(F.col("hit"), "seeded").otherwise("no_indexed_symbol_touched").alias("outcome"))


def narrow_to_paths(changes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Changes (before, after) with a path equal to or below one of ``prefixes`` (prefix).

    Every ancestor of a path is looked up by an equi-join, so neither side is
    broadcast for its order of magnitude.
    """
    def ancestors(c: str):
        parts = F.split(c, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))

    keyed = changes.withColumn("_row", F.struct(*changes.columns)).withColumn("prefix", F.explode(F.array_distinct(F.concat(F.coalesce(ancestors("before"), F.array().cast("array<string>")), F.coalesce(ancestors("after"), F.array().cast("array<string>"))))))
    wanted = prefixes.select(F.rtrim("prefix", F.lit("/")).alias("prefix")).distinct()
    return keyed.join(wanted, "prefix", "left_semi").select("_row").distinct().select("_row.*")
