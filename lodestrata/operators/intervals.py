"""Intervals over documents: which span holds a point, which spans overlap, which are innermost.

All joins are equi-joins on (document, bin): long spans are listed in every bin
they touch, points in one. A large document therefore spreads over its bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BIN = 4096


def _bins(start, end, width: int):
    """Bins of a half-open span; an empty span lies in the bin of its start."""
    first = F.floor(start / width).cast("long")
    return F.sequence(first, F.greatest(first, F.floor((F.greatest(end, start + 1) - 1) / width).cast("long")))


def spans_of_points(points: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of points (document_path, point, …) and spans (document_path, start, end, …) with start <= point < end."""
    left = points.withColumn("_bin", F.floor(F.col("point") / width).cast("long"))
    right = spans.where("start IS NOT NULL AND `end` IS NOT NULL").withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end"), width)))
    return left.join(right, ["document_path", "_bin"]).where("start <= point AND point < `end`").drop("_bin")


def innermost(points: DataFrame, spans: DataFrame, point_id: str, span_id: str, width: int = BIN) -> DataFrame:
    """(point_id, span_id): the narrowest span around each point, the least id among equals.

    Points that no span holds do not appear.
    """
    pairs = spans_of_points(points.select(point_id, "document_path", "point"), spans.select(span_id, "document_path", "start", "end"), width)
    best = F.min(F.struct((F.col("end") - F.col("start")).alias("w"), F.col(span_id).alias("i")))
    return pairs.groupBy(point_id).agg(best.alias("_m")).select(point_id, F.col("_m.i").alias(span_id))


#: Lines and columns as one number.
COLUMNS = 1 << 24


def innermost_by_line(points: DataFrame, spans: DataFrame, point_id: str, span_id: str) -> DataFrame:
    """(point_id, span_id): the innermost span around each place given by line and column.

    ``points``: document_path, line, column; ``spans``: document_path,
    start_line, start_column, end_line, end_column (behind the last character).
    Lines of more than 16 million columns are not told apart there.
    """
    at = lambda line, column: F.col(line).cast("long") * COLUMNS + F.least(F.col(column).cast("long"), F.lit(COLUMNS - 1))
    p = points.where("line IS NOT NULL AND `column` IS NOT NULL").select(point_id, "document_path", at("line", "column").alias("point"))
    s = spans.where("start_line IS NOT NULL AND end_line IS NOT NULL").select(span_id, "document_path", at("start_line", "start_column").alias("start"), at("end_line", "end_column").alias("end"))
    return innermost(p, s, point_id, span_id, 64 * COLUMNS)


def overlapping(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of half-open spans a and b of one document with a.start < b.end and b.start < a.end.

    ``left`` has document_path, a, a_start, a_end; ``right`` document_path, b, b_start, b_end.
    A pair is given out in the first bin both spans touch, and so only once.
    """
    a = left.withColumn("_bin", F.explode(_bins(F.col("a_start"), F.col("a_end"), width)))
    b = right.withColumn("_bin", F.explode(_bins(F.col("b_start"), F.col("b_end"), width)))
    met = a.join(b, ["document_path", "_bin"]).where("a_start < b_end AND b_start < a_end")
    return met.where(F.col("_bin") == F.floor(F.greatest("a_start", "b_start") / width)).drop("_bin")


def parents(spans: DataFrame, span_id: str, width: int = BIN) -> DataFrame:
    """(parent, child): for each span the narrowest one around it.

    A span of equal extent is a parent only where it is a module; among equals
    the least id is taken. ``spans`` has document_path, start, end and kind.
    """
    right = spans.select("document_path", F.col(span_id).alias("b"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("kind").alias("b_kind"))
    left = spans.select("document_path", F.col(span_id).alias("a"), F.col("start").alias("point"), F.col("end").alias("a_end"), F.col("kind").alias("a_kind"))
    right = right.withColumnsRenamed({"b_start": "start", "b_end": "end"})
    pairs = spans_of_points(left, right, width).where("a <> b AND `end` >= a_end")
    wider = (F.col("end") - F.col("start")) > (F.col("a_end") - F.col("point"))
    pairs = pairs.where(wider | ((F.col("b_kind") == "module") & (F.col("a_kind") != "module")))
    best = F.min(F.struct((F.col("end") - F.col("start")).alias("w"), F.col("b").alias("i")))
    return pairs.groupBy("a").agg(best.alias("m")).select(F.col("m.i").alias("parent"), F.col("a").alias("child"))


def minimal(spans: DataFrame, span_id: str, group: list[str], width: int = BIN) -> DataFrame:
    """Spans of a group that strictly contain no other of it; equal spans all stay."""
    inner = spans.select(*group, "document_path", F.col("start").alias("point"), F.col("end").alias("in_end"))
    keys = [*group, "document_path"]
    left = inner.withColumn("_bin", F.floor(F.col("point") / width).cast("long"))
    right = spans.withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end"), width)))
    holding = right.join(left, [*keys, "_bin"]).where("start <= point AND in_end <= `end` AND (start < point OR in_end < `end`)").select(*group, span_id).distinct()
    return spans.join(holding, [*group, span_id], "left_anti")


def outermost(spans: DataFrame, span_id: str, group: list[str]) -> DataFrame:
    """Spans of a group contained in no other of it; equal spans do not contain each other.

    One pass per group in the order of starts: a span is contained when an
    earlier (or equally early and longer) one reaches beyond it.
    """
    by = Window.partitionBy(*group).orderBy("start", F.col("end").desc())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    far = F.max(F.struct("end", (-F.col("start")).alias("s"))).over(before)
    marked = spans.withColumn("_far", far)
    inside = F.col("_far").isNotNull() & ((F.col("_far.end") > F.col("end")) | ((F.col("_far.end") == F.col("end")) & (-F.col("_far.s") < F.col("start"))))
    return marked.where(~F.coalesce(inside, F.lit(False))).drop("_far")
