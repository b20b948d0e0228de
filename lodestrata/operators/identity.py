"""Identities: building them, telling collisions apart, symbol strings, units of build targets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def base_identity(workspace, package, unit, segments):
    """``workspace::package[+unit]::segment::…`` from columns; a null unit is left out."""
    return F.concat_ws("::", workspace, F.when(unit.isNull(), package).otherwise(F.concat(package, F.lit("+"), unit)), F.array_join(segments, "::"))


def disambiguate(rows: DataFrame, base: str, order: list, name: str = "identity") -> DataFrame:
    """``rows`` with an identity: the base alone where it is unique, else base#rank (from 0) by ``order``."""
    w = Window.partitionBy(base)
    rank = F.row_number().over(w.orderBy(*order)) - 1
    return rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(name, F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(base, F.lit("#"), rank.cast("string")))).drop("_n")


#: What ends a descriptor in a symbol string, and the kind it stands for (fixed values).
_ENDS = {"/": "namespace", "#": "type", ".": "term", ":": "meta", "!": "macro"}


def parse_symbol(text: str) -> tuple[str, list[tuple[str, str]]] | None:
    """(package, [(name, kind)]) of a symbol string ``scheme manager package version descriptors``; null if local or malformed.

    Fields end at a single blank, two blanks stand for one in a field. Names in
    back-ticks may hold anything, a doubled tick standing for one.
    """
    if text.startswith("local "):
        return None
    fields, i = [], 0
    for _ in range(4):
        out = []
        while i < len(text):
            if text[i] == " ":
                if text[i + 1 : i + 2] == " ":
                    out.append(" ")
                    i += 2
                    continue
                break
            out.append(text[i])
            i += 1
        if i >= len(text):
            return None
        fields.append("".join(out))
        i += 1
    segments = []

    def name_at(i: int) -> tuple[str, int]:
        if text[i : i + 1] == "`":
            out, i = [], i + 1
            while i < len(text):
                if text[i] == "`":
                    if text[i + 1 : i + 2] == "`":
                        out.append("`")
                        i += 2
                        continue
                    return "".join(out), i + 1
                out.append(text[i])
                i += 1
            raise ValueError(text)
        j = i
        while j < len(text) and (text[j].isalnum() or text[j] in "_+-$"):
            j += 1
        if j == i:
            raise ValueError(text)
        return text[i:j], j

    try:
        while i < len(text):
            if text[i] in "([":
                closing = ")" if text[i] == "(" else "]"
                name, j = name_at(i + 1)
                if text[j : j + 1] != closing:
                    return None
                segments.append((name, "parameter" if closing == ")" else "type_parameter"))
                i = j + 1
                continue
            name, i = name_at(i)
            end = text[i : i + 1]
            if end == "(":
                close = text.index(").", i)
                segments.append((name, "method"))
                i = close + 2
            elif end in _ENDS and end:
                segments.append((name, _ENDS[end]))
                i += 1
            else:
                return None
    except ValueError:
        return None
    return (fields[2], segments) if segments else None


def kind_of(segments: list[tuple[str, str]]) -> str:
    """A symbol's kind by its last segment; something to call is a method only inside a type."""
    last = segments[-1][1]
    if last == "method":
        return "Method" if len(segments) > 1 and segments[-2][1] in ("type", "type_parameter") else "Function"
    if last == "term":
        return "Field" if len(segments) > 1 and segments[-2][1] == "type" else "Constant"
    return {"namespace": "Module", "type": "Type"}.get(last, "Other")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string())]))
    for b in batches:
        got = [x and parse_symbol(x) for x in b.column("symbol").to_pylist()]
        packages = pa.array([g and g[0] for g in got], pa.string())
        segments = pa.array([g and [{"name": n, "kind": k} for n, k in g[1]] for g in got], kind)
        kinds = pa.array([g and kind_of(g[1]) for g in got], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("symbol"), packages, segments, kinds], ["symbol", "package", "segments", "kind"])


def parse_symbols(symbols: DataFrame) -> DataFrame:
    """(symbol, package, segments, kind) of different symbol strings; null parts where one is local or malformed."""
    return symbols.select("symbol").distinct().mapInArrow(_parsed, "symbol string, package string, segments array<struct<name:string,kind:string>>, kind string")


def assign_units(targets: DataFrame, reach: DataFrame) -> DataFrame:
    """(document, unit): targets (target, unit) that reach a document (target, document).

    One target gives its unit, several ``shared``; documents none reaches do not appear.
    """
    hits = reach.join(targets, "target").select("document", "target", "unit").distinct()
    per = hits.groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"))
    return per.select("document", F.when(F.col("n") == 1, F.col("unit")).otherwise("shared").alias("unit"))


def single_parent(declared: DataFrame) -> DataFrame:
    """(document, parent) for documents that exactly one other declares."""
    per = declared.select("document", "parent").distinct().groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("parent"))
    return per.where("n = 1").select("document", "parent")
