"""Semantic index files (protobuf) as occurrences and symbols."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field numbers of the public index format (fixed values): documents of an index; path and occurrences of a
#: document; range, symbol and roles of an occurrence; the bit that marks a definition.
DOCUMENTS, PATH, OCCURRENCES, RANGE, SYMBOL, ROLES, DEFINITION = 2, 1, 2, 1, 2, 3, 1


def _varint(data: memoryview, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        value |= (byte & 127) << shift
        i += 1
        if byte < 128:
            return value, i
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields: numbers as they are, all else as bytes."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        yield key >> 3, value


def _packed(data: memoryview) -> list[int]:
    out, i = [], 0
    while i < len(data):
        v, i = _varint(data, i)
        out.append(v)
    return out


def occurrences_of(content: bytes) -> Iterator[tuple[str, str, list[int], bool]]:
    """(path, symbol, [start line, start column, end line, end column], is a definition), all counted from 0."""
    for number, document in fields(memoryview(content).cast("B")):
        if number != DOCUMENTS or isinstance(document, int):
            continue
        path, found = "", []
        for n, v in fields(document):
            if n == PATH:
                path = bytes(v).decode()
            elif n == OCCURRENCES:
                symbol, place, roles = "", [], 0
                for m, w in fields(v):
                    if m == RANGE:
                        place += [w] if isinstance(w, int) else _packed(w)
                    elif m == SYMBOL:
                        symbol = bytes(w).decode()
                    elif m == ROLES:
                        roles = w
                found.append((symbol, place, roles))
        for symbol, place, roles in found:
            if len(place) == 3:
                place = [place[0], place[1], place[0], place[2]]
            if len(place) == 4:
                yield path, symbol, place, bool(roles & DEFINITION)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["index_path", "document_path", "symbol", "start_line", "start_character", "end_line", "end_character", "is_definition"]
    types = [pa.string()] * 3 + [pa.int32()] * 4 + [pa.bool_()]
    for b in batches:
        for source, content in zip(b.column("path").to_pylist(), b.column("content")):
            rows = [(source, p, s, *place, d) for p, s, place, d in occurrences_of(content.as_buffer())]
            for at in range(0, max(1, len(rows)), 50_000):
                cols = list(zip(*rows[at : at + 50_000])) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per occurrence of the index files under ``path``; lines and characters count from 0."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInArrow(_decode, "index_path string, document_path string, symbol string, start_line int, start_character int, end_line int, end_character int, is_definition boolean")


def classified(occurrences: DataFrame) -> DataFrame:
    """(symbol, class, definitions, references): symbols with any definition are in_workspace, others external; local ones are left out."""
    rows = occurrences.where(~F.col("symbol").startswith("local ") & (F.col("symbol") != ""))
    out = rows.groupBy("symbol").agg(F.count_if("is_definition").alias("definitions"), F.count_if(~F.col("is_definition")).alias("references"))
    return out.select("symbol", F.when(F.col("definitions") > 0, "in_workspace").otherwise("external").alias("class"), "definitions", "references")
