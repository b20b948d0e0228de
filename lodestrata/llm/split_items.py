"""Cutting oversized items at natural boundaries, with an overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import spread

#: What a null chunk_size and a null chunk_overlap stand for.
DEFAULT_SIZE, DEFAULT_OVERLAP = 512, 64

_UNIT = re.compile(r"[A-Za-z0-9_]+|[^ \t\n\r\f]")
#: Natural places, the strongest first: before a line at the left margin that follows a blank line or a closing
#: line, after a blank line, after a line, after a sentence or statement. Each pattern's end is the place.
_LEVELS = [
    re.compile(r"(?:\r\n|\r|\n)[ \t\f]*(?:\r\n|\r|\n)(?=[^\s})\]])|(?:\r\n|\r|\n)[})\]]+[;,]?[ \t\f]*(?:\r\n|\r|\n)(?=\S)"),
    re.compile(r"(?:\r\n|\r|\n)[ \t\f]*(?:\r\n|\r|\n)"),
    re.compile(r"\r\n|\r|\n"),
    re.compile(r"[.!?;][\"')\]]*[ \t]+|[。！？；।॥؟]"),
]
_NAMES = ["block", "paragraph", "line", "sentence", "hard"]


def split_text(text: str, size: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """Pieces of ``text``: (first unit, end unit, start char, end char, kind of the end).

    No piece has more than ``size`` units. A cut falls on the strongest kind of
    natural place found in the last half of what would fit, else on any natural
    place that makes progress, else right at the limit. The next piece starts
    up to ``overlap`` units before the cut, at a line start where one lies there.
    A text within the limit is one piece; one without units is none.
    """
    starts, ends = [], []
    for m in _UNIT.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    n = len(starts)
    if n == 0:
        return []
    size = max(1, size)
    if n <= size:
        return [(0, n, 0, len(text), "end")]
    overlap = min(max(0, overlap), size - 1)
    levels = []
    for pattern in _LEVELS:
        # a place is kept as the number of units before it
        levels.append(sorted({bisect_left(starts, m.end()) for m in pattern.finditer(text)}))
    lines = levels[2]
    out, first, covered = [], 0, 0
    while True:
        limit = first + size
        if limit >= n:
            out.append((first, n, starts[first] if first else 0, len(text), "end"))
            return out
        cut, kind = limit, "hard"
        for least in (max(covered, first + size // 2), covered):
            for k, places in enumerate(levels):
                i = bisect_right(places, limit) - 1
                if i >= 0 and places[i] > least:
                    cut, kind = places[i], _NAMES[k]
                    break
            if kind != "hard":
                break
        out.append((first, cut, starts[first] if first else 0, starts[cut] if kind != "hard" else ends[cut - 1], kind))
        covered = cut
        back = max(cut - overlap, first + 1)
        i = bisect_left(lines, back)
        first = lines[i] if i < len(lines) and lines[i] < cut else back


def _pieces(with_text: bool, only_split: bool):
    names = ["id", "piece_no", "start_char", "end_char", "units", "overlap_units", "cut"] + ["piece"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for item, text, size, overlap in zip(*(b.column(c).to_pylist() for c in ("id", "text", "size", "overlap"))):
                # a unit takes a character at least, so short texts need no look
                if only_split and len(text) <= size:
                    continue
                pieces = split_text(text, size, overlap)
                if only_split and len(pieces) < 2:
                    continue
                before = 0
                for k, (first, end, a, z, kind) in enumerate(pieces):
                    row = [item, k, a, z, end - first, max(0, before - first) if k else 0, kind]
                    if with_text:
                        row.append(text[a:z])
                    for c, v in zip(cols, row):
                        c.append(v)
                    before = end
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()] + [pa.string()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def split_items(symbols: DataFrame, metadata: DataFrame, with_text: bool = True, only_split: bool = False) -> DataFrame:
    """The pieces of every item under its workspace's chunk_size and chunk_overlap.

    Result: canonical_id, piece_no (from 0), start_char, end_char (characters of
    span_text), units, overlap_units (units repeated from the piece before), cut
    (block, paragraph, line, sentence, hard or end) and, ``with_text``, piece.
    ``only_split`` leaves out items that fit. A null or missing setting stands
    for 512 and 64; an overlap of at least the size counts as size - 1. Items
    without id or text give no piece; rows delivered again count once.
    """
    settings = metadata.where(F.col("workspace_id").isNotNull()).groupBy("workspace_id").agg(F.max("chunk_size").alias("size"), F.max("chunk_overlap").alias("overlap"))
    rows = symbols.where(F.col("canonical_id").isNotNull() & F.col("span_text").isNotNull()).select(F.col("canonical_id").alias("id"), "workspace_id", F.col("span_text").alias("text"))
    rows = spread(rows).join(settings, "workspace_id", "left").select("id", "text", F.coalesce("size", F.lit(DEFAULT_SIZE)).cast("int").alias("size"), F.coalesce("overlap", F.lit(DEFAULT_OVERLAP)).cast("int").alias("overlap"))
    if only_split:
        # a unit has a character at least
        rows = rows.where(F.length("text") > F.col("size"))
    schema = "id string, piece_no int, start_char int, end_char int, units int, overlap_units int, cut string" + ", piece string" * with_text
    return rows.mapInArrow(_pieces(with_text, only_split), schema).dropDuplicates(["id", "piece_no"]).withColumnRenamed("id", "canonical_id")
