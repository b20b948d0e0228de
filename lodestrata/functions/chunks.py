"""Passages cut to a number of tokens, with a header and an overlap."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import spread

#: Boundaries of content, the widest first: blank lines, sentence ends, lines.
_CUTS = [re.compile(r"\n[ \t]*\n+"), re.compile(r"[.!?](?=\s)\s?"), re.compile(r"\n")]
_UNIT = re.compile(r"\w+|[^\w\s]")


def count_units(text: str) -> int:
    return len(_UNIT.findall(text))


def bounded_header(header: str, size: int, count: Callable[[str], int] = count_units) -> str:
    """The header within half of ``size``; its last lines go first."""
    lines = header.split("\n")
    while len(lines) > 1 and count("\n".join(lines)) > size // 2:
        lines.pop()
    text = "\n".join(lines)
    if count(text) <= size // 2:
        return text
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if count(text[:mid]) <= size // 2 else (low, mid - 1)
    return text[:low]


def _atoms(text: str, size: int, count: Callable[[str], int], level: int = 0) -> list[str]:
    if count(text) <= size:
        return [text] if text else []
    if level == len(_CUTS):
        out, start, seen = [], 0, 0
        for m in _UNIT.finditer(text):
            if seen == size:
                out.append(text[start : m.start()])
                start, seen = m.start(), 0
            seen += 1
        return [*out, text[start:]]
    parts, start = [], 0
    for m in _CUTS[level].finditer(text):
        parts.append(text[start : m.end()])
        start = m.end()
    parts.append(text[start:])
    return [a for p in parts if p for a in _atoms(p, size, count, level + 1)]


def split_passages(passages: DataFrame, size: int = 512, overlap: int = 64, key: str = "id") -> DataFrame:
    """(key, ordinal, chunk, units) of passages (key, header, content): each cut as by ``split_passage``, in tasks.

    Rows without key are left out; null headers and contents are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, c, count_units(c)) for i, h, t in zip(*(b.column(x).to_pylist() for x in ("key", "header", "content"))) for k, c in enumerate(split_passage(h or "", t or "", size, overlap))]
            keys, ordinals, texts, units = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("key").type), pa.array(ordinals, pa.int32()), pa.array(texts, pa.string()), pa.array(units, pa.int32())], ["key", "ordinal", "chunk", "units"])

    rows = passages.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "header", "content")
    return spread(rows).mapInArrow(run, f"key {dict(rows.dtypes)['key']}, ordinal int, chunk string, units int").withColumnRenamed("key", key)


def split_passage(header: str, content: str, size: int = 512, overlap: int = 64, count: Callable[[str], int] = count_units) -> list[str]:
    """Chunks of header and content of at most ``size`` tokens by ``count``.

    Content descends the boundaries only where a piece is too large. A chunk
    starts with whole pieces of the one before, up to ``overlap`` tokens.
    """
    head = bounded_header(header, size, count)
    room = max(1, size - count(head))
    out: list[list[str]] = []
    now: list[str] = []
    used = 0
    for atom in _atoms(content, room, count):
        n = count(atom)
        if now and used + n > room:
            out.append(now)
            carried: list[str] = []
            kept = 0
            for a in reversed(now):
                c = count(a)
                if kept + c > overlap or kept + c + n > room:
                    break
                carried.insert(0, a)
                kept += c
            now, used = carried, kept
        now.append(atom)
        used += n
    if now or not out:
        out.append(now)
    return ["\n".join(x for x in (head, "".join(c)) if x) for c in out]
