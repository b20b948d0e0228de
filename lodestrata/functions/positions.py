"""Places in text under different counts: bytes, UTF-16 units, characters; lines and columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

ENCODINGS = ("utf8", "utf16", "utf32")


def to_byte(line: str, character: int, encoding: str) -> int | None:
    """The byte offset in ``line`` of an offset counted in ``encoding``; null where there is none."""
    if character < 0:
        return None
    raw = line.encode()
    if encoding == "utf8":
        if character > len(raw):
            return None
        return character if character == len(raw) or raw[character] & 0xC0 != 0x80 else None
    if encoding == "utf32":
        return len(line[:character].encode()) if character <= len(line) else None
    units = at = 0
    for ch in line:
        if units == character:
            return at
        units += 2 if ord(ch) > 0xFFFF else 1
        at += len(ch.encode())
        if units > character:
            return None
    return at if units == character else None


def byte_of(line, character, encoding):
    """``to_byte`` as a column; null inputs give null."""
    return F.pandas_udf(_bytes, "int")(line, character, encoding)


def _bytes(line: pd.Series, character: pd.Series, encoding: pd.Series) -> pd.Series:
    out = [None if a is None or pd.isna(b) or c is None else to_byte(a, int(b), c) for a, b, c in zip(line, character, encoding)]
    return pd.Series(out, dtype="Int32")
