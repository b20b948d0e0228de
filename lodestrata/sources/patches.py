"""Unified diffs as rows of changed regions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
#: One-letter escapes of quoted paths (fixed values).
_ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}


@dataclass
class FileChange:
    """A file's change: its paths before and after (null where there is none) and its regions before."""

    kind: str
    before: str | None
    after: str | None
    ranges: list[tuple[int, int]] = field(default_factory=list)


def unquote(text: str) -> str | None:
    """A path in C-style quotes; null if malformed."""
    if len(text) < 2 or text[0] != '"' or text[-1] != '"':
        return None
    out, i, body = bytearray(), 0, text[1:-1]
    while i < len(body):
        c = body[i]
        if c == '"':
            return None
        if c != "\\":
            out += c.encode()
            i += 1
            continue
        octal = re.match(r"[0-3][0-7]{2}", body[i + 1 :])
        if octal:
            out.append(int(octal[0], 8))
            i += 4
        elif body[i + 1 : i + 2] in _ESCAPES and body[i + 1 : i + 2]:
            out.append(_ESCAPES[body[i + 1]])
            i += 2
        else:
            return None
    try:
        return out.decode()
    except UnicodeDecodeError:
        return None


def _path(value: str, prefix: str) -> str | None:
    """A path of a header line: none for /dev/null, unquoted, up to a tab, without a/ or b/."""
    if value.startswith('"'):
        end = value.rfind('"')
        got = unquote(value[: end + 1])
    else:
        got = value.split("\t")[0].rstrip("\r")
    if got is None or got == "/dev/null":
        return None
    return got[len(prefix) :] if got.startswith(prefix) else got


def parse_patch(text: str) -> list[FileChange]:
    """The changed files of a unified diff.

    Inside a hunk lines are counted, so lines there that look like headers are
    content. Renames, changes of mode only and binary files have no ranges.
    """
    out: list[FileChange] = []
    now: FileChange | None = None
    old_left = new_left = 0
    for line in text.split("\n"):
        if now is not None and (old_left > 0 or new_left > 0):
            mark = line[:1]
            if mark == "-":
                old_left -= 1
            elif mark == "+":
                new_left -= 1
            elif mark != "\\":
                old_left -= 1
                new_left -= 1
            continue
        if line.startswith("diff --git "):
            now = FileChange("modified", None, None)
            m = re.match(r'diff --git (?:a/(.*) b/(.*)|("a/.*") ("b/.*"))$', line.rstrip("\r"))
            if m:
                now.before, now.after = (m[1], m[2]) if m[1] is not None else (_path(m[3], "a/"), _path(m[4], "b/"))
            out.append(now)
        elif line.startswith("--- ") and not line.startswith("--- a/dev/null"):
            path = _path(line[4:], "a/")
            if now is None or now.ranges:
                now = FileChange("modified", None, None)
                out.append(now)
            now.before = path
            if path is None:
                now.kind = "added"
        elif line.startswith("+++ ") and now is not None:
            now.after = _path(line[4:], "b/")
            if now.after is None:
                now.kind = "deleted"
        elif now is not None and line.startswith("new file mode"):
            now.kind, now.before = "added", None
        elif now is not None and line.startswith("deleted file mode"):
            now.kind, now.after = "deleted", None
        elif now is not None and line.startswith("rename from "):
            now.kind, now.before = "renamed", _path(line[12:], "")
        elif now is not None and line.startswith("rename to "):
            now.after = _path(line[10:], "")
        elif now is not None and (m := _HUNK.match(line)):
            old_left = int(m[2]) if m[2] is not None else 1
            new_left = int(m[4]) if m[4] is not None else 1
            now.ranges.append((int(m[1]), old_left))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["patch_id", "kind", "before", "after", "start", "count"]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for i, text in zip(b.column("patch_id").to_pylist(), b.column("text").to_pylist()):
            for f in parse_patch(text or ""):
                for start, count in f.ranges or [(None, None)]:
                    for c, v in zip(cols, (i, f.kind, f.before, f.after, start, count)):
                        c.append(v)
        types = [pa.string()] * 4 + [pa.int32()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def patch_regions(patches: DataFrame) -> DataFrame:
    """(patch_id, kind, before, after, start, count) from (patch_id, text); files without hunks once with nulls."""
    return patches.selectExpr("cast(patch_id as string) patch_id", "text").mapInArrow(_rows, "patch_id string, kind string, before string, after string, start int, count int")
