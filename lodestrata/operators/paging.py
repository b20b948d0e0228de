"""Pages of ordered results and the cursors that continue them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Page:
    """One page, whether more follows, and the cursor that continues it."""

    rows: DataFrame
    total: int
    index: int
    cursor: str | None


def query_identity(command: str, arguments: dict, content_hash: str, version: int = 1) -> str:
    """A digest of what was asked, of which content, under which order."""
    body = json.dumps({"command": command, "arguments": arguments, "content": content_hash, "version": version}, sort_keys=True, ensure_ascii=False)
    return hashlib.sha256(body.encode()).hexdigest()


def encode_cursor(identity: str, page: int, after: str | None = None) -> str:
    text = f"{identity}:{page}" if after is None else f"{identity}:{page}:{after}"
    return text.encode().hex()


def decode_cursor(token: str) -> tuple[str, int, str | None] | None:
    """(identity, page, after), or null for a malformed token."""
    try:
        parts = bytes.fromhex(token).decode().split(":", 2)
        return parts[0], int(parts[1]), parts[2] if len(parts) > 2 else None
    except (ValueError, IndexError, UnicodeDecodeError):
        return None


def _position(cursor: str | None, limit: int | None, identity: str) -> tuple[int, str | None]:
    if cursor is None:
        return 0, None
    if not limit:
        raise ValueError("a cursor needs a limit")
    got = decode_cursor(cursor)
    if got is None:
        raise ValueError("the cursor is malformed")
    if got[0] != identity:
        raise ValueError("the cursor belongs to another query or content")
    return got[1], got[2]


def offset_page(rows: DataFrame, order: list, limit: int, identity: str, cursor: str | None = None) -> Page:
    """Rows page * limit and on, in a total order; a page beyond the last is an error that names the range."""
    page, _ = _position(cursor, limit, identity)
    total = rows.count()
    pages = max(1, -(-total // limit))
    if page >= pages:
        raise ValueError(f"page {page} is out of range; pages 0 to {pages - 1} exist")
    shown = rows.orderBy(*order).offset(page * limit).limit(limit)
    return Page(shown, total, page, encode_cursor(identity, page + 1) if page + 1 < pages else None)


def keyset_page(rows: DataFrame, key: str, limit: int, identity: str, cursor: str | None = None) -> Page:
    """The ``limit`` rows behind the last key given out; no total is counted, no rows are skipped over."""
    page, after = _position(cursor, limit, identity)
    left = rows if after is None else rows.where(F.col(key) > after)
    keys = [r[0] for r in left.select(key).orderBy(key).limit(limit + 1).collect()]
    more = len(keys) > limit
    shown = left.where(F.col(key) <= keys[limit - 1]) if more else left
    return Page(shown.orderBy(key).limit(limit), -1, page, encode_cursor(identity, page + 1, str(keys[limit - 1])) if more else None)


def capped_groups(rows: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group, each with the group's total; totals come from a count, not from the rows."""
    from pyspark.sql.window import Window

    totals = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    few = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= limit).drop("_rn")
    return few.join(totals, group)
