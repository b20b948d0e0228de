"""Copies that differ only in blanks, letter case, marks, comments or order."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.lexing import WORD, without_comments
from lodestrata.runtime import broadcast_within, latest_per_key, materialize, spread

#: A key with more members than this is hot: its rows are salted.
HOT_MEMBERS = 50_000
SALTS = 64
#: Hot keys sent to all executors at most (16 bytes each); beyond that they are joined.
MOST_HOT = 1_000_000


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = []
        for text, path in zip(b.column("text").to_pylist(), b.column("path").to_pylist()):
            words = WORD.findall(without_comments(text, path).lower())
            words.sort()
            keys.append(blake2b("\n".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("at"), pa.array(keys, pa.binary())], ["id", "at", "key"])


def canonical_keys(items: DataFrame, item_id: str = "canonical_id", text: str = "span_text", path: str = "document_path", at: str = "indexed_at") -> DataFrame:
    """One row (id, key) per item with a text; ``key`` stands for its multiset of words.

    A word is a longest run of letters, digits and underscores in lower case;
    comments are left out (``.py`` and ``.rs`` paths; others have none). Items
    without words share the key of the empty multiset. Items without id or
    text give no row. Of an item delivered again the latest row holds.
    """
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("id"), F.col(at).alias("at"), F.col(text).alias("text"), F.col(path).alias("path"))
    at_type = dict(rows.dtypes)["at"]
    return latest_per_key(spread(rows).mapInArrow(_keys, f"id string, at {at_type}, key binary"), "id", "at", "key")


def collapse(keyed: DataFrame, hot_members: int = HOT_MEMBERS, salts: int = SALTS) -> DataFrame:
    """(id, key) to one row (id, keeper_id, copies) per item; the least id of a key is its keeper.

    Counts per key find the hot keys exactly. Their rows go through two levels
    (per key and salt, then per key), and their members meet the keeper by key
    and salt, so no task sees a whole hot group. All other keys are settled by
    one shuffle on the key. ``keyed`` is read several times: pass a written table.
    """
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # hot keys are at most the rows over hot_members: with them sent to all, no row of a hot key is shuffled before it has its salt
    hot = broadcast_within(materialize(counted.where(F.col("n") > hot_members).select("key"), "hot-keys"), MOST_HOT)
    rest = keyed.join(hot, "key", "left_anti").groupBy("key").agg(F.min("id").alias("keeper_id"), F.count(F.lit(1)).alias("copies"))
    many = rest.where("copies > 1")
    out = keyed.join(many, "key").select("id", "keeper_id", "copies")
    single = keyed.join(hot, "key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    part = single.groupBy("key", "salt").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    keepers = part.groupBy("key").agg(F.min("id").alias("keeper_id"), F.sum("n").alias("copies"))
    spread = keepers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return out.unionByName(single.join(spread, ["key", "salt"]).select("id", "keeper_id", "copies"))


def format_copies(items: DataFrame, hot_members: int = HOT_MEMBERS, **columns: str) -> DataFrame:
    """Each item that has copies with its keeper and the number of copies, itself included.

    Empty input gives an empty result; items without copies do not appear.
    """
    return collapse(materialize(canonical_keys(items, **columns), "format-keys"), hot_members)


def collapsed(items: DataFrame, hot_members: int = HOT_MEMBERS, **columns: str) -> DataFrame:
    """One row (keeper_id, copies) per group of copies."""
    return format_copies(items, hot_members, **columns).where("id = keeper_id").select("keeper_id", "copies")
