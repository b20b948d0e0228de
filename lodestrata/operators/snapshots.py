"""Row changes between consecutive full snapshots of a table.

Rows of all snapshots are range-partitioned and sorted by key, snapshot and
delivery, so each range holds every snapshot's rows of its keys side by side.
One pass per range then runs the merge of each two neighbouring snapshots: the
pointer on the earlier snapshot and the pointer on the later one move over the
same sorted stream, of several deliveries of a row the last holds, and only two
rows have to be remembered. That sort is the only shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestrata.runtime import materialize

_CHANGES = T.StructType(
    [
        T.StructField("workspace_id", T.StringType()),
        T.StructField("snapshot_no", T.IntegerType()),
        T.StructField("document_path", T.StringType()),
        T.StructField("change", T.StringType()),
    ]
)


def normal_path(path, root=None):
    """A file's path as an index writes it: ``/`` between parts, none empty, no ``.``.

    ``..`` takes back the part before it. An absolute path below ``root`` becomes
    relative to it. Blank and null paths give null.
    """
    p = F.regexp_replace(F.translate(path, "\\", "/"), r"^[\s\ufeff]+|[\s\ufeff]+$", "")
    if root is not None:
        base = F.concat(F.rtrim(F.translate(root, "\\", "/"), F.lit("/")), F.lit("/"))
        p = F.when(root.isNotNull() & (F.length(F.trim(root)) > 0) & p.startswith(base), F.substr(p, F.length(base) + 1)).otherwise(p)
    parts = F.filter(F.split(p, "/", -1), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when((x == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    # taking a path apart is only worth its cost where a part is empty or made of dots, folding where one goes back
    odd = p.rlike(r"(?:^|/)\.{0,2}(?:/|$)")
    joined = F.when(odd, F.when(F.array_contains(parts, ".."), F.array_join(kept, "/")).otherwise(F.array_join(parts, "/"))).otherwise(p)
    return F.nullif(joined, F.lit(""))


def normal_hash(value):
    """The 64 hex digits in lower case; other values trimmed and in lower case."""
    digits = F.regexp_extract(F.lower(value), r"([0-9a-f]{64})\s*$", 1)
    return F.when(value.isNull(), None).when(digits != "", digits).otherwise(F.lower(F.trim(value)))


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by (workspace, path, seq) and delivery.

    Two rows are carried to the next batch: the last, which a later delivery may
    still replace, and the one before it.
    """

    def latest(rows: pd.DataFrame) -> pd.DataFrame:
        """Of rows of one key and snapshot the last."""
        ws, path, seq = (rows[c].to_numpy(object) for c in ("workspace_id", "document_path", "seq"))
        again = (ws[1:] == ws[:-1]) & (path[1:] == path[:-1]) & (seq[1:] == seq[:-1])
        return rows[np.append(~again, True)]

    def compare(rows: pd.DataFrame, ended: bool) -> pd.DataFrame | None:
        """Changes seen at the steps between neighbouring rows of ``rows``; the step behind the last is only taken when the stream has ended."""
        ws, path = rows["workspace_id"].to_numpy(object), rows["document_path"].to_numpy(object)
        seq = rows["seq"].to_numpy(np.int64)
        number, after = rows["snapshot_no"].to_numpy(np.int64), rows["next_no"].to_numpy(np.float64)
        digest = rows["content_hash"].to_numpy(object)
        same = (ws[1:] == ws[:-1]) & (path[1:] == path[:-1])
        next_to = same & (seq[1:] == seq[:-1] + 1)
        gone = ~next_to & (seq[:-1] > 0) & ~np.isnan(after[:-1])  # the later snapshot lacks the row
        new = ~next_to & (seq[1:] > 1)  # the earlier snapshot lacks the row
        null = pd.isna(digest)
        equal = (null[1:] & null[:-1]) | (~null[1:] & ~null[:-1] & (digest[1:] == digest[:-1]))
        other = next_to & ~equal
        out = [(ws[:-1][gone], after[:-1][gone].astype(np.int64), path[:-1][gone], "removed"), (ws[1:][new], number[1:][new], path[1:][new], "added"), (ws[1:][other], number[1:][other], path[1:][other], "changed")]
        if ended and seq[-1] > 0 and not np.isnan(after[-1]):
            out.append((ws[-1:], after[-1:].astype(np.int64), path[-1:], "removed"))
        frames = [pd.DataFrame({"workspace_id": a, "snapshot_no": b.astype(np.int32), "document_path": c, "change": d}) for a, b, c, d in out if len(a)]
        return pd.concat(frames, ignore_index=True) if frames else None

    blank = pd.DataFrame({"workspace_id": [None], "document_path": [None], "seq": [0], "snapshot_no": [0], "next_no": [np.nan], "content_hash": [None]})
    carried = blank
    for batch in batches:
        if not len(batch):
            continue
        rows = latest(pd.concat([carried, batch[list(blank.columns)]], ignore_index=True))
        found = compare(rows.iloc[:-1], False) if len(rows) > 2 else None
        carried = rows.tail(2)
        if found is not None:
            yield found
    if carried is not blank:
        found = compare(carried, True)
        if found is not None:
            yield found


def snapshot_changes(files: DataFrame, snapshots: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Files added, removed and changed between consecutive complete snapshots.

    ``files`` has workspace_id, snapshot_no, document_path, content_hash and
    delivered_at; ``snapshots`` has workspace_id, snapshot_no and status; the
    optional ``roots`` has workspace_id and workspace_root. Other columns are
    ignored. Result: workspace_id, snapshot_no (of the later snapshot),
    document_path, change.

    Partial and unlisted snapshots are passed over. The first complete snapshot
    of a workspace gives no changes. Of several rows for one file the latest
    delivered holds, among equals the greatest hash, null being least. Two null
    hashes are equal. Rows without path or workspace are no files. A listed
    snapshot without any row means that every file was removed. Empty inputs
    give an empty result.
    """
    by_ws = Window.partitionBy("workspace_id").orderBy("snapshot_no")
    complete = (
        snapshots.where((F.lower(F.trim("status")) == "complete") & F.col("workspace_id").isNotNull() & F.col("snapshot_no").isNotNull())
        .select("workspace_id", F.col("snapshot_no").cast("int").alias("snapshot_no"))
        .distinct()
        .select("workspace_id", "snapshot_no", F.row_number().over(by_ws).alias("seq"), F.lead("snapshot_no").over(by_ws).alias("next_no"))
    )
    rows = files.select("workspace_id", F.col("snapshot_no").cast("int").alias("snapshot_no"), "document_path", "content_hash", "delivered_at")
    root = None
    if roots is not None:
        known = roots.where(F.col("workspace_id").isNotNull()).groupBy("workspace_id").agg(F.max("workspace_root").alias("workspace_root"))
        rows, root = rows.join(known, "workspace_id", "left"), F.col("workspace_root")
    rows = rows.select("workspace_id", "snapshot_no", normal_path(F.col("document_path"), root).alias("document_path"), normal_hash(F.col("content_hash")).alias("content_hash"), "delivered_at")
    rows = rows.where(F.col("document_path").isNotNull() & F.col("workspace_id").isNotNull())
    # written once: the ranges are read off a sample of it
    held = materialize(rows.join(complete, ["workspace_id", "snapshot_no"]).select("workspace_id", "document_path", "seq", "snapshot_no", "next_no", "content_hash", "delivered_at"), "snapshots")
    sorted_rows = held.repartitionByRange("workspace_id", "document_path").sortWithinPartitions("workspace_id", "document_path", "seq", F.col("delivered_at").asc_nulls_first(), F.col("content_hash").asc_nulls_first())
    return sorted_rows.select("workspace_id", "document_path", "seq", "snapshot_no", "next_no", "content_hash").mapInPandas(_merge, _CHANGES)
