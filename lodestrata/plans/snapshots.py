"""Queries over snapshots of files."""

from __future__ import annotations

from lodestrata.operators.snapshots import snapshot_changes
from lodestrata.plans.base import query
from lodestrata.runtime import table


_P5 = r"""
        WITH complete AS (
            SELECT workspace_id, snapshot_no,
                   row_number() OVER (PARTITION BY workspace_id ORDER BY snapshot_no) AS seq,
                   lead(snapshot_no) OVER (PARTITION BY workspace_id ORDER BY snapshot_no) AS next_no
            FROM (SELECT DISTINCT workspace_id, snapshot_no FROM index_snapshots WHERE status = 'complete')
        ), cleaned AS (
            SELECT workspace_id, snapshot_no, delivered_at,
                   regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(document_path), chr(92), '/'),
                       '/(\./)+', '/', 'g'), '^(\./)+', ''), '/+', '/', 'g'), '^(\./)+', '') AS document_path,
                   nullif(regexp_extract(lower(content_hash), '([0-9a-f]{64})\s*$', 1), '') AS content_hash
            FROM source_files
        ), held AS (
            SELECT c.workspace_id, c.document_path, k.snapshot_no, k.seq, k.next_no, c.content_hash
            FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, snapshot_no, document_path
                                               ORDER BY delivered_at DESC NULLS LAST, content_hash DESC NULLS LAST) AS rn
                  FROM cleaned WHERE document_path IS NOT NULL AND document_path <> '') c
            JOIN complete k ON c.workspace_id = k.workspace_id AND c.snapshot_no = k.snapshot_no
            WHERE rn = 1
        ), spots AS (
            SELECT h.workspace_id, h.document_path, h.seq FROM held h
            UNION SELECT h.workspace_id, h.document_path, h.seq + 1 FROM held h WHERE next_no IS NOT NULL
        )
        SELECT p.workspace_id, k.snapshot_no, p.document_path,
               CASE WHEN b.seq IS NULL THEN 'added' WHEN a.seq IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM spots p
        JOIN complete k ON k.workspace_id = p.workspace_id AND k.seq = p.seq
        LEFT JOIN held a ON a.workspace_id = p.workspace_id AND a.document_path = p.document_path AND a.seq = p.seq
        LEFT JOIN held b ON b.workspace_id = p.workspace_id AND b.document_path = p.document_path AND b.seq = p.seq - 1
        WHERE p.seq > 1
          AND (a.seq IS NULL OR b.seq IS NULL OR a.content_hash IS DISTINCT FROM b.content_hash)
"""


@query(_P5)
def p5_found(spark, d):
    return snapshot_changes(table(spark, d, "source_files"), table(spark, d, "index_snapshots"), table(spark, d, "index_metadata"))
