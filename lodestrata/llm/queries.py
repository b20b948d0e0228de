"""The training-data queries and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.llm import encode, format_duplicates, function_docs, mixing, near_duplicates, sentences, shared_spans, split_items
from lodestrata.runtime import materialize, table


def p1_found(spark, d):
    return near_duplicates.near_duplicates(table(spark, d, "symbols"))


def p1_groups(spark, d):
    return near_duplicates.near_groups(table(spark, d, "symbols"))


def p2_found(spark, d):
    return shared_spans.shared_stretches(table(spark, d, "clone_fingerprints")).select("passage_a", "start_a", "passage_b", "start_b")


def p2_shared_tokens(spark, d):
    return shared_spans.shared_tokens(table(spark, d, "clone_fingerprints"), table(spark, d, "semantic_corpus"))


def p3_found(spark, d):
    return format_duplicates.format_copies(table(spark, d, "symbols")).where("id <> keeper_id").select("keeper_id", F.col("id").alias("copy_id"))


def p3_collapsed(spark, d):
    return format_duplicates.collapsed(table(spark, d, "symbols"))


def p4_found(spark, d):
    return function_docs.documented_functions(table(spark, d, "symbols")).select("canonical_id")


def p4_pairs(spark, d):
    return function_docs.documented_functions(table(spark, d, "symbols"))


def p6_found(spark, d):
    return split_items.split_items(table(spark, d, "symbols"), table(spark, d, "index_metadata")).where("piece_no = 1").select("canonical_id")


def p6_pieces(spark, d):
    return split_items.split_items(table(spark, d, "symbols"), table(spark, d, "index_metadata"))


def p7_ids(spark, d):
    return encode.encode(table(spark, d, "documents"))


def p7_decoded(spark, d):
    ids = materialize(encode.encode(table(spark, d, "documents")), "ids")
    return encode.decode(ids, encode.pieces(spark))


#: Which of these tables' sources belong together.
DOMAINS = {"docstring": "code", "commit_log": "code", "readme": "documents", "changelog": "documents", "design_note": "documents", "runbook": "documents", "issue": "discussion", "review": "discussion", "forum": "discussion", "transcript": "discussion", "eval_report": "reports"}


def p8_mixture(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), domains=DOMAINS)[0]


def p8_report(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), domains=DOMAINS)[1]


def p9_found(spark, d):
    return sentences.sentences(table(spark, d, "documents"), with_text=False).select("doc_id", "end_char")


def p9_sentences(spark, d):
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_shared_tokens, p3_found, p3_collapsed, p4_found, p4_pairs, p6_found, p6_pieces, p7_ids, p7_decoded, p8_mixture, p8_report, p9_found, p9_sentences)}

_STRETCHES = r"""
        WITH f AS (
            SELECT DISTINCT hash, passage_id, token_ordinal FROM clone_fingerprints
            WHERE hash IS NOT NULL AND passage_id IS NOT NULL AND token_ordinal IS NOT NULL
        ), s AS (
            SELECT a.passage_id AS pa, b.passage_id AS pb, a.token_ordinal - b.token_ordinal AS d, a.token_ordinal AS o
            FROM f a JOIN f b ON a.hash = b.hash AND a.passage_id < b.passage_id
        ), m AS (
            SELECT *, CASE WHEN o - lag(o) OVER (PARTITION BY pa, pb, d ORDER BY o) <= 17 THEN 0 ELSE 1 END AS new_ FROM s
        ), k AS (
            SELECT *, sum(new_) OVER (PARTITION BY pa, pb, d ORDER BY o) AS r FROM m
        ), st AS (
            SELECT pa, pb, d, min(o) AS sa, max(o) AS la FROM k GROUP BY pa, pb, d, r HAVING max(o) - min(o) + 16 >= 64
        )
"""

_ALIKE = r"""
        WITH RECURSIVE s AS (
            SELECT DISTINCT canonical_id, regexp_extract_all(lower(span_text), '[\p{L}\p{N}_]+') AS w
            FROM symbols WHERE clone_token_count >= 40 AND span_text IS NOT NULL AND canonical_id IS NOT NULL
        ), r AS (
            SELECT canonical_id, list_sort(list(DISTINCT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS runs
            FROM (SELECT canonical_id, w, unnest(range(1, len(w) - 1)) AS i FROM s) GROUP BY 1
        ), c AS (
            SELECT md5(array_to_string(runs, chr(10))) AS cls, min(canonical_id) AS rep, any_value(runs) AS runs FROM r GROUP BY 1
        ), u AS (
            SELECT rep, unnest(runs) AS run FROM c
        ), met AS (
            SELECT a.rep AS a, b.rep AS b, count(*) AS both_ FROM u a JOIN u b ON a.run = b.run AND a.rep <> b.rep GROUP BY 1, 2
        ), link AS (
            SELECT a, b FROM met JOIN c x ON x.rep = a JOIN c y ON y.rep = b WHERE both_ >= 0.6 * (len(x.runs) + len(y.runs) - both_)
        ), reach AS (
            SELECT rep AS node, rep AS other FROM c UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other
        ), grp AS (SELECT node, min(other) AS group_id FROM reach GROUP BY 1), deg AS (SELECT a AS node, count(*) AS links FROM link GROUP BY 1)
        SELECT r.canonical_id, g.group_id, coalesce(d.links, 0) AS links
        FROM r JOIN c ON c.cls = md5(array_to_string(r.runs, chr(10))) JOIN grp g ON g.node = c.rep LEFT JOIN deg d ON d.node = c.rep
"""

#: Literals (group 1, kept) or comments of Python and of Rust, whose block comments nest two levels deep at most here.
_PY_PARTS = r"""("{3}(?:[^"\\]|\\[\s\S]|"[^"]|""[^"])*"{3}|'{3}(?:[^'\\]|\\[\s\S]|'[^']|''[^'])*'{3}|"(?:[^"\\\r\n]|\\[\s\S])*"|'(?:[^'\\\r\n]|\\[\s\S])*')|#[^\r\n]*"""
_RS_PARTS = r"""(r"[^"]*"|r#"(?:[^"]|"[^#])*"#|"(?:[^"\\]|\\[\s\S])*"|'(?:[^'\\\r\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|[^\r\n]))')|//[^\n]*|/\*(?:[^*/]|\*+[^*/]|/+[^*/]|/\*(?:[^*]|\*+[^*/])*\*+/)*\*+/"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_COPIES = rf"""
        WITH t AS (SELECT DISTINCT canonical_id, document_path, span_text FROM symbols WHERE canonical_id IS NOT NULL AND span_text IS NOT NULL), x AS (
            SELECT canonical_id, CASE WHEN document_path LIKE '%.py' THEN regexp_replace(span_text, {_sql(_PY_PARTS)}, '\1 ', 'g')
                WHEN document_path LIKE '%.rs' THEN regexp_replace(span_text, {_sql(_RS_PARTS)}, '\1 ', 'g') ELSE span_text END AS y FROM t
        ), k AS (
            SELECT canonical_id, array_to_string(list_sort(regexp_extract_all(lower(y), '[\p{{L}}\p{{N}}_]+')), ' ') AS key FROM x
        ), g AS (SELECT key, min(canonical_id) AS keeper_id, count(*) AS copies FROM k GROUP BY 1 HAVING count(*) > 1)
"""

SQL = {
    "p1_groups": _ALIKE,
    "p3_found": _COPIES + "SELECT g.keeper_id, k.canonical_id AS copy_id FROM k JOIN g ON g.key = k.key WHERE k.canonical_id <> g.keeper_id",
    "p3_collapsed": _COPIES + "SELECT keeper_id, copies FROM g",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL",
    "p2_found": _STRETCHES + "SELECT pa AS passage_a, sa AS start_a, pb AS passage_b, sa - d AS start_b FROM st",
    "p2_shared_tokens": _STRETCHES
    + r"""
        , places AS (
            SELECT pa AS p, sa AS a, la + 16 AS z FROM st UNION ALL SELECT pb, sa - d, la - d + 16 FROM st
        ), covered AS (
            SELECT DISTINCT p, unnest(range(a, z)) AS t FROM places
        )
        SELECT c.id AS passage_id, coalesce(x.n, 0) AS shared_tokens, coalesce(y.n, 0) AS stretches
        FROM (SELECT DISTINCT id FROM semantic_corpus WHERE id IS NOT NULL) c
        LEFT JOIN (SELECT p, count(*) AS n FROM covered GROUP BY 1) x ON x.p = c.id
        LEFT JOIN (SELECT p, count(*) AS n FROM places GROUP BY 1) y ON y.p = c.id
    """,
    "p1_found": r"""
        WITH s AS (
            SELECT DISTINCT canonical_id, clone_substitution_key AS k,
                   regexp_extract_all(lower(span_text), '[\p{L}\p{N}_]+') AS w
            FROM symbols WHERE clone_token_count >= 40 AND span_text IS NOT NULL
        ), r AS (
            SELECT DISTINCT canonical_id, k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run
            FROM (SELECT canonical_id, k, w, unnest(range(1, len(w) - 1)) AS i FROM s)
        ), n AS (
            SELECT canonical_id, count(*) AS n FROM r GROUP BY 1
        ), c AS (
            SELECT a.canonical_id AS a, b.canonical_id AS b, count(*) AS both_
            FROM r a JOIN r b ON a.run = b.run AND a.canonical_id < b.canonical_id
            WHERE a.k IS NULL OR b.k IS NULL OR a.k <> b.k
            GROUP BY 1, 2
        )
        SELECT c.a AS canonical_id_a, c.b AS canonical_id_b
        FROM c JOIN n x ON x.canonical_id = c.a JOIN n y ON y.canonical_id = c.b
        WHERE both_ >= 0.6 * (x.n + y.n - both_)
    """,
    "p6_found": r"""
        SELECT DISTINCT s.canonical_id
        FROM symbols s LEFT JOIN index_metadata m ON s.workspace_id = m.workspace_id
        WHERE s.span_text IS NOT NULL
          AND len(regexp_extract_all(s.span_text, '[A-Za-z0-9_]+|[^ \t\n\r\f]')) > coalesce(m.chunk_size, 512)
    """,
}
