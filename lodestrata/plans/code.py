"""Queries over clones, text, identities, status and retrieval of the index."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import text as tx
from lodestrata.operators import clones, graph, identity, impact, paging, retrieval, similarity, status, syntax
from lodestrata.operators.snapshots import normal_hash, normal_path
from lodestrata.plans.base import occurrences, query, symbols, with_ctes
from lodestrata.runtime import materialize, table

_KEYS = """WITH k AS (
    SELECT DISTINCT canonical_id, clone_substitution_key AS s, coalesce(lower(trim(clone_formatting_key)), '?' || canonical_id) AS f, clone_token_count AS n
    FROM symbols WHERE clone_substitution_key IS NOT NULL)"""


def _keys(spark, d):
    rows = table(spark, d, "symbols").select("canonical_id", F.col("clone_substitution_key").alias("substitution_key"), F.lower(F.trim("clone_formatting_key")).alias("formatting_key"), F.col("clone_token_count").alias("token_count"))
    return rows.dropDuplicates(["canonical_id"])


@query(
    _KEYS
    + """, sets AS (SELECT s, f, min(canonical_id) AS first_, count(*) AS n, max(n) AS tokens FROM k GROUP BY 1, 2)
    , groups AS (SELECT s, min(first_) AS group_id, sum(n) AS members, count(*) AS sets, max(tokens) AS token_count FROM sets GROUP BY 1 HAVING sum(n) > 1)
    , numbered AS (SELECT s, f, row_number() OVER (PARTITION BY s ORDER BY first_) - 1 AS exact_set FROM sets)
    SELECT g.group_id, k.canonical_id, CAST(g.members AS BIGINT) AS members, g.token_count, CAST(n.exact_set AS INT) AS exact_set, g.sets = 1 AS exact
    FROM k JOIN groups g ON g.s = k.s JOIN numbered n ON n.s = k.s AND n.f = k.f"""
)
def clone_groups(spark, d):
    return clones.clone_groups(_keys(spark, d))


@query(
    _KEYS
    + """, n AS (SELECT s, count(*) AS members, max(n) AS tokens, min(canonical_id) AS first_ FROM k GROUP BY 1 HAVING count(*) > 1)
    SELECT first_ AS group_id, members, tokens AS token_count, CAST(row_number() OVER (ORDER BY tokens DESC, members DESC, first_) AS INT) AS place FROM n ORDER BY place LIMIT 50"""
)
def largest_clone_groups(spark, d):
    groups = _keys(spark, d).where("substitution_key IS NOT NULL").groupBy("substitution_key").agg(F.count(F.lit(1)).alias("members"), F.max("token_count").alias("token_count"), F.min("canonical_id").alias("group_id")).where("members > 1")
    top = groups.select("group_id", "members", "token_count").orderBy(F.col("token_count").desc(), F.col("members").desc(), "group_id").limit(50)
    w = Window.orderBy(F.col("token_count").desc(), F.col("members").desc(), "group_id")  # 50 rows
    return top.withColumn("place", F.row_number().over(w))


@query(
    """WITH f AS (SELECT DISTINCT hash, passage_id, token_ordinal FROM clone_fingerprints WHERE hash IS NOT NULL AND passage_id IS NOT NULL)
    , per AS (SELECT hash, passage_id, count(*) AS n FROM f GROUP BY 1, 2)
    SELECT x.passage_id AS passage_a, y.passage_id AS passage_b, CAST(sum(x.n * y.n) AS BIGINT) AS seeds, sum(x.n * y.n) <= 1000000 AS compared
    FROM per x JOIN per y ON y.hash = x.hash AND x.passage_id < y.passage_id GROUP BY 1, 2"""
)
def fragment_seeds(spark, d):
    return clones.fragment_seeds(table(spark, d, "clone_fingerprints"))


@query()
def clone_keys(spark, d):
    return clones.keyed(table(spark, d, "symbols"))


@query()
def fingerprints(spark, d):
    return clones.fingerprints(table(spark, d, "symbols"))


_WORDS = r"""list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace({c}, '[^\p{L}\p{N}]+', ' ', 'g'),
        '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), ' +'), lambda x: x <> '')"""


@query(with_ctes("syms") + " SELECT canonical_id, " + _WORDS.replace("{c}", "display_name") + " AS words FROM syms")
def name_words(spark, d):
    return symbols(spark, d).select("canonical_id", tx.split_words(F.col("display_name")).alias("words"))


@query(
    with_ctes("syms")
    + r""" SELECT canonical_id, regexp_replace(canonical_id, '^[^:]*::', '') AS qualified, regexp_replace(canonical_id, '#[0-9]+$', '') AS bare,
        list_contains(string_split(document_path, '/')[:-2], 'tests') AS in_tests,
        regexp_matches(document_path, '(^|/)(test_[^/]*\.py|[^/]*_test\.py|tests\.py|conftest\.py)$') AS test_file,
        document_path LIKE '%.py' AND NOT regexp_matches(document_path, '(^|/)(\.[^/]*|target|venv)/') AS discovered
        FROM syms WHERE document_path IS NOT NULL"""
)
def path_predicates(spark, d):
    p, i = F.col("document_path"), F.col("canonical_id")
    rows = symbols(spark, d).where(p.isNotNull())
    return rows.select("canonical_id", tx.without_workspace(i).alias("qualified"), tx.without_rank(i).alias("bare"), tx.in_tests_directory(p).alias("in_tests"), tx.is_python_test_file(p).alias("test_file"), tx.is_discovered(p, "py").alias("discovered"))


@query(
    r"""WITH t AS (SELECT DISTINCT canonical_id, span_text AS x, string_split(span_text, chr(10)) AS l FROM symbols WHERE span_text IS NOT NULL)
    SELECT canonical_id, CASE WHEN len(l) > 10 THEN array_to_string(l[:10], chr(10)) ELSE x END AS head, len(l) > 10 AS truncated,
           CASE WHEN len(l) >= 5 THEN array_to_string(l[5:9], chr(10)) ELSE '' END AS part, CAST(len(l) AS INT) AS total,
           substring(x, 1, 200) AS quoted, length(x) > 200 AS cut FROM t"""
)
def content_windows(spark, d):
    t = F.col("span_text")
    rows = table(spark, d, "symbols").where(t.isNotNull()).dropDuplicates(["canonical_id"])
    head, part, quoted = tx.cap_lines(t, 10), tx.window_lines(t, 5, 5), tx.shorten(t)
    return rows.select("canonical_id", head["text"].alias("head"), head["truncated"].alias("truncated"), part["text"].alias("part"), part["total"].alias("total"), quoted["text"].alias("quoted"), quoted["cut"].alias("cut"))


@query(
    r"""WITH t AS (SELECT DISTINCT canonical_id, span_text AS x, length(span_text) // 2 AS o FROM symbols WHERE span_text IS NOT NULL)
    , b AS (SELECT canonical_id, o, CASE WHEN substring(x, o, 1) = chr(13) AND substring(x, o + 1, 1) = chr(10) THEN substring(x, 1, o - 1) ELSE substring(x, 1, o) END AS pre,
            substring(x, o, 1) = chr(13) AND substring(x, o + 1, 1) = chr(10) AS pair FROM t)
    SELECT canonical_id, CAST(o AS BIGINT) AS at, CAST(len(string_split_regex(pre, '\r\n|\r|\n')) AS INT) AS line,
           CAST(length(string_split_regex(pre, '\r\n|\r|\n')[-1]) + 1 + CASE WHEN pair THEN 1 ELSE 0 END AS INT) AS "column" FROM b"""
)
def line_columns(spark, d):
    rows = table(spark, d, "symbols").where("span_text IS NOT NULL").dropDuplicates(["canonical_id"]).withColumn("at", F.floor(F.length("span_text") / 2).cast("int"))
    place = tx.line_column(F.col("span_text"), F.col("at"))
    return rows.select("canonical_id", F.col("at").cast("bigint").alias("at"), place["line"].alias("line"), place["column"].alias("column"))


@query(
    r"""SELECT doc_id, regexp_replace(text, '[\x00-\x1f\x7f-\x{9f}\x{202A}-\x{202E}\x{2066}-\x{2069}]', chr(65533), 'g') AS clean,
        CAST(len(regexp_split_to_array(text, '[.!?]\s')) AS INT) AS pieces FROM documents WHERE text IS NOT NULL"""
)
def cleaned_texts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull()).select("doc_id", tx.sanitize(t).alias("clean"), F.size(tx.sentence_cuts(t)).alias("pieces"))


@query(
    with_ctes("syms")
    + """, b AS (SELECT canonical_id, document_path, span_start, display_name || '@' || coalesce(document_path, '') AS base FROM syms)
    SELECT canonical_id, CASE WHEN count(*) OVER (PARTITION BY base) = 1 THEN base
        ELSE base || '#' || (row_number() OVER (PARTITION BY base ORDER BY span_start NULLS FIRST, canonical_id) - 1) END AS identity FROM b"""
)
def disambiguated(spark, d):
    rows = symbols(spark, d).withColumn("base", F.concat("display_name", F.lit("@"), F.coalesce("document_path", F.lit(""))))
    return identity.disambiguate(rows, "base", [F.col("span_start").asc_nulls_first(), F.col("canonical_id")]).select("canonical_id", "identity")


@query(with_ctes("occs") + " SELECT v AS rule, count(o.id) AS count FROM (SELECT unnest(['exact','crate_root','operator_desugar','module_span','self_keyword','module_name','self_name','module_marker','import_alias','range_literal','use_list_self','super_keyword']) AS v) LEFT JOIN occs o ON o.rule = v GROUP BY 1")
def alignment_counts(spark, d):
    return status.counted_by(occurrences(spark, d), "rule", status.ALIGNMENT_RULES)


@query(
    with_ctes("occs")
    + """ SELECT role, rule, count(*) AS occurrences, count(DISTINCT document_path) AS documents, min(id) AS first_id FROM occs GROUP BY 1, 2"""
)
def occurrence_summary(spark, d):
    return status.summary_with_exemplar(occurrences(spark, d), ["role", "rule"], "document_path", [F.col("id")], ["id"], None)


@query(
    with_ctes("syms")
    + " SELECT display_name, kind, count(*) AS members, min(canonical_id) AS first_id FROM syms WHERE class = 'in_workspace' GROUP BY 1, 2 HAVING count(*) > 1"
)
def duplicate_symbols(spark, d):
    return status.duplicated(symbols(spark, d).where("class = 'in_workspace'"), ["display_name", "kind"])


_CLEAN = r"""WITH files AS (
    SELECT workspace_id, snapshot_no, p AS document_path, arg_max(h, (coalesce(delivered_at, TIMESTAMP '1900-01-01'), coalesce(h, ''))) AS hash FROM (
        SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(document_path), chr(92), '/'), '/(\./)+', '/', 'g'), '^(\./)+', ''), '/+', '/', 'g'), '^(\./)+', '') AS p,
               coalesce(nullif(regexp_extract(lower(content_hash), '([0-9a-f]{64})\s*$', 1), ''), '-') AS h FROM source_files) WHERE p <> '' GROUP BY 1, 2, 3)"""


def _files(spark, d):
    rows = table(spark, d, "source_files")
    rows = rows.select("workspace_id", F.col("snapshot_no").cast("int").alias("snapshot_no"), normal_path(F.col("document_path")).alias("document_path"), F.coalesce(normal_hash(F.col("content_hash")), F.lit("-")).alias("hash"), "delivered_at").where("document_path IS NOT NULL")
    return rows.groupBy("workspace_id", "snapshot_no", "document_path").agg(F.max(F.struct("delivered_at", "hash")).alias("m")).select("workspace_id", "snapshot_no", "document_path", F.col("m.hash").alias("hash"))


@query(
    _CLEAN
    + """, seen AS (SELECT DISTINCT workspace_id, snapshot_no FROM files)
    , a AS (SELECT f.workspace_id, f.snapshot_no + 1 AS snapshot_no, f.document_path, f.hash FROM files f JOIN seen s ON s.workspace_id = f.workspace_id AND s.snapshot_no = f.snapshot_no + 1)
    , b AS (SELECT f.* FROM files f JOIN seen s ON s.workspace_id = f.workspace_id AND s.snapshot_no = f.snapshot_no - 1)
    SELECT coalesce(a.workspace_id, b.workspace_id) AS workspace_id, coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no, coalesce(a.document_path, b.document_path) AS document_path,
        CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM a FULL JOIN b ON a.workspace_id = b.workspace_id AND a.snapshot_no = b.snapshot_no AND a.document_path = b.document_path
        WHERE a.hash IS DISTINCT FROM b.hash"""
)
def file_differences(spark, d):
    """What differs between each two neighbouring numbers of a workspace's snapshots, whatever their state."""
    files = materialize(_files(spark, d), "files")
    seen = files.select("workspace_id", "snapshot_no").distinct()
    later = files.withColumn("snapshot_no", F.col("snapshot_no") + 1).join(seen, ["workspace_id", "snapshot_no"], "left_semi")
    former = files.join(seen.withColumn("snapshot_no", F.col("snapshot_no") + 1), ["workspace_id", "snapshot_no"], "left_semi")
    return status.file_differences(later, former, ["workspace_id", "snapshot_no", "document_path"], "hash")


@query(
    """WITH m AS (SELECT *, min(analyzer_version) OVER () AS v FROM index_metadata)
    SELECT workspace_id, CASE WHEN text_mismatch_count % 3 = 0 THEN 'stale_content' WHEN analyzer_version <> v THEN 'stale_version' WHEN workspace_root IS NULL THEN 'stale_environment' ELSE 'fresh' END AS state,
        CAST((text_mismatch_count % 3 = 0)::INT + (analyzer_version <> v)::INT + (workspace_root IS NULL)::INT AS INT) AS reasons FROM m"""
)
def freshness(spark, d):
    m = table(spark, d, "index_metadata")
    oldest = m.agg(F.min("analyzer_version").alias("oldest"))
    side = m.select("workspace_id", F.col("content_hash").alias("content"), F.col("analyzer_version").alias("version"), F.col("workspace_root").alias("environment"))
    now = m.crossJoin(F.broadcast(oldest)).select("workspace_id", F.when(F.col("text_mismatch_count") % 3 == 0, "other").otherwise(F.col("content_hash")).alias("content"), F.col("oldest").alias("version"), F.coalesce("workspace_root", F.lit("unknown")).alias("environment"))
    return status.stale_reasons(side, now, "workspace_id").select("workspace_id", "state", F.size("reasons").alias("reasons"))


_PART = "printf('%02x', octet_length(encode({c})) % 256) || printf('%02x', octet_length(encode({c})) // 256) || '000000000000' || hex(encode({c}))"


@query(
    _CLEAN
    + " SELECT workspace_id || '/' || snapshot_no AS \"group\", sha256(unhex(string_agg(" + _PART.format(c="document_path") + " || " + _PART.format(c="hash") + ", '' ORDER BY document_path))) AS digest FROM files GROUP BY 1"
)
def content_digest(spark, d):
    rows = _files(spark, d).withColumn("group", F.concat("workspace_id", F.lit("/"), "snapshot_no"))
    return status.content_digest(rows, "group", "document_path", "hash")


@query(
    """SELECT (SELECT count(DISTINCT canonical_id) FROM symbols) AS symbols, (SELECT count(DISTINCT id) FROM semantic_corpus) AS passages,
        (SELECT count(DISTINCT id) FROM occurrences) AS occurrences, (SELECT sum(text_mismatch_count) FROM index_metadata) AS text_mismatch"""
)
def index_status(spark, d):
    n = lambda t, c: table(spark, d, t).agg(F.countDistinct(c).alias("n"))
    mismatch = table(spark, d, "index_metadata").agg(F.sum("text_mismatch_count").alias("text_mismatch"))
    out = n("symbols", "canonical_id").withColumnRenamed("n", "symbols").crossJoin(n("semantic_corpus", "id").withColumnRenamed("n", "passages"))
    return out.crossJoin(n("occurrences", "id").withColumnRenamed("n", "occurrences")).crossJoin(mismatch)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_offset(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    asked = paging.query_identity("orders", {"limit": 25}, "-")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return paging.offset_page(rows, order, 25, asked, paging.encode_cursor(asked, 2)).rows


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25)) ORDER BY o_orderkey LIMIT 25")
def page_keyset(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    asked = paging.query_identity("orders", {"limit": 25}, "-")
    first = paging.keyset_page(rows, "o_orderkey", 25, asked)
    return paging.keyset_page(rows, "o_orderkey", 25, asked, first.cursor).rows


_BM25 = (
    "WITH w AS (SELECT id, unnest(" + _WORDS.replace("{c}", "render") + """) AS word FROM (SELECT DISTINCT id, render FROM semantic_corpus WHERE render IS NOT NULL))
    , p AS (SELECT id, word, count(*) AS tf FROM w GROUP BY 1, 2), len_ AS (SELECT id, sum(tf) AS l FROM p GROUP BY 1)
    , tot AS (SELECT count(*) AS n, avg(l) AS a FROM len_), df AS (SELECT word, count(*) AS df FROM p GROUP BY 1)
    , q AS (SELECT DISTINCT id AS query, word FROM p WHERE id % 20 = 0)
    , s AS (
        SELECT q.query, p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score
        FROM q JOIN p ON p.word = q.word JOIN df ON df.word = q.word JOIN len_ ON len_.id = p.id CROSS JOIN tot GROUP BY 1, 2
    ), r AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM s WHERE query <> id)"""
)


def _lexical(spark, d, most=10, subjects=None):
    passages = table(spark, d, "semantic_corpus").select("id", "render").dropDuplicates(["id"])
    index = materialize(retrieval.postings(passages, "id", "render"), "postings")
    asked = index.where("id % 20 = 0") if subjects is None else index.join(subjects, "id", "left_semi")
    asked = asked.select(F.col("id").alias("query"), "word")
    scored = retrieval.top_lexical(index, asked, retrieval.corpus_totals(index, "id"), most)
    return retrieval.ranked(scored.withColumn("score", F.round("score", 9)), "query", "id", F.col("score").desc(), most)


@query(_BM25 + " SELECT query, id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def search_lexical(spark, d):
    return _lexical(spark, d)


_NEAR = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
    , n AS (SELECT a.id AS query, b.id, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.id <> b.id WHERE {q})
    , r AS (SELECT query, id, distance, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM n)"""


def _passage_vectors(spark, d):
    """The given vectors as those of the passages, whose ids start at 1000."""
    return _vectors(spark, d).withColumn("id", F.col("id") + 1000)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query(_NEAR.format(q="a.id % 20 = 0") + " SELECT query, id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def search_vectors(spark, d):
    v = _vectors(spark, d)
    return retrieval.nearest(v.where("id % 20 = 0"), v, 10).select("query", "id", F.round("distance", 6).alias("distance"), "rank")


@query(_NEAR.format(q="TRUE") + " SELECT x.query AS a, x.id AS b FROM r x JOIN r y ON y.query = x.id AND y.id = x.query WHERE x.rank = 1 AND y.rank = 1 AND x.query < x.id")
def mutual_pairs(spark, d):
    v = _vectors(spark, d)
    return retrieval.mutual_pairs(retrieval.nearest(v, v, 1).where("rank = 1").select("query", "id"))


@query(
    _NEAR.format(q="a.id % 20 = 0")
    + """, p AS (SELECT r.query, l.label, min(r.distance) AS distance FROM r JOIN (SELECT vec_id, label FROM embeddings) l ON l.vec_id = r.id WHERE r.rank <= 4096 GROUP BY 1, 2)
    SELECT query, CAST(label AS BIGINT) AS passage, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, label) AS INT) AS rank FROM p"""
)
def best_chunks(spark, d):
    v = _vectors(spark, d)
    # of the neighbours a search gives, at its farthest rank
    near = retrieval.nearest(v.where("id % 20 = 0"), v, retrieval.MOST_NEIGHBOURS)
    labelled = near.join(v.select("id", F.col("label").cast("long").alias("passage")), "id")
    best = labelled.groupBy("query", "passage").agg(F.min("distance").alias("distance"))
    return retrieval.ranked(best, "query", "passage", F.col("distance"), retrieval.MOST_NEIGHBOURS)


@query(
    _BM25
    + """, e AS (SELECT vec_id + 1000 AS id, embedding::DOUBLE[] AS v FROM embeddings)
    , n AS (SELECT a.id AS query, b.id, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 20 = 0)
    , both_ AS (SELECT query, id, 1.0 / (60 + rank) AS part FROM r WHERE rank <= 10 UNION ALL SELECT query, id, 1.0 / (60 + rank) FROM n WHERE rank <= 10)
    , f AS (SELECT query, id, round(sum(part), 15) AS score FROM both_ GROUP BY 1, 2)
    SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INT) AS place FROM f"""
)
def search_fused(spark, d):
    """Both signals fused: the words of passages, and the given vectors as theirs."""
    v = _passage_vectors(spark, d)
    near = retrieval.nearest(v.where("id % 20 = 0"), v, 10)
    return retrieval.fuse(_lexical(spark, d), near.select("query", "id", "rank"))


@query(
    _BM25
    + ", "
    + with_ctes("syms", "occs", "edges").removeprefix("WITH ")
    + """, c AS (SELECT DISTINCT id, symbol_id FROM semantic_corpus)
    , near_ AS (SELECT x.symbol_id AS subject, y.symbol_id AS candidate FROM r JOIN c x ON x.id = r.query JOIN c y ON y.id = r.id WHERE r.rank <= 10)
    SELECT subject, candidate, list_filter([
        CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = candidate AND e.dst = subject) THEN 'uses_subject' END,
        CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.dst = candidate AND e.src = subject) THEN 'used_by_subject' END,
        CASE WHEN EXISTS (SELECT 1 FROM edges e JOIN syms s ON s.canonical_id = e.src WHERE e.src = candidate AND e.dst = subject AND s.test_rule IS NOT NULL) THEN 'tests_subject' END,
        CASE WHEN subject <> candidate AND EXISTS (SELECT 1 FROM syms s WHERE s.canonical_id = subject AND s.kind IN ('type', 'trait')) AND EXISTS (SELECT 1 FROM syms s WHERE s.canonical_id = candidate AND s.kind IN ('type', 'trait')) AND (
            EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'type_hierarchy' AND ((e.src = candidate AND e.dst = subject) OR (e.dst = candidate AND e.src = subject)))
            OR EXISTS (SELECT 1 FROM edges e JOIN edges f ON f.dst = e.dst JOIN syms u ON u.canonical_id = e.dst WHERE e.kind = 'type_hierarchy' AND f.kind = 'type_hierarchy' AND e.src = subject AND f.src = candidate AND u.class = 'in_workspace')) THEN 'type_family' END
    ], lambda x: x IS NOT NULL) AS labels FROM near_"""
)
def similar_labels(spark, d):
    ids = table(spark, d, "semantic_corpus").select("id", "symbol_id").dropDuplicates(["id"])
    near = _lexical(spark, d)
    pairs = near.join(ids.select(F.col("id").alias("query"), F.col("symbol_id").alias("subject")), "query").join(ids.select("id", F.col("symbol_id").alias("candidate")), "id").select("subject", "candidate")
    known = symbols(spark, d)
    return similarity.labelled(pairs, graph.reference_edges(occurrences(spark, d), known), known)


@query()
def syntax_facts(spark, d):
    rows = table(spark, d, "symbols").where("span_text IS NOT NULL").dropDuplicates(["canonical_id"])
    files = rows.select(F.concat("canonical_id", F.lit("/"), "document_path").alias("document_path"), F.col("span_text").alias("text"))
    return syntax.extract(files)


@query(
    with_ctes("syms")
    + r""", t AS (SELECT DISTINCT canonical_id, signature_text, span_text FROM symbols)
    SELECT s.canonical_id, array_to_string("""
    + _WORDS.replace("{c}", "s.display_name")
    + r""", ' ') || chr(10) || s.kind || CASE WHEN m = '' THEN '' ELSE chr(10) || m END || CASE WHEN t.signature_text IS NULL THEN '' ELSE chr(10) || t.signature_text END
        || chr(10) || 'Notes on ' || s.display_name || CASE WHEN s.kind IN ('type', 'module', 'trait') THEN chr(10) || coalesce(t.signature_text || chr(10), '') || 'Notes on ' || s.display_name ELSE chr(10) || t.span_text END AS render
    FROM syms s JOIN t ON t.canonical_id = s.canonical_id
    CROSS JOIN LATERAL (SELECT array_to_string("""
    + _WORDS.replace("{c}", "array_to_string(string_split(regexp_replace(s.canonical_id, '#[0-9]+$', ''), '::')[2:-2], ' ')")
    + """, ' ') AS m) WHERE t.span_text IS NOT NULL"""
)
def passage_renders(spark, d):
    # an interface is the signature and what is said about it
    notes = F.concat_ws("\n", "signature_text", F.concat(F.lit("Notes on "), "display_name"))
    rows = symbols(spark, d, "signature_text", "span_text").withColumn("interface_text", notes)
    return similarity.passages(rows)


_REGIONS = """, regions AS (
        SELECT id AS region_id, document_path, greatest(start_line, 1) AS line, id % 4 = 0 AS ins, greatest(id % 4, 1) AS n FROM occs WHERE start_line IS NOT NULL)
    , met AS (SELECT r.*, s.canonical_id, s.start_line AS a, s.end_line AS z FROM regions r JOIN syms s ON s.document_path = r.document_path AND s.start_line < r.line + r.n AND r.line <= s.end_line
        WHERE NOT (r.ins AND s.end_line = r.line))
    , hit AS (SELECT region_id, canonical_id, CASE WHEN a = line AND z = line + n - 1 AND NOT ins THEN 'exact' ELSE 'approximate' END AS grade FROM met x
        WHERE NOT EXISTS (SELECT 1 FROM met y WHERE y.region_id = x.region_id AND x.a <= y.a AND y.z <= x.z AND (x.a < y.a OR y.z < x.z)))"""


def _regions(spark, d):
    """Every place of an occurrence as a changed region: insertions, and changes of one to three lines."""
    o = occurrences(spark, d).where("start_line IS NOT NULL")
    return o.select(F.col("id").alias("region_id"), "document_path", F.col("start_line").cast("int").alias("start"), (F.col("id") % 4).cast("int").alias("count"))


@query(with_ctes("syms", "occs") + _REGIONS + " SELECT region_id, canonical_id, grade FROM hit")
def impact_seeds(spark, d):
    return impact.seeds_of_regions(_regions(spark, d), symbols(spark, d))


@query(
    with_ctes("syms", "occs", "edges", recursive=True)
    + _REGIONS
    + """, seeds AS (SELECT DISTINCT canonical_id AS node FROM hit), links AS (SELECT DISTINCT dst AS at, src AS next FROM edges)
    , walk AS (SELECT node, node AS root, 0 AS d FROM seeds UNION SELECT l.next, w.root, w.d + 1 FROM walk w JOIN links l ON l.at = w.node WHERE w.d < 20)
    SELECT node, CAST(min(d) AS INT) AS distance FROM walk WHERE node <> root GROUP BY 1"""
)
def impact_dependents(spark, d):
    known = symbols(spark, d)
    return impact.impact(_regions(spark, d), known, graph.reference_edges(occurrences(spark, d), known))[1].select("node", "distance")


#: Subjects are passages with vectors: each twentieth of them, or all.
_FULL_ALL = (
    _BM25.replace("WHERE id % 20 = 0)", "WHERE id IN (SELECT vec_id + 1000 FROM embeddings))").replace("SELECT DISTINCT id, render FROM semantic_corpus", "SELECT id, min(render) AS render FROM semantic_corpus", 1).replace("WHERE render IS NOT NULL)", "WHERE render IS NOT NULL GROUP BY 1)", 1)
    + """, e AS (SELECT vec_id + 1000 AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id + 1000 IN (SELECT id FROM semantic_corpus))
    , n AS (SELECT a.id AS query, b.id, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM e a JOIN e b ON a.id <> b.id WHERE a.id IN (SELECT query FROM q))
    , parts AS (SELECT query, id, 1.0 / (60 + rank) AS part FROM r UNION ALL SELECT query, id, 1.0 / (60 + rank) FROM n WHERE rank <= 4096)
    , f AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(sum(part), 15) DESC, id) AS place FROM parts GROUP BY 1, 2)
    , k AS (SELECT c.id, min(s.clone_formatting_key) AS fk, min(s.clone_substitution_key) AS sk FROM semantic_corpus c JOIN symbols s ON s.canonical_id = c.symbol_id GROUP BY 1)
    , m AS (SELECT f.query, f.id, f.place, CASE WHEN x.sk = y.sk AND x.fk IS NOT DISTINCT FROM y.fk THEN 'exact' WHEN x.sk = y.sk THEN 'variant' END AS certainty FROM f LEFT JOIN k x ON x.id = f.query LEFT JOIN k y ON y.id = f.id)
    , o AS (SELECT query, id, certainty, row_number() OVER (PARTITION BY query ORDER BY CASE certainty WHEN 'exact' THEN 0 WHEN 'variant' THEN 1 ELSE 2 END, place) AS place FROM m)"""
)
_FULL = _FULL_ALL.replace("WHERE id IN (SELECT vec_id + 1000 FROM embeddings))", "WHERE id % 20 = 0 AND id IN (SELECT vec_id + 1000 FROM embeddings))")


def _signals(spark, d, subjects: str):
    """(both signals over all passages, keys of clones); subjects are the passages with vectors that ``subjects`` picks."""
    ids = table(spark, d, "semantic_corpus").select("id").distinct()
    v = materialize(_passage_vectors(spark, d).join(ids, "id", "left_semi"), "vectors")
    asked = v.where(subjects)
    near = retrieval.nearest(asked, v, retrieval.MOST_NEIGHBOURS).select("query", "id", "rank")
    words = _lexical(spark, d, 2**31 - 1, asked.select("id"))
    known = table(spark, d, "symbols").groupBy("canonical_id").agg(F.min("clone_formatting_key").alias("formatting_key"), F.min("clone_substitution_key").alias("substitution_key"))
    ids = table(spark, d, "semantic_corpus").select("id", "symbol_id").dropDuplicates(["id"])
    keys = ids.join(known, ids.symbol_id == known.canonical_id).select("id", "formatting_key", "substitution_key")
    return [words, near], keys


@query(_FULL + " SELECT query, id, CAST(place AS INT) AS place, certainty FROM o WHERE place <= 25")
def similar_ranked(spark, d):
    signals, keys = _signals(spark, d, "id % 20 = 0")
    return similarity.certain_first(retrieval.fuse(*signals), keys).where("place <= 25")


@query(_FULL_ALL + " SELECT x.query AS a, x.id AS b FROM o x JOIN o y ON y.query = x.id AND y.id = x.query WHERE x.place = 1 AND y.place = 1 AND x.query < x.id")
def mutual_similar(spark, d):
    """All passages with vectors that are each other's first row by both signals and certainty."""
    signals, keys = _signals(spark, d, "true")
    return retrieval.mutual_pairs(similarity.first_rows(retrieval.fused_scores(*signals), keys))


@query(
    _BM25
    + ", "
    + with_ctes("syms", "occs", "edges").removeprefix("WITH ")
    + """, c AS (SELECT DISTINCT id, symbol_id FROM semantic_corpus)
    , near_ AS (SELECT DISTINCT x.symbol_id AS subject, y.symbol_id AS candidate FROM r JOIN c x ON x.id = r.query JOIN c y ON y.id = r.id WHERE r.rank <= 10)
    SELECT subject, candidate FROM near_ WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = candidate AND e.dst = subject) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = candidate AND e.src = subject)"""
)
def similar_unrelated(spark, d):
    """Similar symbols without those that use the subject or are used by it."""
    return similarity.exclude(similar_labels(spark, d), ["uses_subject", "used_by_subject"]).select("subject", "candidate").distinct()
