"""Queries over tables that went through a store, files, patches or JSON and came back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrata.functions import positions
from lodestrata.functions import text as tx
from lodestrata.plans.base import occurrences, query, symbols, with_ctes
from lodestrata.plans.graph import _edges
from lodestrata.runtime import shared_dir, table
from lodestrata.sources import files, patches, store


def _stored(spark, name, df, facts=None):
    """``df`` published as a build of a new store, then published again and read back from the second build."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store.publish(spark, root, {name: df.limit(0)}, {})
    store.publish(spark, root, {name: df}, facts)
    return store.Snapshot(spark, root)


@query(with_ctes("syms") + " SELECT canonical_id, display_name, kind, class, workspace_id, document_path, span_start, span_end, start_line, end_line, test_rule FROM syms")
def stored_symbols(spark, d):
    s = symbols(spark, d).select("canonical_id", "display_name", "kind", "class", "workspace_id", "document_path", "span_start", "span_end", "start_line", "end_line", "test_rule")
    return _stored(spark, "symbols", s).table("symbols")


@query(with_ctes("occs") + " SELECT id, symbol_id, document_path, span_start, span_end, role, rule, enclosing_id, locality FROM occs")
def stored_occurrences(spark, d):
    o = occurrences(spark, d).select("id", "symbol_id", "document_path", "span_start", "span_end", "role", "rule", "enclosing_id", "locality")
    return _stored(spark, "occurrences", o).table("occurrences")


@query(with_ctes("syms", "occs", "edges") + " SELECT kind, src, dst FROM edges")
def stored_edges(spark, d):
    e = _edges(spark, d)
    return _stored(spark, "edges", e.unionByName(e)).table("edges")


@query("SELECT DISTINCT id, symbol_id, render FROM semantic_corpus")
def stored_passages(spark, d):
    return _stored(spark, "semantic_corpus", table(spark, d, "semantic_corpus").select("id", "symbol_id", "render").distinct()).table("semantic_corpus")


@query("SELECT DISTINCT hash, passage_id, token_ordinal FROM clone_fingerprints WHERE hash IS NOT NULL")
def stored_fingerprints(spark, d):
    rows = table(spark, d, "clone_fingerprints").select("hash", "passage_id", "token_ordinal").where("hash IS NOT NULL").distinct()
    return _stored(spark, "clone_fingerprints", rows).table("clone_fingerprints")


@query("SELECT DISTINCT document_path, sha256(span_text) AS content_hash FROM symbols WHERE span_text IS NOT NULL")
def stored_source_files(spark, d):
    rows = files.hashed(table(spark, d, "symbols").where("span_text IS NOT NULL").select("document_path", F.col("span_text").alias("text"))).distinct()
    return _stored(spark, "source_files", rows).table("source_files")


@query("SELECT CAST(kgram AS BIGINT) AS kgram, CAST(\"window\" AS BIGINT) AS \"window\", CAST(workspaces AS BIGINT) AS workspaces FROM (SELECT max(fragment_kgram_length) AS kgram, max(fragment_window) AS \"window\", count(*) AS workspaces FROM index_metadata)")
def stored_metadata(spark, d):
    """Facts written with a build, read back from its manifest."""
    m = table(spark, d, "index_metadata").agg(F.max("fragment_kgram_length").alias("kgram"), F.max("fragment_window").alias("window"), F.count(F.lit(1)).alias("workspaces"))
    got = _stored(spark, "index_metadata", m, m.first().asDict()).facts
    return spark.createDataFrame([(got["kgram"], got["window"], got["workspaces"])], "kgram long, window long, workspaces long")


# --- files ----------------------------------------------------------------------

def _written(spark, df):
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    return path, df.write.mode("overwrite")


@query(with_ctes("syms") + " SELECT workspace_id, count(*) AS lines, CAST(sum(length(display_name)) AS BIGINT) AS characters FROM syms WHERE workspace_id IS NOT NULL GROUP BY 1")
def scanned_sources(spark, d):
    """Names written as text files by workspace, found again by a scan of the folder."""
    path, out = _written(spark, symbols(spark, d).where("workspace_id IS NOT NULL").select("workspace_id", "display_name"))
    out.partitionBy("workspace_id").text(path)
    found = files.scan_sources(spark, path, "txt").select(F.regexp_extract("document_path", "workspace_id=([^/]*)/", 1).alias("workspace_id"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return found.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("characters"))


@query(with_ctes("syms") + " SELECT display_name AS reference, count(*) AS n FROM syms GROUP BY 1")
def read_subjects(spark, d):
    """A list of subjects, blank lines and blanks around them left out."""
    path, out = _written(spark, symbols(spark, d).select(F.explode(F.array(F.concat(F.lit("  "), "display_name", F.lit(" ")), F.lit("   "))).alias("value")))
    out.text(path)
    return files.read_references(spark, path).groupBy("reference").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(user_id AS VARCHAR) AS instance_id, event_id AS attempt, event_type AS terminal_state, round(value, 6) AS value FROM events WHERE user_id % 2 = 0")
def read_trials(spark, d):
    """Trials of one arm out of exported JSON lines."""
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("instance_id"), F.when(F.col("user_id") % 2 == 0, "treatment").otherwise("baseline").alias("arm"), F.col("event_id").alias("attempt"), F.col("event_type").alias("terminal_state"), F.create_map(F.lit("value"), "value").alias("metrics"))
    path, out = _written(spark, rows)
    out.json(path)
    return files.read_trials(spark, path, "treatment").select("instance_id", "attempt", "terminal_state", F.round(F.col("metrics")["value"], 6).alias("value"))


@query("SELECT event_id, left(sha256(user_id || chr(31) || event_type || chr(31) || event_id), 24) AS trial FROM events")
def trial_keys(spark, d):
    return table(spark, d, "events").select("event_id", files.trial_key("user_id", "event_type", "event_id").alias("trial"))


@query(
    with_ctes("syms")
    + " SELECT workspace_id AS package, CASE WHEN test_rule IS NULL THEN 'lib' ELSE 'test' END AS kind, display_name AS name, '/srv/' || document_path AS root, '/srv/' || workspace_id || '/manifest' AS manifest FROM syms WHERE kind = 'module' AND document_path IS NOT NULL"
)
def build_targets(spark, d):
    """Targets out of build-metadata JSON, one object a workspace."""
    target = F.struct(F.array(F.when(F.col("test_rule").isNull(), "lib").otherwise("test")).alias("kind"), F.col("display_name").alias("name"), F.concat(F.lit("/srv/"), "document_path").alias("src_path"))
    per = symbols(spark, d).where("kind = 'module' AND document_path IS NOT NULL").groupBy("workspace_id").agg(F.collect_list(target).alias("targets"))
    package = F.struct(F.col("workspace_id").alias("name"), F.concat(F.lit("/srv/"), "workspace_id", F.lit("/manifest")).alias("manifest_path"), "targets")
    return files.build_targets(per.select(F.to_json(F.struct(F.array(package).alias("packages"))).alias("json")))


# --- patches --------------------------------------------------------------------

@query(
    with_ctes("occs")
    + """ SELECT CAST(id AS VARCHAR) AS patch_id, CASE WHEN id % 7 = 0 THEN 'deleted' WHEN id % 7 = 1 THEN 'added' ELSE 'modified' END AS kind,
        CASE WHEN id % 7 <> 1 THEN document_path || CASE WHEN id % 5 = 0 THEN chr(9) || 'x' ELSE '' END END AS before,
        CASE WHEN id % 7 <> 0 THEN document_path || CASE WHEN id % 5 = 0 THEN chr(9) || 'x' ELSE '' END END AS after,
        CAST(start_line AS INT) AS start, CAST(id % 4 AS INT) AS count FROM occs WHERE start_line IS NOT NULL AND document_path IS NOT NULL"""
)
def patch_regions(spark, d):
    """Unified diffs with quoted paths, additions, deletions and lines that look like headers, read as regions."""
    o = occurrences(spark, d).where("start_line IS NOT NULL AND document_path IS NOT NULL")
    quoted = F.col("id") % 5 == 0

    def path(prefix):
        plain = F.concat(F.lit(prefix), "document_path")
        return F.when(quoted, F.concat(F.lit('"'), plain, F.lit('\\tx"'))).otherwise(plain)

    n = (F.col("id") % 4).cast("int")
    old = F.when(F.col("id") % 7 == 1, F.lit("/dev/null")).otherwise(path("a/"))
    new = F.when(F.col("id") % 7 == 0, F.lit("/dev/null")).otherwise(path("b/"))
    header = F.concat(F.lit("diff --git "), path("a/"), F.lit(" "), path("b/"), F.lit("\n--- "), old, F.lit("\n+++ "), new)
    hunk = F.concat(F.lit("\n@@ -"), F.col("start_line").cast("int").cast("string"), F.when(n == 1, F.lit("")).otherwise(F.concat(F.lit(","), n.cast("string"))), F.lit(" +1 @@ fn\n"), F.repeat(F.lit("--- a/no\n"), n), F.lit("+++ b/header\n"))
    return patches.patch_regions(o.select(F.col("id").alias("patch_id"), F.concat(header, hunk).alias("text")))


# --- text -----------------------------------------------------------------------

@query(r"SELECT DISTINCT canonical_id, trim(regexp_replace(span_text, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) AS flat, CAST(len(string_split(span_text, chr(10))) AS INT) AS lines FROM symbols WHERE span_text IS NOT NULL")
def collapsed_texts(spark, d):
    """White space as single blanks, and the pieces between line ends."""
    rows = table(spark, d, "symbols").where("span_text IS NOT NULL").dropDuplicates(["canonical_id"])
    t = F.col("span_text")
    return rows.select("canonical_id", tx.collapse_whitespace(t).alias("flat"), F.size(tx.lines(t)).alias("lines"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents WHERE text IS NOT NULL)
    , b AS (SELECT *, length(line) AS n, octet_length(encode(line)) AS total, [octet_length(encode(substring(line, 1, 1))), octet_length(encode(substring(line, 1, 2))), octet_length(encode(substring(line, 1, 3)))] AS up, ['utf8', 'utf16', 'utf32'][(doc_id + no) % 3 + 1] AS encoding FROM l)
    , u AS (SELECT *, [up[1], up[2] - up[1], up[3] - up[2]] AS w FROM b)
    , v AS (SELECT *, CASE WHEN w[1] = 4 THEN 2 ELSE 1 END + CASE WHEN w[2] = 4 THEN 2 ELSE 1 END AS two FROM u)
    SELECT doc_id, CAST(no AS INT) AS line, encoding, CAST(CASE encoding
        WHEN 'utf32' THEN CASE WHEN n >= 3 THEN up[3] END
        WHEN 'utf8' THEN CASE WHEN total = 3 OR (total > 3 AND list_contains(up, 3)) THEN 3 END
        ELSE CASE WHEN n >= 2 AND two = 3 THEN up[2] WHEN n >= 3 AND two + CASE WHEN w[3] = 4 THEN 2 ELSE 1 END = 3 THEN up[3] END END AS INT) AS byte FROM v"""
)
def encoded_positions(spark, d):
    """The byte of the third place of every line, counted in bytes, UTF-16 units or characters."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    encoding = F.element_at(F.array(F.lit("utf8"), F.lit("utf16"), F.lit("utf32")), ((F.col("doc_id") + F.col("at") + 1) % 3 + 1).cast("int"))
    named = rows.select("doc_id", (F.col("at") + 1).alias("no"), encoding.alias("encoding"), "line")
    return named.select("doc_id", F.col("no").alias("line"), "encoding", positions.byte_of(F.col("line"), F.lit(3), F.col("encoding")).alias("byte"))


@query("SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN epoch_us(ts) / 1e6 WHEN 1 THEN event_id * 1.5 END, 6) AS seconds FROM events")
def epoch_seconds(spark, d):
    """Times out of text: ISO-8601, plain numbers, and what is neither."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.format_string("%.1f", F.col("event_id") * 1.5)).otherwise("soon")
    return table(spark, d, "events").select("event_id", F.round(tx.epoch_seconds(text), 6).alias("seconds"))


@query("SELECT max(semantic_model_identity) AS model, CAST(max(corpus_definition_version) AS BIGINT) AS corpus_version, CAST(max(chunk_size) AS BIGINT) AS chunk_size, CAST(max(chunk_overlap) AS BIGINT) AS chunk_overlap FROM index_metadata")
def stored_semantic_identity(spark, d):
    """What a build's vectors were made with, read back from its manifest."""
    m = table(spark, d, "index_metadata").agg(F.max("semantic_model_identity").alias("model"), F.max("corpus_definition_version").alias("corpus_version"), F.max("chunk_size").alias("chunk_size"), F.max("chunk_overlap").alias("chunk_overlap"))
    got = _stored(spark, "index_metadata", m, m.first().asDict()).semantic_identity()
    return spark.createDataFrame([tuple(got.values())], "model string, corpus_version long, chunk_size long, chunk_overlap long")


@query("SELECT sha256(string_agg(path || chr(31) || h, chr(10) ORDER BY path || chr(31) || h)) AS digest FROM (SELECT 'workspace_id=' || workspace_id AS path, sha256(string_agg(display_name || chr(10), '' ORDER BY display_name)) AS h FROM (SELECT DISTINCT canonical_id, display_name, workspace_id FROM symbols WHERE workspace_id IS NOT NULL) GROUP BY 1)")
def directory_digests(spark, d):
    """One digest of a folder's files, whose names are written without the parts that differ from run to run."""
    rows = symbols(spark, d).where("workspace_id IS NOT NULL").select("workspace_id", "display_name")
    one = rows.repartition("workspace_id").sortWithinPartitions("workspace_id", "display_name")
    path, out = _written(spark, one)
    out.partitionBy("workspace_id").text(path)
    return spark.createDataFrame([(files.directory_digest(spark, path, named=r"^(workspace_id=[^/]*)/part-.*$"),)], "digest string")
