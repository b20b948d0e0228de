"""Queries that ask an index as its users do, and over what answers carry beside their rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrata.api import EVERY, Index
from lodestrata.functions import text as tx
from lodestrata.operators import clones, experiment, intervals, references, status, units
from lodestrata.plans import building
from lodestrata.plans.base import occurrences, query, symbols, with_ctes
from lodestrata.plans.code import _keys
from lodestrata.plans.graph import _edges
from lodestrata.plans.trials import _TRIALS, _trials
from lodestrata.runtime import materialize, shared_dir, table

#: The symbol with most references, the least id among equals; and the same for Spark.
_SUBJECT = ", refs AS (SELECT symbol_id, count(*) AS n FROM occs WHERE role = 'reference' GROUP BY 1), me AS (SELECT symbol_id AS me FROM refs JOIN syms ON canonical_id = symbol_id AND class = 'in_workspace' ORDER BY n DESC, symbol_id LIMIT 1)"


def _subject(spark, d) -> str:
    refs = occurrences(spark, d).where("role = 'reference'").groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n"))
    known = symbols(spark, d).where("class = 'in_workspace'").select(F.col("canonical_id").alias("symbol_id"))
    return refs.join(known, "symbol_id", "left_semi").orderBy(F.col("n").desc(), "symbol_id").first().symbol_id


def _index(spark, d) -> Index:
    rows = symbols(spark, d, "span_text", "signature_text", "clone_substitution_key", "clone_formatting_key", "clone_token_count")
    edges = _edges(spark, d).unionByName(building._holds(spark, d).select("kind", "src", "dst"))
    return Index(rows, edges, occurrences(spark, d), table(spark, d, "semantic_corpus").select("id", "symbol_id", "render").distinct())


@query(
    with_ctes("syms", "occs")
    + _SUBJECT
    + """, t AS (SELECT canonical_id, min(span_text) AS x FROM symbols GROUP BY 1) SELECT s.canonical_id, s.kind, s.document_path, s.start_line, array_to_string(string_split(t.x, chr(10))[2:6], chr(10)) AS content
    FROM syms s JOIN me ON s.canonical_id = me JOIN t ON t.canonical_id = me"""
)
def asked_get(spark, d):
    """Lines 2 to 6 of a symbol's body."""
    rows = _index(spark, d).get(_subject(spark, d), "body", start=2, lines=5).rows
    return rows.select("canonical_id", "kind", "document_path", "start_line", F.col("content.text").alias("content"))


@query(with_ctes("syms", "occs") + _SUBJECT + " SELECT canonical_id, display_name, kind FROM syms WHERE contains(lower(display_name), (SELECT left(lower(display_name), 4) FROM syms JOIN me ON canonical_id = me))")
def asked_find(spark, d):
    i = _index(spark, d)
    name = i.symbols.where(F.col("canonical_id") == _subject(spark, d)).first().display_name
    return i.find(name[:4].upper(), limit=EVERY)


@query(with_ctes("syms", "occs") + _SUBJECT + " SELECT id, document_path, span_start FROM occs JOIN me ON symbol_id = me WHERE role = 'reference'")
def asked_references(spark, d):
    return _index(spark, d).trace(_subject(spark, d), "references").rows.select("id", "document_path", "span_start")


@query(
    with_ctes("syms", "occs", "edges", recursive=True)
    + _SUBJECT
    + """, walk AS (SELECT me AS node, 0 AS d FROM me UNION SELECT e.src, w.d + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.d < 3)
    SELECT node, CAST(min(d) AS INT) AS distance FROM walk WHERE node NOT IN (SELECT me FROM me) GROUP BY 1"""
)
def asked_dependents(spark, d):
    """All that depends on a symbol within three hops."""
    return _index(spark, d).trace(_subject(spark, d), "dependents", depth=3, ranked=False).rows.select("node", "distance")


@query(
    with_ctes("syms", "occs")
    + building._HOLDS
    + ", first_ AS (SELECT src, count(*) AS n FROM holds GROUP BY 1 ORDER BY n DESC, src LIMIT 1) SELECT h.dst AS node FROM holds h JOIN first_ f ON f.src = h.src"
)
def asked_contains(spark, d):
    per = building._holds(spark, d).groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "src").first()
    return _index(spark, d).trace(per.src, "contains").rows


@query(
    with_ctes("syms", "occs")
    + """, k AS (SELECT canonical_id, min(clone_substitution_key) AS s FROM symbols WHERE clone_substitution_key IS NOT NULL GROUP BY 1), g AS (SELECT s, min(canonical_id) AS me FROM k GROUP BY 1 HAVING count(*) > 1 ORDER BY count(*) DESC, me LIMIT 1)
    SELECT k.canonical_id FROM k JOIN g ON g.s = k.s WHERE k.canonical_id <> g.me"""
)
def asked_clones(spark, d):
    """The clones of one symbol."""
    i = _index(spark, d)
    keys = i.symbols.where("clone_substitution_key IS NOT NULL")
    me = keys.groupBy("clone_substitution_key").agg(F.count(F.lit(1)).alias("n"), F.min("canonical_id").alias("me")).where("n > 1").orderBy(F.col("n").desc(), "me").first().me
    return i.clones(me).rows.select("canonical_id")


@query(
    with_ctes("syms")
    + """, k AS (SELECT canonical_id, min(clone_substitution_key) AS s, coalesce(min(lower(trim(clone_formatting_key))), '?' || canonical_id) AS f FROM symbols WHERE clone_substitution_key IS NOT NULL GROUP BY 1)
    , g AS (SELECT s FROM k GROUP BY 1 HAVING count(*) > 1), lead_ AS (SELECT s, arg_min(f, canonical_id) AS f0 FROM k GROUP BY 1)
    SELECT k.canonical_id, CAST(row_number() OVER (PARTITION BY k.s ORDER BY CASE WHEN k.f = l.f0 THEN 0 ELSE 1 END, k.canonical_id) AS INT) AS place FROM k JOIN g ON g.s = k.s JOIN lead_ l ON l.s = k.s"""
)
def clone_members_in_order(spark, d):
    """Members of each group, those spelled as its first one ahead of variants."""
    return clones.in_order(clones.clone_groups(_keys(spark, d)))


# --- beside the rows ------------------------------------------------------------

@query(
    with_ctes("syms", "occs")
    + building._REFUSED
    + r""", calls AS (SELECT regexp_extract(s.display_name, '([^.:]*)$', 1) AS name FROM occs o JOIN syms s ON s.canonical_id = o.symbol_id WHERE o.id % 3 = 0 AND o.role = 'reference')
    , c AS (SELECT name, count(*) AS n FROM calls GROUP BY 1), u AS (SELECT symbol_id, count(DISTINCT discrepancy_id) AS n FROM links GROUP BY 1)
    SELECT s.canonical_id, regexp_extract(s.display_name, '([^.:]*)$', 1) AS name, coalesce(c.n, 0) AS unresolved_calls, coalesce(u.n, 0) AS unconfirmed_uses
    FROM syms s LEFT JOIN c ON c.name = regexp_extract(s.display_name, '([^.:]*)$', 1) LEFT JOIN u ON u.symbol_id = s.canonical_id"""
)
def reference_groups(spark, d):
    """Unresolved calls by name and unconfirmed uses of every symbol; every third reference stands for an unresolved call."""
    s = symbols(spark, d)
    calls = occurrences(spark, d).where("id % 3 = 0 AND role = 'reference'").join(s.select(F.col("canonical_id").alias("symbol_id"), "display_name"), "symbol_id").select(references.last_component(F.col("display_name")).alias("name"))
    return references.reference_groups(s, calls, building._links(spark, d))


@query(
    with_ctes("syms", "occs")
    + """, module AS (SELECT document_path, min(canonical_id) AS module_id FROM syms WHERE kind = 'module' AND document_path IS NOT NULL GROUP BY 1), t AS (SELECT canonical_id, min(signature_text) AS content FROM symbols GROUP BY 1)
    SELECT o.id, coalesce(o.enclosing_id, m.module_id) AS shown_id, t.content FROM occs o LEFT JOIN module m ON m.document_path = o.document_path LEFT JOIN t ON t.canonical_id = coalesce(o.enclosing_id, m.module_id) WHERE o.role = 'reference'"""
)
def reference_contents(spark, d):
    """The head of the declaration around each reference, else of its document's module."""
    heads = table(spark, d, "symbols").where("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.min("signature_text").alias("content"))
    modules = symbols(spark, d).where("kind = 'module' AND document_path IS NOT NULL").groupBy("document_path").agg(F.min("canonical_id").alias("canonical_id"))
    return references.reference_content(occurrences(spark, d).where("role = 'reference'"), heads, modules).select("id", "shown_id", "content")


@query(
    with_ctes("syms", "occs", recursive=True)
    + building._METHODS
    + """, over AS (SELECT DISTINCT a.method AS src, b.method AS dst FROM bases h JOIN methods a ON a.container = h.type JOIN methods b ON b.container = h.base WHERE h.type <> h.base)
    , reach AS (SELECT src AS start, dst AS node FROM over UNION SELECT r.start, o.dst FROM reach r JOIN over o ON o.src = r.node)
    , n AS (SELECT symbol_id AS node, count(*) AS c FROM occs WHERE role = 'reference' GROUP BY 1), r AS (SELECT * FROM reach WHERE start <> node)
    SELECT m.method, (SELECT count(*) FROM r WHERE r.node = m.method) AS overridden_by, CAST((SELECT coalesce(sum(c), 0) FROM r JOIN n ON n.node = r.start WHERE r.node = m.method) AS BIGINT) AS overridden_by_references,
        (SELECT count(*) FROM r WHERE r.start = m.method) AS overrides, CAST((SELECT coalesce(sum(c), 0) FROM r JOIN n ON n.node = r.node WHERE r.start = m.method) AS BIGINT) AS overrides_references FROM (SELECT DISTINCT method FROM methods) m"""
)
def override_relations(spark, d):
    """Overriding and overridden methods, each transitively, with their references; every method of a type overrides those of its base here."""
    methods, bases = building._methods(spark, d), building._bases(spark, d)
    over = bases.where("type <> base").join(methods.select(F.col("container").alias("type"), F.col("method").alias("src")), "type").join(methods.select(F.col("container").alias("base"), F.col("method").alias("dst")), "base").select("src", "dst").distinct()
    counts = occurrences(spark, d).where("role = 'reference'").groupBy(F.col("symbol_id").alias("node")).agg(F.count(F.lit(1)).alias("references"))
    return references.override_relations(methods, over, counts)


@query(
    with_ctes("syms", "occs")
    + """, p AS (SELECT o.id, s.canonical_id, row_number() OVER (PARTITION BY o.id ORDER BY (s.end_line - s.start_line)::BIGINT * 16777216 + s.end_column - s.start_column, s.canonical_id) AS rn FROM occs o JOIN syms s ON s.document_path = o.document_path
        AND (s.start_line, s.start_column) <= (o.start_line, o.start_column) AND (o.start_line, o.start_column) < (s.end_line, s.end_column) WHERE o.start_line IS NOT NULL AND o.start_column IS NOT NULL)
    SELECT id, canonical_id FROM p WHERE rn = 1"""
)
def innermost_by_line(spark, d):
    """The innermost symbol around each occurrence, by line and column."""
    points = occurrences(spark, d).select("id", "document_path", F.col("start_line").alias("line"), F.col("start_column").alias("column"))
    return intervals.innermost_by_line(points, symbols(spark, d).where("document_path IS NOT NULL"), "id", "canonical_id")


@query(with_ctes("syms", "occs") + " SELECT DISTINCT document_path FROM occs WHERE document_path IN (SELECT document_path FROM syms)")
def held_documents(spark, d):
    """Documents of occurrences that hold symbols."""
    return occurrences(spark, d).select("document_path").distinct().join(symbols(spark, d).select("document_path"), "document_path", "left_semi")


@query(with_ctes("syms", "occs") + building._REFUSED + " SELECT discrepancy_id, document_path, span_start FROM refused ORDER BY document_path, span_start, discrepancy_id")
def discrepancy_listing(spark, d):
    """All discrepancies in the order of their places."""
    return building._refused(spark, d).select("discrepancy_id", "document_path", "span_start").orderBy("document_path", "span_start", "discrepancy_id")


@query("SELECT count(*) AS chunks, count(DISTINCT vec_id // 3) AS passages FROM embeddings")
def chunk_count(spark, d):
    return table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct(F.floor(F.col("vec_id") / 3)).alias("passages"))


@query("SELECT vec_id // 3 AS passage, len(list(vec_id)) AS chunks, round(CAST(list_extract(list_extract(list(embedding ORDER BY vec_id), -1), 1) AS DOUBLE), 5) AS last_first FROM embeddings GROUP BY 1")
def passage_vectors(spark, d):
    """Three vectors in a row stand for the chunks of a passage, kept in their order."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("passage"), (F.col("vec_id") % 3).alias("ordinal"), "embedding")
    return references.passage_vectors(rows).select("passage", F.size("vectors").alias("chunks"), F.round(F.element_at(F.element_at("vectors", -1), 1).cast("double"), 5).alias("last_first"))


@query("WITH v AS (SELECT DISTINCT c.symbol_id, c.render FROM semantic_corpus c) SELECT symbol_id, 0 AS ordinal FROM v WHERE length(render) % 3 <> 0 GROUP BY 1")
def reused_vectors(spark, d):
    """Of an earlier build the vectors of passages that read as before; a third were written anew."""
    now = table(spark, d, "semantic_corpus").select("symbol_id", "render").distinct()
    earlier = now.withColumn("render", F.when(F.length("render") % 3 == 0, F.concat("render", F.lit("!"))).otherwise(F.col("render")))
    vectors = earlier.select("symbol_id").distinct().select("symbol_id", F.lit(0).alias("ordinal"), F.array(F.lit(1.0)).alias("embedding"))
    return references.reused_vectors(now, earlier, vectors).select("symbol_id", "ordinal")


_TEXTS = "WITH f AS (SELECT canonical_id AS document_path, min(span_text) AS text FROM symbols WHERE span_text IS NOT NULL GROUP BY 1)"


@query(_TEXTS + " SELECT CASE WHEN length(document_path) % 4 = 1 THEN document_path || '.old' ELSE document_path END AS document_path, CASE WHEN length(document_path) % 4 = 0 THEN 'before' WHEN length(document_path) % 4 = 1 THEN 'moved' ELSE text END AS text FROM f WHERE length(document_path) % 4 <> 2")
def reverted_sources(spark, d):
    """Sources as they were ahead of a patch that changed, moved and added a quarter each."""
    f = table(spark, d, "symbols").where("span_text IS NOT NULL AND canonical_id IS NOT NULL").groupBy(F.col("canonical_id").alias("document_path")).agg(F.min("span_text").alias("text"))
    r, p = F.length("document_path") % 4, F.col("document_path")
    changes = f.where(r < 3).select(F.when(r == 0, p).when(r == 1, F.concat(p, F.lit(".old"))).alias("before"), p.alias("after"))
    before = f.where(r == 0).select("document_path", F.lit("before").alias("text")).unionByName(f.where(r == 1).select(F.concat(p, F.lit(".old")).alias("document_path"), F.lit("moved").alias("text")))
    return references.revert_changes(f, changes, before)


@query(_TEXTS + r", s AS (SELECT document_path, CASE WHEN length(text) % 2 = 0 THEN 0 ELSE 1 END AS start, length(text) - CASE WHEN length(text) % 3 = 0 THEN 20 ELSE 0 END AS e, length(regexp_replace(text, '\s+$', '')) AS solid FROM f) SELECT document_path, start FROM s WHERE NOT (start = 0 AND e >= solid)")
def partial_spans(spark, d):
    """Spans that leave out something of their document that isn't blank."""
    f = table(spark, d, "symbols").where("span_text IS NOT NULL AND canonical_id IS NOT NULL").groupBy(F.col("canonical_id").alias("document_path")).agg(F.min("span_text").alias("text"))
    n = F.length("text")
    spans = f.select("document_path", F.when(n % 2 == 0, 0).otherwise(1).alias("start"), (n - F.when(n % 3 == 0, 20).otherwise(0)).alias("end"))
    return references.drop_whole_file_spans(spans, f).select("document_path", "start")


@query(with_ctes("syms") + building._REQUESTS + ", fit AS (SELECT document, name, candidate FROM cand WHERE candidate IN (SELECT p FROM docs)) SELECT document, name, min(candidate) AS candidate FROM fit GROUP BY 1, 2 HAVING count(*) = 1")
def unique_module_files(spark, d):
    """Module declarations that fit exactly one file."""
    docs = symbols(spark, d).where("document_path IS NOT NULL").select("document_path")
    return units.unique_module_files(building._requests(spark, d), docs)


# --- analysis -------------------------------------------------------------------

@query("SELECT event_id, value / 50 - 0.5 AS low, value / 50 - 0.3 AS high, value / 50 - 0.5 > 0 AS superior, value / 50 - 0.5 > -0.05 AS non_inferior, value / 50 - 0.5 > -0.05 AND value / 50 - 0.3 < 0.05 AS equivalent, value / 50 - 0.3 < 0 AS harm, value / 50 - 0.3 < -0.05 AS material_harm FROM events WHERE value IS NOT NULL".replace(", value / 50 - 0.5 AS low, value / 50 - 0.3 AS high", ""))
def accuracy_claims(spark, d):
    v = F.col("value") / 50
    rows = table(spark, d, "events").where("value IS NOT NULL").select("event_id", (v - 0.5).alias("low"), (v - 0.3).alias("high"))
    return experiment.claims(rows, 0.05).drop("low", "high")


@query("SELECT event_id, value / 20 + 0.2 < 1 AS superior, value / 20 + 0.2 < 1 + 0.05 AS non_inferior, value / 20 > 1 AS harm, value / 20 > 1 + 0.05 AS material_harm FROM events WHERE value IS NOT NULL")
def token_use_claims(spark, d):
    v = F.col("value") / 20
    rows = table(spark, d, "events").where("value IS NOT NULL").select("event_id", v.alias("low"), (v + 0.2).alias("high"))
    return experiment.claims(rows, 0.05, ratio=True).drop("low", "high")


@query(
    _TRIALS
    + """ SELECT 'pairs' AS measure, CAST(count(*) AS DOUBLE) AS value FROM pairs
    UNION ALL SELECT 'both', count(*) FILTER (b_hit > 0 AND t_hit > 0) FROM pairs WHERE excluded IS NULL
    UNION ALL SELECT 'neither', count(*) FILTER (b_hit = 0 AND t_hit = 0) FROM pairs WHERE excluded IS NULL
    UNION ALL SELECT 'mean ' || arm, round(avg(value), 6) FROM trials GROUP BY arm
    UNION ALL SELECT 'ratio value', round(sum(t_value) / sum(b_value), 6) FROM pairs WHERE excluded IS NULL AND b_value > 0 AND t_value > 0
    UNION ALL SELECT 'state ' || CASE arm WHEN 'baseline' THEN 'click' ELSE 'view' END, count(*) FROM latest GROUP BY arm"""
)
def whole_analysis(spark, d):
    """One analysis from trials to all its tables."""
    a = experiment.analyze(materialize(_trials(spark, d), "trials"), ["value"], "hit")
    row = lambda df, name, value: df.select(name.alias("measure"), value.cast("double").alias("value"))
    parts = [
        row(a["pairs"].agg(F.count(F.lit(1)).alias("n")), F.lit("pairs"), F.col("n")), row(a["outcomes"], F.lit("both"), F.col("both")), row(a["outcomes"], F.lit("neither"), F.col("neither")),
        row(a["arms"], F.concat(F.lit("mean "), "arm"), F.round("mean", 6)), row(a["ratios"], F.concat(F.lit("ratio "), "metric"), F.round("ratio_of_totals", 6)), row(a["states"], F.concat(F.lit("state "), "terminal_state"), F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(_TRIALS + " SELECT instance_id, round(b_value, 6) AS b_value, round(t_value, 6) AS t_value FROM pairs WHERE excluded IS NULL")
def exported_pairs(spark, d):
    """The rows that estimates can be computed from again, written as JSON lines and read back."""
    paired = experiment.pairs(experiment.latest_attempts(_trials(spark, d)), ["value", "hit"]).where("excluded IS NULL")
    path = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    paired.select("instance_id", "b_value", "t_value").write.json(path)
    back = spark.read.schema("instance_id long, b_value double, t_value double").json(path)
    return back.select("instance_id", F.round("b_value", 6).alias("b_value"), F.round("t_value", 6).alias("t_value"))


@query(
    """WITH w AS (SELECT id, length(t) % 50 AS token FROM (SELECT id, unnest(string_split_regex(render, '\\s+')) AS t FROM (SELECT id, min(render) AS render FROM semantic_corpus WHERE render IS NOT NULL GROUP BY 1)) WHERE t <> '')
    , v AS (SELECT vec_id AS token, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 40)
    , m AS (SELECT w.id, i, avg(v.e[i]) AS x FROM w JOIN v ON v.token = w.token, (SELECT unnest(range(1, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS i) GROUP BY 1, 2)
    SELECT id, count(*) AS dims, round(max(x) / sqrt(sum(x * x)), 5) AS largest, round(arg_max(x, -i) / sqrt(sum(x * x)), 5) AS "first" FROM m GROUP BY 1"""
)
def text_embeddings(spark, d):
    """Passages as the mean of their words' vectors; a word's vector goes by its length here, and words too long have none."""
    from lodestrata.operators import embedding

    texts = table(spark, d, "semantic_corpus").where("render IS NOT NULL").groupBy("id").agg(F.min("render").alias("render"))
    tokens = texts.select("id", F.explode(F.split("render", r"\s+")).alias("t")).where("t <> ''").select("id", (F.length("t") % 50).cast("long").alias("token"))
    vectors = table(spark, d, "embeddings").where("vec_id < 40").select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    rows = embedding.static_embeddings(tokens, vectors)
    return rows.select("id", F.size("embedding").cast("long").alias("dims"), F.round(F.array_max("embedding"), 5).alias("largest"), F.round(F.element_at("embedding", 1), 5).alias("first"))


@query(with_ctes("syms", "occs") + _SUBJECT + " SELECT id FROM occs JOIN me ON symbol_id = me WHERE role = 'reference' ORDER BY document_path, span_start, id LIMIT 10 OFFSET 10")
def asked_page(spark, d):
    """The second page of ten references, by the cursor of the first."""
    i, me = _index(spark, d), _subject(spark, d)
    order = [F.col(c) for c in ("document_path", "span_start", "id")]
    answer = i.trace(me, "references")
    first = i.page(answer, order, 10, {"of": me})
    return i.page(answer, order, 10, {"of": me}, first.cursor).rows.select("id")


@query("SELECT id, true AS within, true AS whole FROM (SELECT DISTINCT id FROM semantic_corpus WHERE render IS NOT NULL)")
def passage_chunks(spark, d):
    """Chunks of passages: none is larger than 64 tokens, and together they hold the passage's words in order."""
    from lodestrata.functions.chunks import split_passages

    texts = table(spark, d, "semantic_corpus").where("render IS NOT NULL").groupBy("id").agg(F.min("render").alias("content"))
    chunks = split_passages(texts.withColumn("header", F.lit("")), 64, 0)
    per = chunks.groupBy("id").agg(F.max("units").alias("most"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk"))), lambda x: x["chunk"]), " ").alias("all"))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return per.join(texts, "id").select("id", (F.col("most") <= 64).alias("within"), (bare("all") == bare("content")).alias("whole"))
