"""Queries over the graph of symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import components, graph, intervals, resolution
from lodestrata.plans.base import occurrences, query, symbols, with_ctes
from lodestrata.runtime import materialize, table

_DEPENDENTS = ", links AS (SELECT dst AS at, src AS next, min(CASE kind WHEN 'uses' THEN 1 WHEN 'imports' THEN 2 WHEN 'type_hierarchy' THEN 3 ELSE 4 END) AS k FROM edges GROUP BY 1, 2)"

#: Distances by root, then for each node the nearest other root, and the first kind among the edges from one hop nearer.
_WALK = (
    with_ctes("syms", "occs", "edges", recursive=True)
    + _DEPENDENTS
    + """
    , seeds AS (SELECT canonical_id AS node FROM syms WHERE {seed})
    , walk AS (
        SELECT node, node AS root, 0 AS d FROM seeds
        UNION
        SELECT l.next, w.root, w.d + 1 FROM walk w JOIN links l ON l.at = w.node WHERE w.d < 20
    ), near AS (SELECT node, root, min(d) AS d FROM walk GROUP BY 1, 2)
    , found AS (SELECT node, min(d) AS distance FROM near WHERE node <> root GROUP BY 1)
    , dep AS (
        SELECT f.node, f.distance, min(l.k) AS k
        FROM found f JOIN links l ON l.next = f.node JOIN near n ON n.node = l.at AND n.d = f.distance - 1 AND n.root <> f.node
        GROUP BY 1, 2
    ), dependents AS (
        SELECT node, CAST(distance AS INT) AS distance, CASE k WHEN 1 THEN 'uses' WHEN 2 THEN 'imports' WHEN 3 THEN 'type_hierarchy' ELSE 'overrides' END AS kind FROM dep
    )
    """
)
_SEED = "kind = 'constant' AND test_rule IS NOT NULL"
_RANKS = (
    ", nodes AS (SELECT canonical_id AS node FROM syms WHERE class = 'in_workspace')"
    ", pairs AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes))"
    ", deg AS (SELECT src, count(*) AS c FROM pairs GROUP BY 1)"
    ", size AS (SELECT count(*) AS n FROM nodes)"
    ", r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS r FROM nodes, size)"
    + "".join(
        f", r{k} AS MATERIALIZED (SELECT v.node, 0.15::DOUBLE / s.n + 0.85::DOUBLE * (coalesce(g.g, 0) + l.lost / s.n) AS r"
        f" FROM nodes v CROSS JOIN size s"
        f" CROSS JOIN (SELECT coalesce(sum(r), 0) AS lost FROM r{k - 1} WHERE node NOT IN (SELECT src FROM deg)) l"
        f" LEFT JOIN (SELECT p.dst, sum(x.r / d.c) AS g FROM pairs p JOIN r{k - 1} x ON x.node = p.src JOIN deg d ON d.src = p.src GROUP BY 1) g ON g.dst = v.node)"
        for k in range(1, 41)
    )
)


def _edges(spark, d):
    return graph.reference_edges(occurrences(spark, d), symbols(spark, d))


def _hierarchy(spark, d):
    """Links to types. Links are a set, so rows delivered again need no removal ahead of it."""
    ends = table(spark, d, "symbols").where("canonical_id IS NOT NULL").select("canonical_id", F.lower(F.trim("kind")).alias("kind")).distinct()
    return graph.reference_edges(table(spark, d, "occurrences").where("id IS NOT NULL"), ends).where("kind = 'type_hierarchy'")


def _seeds(spark, d):
    return symbols(spark, d).where(_SEED).select(F.col("canonical_id").alias("node"))


@query(with_ctes("syms", "occs", "edges") + " SELECT kind, src, dst FROM edges")
def edge_set(spark, d):
    return _edges(spark, d)


@query(with_ctes("syms", "occs", "edges") + " SELECT dst AS node, kind, count(*) AS sources FROM edges GROUP BY 1, 2")
def trace_sources(spark, d):
    return _edges(spark, d).groupBy(F.col("dst").alias("node"), "kind").agg(F.count(F.lit(1)).alias("sources"))


@query(with_ctes("syms", "occs", "edges") + " SELECT src AS node, kind, count(*) AS targets FROM edges GROUP BY 1, 2")
def trace_targets(spark, d):
    return _edges(spark, d).groupBy(F.col("src").alias("node"), "kind").agg(F.count(F.lit(1)).alias("targets"))


@query(with_ctes("syms", "occs", "edges") + " SELECT DISTINCT src AS node, dst AS other FROM edges WHERE kind IN ('type_hierarchy', 'overrides')")
def hierarchy_relatives(spark, d):
    return graph.neighbours(_edges(spark, d), ["type_hierarchy", "overrides"])


@query(
    with_ctes("syms", "occs")
    + """, both_ AS (
        SELECT canonical_id, document_path, span_start, span_end, kind FROM syms WHERE document_path IS NOT NULL
        UNION ALL SELECT 'occurrence ' || id, document_path, span_start, span_end, 'reference' FROM occs WHERE span_start IS NOT NULL AND span_end IS NOT NULL
    ), pairs AS (
        SELECT c.canonical_id AS child, p.canonical_id AS parent, row_number() OVER (PARTITION BY c.canonical_id ORDER BY p.span_end - p.span_start, p.canonical_id) AS rn
        FROM both_ c JOIN both_ p ON c.document_path = p.document_path AND p.canonical_id <> c.canonical_id
             AND p.span_start <= c.span_start AND c.span_start < p.span_end AND c.span_end <= p.span_end
             AND (p.span_end - p.span_start > c.span_end - c.span_start OR (p.kind = 'module' AND c.kind <> 'module'))
    ) SELECT parent, child FROM pairs WHERE rn = 1"""
)
def contains_edges(spark, d):
    """The nearest container of every symbol and of every occurrence's span (no two symbols of these tables nest)."""
    spans = symbols(spark, d).where("document_path IS NOT NULL").select("canonical_id", "document_path", F.col("span_start").alias("start"), F.col("span_end").alias("end"), "kind")
    places = occurrences(spark, d).where("span_start IS NOT NULL AND span_end IS NOT NULL").select(F.concat(F.lit("occurrence "), "id").alias("canonical_id"), "document_path", F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.lit("reference").alias("kind"))
    spans = spans.unionByName(places)
    return intervals.parents(spans, "canonical_id")


@query(_WALK.format(seed=_SEED) + " SELECT node, distance, kind FROM dependents")
def dependents(spark, d):
    return graph.dependents(_edges(spark, d), _seeds(spark, d))


@query(_WALK.format(seed=_SEED) + " SELECT node, distance, kind FROM dependents")
def dependents_joined(spark, d):
    """The same walk as one join a hop, as graphs beyond one task's bound are walked."""
    return graph.dependents(_edges(spark, d), _seeds(spark, d), one_task=0)


@query(with_ctes("syms", "occs", "edges") + _RANKS + " SELECT node, round(r, 9) AS rank FROM r40")
def global_rank_joined(spark, d):
    """The same ranks as one join a round, as graphs beyond one task's bound are ranked."""
    nodes, links = graph.rank_projection(_edges(spark, d), symbols(spark, d))
    return graph.page_rank(nodes, links, one_task=0).select("node", F.round("rank", 9).alias("rank"))


@query(
    _WALK.format(seed=_SEED)
    + """ SELECT distance, kind, count(*) AS dependents, distance > 1 AS beyond,
        CASE WHEN (SELECT max(distance) FROM dependents) >= 20 THEN 'cut_at_horizon' WHEN (SELECT max(distance) FROM dependents) > 1 THEN 'beyond_bound' ELSE 'ends_within_bound' END AS disclosure
        FROM dependents GROUP BY distance, kind"""
)
def dependents_report(spark, d):
    return graph.dependents_report(materialize(graph.dependents(_edges(spark, d), _seeds(spark, d)), "dependents"), depth=1)


@query(with_ctes("syms", "occs", "edges") + _RANKS + " SELECT node, round(r, 9) AS rank FROM r40")
def global_rank(spark, d):
    nodes, links = graph.rank_projection(_edges(spark, d), symbols(spark, d))
    return graph.page_rank(nodes, links).select("node", F.round("rank", 9).alias("rank"))


@query(
    _WALK.format(seed=_SEED)
    + _RANKS
    + """ SELECT d.node, d.distance, d.kind, CAST(row_number() OVER (PARTITION BY d.distance ORDER BY round(coalesce(r.r, 0), 12) DESC,
            CASE d.kind WHEN 'uses' THEN 1 WHEN 'imports' THEN 2 WHEN 'type_hierarchy' THEN 3 ELSE 4 END, d.node) AS INT) AS place
        FROM dependents d LEFT JOIN r40 r ON r.node = d.node"""
)
def ranked_dependents(spark, d):
    edges = materialize(_edges(spark, d), "edges")
    nodes, links = graph.rank_projection(edges, symbols(spark, d))
    return graph.ranked_dependents(graph.dependents(edges, _seeds(spark, d)), graph.page_rank(nodes, links))


@query(
    with_ctes("syms", "occs", "edges", recursive=True)
    + """, reach AS (
        SELECT src AS start, dst AS node FROM edges WHERE kind = 'type_hierarchy'
        UNION SELECT r.start, e.dst FROM reach r JOIN edges e ON e.src = r.node WHERE e.kind = 'type_hierarchy'
    ) SELECT start, node FROM reach WHERE start <> node"""
)
def hierarchy_closure(spark, d):
    return graph.closure(_hierarchy(spark, d))


@query(
    with_ctes("syms", "occs", "edges", recursive=True)
    + """, both_ AS (SELECT src AS a, dst AS b FROM edges WHERE kind = 'imports' UNION SELECT dst, src FROM edges WHERE kind = 'imports')
    , reach AS (SELECT a AS node, a AS other FROM both_ UNION SELECT r.node, b.b FROM reach r JOIN both_ b ON b.a = r.other)
    SELECT node, min(other) AS component FROM reach GROUP BY 1"""
)
def import_components(spark, d):
    return components.connected_components(_edges(spark, d).where("kind = 'imports'"))


@query(with_ctes("occs") + " SELECT symbol_id, count(*) AS \"references\", count(DISTINCT document_path) AS documents FROM occs WHERE role = 'reference' GROUP BY 1")
def count_references(spark, d):
    refs = occurrences(spark, d).where("role = 'reference'")
    # two levels: the inner one is spread by document, so a symbol with a tenth of all rows is no hot group
    inner = refs.groupBy("symbol_id", "document_path").agg(F.count(F.lit(1)).alias("n"))
    return inner.groupBy("symbol_id").agg(F.sum("n").alias("references"), F.count(F.lit(1)).alias("documents"))


@query(
    with_ctes("syms", "occs")
    + """, module AS (SELECT document_path, min(canonical_id) AS module_id, min(test_rule) AS module_rule FROM syms WHERE kind = 'module' GROUP BY 1)
    SELECT o.id, o.symbol_id, coalesce(e.test_rule, m.module_rule) AS test_rule
    FROM occs o LEFT JOIN syms e ON e.canonical_id = o.enclosing_id LEFT JOIN module m ON m.document_path = o.document_path
    WHERE o.role = 'reference' AND coalesce(e.test_rule, m.module_rule) IS NOT NULL"""
)
def trace_tests(spark, d):
    s = symbols(spark, d)
    rules = s.select(F.col("canonical_id").alias("enclosing_id"), "test_rule")
    module = s.where("kind = 'module'").groupBy("document_path").agg(F.min("test_rule").alias("module_rule"))
    refs = occurrences(spark, d).where("role = 'reference'").select("id", "symbol_id", "document_path", "enclosing_id")
    out = refs.join(rules, "enclosing_id", "left").join(module, "document_path", "left")
    return out.select("id", "symbol_id", F.coalesce("test_rule", "module_rule").alias("test_rule")).where("test_rule IS NOT NULL")


@query(
    with_ctes("syms", "occs")
    + """, pairs AS (
        SELECT o.id, s.canonical_id, row_number() OVER (PARTITION BY o.id ORDER BY s.span_end - s.span_start, s.canonical_id) AS rn
        FROM occs o JOIN syms s ON s.document_path = o.document_path AND s.span_start <= o.span_start AND o.span_start < s.span_end
    ) SELECT id, canonical_id FROM pairs WHERE rn = 1"""
)
def innermost_symbol(spark, d):
    points = occurrences(spark, d).select("id", "document_path", F.col("span_start").alias("point"))
    spans = symbols(spark, d).where("document_path IS NOT NULL").select("canonical_id", "document_path", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    return intervals.innermost(points, spans, "id", "canonical_id")


@query(
    with_ctes("syms", "occs")
    + """ SELECT o.id, count(*) AS symbols FROM occs o JOIN syms s ON s.document_path = o.document_path
        AND o.span_start < s.span_end AND s.span_start < o.span_end GROUP BY 1"""
)
def span_overlap(spark, d):
    a = occurrences(spark, d).select("document_path", F.col("id").alias("a"), F.col("span_start").alias("a_start"), F.col("span_end").alias("a_end"))
    b = symbols(spark, d).where("document_path IS NOT NULL").select("document_path", F.col("canonical_id").alias("b"), F.col("span_start").alias("b_start"), F.col("span_end").alias("b_end"))
    return intervals.overlapping(a, b).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("symbols"))


_DOCUMENT_SPANS = with_ctes("syms") + ", s AS (SELECT canonical_id, document_path, span_start AS a, span_end AS z FROM syms WHERE document_path IS NOT NULL)"


@query(_DOCUMENT_SPANS + " SELECT canonical_id FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.document_path = x.document_path AND x.a <= y.a AND y.z <= x.z AND (x.a < y.a OR y.z < x.z))")
def minimal_spans(spark, d):
    spans = symbols(spark, d).where("document_path IS NOT NULL").select("canonical_id", "document_path", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    return intervals.minimal(spans, "canonical_id", []).select("canonical_id")


@query(_DOCUMENT_SPANS + " SELECT canonical_id FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.document_path = x.document_path AND y.a <= x.a AND x.z <= y.z AND (y.a < x.a OR x.z < y.z))")
def outermost_spans(spark, d):
    spans = symbols(spark, d).where("document_path IS NOT NULL").select("canonical_id", "document_path", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    return intervals.outermost(spans, "canonical_id", ["document_path"]).select("canonical_id")


@query(with_ctes("syms") + " SELECT canonical_id, display_name, kind FROM syms WHERE contains(lower(display_name), 'ladder')")
def find_fragment(spark, d):
    return resolution.find(symbols(spark, d), "LADDER").select("canonical_id", "display_name", "kind")


@query(with_ctes("syms") + " SELECT display_name, count(*) AS symbols, min(canonical_id) AS first_id FROM syms GROUP BY 1")
def symbols_by_shortname(spark, d):
    return symbols(spark, d).groupBy("display_name").agg(F.count(F.lit(1)).alias("symbols"), F.min("canonical_id").alias("first_id"))


@query(
    with_ctes("syms")
    + """, refs AS (
        SELECT canonical_id AS reference FROM syms
        UNION SELECT display_name FROM syms
        UNION SELECT array_to_string(string_split(canonical_id, '::')[-2:], '::') FROM syms
        UNION SELECT array_to_string(string_split(canonical_id, '::')[-2:], '.') FROM syms
        UNION SELECT display_name || '_missing' FROM syms
    ), refs2 AS (SELECT DISTINCT reference FROM refs WHERE reference IS NOT NULL)
    , tails AS (
        SELECT canonical_id, workspace_id, array_to_string(string_split(canonical_id, '::')[i:], '::') AS suffix
        FROM (SELECT canonical_id, workspace_id, unnest(range(1, len(string_split(canonical_id, '::')) + 1)) AS i FROM syms)
    ), t2 AS (
        SELECT r.reference, t.canonical_id, t.canonical_id = concat_ws('::', t.workspace_id, r.reference) AS full_
        FROM refs2 r JOIN tails t ON t.suffix = r.reference WHERE contains(r.reference, '::')
    ), found AS (
        SELECT r.reference, 1 AS tier, s.canonical_id FROM refs2 r JOIN syms s ON s.canonical_id = r.reference
        UNION ALL SELECT reference, 2, canonical_id FROM t2 x WHERE full_ OR NOT EXISTS (SELECT 1 FROM t2 y WHERE y.reference = x.reference AND y.full_)
        UNION ALL SELECT r.reference, 3, t.canonical_id FROM refs2 r JOIN tails t ON t.suffix = replace(r.reference, '.', '::') WHERE NOT contains(r.reference, '::') AND contains(r.reference, '.')
        UNION ALL SELECT r.reference, 4, s.canonical_id FROM refs2 r JOIN syms s ON s.display_name = r.reference WHERE NOT contains(r.reference, '::')
    ), per AS (SELECT reference, tier, count(DISTINCT canonical_id) AS n, min(canonical_id) AS c FROM found GROUP BY 1, 2)
    , first_ AS (SELECT reference, min(tier) AS tier FROM per GROUP BY 1)
    SELECT r.reference, CASE WHEN p.n IS NULL THEN 'absent' WHEN p.n = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome, p.tier,
           coalesce(p.n, 0) AS candidates, CASE WHEN p.n = 1 THEN p.c END AS canonical_id
    FROM refs2 r LEFT JOIN first_ f ON f.reference = r.reference LEFT JOIN per p ON p.reference = f.reference AND p.tier = f.tier"""
)
def resolve_references(spark, d):
    s = symbols(spark, d)
    parts = F.split("canonical_id", "::")
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    refs = s.select(F.explode(F.array("canonical_id", "display_name", F.array_join(last, "::"), F.array_join(last, "."), F.concat("display_name", F.lit("_missing")))).alias("reference"))
    return resolution.resolve(refs, s)
