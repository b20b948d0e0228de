"""Queries over what a build derives: symbol strings, modules, units, tests, twins, discrepancies, overrides."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import text as tx
from lodestrata.operators import alignment, clones, graph, identity, impact, paging, syntax, units
from lodestrata.plans.base import occurrences, query, symbols, with_ctes
from lodestrata.runtime import materialize, table
from lodestrata.sources import backend, semantic_index

_SYMBOL_STRING = """'scip lex ' || coalesce(workspace_id, '.') || ' 1.0 ' || CASE WHEN len(m) > 0 THEN array_to_string(m, '/') || '/' ELSE '' END
        || CASE kind WHEN 'type' THEN display_name || '#' WHEN 'function' THEN display_name || '().' WHEN 'method' THEN 'Owner#' || display_name || '(+1).'
           WHEN 'field' THEN 'Owner#' || display_name || '.' WHEN 'constant' THEN display_name || '.' WHEN 'module' THEN display_name || '/' ELSE '`' || display_name || '``x`!' END"""


@query(
    with_ctes("syms")
    + ", p AS (SELECT *, string_split(regexp_replace(canonical_id, '#[0-9]+$', ''), '::')[2:-2] AS m FROM syms) SELECT DISTINCT "
    + _SYMBOL_STRING
    + """ AS symbol, coalesce(workspace_id, '.') AS package,
        array_to_string(m || CASE WHEN kind IN ('method', 'field') THEN ['Owner', display_name] WHEN kind IN ('type', 'function', 'constant', 'module') THEN [display_name] ELSE [display_name || '`x'] END, '/') AS names,
        CASE kind WHEN 'type' THEN 'Type' WHEN 'function' THEN 'Function' WHEN 'method' THEN 'Method' WHEN 'field' THEN 'Field' WHEN 'constant' THEN 'Constant' WHEN 'module' THEN 'Module' ELSE 'Other' END AS kind FROM p"""
)
def parsed_symbols(spark, d):
    """Symbol strings of all symbols, taken apart again."""
    parts = F.split(tx.without_rank(F.col("canonical_id")), "::")
    middle = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    name, owner = F.col("display_name"), F.lit("Owner#")
    last = (
        F.when(F.col("kind") == "type", F.concat(name, F.lit("#"))).when(F.col("kind") == "function", F.concat(name, F.lit("()."))).when(F.col("kind") == "method", F.concat(owner, name, F.lit("(+1).")))
        .when(F.col("kind") == "field", F.concat(owner, name, F.lit("."))).when(F.col("kind") == "constant", F.concat(name, F.lit("."))).when(F.col("kind") == "module", F.concat(name, F.lit("/"))).otherwise(F.concat(F.lit("`"), name, F.lit("``x`!")))
    )
    text = F.concat(F.lit("scip lex "), F.coalesce("workspace_id", F.lit(".")), F.lit(" 1.0 "), F.array_join(F.transform(middle, lambda x: F.concat(x, F.lit("/"))), ""), last)
    return identity.parse_symbols(symbols(spark, d).select(text.alias("symbol"))).select("symbol", "package", F.array_join(F.transform("segments", lambda s: s["name"]), "/").alias("names"), "kind")


@query(
    with_ctes("syms")
    + """ SELECT DISTINCT CASE WHEN kind = 'module' THEN workspace_id || '::core+lib::' || display_name ELSE workspace_id || '::core::' || display_name || '::' || kind END AS base FROM syms WHERE workspace_id IS NOT NULL"""
)
def base_identities(spark, d):
    unit = F.when(F.col("kind") == "module", F.lit("lib"))
    segments = F.when(F.col("kind") == "module", F.array("display_name")).otherwise(F.array("display_name", "kind"))
    return symbols(spark, d).where("workspace_id IS NOT NULL").select(identity.base_identity(F.col("workspace_id"), F.lit("core"), unit, segments).alias("base")).distinct()


# --- modules, units and tests ---------------------------------------------------

_REQUESTS = """, docs AS (SELECT DISTINCT document_path AS p FROM syms WHERE document_path LIKE '%.rs')
    , requests AS (
        SELECT regexp_replace(p, '[^/]*$', '') || 'mod.rs' AS document, regexp_extract(p, '([^/]*)\\.rs$', 1) AS name, NULL AS path FROM docs
        UNION SELECT regexp_replace(p, '[^/]*$', '') || 'other.rs', 'x', regexp_extract(p, '([^/]*)$', 1) FROM docs)
    , cand AS (
        SELECT document, name, regexp_replace(document, '[^/]*$', '') || path AS candidate FROM requests WHERE path IS NOT NULL
        UNION ALL SELECT document, name, regexp_replace(document, '[^/]*$', '') || name || s FROM requests, (SELECT unnest(['.rs', '/mod.rs']) AS s) WHERE path IS NULL)"""


def _requests(spark, d):
    docs = symbols(spark, d).where("document_path LIKE '%.rs'").select(F.col("document_path").alias("p")).distinct()
    folder = F.regexp_replace("p", r"[^/]*$", "")
    plain = docs.select(F.concat(folder, F.lit("mod.rs")).alias("document"), F.regexp_extract("p", r"([^/]*)\.rs$", 1).alias("name"), F.lit(None).cast("string").alias("path"))
    pathed = docs.select(F.concat(folder, F.lit("other.rs")).alias("document"), F.lit("x").alias("name"), F.regexp_extract("p", r"([^/]*)$", 1).alias("path"))
    return plain.unionByName(pathed).distinct()


@query(with_ctes("syms") + _REQUESTS + " SELECT document, name, candidate FROM cand")
def module_candidates(spark, d):
    return units.module_file_candidates(_requests(spark, d))


@query(with_ctes("syms") + _REQUESTS + " SELECT DISTINCT candidate AS document, document AS parent FROM cand WHERE candidate IN (SELECT p FROM docs)")
def declared_modules(spark, d):
    return units.declared_by(_requests(spark, d), symbols(spark, d).where("document_path IS NOT NULL"))


#: A document declares another where it refers to what that one defines.
_DECLARED = """, declared AS (
        SELECT DISTINCT s.document_path AS document, o.document_path AS parent FROM occs o JOIN syms s ON s.canonical_id = o.symbol_id
        WHERE o.role = 'reference' AND s.document_path IS NOT NULL AND o.document_path IS NOT NULL AND s.document_path <> o.document_path)"""


def _declared(spark, d):
    where = symbols(spark, d).where("document_path IS NOT NULL").select(F.col("canonical_id").alias("symbol_id"), F.col("document_path").alias("document"))
    refs = occurrences(spark, d).where("role = 'reference' AND document_path IS NOT NULL").select("symbol_id", F.col("document_path").alias("parent"))
    return refs.join(where, "symbol_id").where("document <> parent").select("document", "parent").distinct()


_REACH = (
    _DECLARED
    + """, targets AS (SELECT workspace_id AS target, min(document_path) AS root FROM syms WHERE document_path IS NOT NULL AND workspace_id IS NOT NULL GROUP BY 1)
    , reach AS (SELECT target, root AS document FROM targets UNION SELECT r.target, e.document FROM reach r JOIN declared e ON e.parent = r.document)"""
)


def _targets(spark, d):
    return symbols(spark, d).where("document_path IS NOT NULL AND workspace_id IS NOT NULL").groupBy(F.col("workspace_id").alias("target")).agg(F.min("document_path").alias("root"))


@query(with_ctes("syms", "occs", recursive=True) + _REACH + " SELECT target, document FROM reach")
def target_reach(spark, d):
    return units.target_reach(_targets(spark, d), _declared(spark, d))


@query(with_ctes("syms", "occs", recursive=True) + _REACH + " SELECT document, CASE WHEN count(DISTINCT target) = 1 THEN max('unit ' || target) ELSE 'shared' END AS unit FROM reach GROUP BY 1")
def document_units(spark, d):
    targets = _targets(spark, d)
    return identity.assign_units(targets.select("target", F.concat(F.lit("unit "), "target").alias("unit")), units.target_reach(targets, _declared(spark, d)))


@query(with_ctes("syms") + _REQUESTS + " SELECT candidate AS document, max(document) AS parent FROM cand WHERE candidate IN (SELECT p FROM docs) AND (name <> 'x' OR length(candidate) % 2 = 0) GROUP BY 1 HAVING count(DISTINCT document) = 1")
def single_parents(spark, d):
    """Documents that one other declares, where every second one is declared twice."""
    declared = units.declared_by(_requests(spark, d), symbols(spark, d).where("document_path IS NOT NULL"))
    return identity.single_parent(declared.where("parent NOT LIKE '%other.rs' OR length(document) % 2 = 0"))


@query(
    with_ctes("syms", "occs", recursive=True)
    + _DECLARED
    + r""", files AS (
        SELECT document_path AS p FROM syms WHERE kind = 'module' AND test_rule = 'test_configuration' AND document_path IS NOT NULL
        UNION SELECT e.document FROM files f JOIN declared e ON e.parent = f.p)
    , r AS (
        SELECT canonical_id, CASE
            WHEN document_path LIKE '%.rs' AND test_rule = 'test_attribute' THEN 'test_attribute'
            WHEN document_path LIKE '%.rs' AND (document_path IN (SELECT p FROM files) OR EXISTS (
                SELECT 1 FROM syms t WHERE t.kind = 'type' AND t.document_path = s.document_path AND t.span_start <= s.span_start AND s.span_start < t.span_end)) THEN 'test_configuration'
            WHEN regexp_matches(document_path, '(^|/)(test_[^/]*\.py|[^/]*_test\.py|tests\.py|conftest\.py)$') THEN 'test_file'
            WHEN list_contains(string_split(document_path, '/')[:-2], 'tests') THEN 'test_directory' END AS test_rule FROM syms s)
    SELECT canonical_id, test_rule FROM r WHERE test_rule IS NOT NULL"""
)
def classified_tests(spark, d):
    """Test rules by attribute, gated module (here: the types' spans), gated file, file name and folder."""
    s = symbols(spark, d)
    gated = s.where("kind = 'module' AND test_rule = 'test_configuration' AND document_path IS NOT NULL").select("document_path", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    gated = gated.unionByName(s.where("kind = 'type' AND document_path IS NOT NULL").select("document_path", F.col("span_start").alias("start"), F.col("span_end").alias("end")))
    return units.classify_tests(s, s.where("test_rule = 'test_attribute'"), gated, _declared(spark, d))


@query(
    with_ctes("syms", "occs")
    + """, w AS (SELECT symbol_id, max(span_end - span_start) AS w FROM occs WHERE role = 'definition' GROUP BY 1)
    , r AS (SELECT document_path, canonical_id, row_number() OVER (PARTITION BY document_path ORDER BY coalesce(w, -1) DESC, span_end - span_start DESC NULLS LAST, canonical_id) AS rn
        FROM syms LEFT JOIN w ON w.symbol_id = canonical_id WHERE kind = 'module' AND document_path IS NOT NULL)
    SELECT document_path, canonical_id FROM r WHERE rn = 1"""
)
def document_modules(spark, d):
    return units.module_of_documents(symbols(spark, d), occurrences(spark, d).where("role = 'definition'"))


# --- twins ----------------------------------------------------------------------

_TWINS = """, twins AS (SELECT display_name AS descriptor, regexp_replace(document_path, '/[^/]*$', '') AS folder, document_path, canonical_id AS symbol_id, span_start, workspace_id FROM syms WHERE document_path IS NOT NULL)
    , refs AS (SELECT o.id AS occurrence_id, s.display_name AS descriptor, o.document_path, o.span_start AS point FROM occs o JOIN syms s ON s.canonical_id = o.symbol_id
        WHERE o.role = 'reference' AND o.document_path IS NOT NULL AND o.span_start IS NOT NULL)"""


def _twins(spark, d):
    folder = F.regexp_replace("document_path", r"/[^/]*$", "")
    return symbols(spark, d).where("document_path IS NOT NULL").select(F.col("display_name").alias("descriptor"), folder.alias("folder"), "document_path", F.col("canonical_id").alias("symbol_id"), "span_start", "workspace_id")


def _references(spark, d):
    names = symbols(spark, d).select(F.col("canonical_id").alias("symbol_id"), F.col("display_name").alias("descriptor"))
    return occurrences(spark, d).where("role = 'reference' AND document_path IS NOT NULL AND span_start IS NOT NULL").join(names, "symbol_id").select(F.col("id").alias("occurrence_id"), "descriptor", "document_path", F.col("span_start").cast("long").alias("point"))


@query(
    with_ctes("syms", "occs", recursive=True)
    + _TWINS
    + r""", per AS (SELECT descriptor, folder, count(*) AS n, min(symbol_id) AS symbol_id FROM twins GROUP BY 1, 2)
    , walk AS (
        SELECT occurrence_id, descriptor, document_path AS at, 0 AS step FROM refs
        UNION ALL SELECT w.occurrence_id, w.descriptor, regexp_replace(w.at, '/?[^/]*$', ''), step + 1 FROM walk w
        WHERE contains(w.at, '/') AND NOT EXISTS (SELECT 1 FROM per p WHERE p.descriptor = w.descriptor AND p.folder = w.at))
    , hit AS (SELECT w.occurrence_id, p.n, p.symbol_id FROM walk w JOIN per p ON p.descriptor = w.descriptor AND p.folder = w.at)
    SELECT r.occurrence_id, CASE WHEN h.n = 1 THEN h.symbol_id END AS symbol_id, CASE WHEN h.n = 1 THEN 'aligned' ELSE 'duplicate_ambiguous' END AS outcome
    FROM refs r LEFT JOIN hit h ON h.occurrence_id = r.occurrence_id"""
)
def twins_by_ancestor(spark, d):
    """Which twin a reference means: the one in the nearest folder up its path that holds any."""
    refs = _references(spark, d)
    places = F.split("document_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(places) - 1), lambda i: F.struct(F.array_join(F.slice(places, F.lit(1), i + 1), "/").alias("document"), F.array_join(F.slice(places, F.lit(1), i), "/").alias("parent")))
    parents = refs.where("contains(document_path, '/')").select(F.explode(above).alias("x")).select("x.document", "x.parent").distinct()
    return alignment.select_twins(refs, _twins(spark, d).select("descriptor", F.col("folder").alias("document_path"), "symbol_id"), parents)


@query(
    with_ctes("syms", "occs")
    + _TWINS
    + """, du AS (SELECT DISTINCT document_path, workspace_id FROM syms WHERE document_path IS NOT NULL)
    , per AS (SELECT r.occurrence_id, count(*) AS n, min(t.symbol_id) AS symbol_id FROM refs r JOIN du ON du.document_path = r.document_path JOIN twins t ON t.descriptor = r.descriptor AND t.workspace_id = du.workspace_id GROUP BY 1)
    SELECT occurrence_id, symbol_id FROM per WHERE n = 1"""
)
def twins_by_unit(spark, d):
    s = symbols(spark, d).where("document_path IS NOT NULL")
    return alignment.select_twins_by_unit(_references(spark, d), _twins(spark, d), s.select(F.col("document_path").alias("document"), F.col("workspace_id").alias("unit")).distinct(), s.select(F.col("canonical_id").alias("symbol_id"), F.col("workspace_id").alias("unit")))


_SCOPES = """, scopes AS (
        SELECT document_path, span_start AS a, span_end AS z FROM syms WHERE document_path IS NOT NULL
        UNION SELECT document_path, 0, max(span_end) + 1000000 FROM syms WHERE document_path IS NOT NULL GROUP BY 1)"""


@query(
    with_ctes("syms", "occs")
    + _TWINS
    + _SCOPES
    + """, held AS (
        SELECT r.occurrence_id, s.a, s.z, count(DISTINCT t.symbol_id) AS n, min(t.symbol_id) AS symbol_id
        FROM refs r JOIN scopes s ON s.document_path = r.document_path AND s.a <= r.point AND r.point < s.z
        JOIN twins t ON t.descriptor = r.descriptor AND t.document_path = r.document_path AND s.a <= t.span_start AND t.span_start < s.z GROUP BY 1, 2, 3)
    , best AS (SELECT *, row_number() OVER (PARTITION BY occurrence_id ORDER BY z - a, n, symbol_id) AS rn FROM held)
    SELECT occurrence_id, symbol_id FROM best WHERE rn = 1 AND n = 1"""
)
def twins_by_scope(spark, d):
    s = symbols(spark, d).where("document_path IS NOT NULL")
    scopes = s.select("document_path", F.col("span_start").cast("long").alias("start"), F.col("span_end").cast("long").alias("end"))
    whole = s.groupBy("document_path").agg(F.lit(0).cast("long").alias("start"), (F.max("span_end") + 1_000_000).cast("long").alias("end"))
    return alignment.select_twins_by_scope(_references(spark, d), _twins(spark, d).withColumn("start", F.col("span_start")), scopes.unionByName(whole).distinct())


@query(with_ctes("syms") + _TWINS.split(", refs AS")[0] + " SELECT descriptor, regexp_replace(min(symbol_id), '#[0-9]+$', '') AS identity FROM twins GROUP BY 1")
def twin_bases(spark, d):
    return alignment.group_bases(_twins(spark, d))


# --- discrepancies --------------------------------------------------------------

_REFUSED = """, refused AS (
        SELECT id AS discrepancy_id, CASE WHEN locality IS NULL THEN symbol_id END AS symbol_id, CASE WHEN locality IS NOT NULL THEN regexp_extract(symbol_id, '([^:]*)$', 1) END AS duplicate_group, document_path, span_start
        FROM occs WHERE locality IS NOT NULL OR rule <> 'exact')
    , members AS (SELECT regexp_extract(canonical_id, '([^:]*)$', 1) AS duplicate_group, canonical_id AS symbol_id FROM syms)
    , links AS (
        SELECT discrepancy_id, symbol_id FROM refused WHERE symbol_id IS NOT NULL
        UNION SELECT r.discrepancy_id, m.symbol_id FROM refused r JOIN members m ON m.duplicate_group = r.duplicate_group WHERE r.symbol_id IS NULL)"""


def _refused(spark, d):
    last = F.regexp_extract("symbol_id", r"([^:]*)$", 1)
    o = occurrences(spark, d).where("locality IS NOT NULL OR rule <> 'exact'")
    return o.select(F.col("id").alias("discrepancy_id"), F.when(F.col("locality").isNull(), F.col("symbol_id")).alias("symbol_id"), F.when(F.col("locality").isNotNull(), last).alias("duplicate_group"), "document_path", "span_start")


def _links(spark, d):
    members = symbols(spark, d).select(F.regexp_extract("canonical_id", r"([^:]*)$", 1).alias("duplicate_group"), F.col("canonical_id").alias("symbol_id"))
    return units.discrepancy_links(_refused(spark, d), members)


@query(with_ctes("syms", "occs") + _REFUSED + " SELECT discrepancy_id, symbol_id FROM links")
def discrepancy_links(spark, d):
    """Occurrences accepted by other rules than the exact one stand for refused references."""
    return _links(spark, d)


@query(
    with_ctes("syms", "occs")
    + _REFUSED
    + """, few AS (SELECT discrepancy_id, list(symbol_id ORDER BY symbol_id)[:10] AS candidates, count(*) AS total FROM links GROUP BY 1)
    SELECT l.symbol_id, l.discrepancy_id, r.document_path, r.span_start, array_to_string(f.candidates, ' ') AS candidates, f.total
    FROM links l JOIN refused r ON r.discrepancy_id = l.discrepancy_id JOIN few f ON f.discrepancy_id = l.discrepancy_id"""
)
def unconfirmed_uses(spark, d):
    out = units.unconfirmed_uses(materialize(_links(spark, d), "links"), _refused(spark, d))
    return out.withColumn("candidates", F.array_join("candidates", " "))


@query(
    with_ctes("syms", "occs")
    + """, calls AS (SELECT DISTINCT o.document_path, s.display_name AS name, o.span_start AS start, o.span_end AS "end" FROM occs o JOIN syms s ON s.canonical_id = o.symbol_id WHERE o.role = 'reference' AND s.kind IN ('function', 'method'))
    , covered AS (SELECT document_path, span_start, span_end FROM occs WHERE id % 3 <> 0)
    SELECT c.name, count(*) AS calls FROM calls c WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE v.document_path = c.document_path AND v.span_start = c.start AND v.span_end = c."end") GROUP BY 1"""
)
def unresolved_calls_named(spark, d):
    """Calls by name that no occurrence covers, where two thirds of the occurrences are known."""
    names = symbols(spark, d).where("kind IN ('function', 'method')").select(F.col("canonical_id").alias("symbol_id"), F.col("display_name").alias("name"))
    o = occurrences(spark, d)
    calls = o.where("role = 'reference'").join(names, "symbol_id").select("document_path", F.lit("call").alias("fact"), "name", F.lit(None).cast("string").alias("detail"), F.col("span_start").alias("start"), F.col("span_end").alias("end")).distinct()
    return syntax.unresolved_calls(calls, o.where("id % 3 <> 0")).groupBy("name").agg(F.count(F.lit(1)).alias("calls"))


# --- overrides and containment --------------------------------------------------

#: Methods in the types of their documents; each fifth type of a workspace starts a chain of bases.
_METHODS = """, methods AS (SELECT document_path AS container, split_part(display_name, '_', 1) AS name, canonical_id AS method, workspace_id FROM syms WHERE kind = 'method' AND document_path IS NOT NULL)
    , numbered AS (SELECT container, lag(container) OVER w AS base, row_number() OVER w AS rn FROM (SELECT DISTINCT container, workspace_id FROM methods) WINDOW w AS (PARTITION BY workspace_id ORDER BY container))
    , bases AS (SELECT DISTINCT container AS type, base FROM numbered WHERE base IS NOT NULL AND rn % 5 <> 1)"""


def _methods(spark, d):
    return symbols(spark, d).where("kind = 'method' AND document_path IS NOT NULL").select(F.col("document_path").alias("container"), F.substring_index("display_name", "_", 1).alias("name"), F.col("canonical_id").alias("method"), "workspace_id")


def _bases(spark, d):
    w = Window.partitionBy("workspace_id").orderBy("container")
    numbered = _methods(spark, d).select("container", "workspace_id").distinct().select("container", F.lag("container").over(w).alias("base"), F.row_number().over(w).alias("rn"))
    return numbered.where("base IS NOT NULL AND rn % 5 <> 1").select(F.col("container").alias("type"), "base").distinct()


@query(
    with_ctes("syms")
    + _METHODS
    + """ SELECT DISTINCT 'overrides' AS kind, a.method AS src, b.method AS dst FROM bases h JOIN methods a ON a.container = h.type JOIN methods b ON b.container = h.base AND b.name = a.name WHERE h.type <> h.base"""
)
def override_edges(spark, d):
    return graph.override_edges(_methods(spark, d), _bases(spark, d).select(F.col("type").alias("src"), F.col("base").alias("dst")))


@query(
    with_ctes("syms", recursive=True)
    + _METHODS
    + """, bound AS (SELECT container AS type, name, max(CASE WHEN method NOT LIKE '%e' THEN method END) AS method FROM methods GROUP BY 1, 2)
    , walk AS (
        SELECT method AS src, name, type AS at FROM bound WHERE method IS NOT NULL
        UNION SELECT w.src, w.name, b.base FROM walk w JOIN bases b ON b.type = w.at
            WHERE NOT EXISTS (SELECT 1 FROM bound x WHERE x.type = w.at AND x.name = w.name AND x.method IS DISTINCT FROM w.src))
    SELECT DISTINCT w.src, x.method AS dst FROM walk w JOIN bound x ON x.type = w.at AND x.name = w.name WHERE x.method IS NOT NULL AND x.method <> w.src"""
)
def overrides_looked_through(spark, d):
    bindings = _methods(spark, d).select(F.col("container").alias("type"), "name", F.when(~F.col("method").endswith("e"), F.col("method")).alias("method"))
    return units.look_through_overrides(bindings, _bases(spark, d))


#: The type that starts last before a symbol in its document stands for the one around it.
_HOLDS = """, holds AS (
        SELECT c.canonical_id AS dst, arg_max(t.canonical_id, (t.span_start, t.canonical_id)) AS src FROM syms c JOIN syms t ON t.document_path = c.document_path AND t.kind = 'type' AND t.span_start < c.span_start
        WHERE c.kind <> 'type' GROUP BY 1)"""


def _holds(spark, d):
    s = symbols(spark, d).where("document_path IS NOT NULL")
    w = Window.partitionBy("document_path").orderBy("span_start", "canonical_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == "type", F.struct("span_start", "canonical_id")), ignorenulls=True).over(w)
    near = s.select("canonical_id", "kind", "span_start", last.alias("t"))
    return near.where("kind <> 'type' AND t IS NOT NULL AND t.span_start < span_start").select(F.lit("contains").alias("kind"), F.col("t.canonical_id").alias("src"), F.col("canonical_id").alias("dst"))


@query(
    with_ctes("syms")
    + _HOLDS
    + """ SELECT canonical_id AS node, canonical_id AS type FROM syms WHERE kind IN ('type', 'trait') UNION ALL SELECT h.dst, h.src FROM holds h JOIN syms s ON s.canonical_id = h.dst WHERE s.kind <> 'trait'"""
)
def declaring_types(spark, d):
    return graph.declaring_type(symbols(spark, d), _holds(spark, d))


@query(with_ctes("syms") + _HOLDS + " SELECT src AS node, dst AS other FROM holds")
def contained_symbols(spark, d):
    return graph.neighbours(_holds(spark, d), ["contains"])


@query(with_ctes("syms") + _HOLDS + " SELECT dst AS node, src AS other FROM holds")
def container_symbols(spark, d):
    return graph.neighbours(_holds(spark, d), ["contains"], forward=False)


# --- regions and pages ----------------------------------------------------------

@query(
    with_ctes("syms")
    + """, p AS (SELECT DISTINCT regexp_extract(document_path, '^[^/]*/[^/]*', 0) AS prefix FROM syms WHERE document_path LIKE '%/%/%' AND document_path LIKE '%.py')
    SELECT DISTINCT document_path AS before, CASE WHEN kind = 'type' THEN NULL ELSE 'moved/' || document_path END AS after FROM syms s
    WHERE document_path IS NOT NULL AND EXISTS (SELECT 1 FROM p WHERE s.document_path = p.prefix OR s.document_path LIKE p.prefix || '/%' OR (kind <> 'type' AND 'moved/' || s.document_path LIKE p.prefix || '/%'))"""
)
def narrowed_changes(spark, d):
    """Changed files below the folders that hold Python sources two levels down."""
    s = symbols(spark, d).where("document_path IS NOT NULL")
    changes = s.select(F.col("document_path").alias("before"), F.when(F.col("kind") != "type", F.concat(F.lit("moved/"), "document_path")).alias("after"))
    prefixes = s.where("document_path LIKE '%/%/%' AND document_path LIKE '%.py'").select(F.regexp_extract("document_path", r"^[^/]*/[^/]*", 0).alias("prefix"))
    return impact.narrow_to_paths(changes, prefixes)


@query(
    with_ctes("occs")
    + """, r AS (SELECT symbol_id, id, row_number() OVER (PARTITION BY symbol_id ORDER BY document_path, span_start, id) AS rn, count(*) OVER (PARTITION BY symbol_id) AS total FROM occs WHERE role = 'reference')
    SELECT symbol_id, id, total FROM r WHERE rn <= 3"""
)
def capped_references(spark, d):
    return paging.capped_groups(occurrences(spark, d).where("role = 'reference'"), ["symbol_id"], [F.col("document_path"), F.col("span_start"), F.col("id")], 3).select("symbol_id", "id", "total")


@query(
    with_ctes("occs")
    + """, r AS (SELECT DISTINCT document_path AS passage_a, symbol_id AS passage_b, span_start AS a_start, start_line AS b_start, span_end - span_start AS length FROM occs WHERE start_line IS NOT NULL AND document_path IS NOT NULL AND span_start IS NOT NULL AND span_end IS NOT NULL)
    SELECT x.* FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.passage_a = x.passage_a AND y.passage_b = x.passage_b AND y.a_start <= x.a_start AND x.a_start + x.length <= y.a_start + y.length
        AND y.b_start <= x.b_start AND x.b_start + x.length <= y.b_start + y.length AND (y.length > x.length OR y.a_start <> x.a_start OR y.b_start <> x.b_start))"""
)
def uncontained_runs(spark, d):
    """Runs that lie in no longer run of their pair; occurrences stand for runs."""
    o = occurrences(spark, d).where("start_line IS NOT NULL AND document_path IS NOT NULL AND span_start IS NOT NULL AND span_end IS NOT NULL")
    runs = o.select(F.col("document_path").alias("passage_a"), F.col("symbol_id").alias("passage_b"), F.col("span_start").alias("a_start"), F.col("start_line").alias("b_start"), (F.col("span_end") - F.col("span_start")).alias("length")).distinct()
    return clones.drop_contained(runs)


# --- what a backend gives -------------------------------------------------------

_GIVEN = """, given AS (SELECT regexp_replace(symbol_id, '#[0-9]+$', '') AS symbol, document_path, start_line, start_column AS start_character, start_line AS end_line, start_column + span_end - span_start AS end_character, role = 'definition' AS is_definition FROM occs)"""


def _given(spark, d):
    o = occurrences(spark, d)
    return o.select(tx.without_rank(F.col("symbol_id")).alias("symbol"), "document_path", "start_line", F.col("start_column").alias("start_character"), F.col("start_line").alias("end_line"), (F.col("start_column") + F.col("span_end") - F.col("span_start")).alias("end_character"), (F.col("role") == "definition").alias("is_definition"))


@query(with_ctes("occs") + _GIVEN + " SELECT symbol, CASE WHEN count(*) FILTER (is_definition) > 0 THEN 'in_workspace' ELSE 'external' END AS class, count(*) FILTER (is_definition) AS definitions, count(*) FILTER (NOT is_definition) AS \"references\" FROM given WHERE symbol NOT LIKE 'local %' AND symbol <> '' GROUP BY 1")
def classified_symbols(spark, d):
    return semantic_index.classified(_given(spark, d))


@query(
    with_ctes("occs")
    + _GIVEN
    + r""" SELECT 'symbol' AS clause, count(*) FILTER (coalesce(symbol, '') = '') AS violations FROM given
    UNION ALL SELECT 'path', count(*) FILTER (coalesce(document_path, '') = '' OR document_path LIKE '/%' OR regexp_matches(document_path, '\\|(^|/)\.\.?(/|$)')) FROM given
    UNION ALL SELECT 'range', count(*) FILTER (end_character < start_character OR least(start_line, start_character) < 0) FROM given
    UNION ALL SELECT 'role', count(*) FILTER (is_definition IS NULL) FROM given"""
)
def backend_conformance(spark, d):
    return backend.conformance(_given(spark, d))


@query(
    with_ctes("occs")
    + _GIVEN
    + """, defs AS (SELECT DISTINCT symbol, document_path, start_line, start_character FROM given WHERE is_definition), n AS (SELECT symbol, count(*) AS n FROM defs GROUP BY 1)
    SELECT CASE WHEN coalesce(n.n, 0) <= 1 THEN g.symbol END AS symbol, CASE WHEN n.n > 1 THEN g.symbol END AS duplicate_group, count(*) AS "references" FROM given g LEFT JOIN n ON n.symbol = g.symbol WHERE NOT g.is_definition GROUP BY 1, 2"""
)
def duplicate_references(spark, d):
    return backend.split_duplicates(_given(spark, d))[1].groupBy("symbol", "duplicate_group").agg(F.count(F.lit(1)).alias("references"))


@query("SELECT workspace_id, fragment_kgram_length AS kgram, fragment_window AS \"window\", fragment_kgram_length + fragment_window - 1 AS guaranteed FROM index_metadata")
def fragment_lengths(spark, d):
    from lodestrata.build import Parameters

    m = table(spark, d, "index_metadata")
    return m.select("workspace_id", F.col("fragment_kgram_length").alias("kgram"), F.col("fragment_window").alias("window"), Parameters(F.col("fragment_kgram_length"), F.col("fragment_window")).guaranteed_length().alias("guaranteed"))
