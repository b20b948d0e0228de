"""Every semantic occurrence accepted by one rule at its place in the text, or refused.

The text at an occurrence's span has to spell what the occurrence means; a
cascade of rules says in which ways. What is accepted and what is refused always
add up to all occurrences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.status import ALIGNMENT_RULES, JOIN_OUTCOMES, counted_by
from lodestrata.runtime import materialize

#: Operators and the methods they stand for (fixed values).
OPERATORS = {
    "add": "+", "sub": "-", "mul": "*", "div": "/", "rem": "%", "neg": "-", "not": "!", "bitand": "&", "bitor": "|", "bitxor": "^", "shl": "<<", "shr": ">>",
    "add_assign": "+=", "sub_assign": "-=", "mul_assign": "*=", "div_assign": "/=", "rem_assign": "%=", "bitand_assign": "&=", "bitor_assign": "|=",
    "bitxor_assign": "^=", "shl_assign": "<<=", "shr_assign": ">>=", "eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=",
    "index": "[", "index_mut": "[", "deref": "*", "deref_mut": "*", "branch": "?",
}
#: Range signs and the types they stand for (fixed values).
RANGES = {"..": "Range", "..=": "RangeInclusive"}


def align(occurrences: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Occurrences with rule, outcome and the text found.

    ``occurrences``: occurrence_id, document_path, span_start, span_end (in
    characters), name (the symbol's last segment), kind, symbol_id. ``files``:
    document_path, text. ``aliases``: document_path, alias, name of imports
    under another name.

    Rules in order: exact spelling; ``crate``; an operator for its method; a
    module's whole document; ``self``/``Self``; a range sign; ``self`` in a use
    list; ``super``; a dotted module path that ends in the name; a zero-width
    mark at the origin of a module; and, second, an alias whose import was
    accepted for the same symbol. Others are text_mismatch; occurrences without
    a document are semantic_only.
    """
    text = files.select("document_path", "text")
    rows = occurrences.join(text, "document_path", "left")
    found = F.substring(F.col("text"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    rows = rows.withColumn("found", found).withColumn("length", F.length("text")).drop("text")
    op = F.element_at(F.create_map(*[F.lit(x) for p in OPERATORS.items() for x in p]), F.col("name"))
    rng = F.element_at(F.create_map(*[F.lit(x) for p in RANGES.items() for x in p]), F.col("found"))
    rust, python = F.col("document_path").endswith(".rs"), F.col("document_path").endswith(".py")
    module = F.col("kind") == "module"
    spelled = (F.col("found") == F.col("name")) | (F.col("found") == F.concat(F.lit("r#"), F.col("name")))
    rule = (
        F.when(F.col("found").isNull(), None)
        .when(spelled, "exact")
        .when(rust & (F.col("found") == "crate") & module, "crate_root")
        .when(rust & (F.col("found") == op), "operator_desugar")
        .when(module & (F.col("span_start") == 0) & (F.col("span_end") == F.col("length")) & (F.col("length") > 0), "module_span")
        .when(rust & F.col("found").isin("self", "Self") & ~module, "self_keyword")
        .when(rust & rng.isNotNull() & F.col("name").startswith("Range"), "range_literal")
        .when(rust & (F.col("found") == "self") & module, "use_list_self")
        .when(rust & (F.col("found") == "super") & module, "super_keyword")
        .when(python & module & F.col("found").rlike(r"^\.*(\w+\.)*\w*$") & (F.col("found") != "") & ((F.col("found") == F.col("name")) | F.col("found").endswith(F.concat(F.lit("."), F.col("name")))), "module_name")
        .when(python & module & (F.col("span_start") == 0) & (F.col("span_end") == 0), "module_marker")
    )
    first = rows.withColumn("rule", rule)
    if aliases is not None:
        accepted = first.where("rule IS NOT NULL").select("document_path", "symbol_id", "name").distinct()
        named = aliases.select("document_path", F.col("alias").alias("found"), "name").join(accepted, ["document_path", "name"])
        named = named.select("document_path", "found", "symbol_id", F.lit("import_alias").alias("by_alias")).distinct()
        first = first.join(named, ["document_path", "found", "symbol_id"], "left").withColumn("rule", F.coalesce("rule", "by_alias")).drop("by_alias")
    outcome = F.when(F.col("rule").isNotNull(), "aligned").when(F.col("length").isNull(), "semantic_only").otherwise("text_mismatch")
    return first.withColumn("outcome", outcome).drop("length")


#: Methods and the construct each stands for, where the syntax around the place is known (fixed values).
CONSTRUCTS = (
    {m: f"binary {OPERATORS[m]}" for m in "add sub mul div rem bitand bitor bitxor shl shr eq ne lt le gt ge".split()}
    | {m: f"compound {OPERATORS[m]}" for m in OPERATORS if m.endswith("_assign")}
    | {"neg": "unary -", "not": "unary !", "deref": "unary *", "deref_mut": "unary *", "index": "index", "index_mut": "index", "branch": "try"}
    | {"call": "call", "call_mut": "call", "call_once": "call", "into_iter": "for", "next": "for"}
)


def _base(column):
    """A type's last segment without generic arguments."""
    return F.element_at(F.split(F.regexp_replace(column, r"(?s)<.*$", ""), "::"), -1)


def align_at_places(occurrences: DataFrame, places: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Occurrences with rule and outcome by all rules, each held against the syntax around its place.

    ``occurrences``: occurrence_id (string), document_path, name, kind, role,
    symbol_id, package, dotted_name (a Python module's whole name), segments (a
    Rust module's names from its package down) and module_segments (those of the
    document's own module). ``places`` are the facts of ``place_facts`` for them.

    Beyond ``align``: ``Self`` asks that the impl around it is of the type or
    trait; a range sign that the ends it has make the type; ``self`` in a use
    list that the list's path ends in the module's name; ``super`` and a path's
    own ``self`` that the module is the one so many steps above the document's
    module with the inline modules around the place; an operator that the
    construct is the method's; a crate's root also its package's name; Python's
    modules a trailing run of components, also of a dotted name the place starts.
    """
    facts = places.select("occurrence_id", *[c for c in places.columns if c not in ("occurrence_id", "document_path", "span_start", "span_end")], F.col("span_start").alias("at"), F.col("span_end").alias("up_to"))
    rows = occurrences.join(facts, "occurrence_id", "left")
    rust, python = F.col("document_path").endswith(".rs"), F.col("document_path").endswith(".py")
    module, reference = F.col("kind") == "module", F.col("role") == "reference"
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in CONSTRUCTS.items() for x in pair]), F.col("name"))
    package = F.regexp_replace("package", "-", "_")
    here = F.concat(F.coalesce("module_segments", F.array().cast("array<string>")), F.coalesce("modules", F.array().cast("array<string>")))
    above = lambda n: F.when(F.size(here) - n > 0, F.slice(here, F.lit(1), F.greatest(F.size(here) - n, F.lit(0))))
    spelled = F.regexp_replace("found", r"^\.+", "")
    run = lambda text: (text == F.col("dotted_name")) | F.col("dotted_name").endswith(F.concat(F.lit("."), text))
    longer = F.exists(F.coalesce("dotted", F.array().cast("array<string>")), lambda x: run(F.regexp_replace(x, r"^\.+", "")))
    name_at = F.regexp_replace("name_at", "^r#", "")
    rule = (
        F.when(F.col("found").isNull(), None)
        .when(~(python & module) & (name_at == F.col("name")), "exact")
        .when(rust & (F.col("name") == "crate") & ((F.col("found") == "crate") | (F.col("name_at") == package)), "crate_root")
        .when(rust & reference & (F.col("construct") == wanted), "operator_desugar")
        .when(rust & ~reference & module & (F.col("at") == 0) & (F.col("up_to") == F.col("length")), "module_span")
        .when(rust & reference & ~module & (F.col("name_at") == "Self") & ((_base(F.col("impl_type")) == _base(F.col("name"))) | (_base(F.col("impl_trait")) == _base(F.col("name")))), "self_keyword")
        .when(rust & reference & (F.col("range_type") == _base(F.col("name"))), "range_literal")
        .when(rust & reference & module & (F.col("use_terminal") == F.col("name")), "use_list_self")
        .when(rust & reference & module & F.col("path_start_self") & (F.col("segments") == above(F.lit(0))), "self_name")
        .when(rust & reference & module & (F.col("segments") == above(F.col("super_depth"))), "super_keyword")
        .when(python & module & (spelled != "") & F.col("found").rlike(r"^\.*[^\W\d]\w*(?:\.[^\W\d]\w*)*$") & run(spelled), "module_name")
        .when(python & module & longer, "module_name")
        .when(python & module & (F.col("found") == "__name__") & (F.col("segments") == F.col("module_segments")), "self_name")
        .when(python & module & ~reference & (F.col("at") == 0) & (F.col("up_to") == 0), "module_marker")
    )
    first = rows.withColumn("rule", rule)
    if aliases is not None:
        accepted = first.where("rule IS NOT NULL").select("document_path", "symbol_id", "name").distinct()
        named = aliases.select("document_path", F.col("alias").alias("found"), "name").join(accepted, ["document_path", "name"])
        named = named.select("document_path", "found", "symbol_id", F.lit("import_alias").alias("by_alias")).distinct()
        first = first.join(named, ["document_path", "found", "symbol_id"], "left").withColumn("rule", F.coalesce("rule", "by_alias"))
    outcome = F.when(F.col("rule").isNotNull(), "aligned").when(F.col("length").isNull(), "semantic_only").otherwise("text_mismatch")
    return first.select("occurrence_id", "document_path", "symbol_id", "name", "found", "rule", outcome.alias("outcome"))


def accounts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by rule and by outcome, zero-valued members included."""
    return counted_by(aligned.where("rule IS NOT NULL"), "rule", ALIGNMENT_RULES), counted_by(aligned, "outcome", JOIN_OUTCOMES)


def select_twins(references: DataFrame, twins: DataFrame, parents: DataFrame) -> DataFrame:
    """(occurrence_id, symbol_id, outcome) of references to a descriptor that several documents define.

    Walks from the reference's document through parents (document, parent) to
    the first that defines any twin (descriptor, document_path, symbol_id): one
    there is chosen, several are ambiguous; a walk that ends or goes in a circle
    finds none. All references walk together, one join a step.
    """
    per = twins.groupBy("descriptor", "document_path").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("symbol_id"))
    walking = references.select("occurrence_id", "descriptor", F.col("document_path").alias("at"), F.array("document_path").alias("seen"))
    done = None
    while True:
        looked = materialize(walking.join(per.withColumnRenamed("document_path", "at"), ["descriptor", "at"], "left"), "twins")
        hit = looked.where("n IS NOT NULL").select("occurrence_id", F.when(F.col("n") == 1, F.col("symbol_id")).alias("symbol_id"), F.when(F.col("n") == 1, "aligned").otherwise("duplicate_ambiguous").alias("outcome"))
        done = hit if done is None else done.unionByName(hit)
        left = looked.where("n IS NULL").select("occurrence_id", "descriptor", "at", "seen")
        walking = left.join(parents.select(F.col("document").alias("at"), "parent"), "at").where(~F.array_contains("seen", F.col("parent"))).select("occurrence_id", "descriptor", F.col("parent").alias("at"), F.concat("seen", F.array("parent")).alias("seen"))
        if walking.isEmpty():
            break
    none = references.select("occurrence_id").join(done, "occurrence_id", "left_anti").select("occurrence_id", F.lit(None).cast("string").alias("symbol_id"), F.lit("duplicate_ambiguous").alias("outcome"))
    return done.unionByName(none)


def select_twins_by_unit(references: DataFrame, twins: DataFrame, document_unit: DataFrame, symbol_unit: DataFrame) -> DataFrame:
    """(occurrence_id, symbol_id) where exactly one twin lies in the unit that compiles the reference's document."""
    unit = references.select("occurrence_id", "descriptor", F.col("document_path").alias("document")).join(document_unit.select("document", "unit"), "document")
    own = twins.select("descriptor", "symbol_id").join(symbol_unit.select("symbol_id", "unit"), "symbol_id")
    per = unit.join(own, ["descriptor", "unit"]).groupBy("occurrence_id").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("symbol_id"))
    return per.where("n = 1").select("occurrence_id", "symbol_id")


def select_twins_by_scope(references: DataFrame, twins: DataFrame, spans: DataFrame) -> DataFrame:
    """(occurrence_id, symbol_id) by the innermost declaration around the reference that holds any twin of its document.

    ``references``: occurrence_id, descriptor, document_path, point; ``twins``:
    descriptor, document_path, symbol_id, start; ``spans``: document_path, start,
    end of declarations. That declaration has to hold exactly one twin.
    """
    from lodestrata.operators.intervals import spans_of_points

    around = spans_of_points(references.select("occurrence_id", "descriptor", "document_path", "point"), spans.select("document_path", "start", "end"))
    held = around.join(twins.select("descriptor", "document_path", "symbol_id", F.col("start").alias("at")), ["descriptor", "document_path"]).where("start <= at AND at < `end`")
    per = held.groupBy("occurrence_id", "start", "end").agg(F.countDistinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id"))
    inner = per.groupBy("occurrence_id").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("w"), "n", "symbol_id")).alias("m"))
    return inner.where("m.n = 1").select("occurrence_id", F.col("m.symbol_id").alias("symbol_id"))


def group_bases(twins: DataFrame) -> DataFrame:
    """(descriptor, identity): the identity a group of twins goes by: its least one without the collision's number."""
    return twins.groupBy("descriptor").agg(F.regexp_replace(F.min("symbol_id"), r"#[0-9]+$", "").alias("identity"))


def join_group(references: DataFrame, twins: DataFrame, parents: DataFrame, places: DataFrame) -> DataFrame:
    """(occurrence_id, symbol_id, rule, outcome) of references to descriptors that several documents define.

    The twin is chosen by locality as in ``select_twins``; then the place has to
    pass the rules for the chosen one. ``references``: occurrence_id (string),
    descriptor, document_path, role, package, dotted_name, segments,
    module_segments; ``twins``: descriptor, document_path, symbol_id, name, kind.
    Without one nearest twin the outcome is duplicate_ambiguous, with a place
    that no rule accepts text_mismatch. Every reference comes once.
    """
    chosen = materialize(select_twins(references, twins, parents), "chosen")
    named = twins.select("symbol_id", "name", "kind").dropDuplicates(["symbol_id"])
    taken = references.join(chosen.where("symbol_id IS NOT NULL").select("occurrence_id", "symbol_id"), "occurrence_id").join(named, "symbol_id")
    judged = align_at_places(taken, places).select("occurrence_id", "symbol_id", "rule", "outcome")
    none = F.lit(None).cast("string")
    return judged.unionByName(chosen.where("symbol_id IS NULL").select("occurrence_id", none.alias("symbol_id"), none.alias("rule"), F.lit("duplicate_ambiguous").alias("outcome")))
