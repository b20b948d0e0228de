"""Build units, test code and overriding methods: walks over declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import in_tests_directory, is_python_test_file
from lodestrata.runtime import materialize


def module_file_candidates(requests: DataFrame) -> DataFrame:
    """(document, name, candidate) files that ``mod name;`` in a document may mean.

    ``requests`` has document, name and path (the path attribute or null). A
    root or ``mod`` file looks beside itself, another below a folder of its own name.
    """
    folder = F.regexp_replace("document", r"[^/]*$", "")
    stem = F.regexp_extract("document", r"([^/]*)\.rs$", 1)
    base = F.when(stem.isin("lib", "main", "mod"), folder).otherwise(F.concat(folder, stem, F.lit("/")))
    plain = F.array(F.concat(base, "name", F.lit(".rs")), F.concat(base, "name", F.lit("/mod.rs")))
    return requests.select("document", "name", F.explode(F.when(F.col("path").isNotNull(), F.array(F.concat(folder, "path"))).otherwise(plain)).alias("candidate"))


def declared_by(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, parent): files that exist and the files that declare them."""
    there = documents.select(F.col("document_path").alias("candidate")).distinct()
    return module_file_candidates(requests).join(there, "candidate", "left_semi").select(F.col("candidate").alias("document"), F.col("document").alias("parent")).distinct()


def unique_module_files(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, name, candidate): requests of modules that fit exactly one file there is."""
    there = documents.select(F.col("document_path").alias("candidate")).distinct()
    fit = module_file_candidates(requests).join(there, "candidate", "left_semi")
    return fit.groupBy("document", "name").agg(F.count(F.lit(1)).alias("n"), F.min("candidate").alias("candidate")).where("n = 1").select("document", "name", "candidate")


def target_reach(targets: DataFrame, declared: DataFrame) -> DataFrame:
    """(target, document): all files each build target (target, root) reaches through declarations."""
    down = materialize(declared.select(F.col("parent").alias("at"), "document").distinct(), "declared")
    reached = frontier = targets.select("target", F.col("root").alias("document")).distinct()
    while True:
        step = frontier.withColumnRenamed("document", "at").join(down, "at").select("target", "document").distinct()
        frontier = materialize(step.join(reached, ["target", "document"], "left_anti"), "reach")
        if frontier.isEmpty():
            break
        reached = materialize(reached.unionByName(frontier), "reach")
    return reached


def classify_tests(symbols: DataFrame, attributed: DataFrame, gated: DataFrame, declared: DataFrame) -> DataFrame:
    """(canonical_id, test_rule) of symbols that belong to tests.

    Rust: a test attribute on the symbol, else a test-only module around it or a
    file reached from one, else a ``tests`` folder. Python: the file's name, else
    the folder. ``attributed`` has canonical_id; ``gated`` document_path, start,
    end of test-only modules (nulls for whole files); ``declared`` document, parent.
    """
    whole = gated.where("start IS NULL").select(F.lit("t").alias("target"), F.col("document_path").alias("root"))
    files = target_reach(whole, declared).select(F.col("document").alias("document_path")).distinct().withColumn("by_file", F.lit(True))
    inside = symbols.select("canonical_id", "document_path", "span_start").join(gated.where("start IS NOT NULL"), "document_path").where("start <= span_start AND span_start < `end`").select("canonical_id").distinct().withColumn("by_module", F.lit(True))
    named = attributed.select("canonical_id").distinct().withColumn("by_attribute", F.lit(True))
    rows = symbols.select("canonical_id", "document_path").join(named, "canonical_id", "left").join(inside, "canonical_id", "left").join(files, "document_path", "left")
    path = F.col("document_path")
    rule = (
        F.when(path.endswith(".rs") & F.col("by_attribute"), "test_attribute")
        .when(path.endswith(".rs") & (F.col("by_module") | F.col("by_file")), "test_configuration")
        .when(path.endswith(".py") & is_python_test_file(path), "test_file")
        .when(in_tests_directory(path), "test_directory")
    )
    return rows.select("canonical_id", rule.alias("test_rule")).where("test_rule IS NOT NULL")


def look_through_overrides(bindings: DataFrame, bases: DataFrame) -> DataFrame:
    """(src, dst): each method and the method of the nearest base that binds its name.

    ``bindings`` has type, name, method (null where the name is bound to
    something else); ``bases`` has type, base. Names with a leading underscore
    pair that don't end in one are private and override nothing. A base that
    binds the name to no method hides what is behind it; a base reached on two
    ways is looked at once. All methods walk together, one hop a round.
    """
    private = F.col("name").startswith("__") & ~F.col("name").endswith("__")
    per = materialize(bindings.groupBy("type", "name").agg(F.max("method").alias("method")), "bindings")
    up = materialize(bases.select("type", "base").where("type <> base").distinct(), "bases")
    frontier = per.where(F.col("method").isNotNull() & ~private).select(F.col("method").alias("src"), "name", F.col("type").alias("at"))
    seen = frontier.select("src", "at")
    found = None
    while True:
        step = frontier.join(up.withColumnRenamed("type", "at"), "at").select("src", "name", F.col("base").alias("at")).distinct()
        step = materialize(step.join(seen, ["src", "at"], "left_anti"), "walk")
        if step.isEmpty():
            break
        seen = materialize(seen.unionByName(step.select("src", "at")), "walk-seen")
        looked = step.join(per.select(F.col("type").alias("at"), "name", "method", F.lit(True).alias("bound")), ["at", "name"], "left")
        hit = looked.where("method IS NOT NULL").select("src", F.col("method").alias("dst"))
        found = hit if found is None else found.unionByName(hit)
        frontier = looked.where("bound IS NULL").select("src", "name", "at")
    if found is None:
        found = per.select(F.col("method").alias("src"), F.col("method").alias("dst")).limit(0)
    return found.where("src <> dst").distinct()


def module_of_documents(symbols: DataFrame, definitions: DataFrame) -> DataFrame:
    """(document_path, canonical_id): the module that stands for each document.

    Of a document's modules the one with the widest definition occurrence, then
    the widest span, then the least id; without occurrence counts as narrowest.
    ``definitions`` has symbol_id, span_start, span_end.
    """
    width = definitions.groupBy(F.col("symbol_id").alias("canonical_id")).agg(F.max(F.col("span_end") - F.col("span_start")).alias("w"))
    rows = symbols.where("kind = 'module' AND document_path IS NOT NULL").join(width, "canonical_id", "left")
    order = Window.partitionBy("document_path").orderBy(F.coalesce("w", F.lit(-1)).desc(), (F.col("span_end") - F.col("span_start")).desc_nulls_last(), "canonical_id")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("document_path", "canonical_id")


def discrepancy_links(refused: DataFrame, members: DataFrame) -> DataFrame:
    """(discrepancy_id, symbol_id): refused references and the symbols they may mean.

    ``refused`` has discrepancy_id, symbol_id and duplicate_group (one of the two
    null); ``members`` has duplicate_group, symbol_id. A group links to all its members.
    """
    own = refused.where("symbol_id IS NOT NULL").select("discrepancy_id", "symbol_id")
    grouped = refused.where("symbol_id IS NULL AND duplicate_group IS NOT NULL").select("discrepancy_id", "duplicate_group").join(members, "duplicate_group").select("discrepancy_id", "symbol_id")
    return own.unionByName(grouped).distinct()


def unconfirmed_uses(links: DataFrame, discrepancies: DataFrame, most: int = 10) -> DataFrame:
    """(symbol_id, discrepancy_id, document_path, span_start, candidates, total) of a symbol's refused references.

    Ambiguous references name their first ``most`` candidates by id, and how many there are.
    """
    per = links.groupBy("discrepancy_id").agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("discrepancy_id").orderBy("symbol_id")
    few = links.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).groupBy("discrepancy_id").agg(F.array_sort(F.collect_list("symbol_id")).alias("candidates"))
    return links.join(discrepancies.select("discrepancy_id", "document_path", "span_start"), "discrepancy_id").join(per, "discrepancy_id").join(few, "discrepancy_id").select("symbol_id", "discrepancy_id", "document_path", "span_start", "candidates", "total")
