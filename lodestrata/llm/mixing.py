"""A mixture of sources with target shares, within a limit of repetitions.

Budgets flow down a tree of domains, languages and sources: the root's budget is
split over the first level by weight, each of those over the next, down to the
leaves. A source's target is divided among its languages by what there is, and
weights add up towards the root. A node that cannot use its part (its documents
times the repetitions allowed are too small) leaves the rest to its siblings;
only what no sibling can take goes up to its ancestors' siblings. A leaf is
filled by whole epochs and, in the last one, by the longest prefix of its
documents in a seeded order that fits.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.encode import TOKENIZERS, VOCABULARY, token_sizes
from lodestrata.runtime import materialize

#: Leaves of a tree at most: sources of the targets times known languages and one for all others.
MOST_LEAVES = 100_000
#: The domain of all sources where none are named.
ONE_DOMAIN = "all"
#: Languages kept apart, with other codes in use for them (fixed values).
LANGUAGES = {"en": "en", "eng": "en", "de": "de", "deu": "de", "ger": "de", "fr": "fr", "fra": "fr", "fre": "fr", "es": "es", "spa": "es", "ru": "ru", "rus": "ru", "zh": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "ja": "ja", "jpn": "ja", "jp": "ja", "hi": "hi", "hin": "hi", "ar": "ar", "ara": "ar", "th": "th", "tha": "th"}


@dataclass
class Node:
    """A node of the tree: its weight among its siblings and, for leaves, what there is."""

    name: str
    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)
    budget: float = 0.0

    def room(self) -> float:
        return sum(c.room() for c in self.children.values()) if self.children else self.capacity


def share_out(node: Node, budget: float) -> None:
    """Give ``budget`` to ``node``; siblings share what one of them cannot take, by weight."""
    node.budget = min(budget, node.room())
    open_nodes, left = list(node.children.values()), node.budget
    given = {id(c): 0.0 for c in open_nodes}
    while open_nodes and left > 1e-9:
        total = sum(c.weight for c in open_nodes)
        if total <= 0:
            # only children without a target have room: they share by what they have
            total = sum(c.room() for c in open_nodes)
            parts = {id(c): left * c.room() / total if total else 0.0 for c in open_nodes}
        else:
            parts = {id(c): left * c.weight / total for c in open_nodes}
        full = [c for c in open_nodes if given[id(c)] + parts[id(c)] >= c.room()]
        if not full:
            for c in open_nodes:
                given[id(c)] += parts[id(c)]
            break
        for c in full:
            left -= c.room() - given[id(c)]
            given[id(c)] = c.room()
        filled = {id(c) for c in full}
        open_nodes = [c for c in open_nodes if id(c) not in filled]
    for c in node.children.values():
        share_out(c, given[id(c)])


def normal_source(column):
    """A source's name as the targets spell it: lower case, underscores, no blanks around."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s-]+", "_")


def normal_language(column):
    code = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(known, code), F.lit("und"))


def _sized(documents: DataFrame, targets: DataFrame, seed: int, tokenizers: str, vocabulary: str) -> DataFrame:
    """(doc_id, source, language, tokens, place) of the documents that can be used."""
    names = targets.select(F.col("source")).where("source IS NOT NULL").distinct()
    described = documents.where("doc_id IS NOT NULL").select("doc_id", normal_source(F.col("source")).alias("source"), normal_language(F.col("lang")).alias("language")).join(names, "source")
    sizes = token_sizes(documents, tokenizers, vocabulary).where("tokens > 0")
    return materialize(described.join(sizes, "doc_id").withColumn("place", F.xxhash64(F.lit(seed), "doc_id")), "sized")


def _budgets(sized: DataFrame, targets: DataFrame, total: float | None, domains: dict[str, str] | None) -> list[tuple]:
    """(source, language, epochs, rest, parts) of each leaf; parts is how many ranges its seeded order is looked at in."""
    leaves = sized.groupBy("source", "language").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MOST_LEAVES + 1).collect()
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).limit(MOST_LEAVES + 1).collect()
    if max(len(leaves), len(wanted)) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    root = Node("all")
    share, repeats, held = {}, {}, {}
    for r in sorted(wanted, key=lambda r: r["source"]):
        domain = _domain(r["source"], domains)
        # a source without documents still counts for its domain, whose other sources then take its part
        root.children.setdefault(domain, Node(domain)).weight += r["share"] or 0.0
        share[r["source"]] = r["share"] or 0.0
        repeats[r["source"]] = max(0, r["repeats"] if r["repeats"] is not None else 1)
    for r in leaves:
        held[r["source"]] = held.get(r["source"], 0) + r["tokens"]
    for r in sorted(leaves, key=lambda r: (r["language"], r["source"])):
        languages = root.children[_domain(r["source"], domains)].children
        weight = share[r["source"]] * r["tokens"] / held[r["source"]]
        node = languages.setdefault(r["language"], Node(r["language"]))
        node.weight += weight
        node.children[r["source"]] = Node(r["source"], weight=weight, capacity=float(r["tokens"] * repeats[r["source"]]))
    share_out(root, float(sum(held.values())) if total is None else float(total))
    out = []
    for r in leaves:
        leaf = root.children[_domain(r["source"], domains)].children[r["language"]].children[r["source"]]
        epochs = int((leaf.budget + 1e-6) // r["tokens"])
        # as many ranges as each holds documents, so that neither their number nor their size gets large
        out.append((r["source"], r["language"], epochs, int(leaf.budget + 1e-6 - epochs * r["tokens"]), isqrt(r["n"] - 1) + 1))
    return out


def _domain(source: str, domains: dict[str, str] | None) -> str:
    return ONE_DOMAIN if domains is None else domains.get(source, "other")


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, domains: dict[str, str] | None = None, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(chosen, report).

    ``chosen``: doc_id, source, language, tokens, copies (1 to max_repeats).
    ``report``: one row per source of the targets with domain, target_share,
    documents, copies, available_tokens, tokens and actual_share.

    ``total`` tokens (by default as many as the documents of the targets'
    sources hold) are shared out over domains, their languages and the sources
    in these. ``domains`` names the domain of each source (others: "other");
    without it all sources form one. Documents whose text is null or has no
    token, or whose source is no target, are not used. A source without
    documents is reported with 0. Equal seeds give equal mixtures.
    """
    spark = documents.sparkSession
    sized = _sized(documents, targets, seed, tokenizers, vocabulary)
    # one row a leaf, MOST_LEAVES at most
    plan = F.broadcast(spark.createDataFrame(_budgets(sized, targets, total, domains), "source string, language string, epochs int, rest long, parts int"))
    part = F.least(F.floor((F.col("place").cast("double") + 2.0**63) / 2.0**64 * F.col("parts")).cast("int"), F.col("parts") - 1)
    rows = sized.join(plan, ["source", "language"]).withColumn("part", part)
    per_part = rows.groupBy("source", "language", "part").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
    w = Window.partitionBy("source", "language").orderBy("part")  # the square root of the leaf's documents
    before = per_part.withColumn("before", F.sum("sum").over(w) - F.col("sum"))
    # the range in which the rest of the budget ends, one a leaf
    edges = before.where(F.col("before") + F.col("sum") > F.col("rest")).groupBy("source", "language").agg(F.min(F.struct("part", "before")).alias("e"))
    placed = rows.join(F.broadcast(edges.select("source", "language", F.col("e.part").alias("edge"), F.col("e.before").alias("before"))), ["source", "language"])
    within = Window.partitionBy("source", "language").orderBy("place", "doc_id")  # of the edge alone
    edge = placed.where("part = edge").withColumn("up_to", F.col("before") + F.sum("tokens").over(within))
    edge = edge.withColumn("extra", (F.col("up_to") <= F.col("rest")).cast("int"))
    sure = placed.where("part <> edge").withColumn("extra", (F.col("part") < F.col("edge")).cast("int"))
    columns = ["doc_id", "source", "language", "tokens", (F.col("epochs") + F.col("extra")).alias("copies")]
    chosen = materialize(sure.select(*columns).unionByName(edge.select(*columns)).where("copies > 0"), "mixture")
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    domain = F.lit(ONE_DOMAIN) if domains is None else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in domains.items() for x in pair]), F.col("source")), F.lit("other"))
    whole = Window.partitionBy()
    report = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(have, "source", "left").join(used, "source", "left")
    zero = F.lit(0).cast("long")
    report = report.select("source", domain.alias("domain"), "target_share", "max_repeats", *[F.coalesce(c, zero).alias(c) for c in ("documents", "copies", "available_tokens", "tokens")])
    report = report.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(whole), zero), F.lit(0.0)))
    return chosen, report
