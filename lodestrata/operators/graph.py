"""Typed edges between symbols and walks over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.operators.reach import all_pairs
from lodestrata.runtime import bounded, materialize

#: Edge kinds that carry dependence, in the order that breaks ties (fixed values).
DEPENDENCE = ["uses", "imports", "type_hierarchy", "overrides"]
EDGE_KINDS = ["contains", *DEPENDENCE]
#: A walk's farthest hop, and PageRank's constants (fixed values).
HORIZON = 20
DAMPING, ITERATIONS = 0.85, 40


def kind_order(column: str = "kind"):
    """The place of an edge kind in the order of DEPENDENCE."""
    return F.array_position(F.array(*[F.lit(k) for k in DEPENDENCE]), F.col(column))


def edge_set(*parts: DataFrame) -> DataFrame:
    """Edges (kind, src, dst) as a set: null ends dropped, repeated rows once."""
    out = parts[0].select("kind", "src", "dst")
    for p in parts[1:]:
        out = out.unionByName(p.select("kind", "src", "dst"))
    return out.where("kind IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").distinct()


def reference_edges(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Dependence edges: the declaration around a reference depends on what it refers to.

    References to modules are imports, to types type_hierarchy, all others uses.
    References outside any declaration give none.
    """
    refs = occurrences.where("role = 'reference' AND enclosing_id IS NOT NULL").select("symbol_id", "enclosing_id").distinct()
    ends = symbols.select("canonical_id", "kind")
    kind = F.when(F.col("kind") == "module", "imports").when(F.col("kind") == "type", "type_hierarchy").otherwise("uses")
    known = refs.join(ends.withColumnRenamed("canonical_id", "symbol_id"), "symbol_id")
    known = known.join(symbols.select(F.col("canonical_id").alias("enclosing_id")), "enclosing_id", "left_semi")
    return edge_set(known.select(kind.alias("kind"), F.col("enclosing_id").alias("src"), F.col("symbol_id").alias("dst")))


def override_edges(methods: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """A method overrides the same-named method of a direct base: (container, name, method) and (src, dst)."""
    own = methods.select(F.col("container").alias("src"), "name", F.col("method").alias("m_src"))
    base = methods.select(F.col("container").alias("dst"), "name", F.col("method").alias("m_dst"))
    return edge_set(hierarchy.select("src", "dst").join(own, "src").join(base, ["dst", "name"]).where("src <> dst").select(F.lit("overrides").alias("kind"), F.col("m_src").alias("src"), F.col("m_dst").alias("dst")))


def _walk_in_one_task(horizon: int):
    """The whole walk over (a, b, k) rows: an edge from b to a of kind k, or a seed a where b is null."""

    def run(batches):
        next_: dict[str, list[tuple[str, int]]] = {}
        seeds = set()
        for batch in batches:
            for a, b, k in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "k"))):
                if b is None:
                    seeds.add(a)
                else:
                    next_.setdefault(a, []).append((b, k))
        near: dict[str, dict[str, int]] = {s: {s: 0} for s in seeds}
        frontier = [(s, s) for s in sorted(seeds)]
        for hop in range(1, horizon + 1):
            step = []
            for at, root in frontier:
                for x, _ in next_.get(at, ()):
                    have = near.setdefault(x, {})
                    if root not in have and len(have) < 2:
                        have[root] = hop
                        step.append((x, root))
            frontier = step
            if not frontier:
                break
        distance = {}
        for x, have in near.items():
            others = [d for root, d in have.items() if root != x]
            if others:
                distance[x] = min(others)
        kind: dict[str, int] = {}
        for at, links in next_.items():
            for x, k in links:
                d = distance.get(x)
                if d is not None and any(root != x and n == d - 1 for root, n in near.get(at, {}).items()):
                    kind[x] = min(k, kind.get(x, k))
        nodes = sorted(kind)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array([distance[x] for x in nodes], pa.int32()), pa.array([DEPENDENCE[kind[x] - 1] for x in nodes], pa.string())], ["node", "distance", "kind"])

    return run


def dependents(edges: DataFrame, seeds: DataFrame, horizon: int = HORIZON, one_task: int = 2_000_000) -> DataFrame:
    """Everything that depends on the seeds: (node, distance, kind).

    Runs from dst to src over dependence edges. Each node comes once, at its
    shortest hop, with the first kind (in the order of DEPENDENCE) among the
    edges that reach it at that hop. A seed comes only as the dependent of a
    different seed. ``seeds`` has a column ``node``; a depth of 0 gives nothing.

    Each node keeps at most two (distance, root) pairs with different roots: the
    nearest of all, and the nearest from another root. That decides both the
    distance of ordinary nodes and that of seeds, and bounds the state. A graph
    of at most ``one_task`` edges and seeds, which is counted first, is walked
    by one task. Beyond that every hop is one join with the frontier and one
    aggregation, written to the shared folder, and the walk ends with an empty
    frontier. Both ways give the same rows. Nodes are strings.
    """
    known = edges.where(F.col("kind").isin(DEPENDENCE))
    links = known.select(F.col("dst").alias("at"), F.col("src").alias("next"), kind_order().cast("int").alias("k")).groupBy("at", "next").agg(F.min("k").alias("k"))
    start = seeds.select("node").where("node IS NOT NULL").distinct()
    whole = materialize(links.select(F.col("at").alias("a"), F.col("next").alias("b"), "k").unionByName(start.select(F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("int").alias("k"))), "walk")
    if bounded(whole, one_task):
        return whole.coalesce(1).mapInArrow(_walk_in_one_task(horizon), "node string, distance int, kind string")
    links = whole.where("b IS NOT NULL").select(F.col("a").alias("at"), F.col("b").alias("next"), "k")
    start = whole.where("b IS NULL").select(F.col("a").alias("node"))
    reached = frontier = start.select("node", F.col("node").alias("root"), F.lit(0).alias("distance"))
    w = Window.partitionBy("node").orderBy("root")
    for hop in range(1, horizon + 1):
        fresh = materialize(frontier.join(links, frontier.node == links.at).select(F.col("next").alias("node"), "root").distinct(), "fresh")
        # a root a node has already, and a third root, tell nothing new; only nodes met again are looked up
        had = reached.join(fresh.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_list("root").alias("roots"))
        open_ = fresh.join(had, "node", "left").where(F.col("roots").isNull() | ((F.size("roots") < 2) & ~F.array_contains("roots", F.col("root"))))
        ranked = open_.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2 - F.coalesce(F.size("roots"), F.lit(0)))
        frontier = materialize(ranked.select("node", "root", F.lit(hop).alias("distance")), "frontier")
        if frontier.isEmpty():
            break
        reached = materialize(reached.unionByName(frontier), "reached") if hop % 4 == 0 else reached.unionByName(frontier)
    reached = materialize(reached, "reached")
    found = reached.where("node <> root").groupBy("node").agg(F.min("distance").alias("distance"))
    # the kind: edges into nodes one hop nearer, for seeds by a root other than themselves
    nearer = reached.select(F.col("node").alias("at"), F.col("root"), F.col("distance").alias("near"))
    hit = found.join(links.select(F.col("next").alias("node"), "at", "k"), "node").join(nearer, "at").where((F.col("near") == F.col("distance") - 1) & (F.col("root") != F.col("node")))
    best = hit.groupBy("node", "distance").agg(F.min("k").alias("k"))
    names = F.array(*[F.lit(k) for k in DEPENDENCE])
    return best.select("node", F.col("distance").cast("int").alias("distance"), F.element_at(names, F.col("k").cast("int")).alias("kind"))


def dependents_report(rows: DataFrame, depth: int, horizon: int = HORIZON) -> DataFrame:
    """Rows beyond ``depth`` counted by (distance, kind), with what is known of the walk's end.

    ends_within_bound: nothing lies beyond; beyond_bound: something does;
    cut_at_horizon: the walk stopped at its horizon, which is said first.
    """
    whole = rows.agg(F.max("distance").alias("far"))
    state = F.when(F.col("far") >= horizon, "cut_at_horizon").when(F.col("far") > depth, "beyond_bound").otherwise("ends_within_bound")
    return rows.groupBy("distance", "kind").agg(F.count(F.lit(1)).alias("dependents")).crossJoin(F.broadcast(whole)).select("distance", "kind", "dependents", (F.col("distance") > depth).alias("beyond"), state.alias("disclosure"))


def closure(edges: DataFrame, one_task: int = 2_000_000) -> DataFrame:
    """(start, node) for all nodes reachable from each start over (src, dst), the start itself left out.

    The pairs are the result and may be as many as the nodes squared: pass the
    edges of one kind. A graph of at most ``one_task`` edges, which is counted
    first, is numbered by one task, and its pairs are written out block by block.
    Beyond that rounds of joins go on until one finds nothing new; what a round
    finds is written once. Both ways give the same rows.
    """
    links = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "links")
    if bounded(links, one_task):
        return all_pairs(links)
    reached = frontier = links.select(F.col("src").alias("start"), F.col("dst").alias("node"))
    first, found = reached, []
    while True:
        step = frontier.join(links, frontier.node == links.src).select("start", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(reached, ["start", "node"], "left_anti"), "closure")
        if frontier.isEmpty():
            break
        found.append(frontier._lodestrata_path)
        reached = first.unionByName(links.sparkSession.read.schema(first.schema).parquet(*found))
    return reached.where("start <> node")


def rank_projection(edges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) for ranking: in-workspace symbols, and different (src, dst) among them."""
    nodes = symbols.where("class = 'in_workspace'").select(F.col("canonical_id").alias("node")).distinct()
    links = edges.where(F.col("kind").isin(DEPENDENCE)).select("src", "dst").distinct()
    links = links.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, links


def _rank_in_one_task(damping: float, iterations: int):
    """All rounds over (a, b) rows: a link, or a node where b is null."""

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        a, b = t.column("a").to_pandas().to_numpy(object), t.column("b").to_pandas().to_numpy(object)
        linked = np.array([x is not None for x in b])
        names = np.array(sorted(set(a[~linked])), object)
        place = {v: i for i, v in enumerate(names)}
        src = np.fromiter((place[v] for v in a[linked]), np.int64)
        dst = np.fromiter((place[v] for v in b[linked]), np.int64)
        order = np.lexsort((src, dst))  # one order of summing, whatever the partitions
        src, dst = src[order], dst[order]
        n = len(names)
        out = np.bincount(src, minlength=n)
        r = np.full(n, 1.0 / n)
        for _ in range(iterations):
            given = np.bincount(dst, r[src] / out[src], minlength=n)
            r = (1 - damping) / n + damping * (given + r[out == 0].sum() / n)
        yield pa.RecordBatch.from_arrays([pa.array(names.tolist()), pa.array(r)], ["node", "rank"])

    return run


def page_rank(nodes: DataFrame, links: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, keep_every: int = 8, one_task: int = 2_000_000) -> DataFrame:
    """(node, rank) after a fixed number of iterations with uniform teleport.

    What nodes without links hold is spread over all nodes. A graph of at most
    ``one_task`` nodes and links, which is counted first, is ranked by one task.
    Beyond that the links are written once, partitioned by their source, with
    the source's out-degree, and a round is one join and one partial aggregation
    on the target. Both ways give the same ranks. Nodes are strings.
    """
    parts = nodes.select(F.col("node").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(links.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    parts = materialize(parts, "rank-graph")
    if bounded(parts, one_task):
        return parts.coalesce(1).mapInArrow(_rank_in_one_task(damping, iterations), "node string, rank double")
    nodes, links = parts.where("b IS NULL").select(F.col("a").alias("node")), parts.where("b IS NOT NULL").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    weighted = materialize(links.join(degree, "src").repartition("src"), "rank-links")
    every = materialize(nodes.join(degree.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("out", F.lit(0)).alias("out")), "rank-nodes")
    n = every.count()
    if n == 0:
        return every.select("node", F.lit(0.0).alias("rank"))
    rank = every.select("node", "out", F.lit(1.0 / n).alias("rank"))
    for k in range(1, iterations + 1):
        lost = rank.where("out = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = weighted.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        new = every.join(given.withColumnRenamed("dst", "node"), "node", "left").crossJoin(F.broadcast(lost))
        rank = new.select("node", "out", (F.lit((1 - damping) / n) + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if k % keep_every == 0 or k == iterations:
            rank = materialize(rank, "rank")
    return rank.select("node", "rank")


def ranked_dependents(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Dependents with their place: nearest first, then highest rank, kind order, id."""
    joined = rows.join(ranks, "node", "left").withColumn("rank", F.round(F.coalesce("rank", F.lit(0.0)), 12))
    # distances are few: the order is settled in each, then distances are added up
    within = Window.partitionBy("distance").orderBy(F.col("rank").desc(), kind_order(), "node")
    return joined.withColumn("place", F.row_number().over(within)).select("node", "distance", "kind", "place")


def neighbours(edges: DataFrame, kinds: list[str], forward: bool = True) -> DataFrame:
    """(node, other): each node's neighbours over the given kinds, once each."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    return edges.where(F.col("kind").isin(kinds)).select(F.col(a).alias("node"), F.col(b).alias("other")).distinct()


def declaring_type(symbols: DataFrame, contains: DataFrame) -> DataFrame:
    """(node, type): the symbol itself where it is a type or trait, else the type or trait that contains it."""
    own = symbols.where(F.col("kind").isin("type", "trait")).select(F.col("canonical_id").alias("node"), F.col("canonical_id").alias("type"))
    up = contains.select(F.col("src").alias("type"), F.col("dst").alias("node")).join(own.select("type"), "type")
    above = symbols.where(~F.col("kind").isin("type", "trait")).select(F.col("canonical_id").alias("node")).join(up, "node").groupBy("node").agg(F.min("type").alias("type"))
    return own.unionByName(above)
