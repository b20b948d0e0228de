"""All pairs of nodes of which one reaches the other, from a graph that one task can number.

One task numbers the nodes and puts those on a common circle together. Then every
task takes a block of targets and goes back from them, so that it meets only what
reaches one of them; what a node reaches in a block is one number, a bit a target.
Names are put in last, where the pairs are written out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import discard, materialize

#: Targets in a block, and bits that a task keeps at once where blocks are not at their least. With MOST_WIDTH targets and
#: starts a task, names of usual length fit the dictionaries of its Parquet file (fixed values).
LEAST_WIDTH, MOST_WIDTH, BITS = 1 << 10, 1 << 13, 1 << 29
#: Places in a batch, links a task has at least, and tasks at most where cores ask for no more (fixed values).
BATCH, SHARE, TASKS = 1 << 19, 512, 256


def circles(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The number of each node's strongly connected part; a link between two parts leads to the lower number."""
    order = np.argsort(src, kind="stable")
    ends = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    to = dst[order].tolist()
    at, low, part, open_ = [-1] * n, [0] * n, [-1] * n, []
    seen = parts = 0
    for root in range(n):
        if at[root] >= 0:
            continue
        at[root] = low[root] = seen
        seen += 1
        open_.append(root)
        path = [root]
        left = [ends[root]]
        while path:
            x, i = path[-1], left[-1]
            if i < ends[x + 1]:
                left[-1] += 1
                y = to[i]
                if at[y] < 0:
                    at[y] = low[y] = seen
                    seen += 1
                    open_.append(y)
                    path.append(y)
                    left.append(ends[y])
                elif part[y] < 0:
                    low[x] = min(low[x], at[y])
                continue
            path.pop()
            left.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[x])
            if low[x] == at[x]:
                while part[x] < 0:
                    part[open_.pop()] = parts
                parts += 1
    return np.array(part, np.int64)


def _number(batches):
    """(block, names, graph) rows: the names of nodes by block, and at block -1 all links between numbers.

    Nodes that a link leads to come first, those of one part side by side in the order of the parts.
    """
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    coded = pa.chunked_array(t.column("src").chunks + t.column("dst").chunks).dictionary_encode().unify_dictionaries()
    names = coded.chunk(0).dictionary
    codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
    src, dst = codes[: t.num_rows], codes[t.num_rows :]
    n = len(names)
    target = np.zeros(n, bool)
    target[dst] = True
    targets = np.flatnonzero(target)
    place = np.full(n, -1, np.int64)
    place[targets] = np.arange(len(targets))
    inner = target[src]
    part = circles(len(targets), place[src[inner]], place[dst[inner]])
    order = np.argsort(part, kind="stable")
    parts = int(part.max()) + 1
    first = np.searchsorted(part[order], np.arange(parts + 1))
    # links between parts by the one they lead to, and those of nodes that nothing leads to
    from_, to = part[place[src[inner]]], part[place[dst[inner]]]
    into = np.unique((to * parts + from_)[to != from_])
    number = np.empty(n, np.int64)
    number[targets[order]] = np.arange(len(targets))
    number[~target] = np.arange(len(targets), n)
    outer = np.unique(number[src[~inner]] * parts + part[place[dst[~inner]]])
    width = int(min(MOST_WIDTH, max(LEAST_WIDTH, BITS // parts)))
    graph = {
        "width": width, "targets": len(targets), "links": t.num_rows, "starts": len(np.unique(src)), "first": first, "back": (into % parts).astype(np.int32), "ends": np.searchsorted(into // parts, np.arange(parts + 1)),
        "start": (outer // parts).astype(np.int32), "start_to": (outer % parts).astype(np.int32),
    }
    kind = pa.list_(names.type)
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], kind), pa.array([pickle.dumps(graph)], pa.binary())], ["block", "names", "graph"])
    named = np.empty(n, np.int64)
    named[number] = np.arange(n)
    for k in range(0, n, width):
        own = names.take(pa.array(named[k : k + width]))
        listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own).cast(kind)
        yield pa.RecordBatch.from_arrays([pa.array([k // width], pa.int32()), listed, pa.array([None], pa.binary())], ["block", "names", "graph"])


def block_reach(graph: dict, block: int, share: int, shares: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, places in the block it reaches, itself left out), for nodes whose number leaves ``share`` by ``shares``."""
    width, first, back, ends = graph["width"], graph["first"], graph["back"], graph["ends"]
    low = block * width
    high = min(low + width, graph["targets"])
    reach: dict[int, int] = {}
    for p in range(int(np.searchsorted(first, low, "right")) - 1, int(np.searchsorted(first, high, "left"))):
        reach[p] = (1 << min(int(first[p + 1]), high) - low) - (1 << max(int(first[p]), low) - low)
    todo = sorted(reach)
    while todo:  # the lowest part first: all it leads to is done
        p = heappop(todo)
        bits = reach[p]
        for q in back[ends[p] : ends[p + 1]].tolist():
            have = reach.get(q)
            if have is None:
                heappush(todo, q)
            reach[q] = bits | (have or 0)

    def places(bits: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((width + 7) // 8, "little"), np.uint8), bitorder="little")).astype(np.int32)

    for p, bits in reach.items():
        a, b = int(first[p]), int(first[p + 1])
        own = range(a + (share - a) % shares, b, shares)
        if own:
            all_ = places(bits)
            for x in own:
                found = all_[all_ != x - low] if low <= x < high else all_
                if len(found):
                    yield x, found
    met = np.zeros(len(first), bool)
    met[list(reach)] = True
    hit = met[graph["start_to"]] & (graph["start"] % shares == share)
    for x, links in groupby(zip(graph["start"][hit].tolist(), graph["start_to"][hit].tolist()), lambda link: link[0]):
        bits = 0
        for _, p in links:
            bits |= reach[p]
        yield x, places(bits)


def _reached(sent, shares: int):
    """Units of work to (start_block, start_place, block, places)."""

    def batch(at: list[int], blocks: list[int], found: list[np.ndarray], width: int):
        numbers = np.array(at, np.int64)
        lengths = np.cumsum([0, *map(len, found)])
        lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(found)))
        columns = [pa.array((numbers // width).astype(np.int32)), pa.array((numbers % width).astype(np.int32)), pa.array(blocks, pa.int32()), lists]
        return pa.RecordBatch.from_arrays(columns, ["start_block", "start_place", "block", "places"])

    def run(batches):
        graph = pickle.loads(sent.value)
        for rows in batches:
            for unit in rows.column("id").to_pylist():
                at, blocks, found, held = [], [], [], 0
                for x, places in block_reach(graph, unit // shares, unit % shares, shares):
                    at.append(x)
                    blocks.append(unit // shares)
                    found.append(places)
                    held += len(places)
                    if held >= BATCH:
                        yield batch(at, blocks, found, graph["width"])
                        at, blocks, found, held = [], [], [], 0
                if at:
                    yield batch(at, blocks, found, graph["width"])

    return run


def all_pairs(links: DataFrame) -> DataFrame:
    """(start, node) for every node that a different one reaches over (src, dst); both ends of one type, none null.

    The numbered graph is sent to the executors whole: check the number of links ahead.
    """
    spark = links.sparkSession
    kind = links.schema["src"].dataType.simpleString()
    numbered = materialize(links.select("src", "dst").coalesce(1).mapInArrow(_number, f"block int, names array<{kind}>, graph binary"), "numbered")
    row = numbered.where("block = -1").select("graph").first()
    if row is None:
        discard(numbered)
        return links.select(F.col("src").alias("start"), F.col("dst").alias("node")).limit(0)
    graph = pickle.loads(row.graph)
    blocks = -(-graph["targets"] // graph["width"])
    # as many shares as cores ask for, or as keep a file's starts few
    shares = -(-min(4 * spark.sparkContext.defaultParallelism, -(-graph["links"] // SHARE)) // blocks)
    shares = max(shares, min(-(-graph["starts"] // MOST_WIDTH), TASKS // blocks))
    units = spark.range(0, blocks * shares, 1, blocks * shares)
    found = units.mapInArrow(_reached(spark.sparkContext.broadcast(bytes(row.graph)), shares), "start_block int, start_place int, block int, places array<int>")
    names = numbered.where("block >= 0")
    starts, nodes = (F.broadcast(names.select(F.col("block").alias(b), F.col("names").alias(c))) for b, c in (("start_block", "starts"), ("block", "nodes")))
    rows = found.join(starts, "start_block").join(nodes, "block").select(F.col("starts")[F.col("start_place")].alias("start"), "nodes", F.explode("places").alias("place"))
    return rows.select("start", F.col("nodes")[F.col("place")].alias("node"))
