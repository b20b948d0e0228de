"""Lexical and vector retrieval, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import split_words
from lodestrata.runtime import materialize

#: BM25's constants and the constant of reciprocal-rank fusion (fixed values).
K1, B, RRF_K = 1.2, 0.75, 60
#: The farthest rank a nearest-neighbour search gives (fixed value).
MOST_NEIGHBOURS = 4096
#: Postings of one word that meet its questions in one task.
HOT_WORD = 20_000
#: Vectors of one tile of the block comparison.
TILE = 1024
#: Tiles of vectors that meet a tile of queries under one join key.
MEET = 8


def postings(passages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, tf, length) of an inverted index."""
    words = passages.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, split_words(F.col(text)).alias("w"))
    each = words.select(key, F.size("w").alias("length"), F.explode("w").alias("word"))
    return each.groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def bm25(index: DataFrame, key: str, queries: DataFrame, total: DataFrame) -> DataFrame:
    """(query, key, score): any-word matches of ``queries`` (query, word) ranked by BM25.

    ``total`` is one row (n, average) over all passages. A word's weight is
    ln(1 + (n - df + 0.5) / (df + 0.5)); a repeated query word counts once.
    """
    df = index.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # a word of very many passages is met in parts of about HOT_WORD postings, each a join key of its own
    parts = F.ceil(F.col("df") / HOT_WORD)
    wanted = queries.select("query", "word").distinct().join(df, "word").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    held = index.join(df.where(F.col("df") > HOT_WORD).select("word", parts.alias("parts")), "word", "left").withColumn("part", F.pmod(F.xxhash64(key), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    scored = held.join(wanted, ["word", "part"]).crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return scored.groupBy("query", key).agg(F.sum(part).alias("score"))


def _pack_postings(weighted: bool, most: int):
    """Rows (id, wid, weight) sorted by id to tiles of ``most`` ids; the last id of a batch waits for the next."""
    names = ["ids", "offsets", "wids", "weights"]

    def tile(ids, wids, weights):
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        for k in range(0, len(starts), most):
            own = starts[k : k + most]
            end = starts[k + most] if k + most < len(starts) else len(ids)
            parts = [ids[own], np.append(own, end) - own[0], wids[own[0] : end], weights[own[0] : end]]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "wid")]
            cols.append(b.column("weight").to_numpy(zero_copy_only=False).astype(np.float64) if weighted else np.zeros(b.num_rows))
            if held is not None:
                cols = [np.concatenate((x, y)) for x, y in zip(held, cols)]
            # whole tiles go on, the rest waits
            ids = cols[0]
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            full = (len(starts) - 1) // most * most
            cut = int(starts[full])
            if cut:
                yield from tile(*(x[:cut] for x in cols))
            held = [x[cut:] for x in cols]
        if held is not None:
            yield from tile(*held)

    return run


def _score_tiles(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, qo, qw, d, do, dw, weights in zip(*(b.column(c).to_pylist() for c in ("q_ids", "q_offsets", "q_wids", "d_ids", "d_offsets", "d_wids", "d_weights"))):
                q, qo, qw, d, do, dw = (np.frombuffer(x, np.int64) for x in (q, qo, qw, d, do, dw))
                weights = np.frombuffer(weights, np.float64)
                known = np.unique(qw)
                asked = np.zeros((len(q), len(known)))
                asked[np.repeat(np.arange(len(q)), np.diff(qo)), np.searchsorted(known, qw)] = 1.0
                at = np.minimum(np.searchsorted(known, dw), len(known) - 1)
                met = known[at] == dw
                owner = np.repeat(np.arange(len(d)), np.diff(do))[met]
                if not len(owner):
                    continue
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                scores = np.add.reduceat(asked[:, at[met]] * weights[met], first, axis=1)
                ids = d[owner[first]]
                scores[q[:, None] == ids[None, :]] = 0.0
                if scores.shape[1] > most:
                    # ties within rounding stay in
                    least = np.partition(scores, -most, axis=1)[:, -most] - 2e-9
                    who, where = np.nonzero((scores > 0) & (scores >= least[:, None]))
                else:
                    who, where = np.nonzero(scores > 0)
                yield pa.RecordBatch.from_arrays([pa.array(q[who]), pa.array(ids[where]), pa.array(scores[who, where])], ["query", "id", "score"])

    return run


def top_lexical(index: DataFrame, queries: DataFrame, total: DataFrame, most: int) -> DataFrame:
    """(query, id, score): of each query the passages that can be among its first ``most`` by BM25, the query's own left out.

    Scores are those of ``bm25``, but matches are never written out as rows:
    postings of words that are asked for (id, word, tf, length) are weighted
    once and packed into tiles, as are the queries (query, word); each two tiles
    meet in one product, of which only the best ``most`` rows a query (and
    ties) leave the task. Ids and queries are longs; words very many passages
    hold cost their postings and no more.
    """
    asked = queries.select("query", "word").distinct()
    words = index.groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(asked.select("word").distinct(), "word", "left_semi")
    words = materialize(words.withColumn("wid", F.monotonically_increasing_id()), "words")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    weighted = index.join(words, "word").crossJoin(F.broadcast(total)).select(F.col("id").cast("long").alias("id"), "wid", part.alias("weight"))
    named = asked.join(words, "word").select(F.col("query").cast("long").alias("id"), "wid")
    schema = "ids binary, offsets binary, wids binary, weights binary"
    d = materialize(weighted.repartition("id").sortWithinPartitions("id").mapInArrow(_pack_postings(True, TILE), schema), "posting-tiles")
    q = materialize(named.repartition("id").sortWithinPartitions("id").mapInArrow(_pack_postings(False, TILE // 8), schema), "query-tiles")
    groups = max(1, -(-d.count() // MEET))
    left = q.select(F.col("ids").alias("q_ids"), F.col("offsets").alias("q_offsets"), F.col("wids").alias("q_wids"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    right = d.select(F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("group"), *[F.col(c).alias(f"d_{c}") for c in ("ids", "offsets", "wids", "weights")])
    return left.join(right, "group").drop("group").mapInArrow(_score_tiles(most), "query long, id long, score double")


def corpus_totals(index: DataFrame, key: str) -> DataFrame:
    sizes = index.groupBy(key).agg(F.first("length").alias("length"))
    return sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))


def ranked(rows: DataFrame, group: str, key: str, order, most: int) -> DataFrame:
    """(group, key, rank) of the first ``most`` of each group, from 1, ties by key.

    Rows beyond ``most`` are dropped before the shuffle by Spark's group limit.
    """
    w = Window.partitionBy(group).orderBy(order, key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(group, key, "rank")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    rows: list[np.ndarray] = []

    def tile():
        return pa.RecordBatch.from_arrays([pa.array([part * (1 << 24) + k]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.stack(rows).tobytes()], pa.binary())], ["tile", "ids", "vectors"])

    for b in batches:
        for i, v in zip(b.column("id").to_pylist(), b.column("v").to_numpy(zero_copy_only=False)):
            ids.append(i)
            rows.append(np.asarray(v, np.float32))
            if len(ids) == TILE:
                yield tile()
                ids, rows, k = [], [], k + 1
    if ids:
        yield tile()


def _nearest(k: int, others_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qv, di, dv in zip(*(b.column(c).to_pylist() for c in ("q_ids", "q_vectors", "d_ids", "d_vectors"))):
                q, d = np.frombuffer(qi, np.int64), np.frombuffer(di, np.int64)
                a = np.frombuffer(qv, np.float32).reshape(len(q), -1).astype(np.float64)
                c = np.frombuffer(dv, np.float32).reshape(len(d), -1).astype(np.float64)
                far = (a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * a @ c.T
                if others_only:
                    far[q[:, None] == d[None, :]] = np.inf
                take = min(k + 1, len(d))
                near = np.argpartition(far, take - 1, axis=1)[:, :take] if take < len(d) else np.broadcast_to(np.arange(len(d)), (len(q), len(d)))
                who = np.repeat(np.arange(len(q)), near.shape[1])
                near = near.ravel()
                ok = np.isfinite(far[who, near])
                who, near = who[ok], near[ok]
                # the few that are left get their distance without cancellation
                exact = np.sqrt(((a[who] - c[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(q[who]), pa.array(d[near]), pa.array(exact)], ["query", "id", "distance"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, others_only: bool = True) -> DataFrame:
    """(query, id, distance, rank): the k nearest vectors of each query by Euclidean distance, exactly.

    Both sides (id, v) are packed into tiles; a tile of queries meets every tile
    of vectors in an equi-join on the tile's group, and each meeting is one
    matrix product that gives out k rows a query. k is at most MOST_NEIGHBOURS;
    ties go by id; rows with null id or vector take no part.
    """
    k = min(k, MOST_NEIGHBOURS)
    q = queries.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v").mapInArrow(_pack, "tile long, ids binary, vectors binary")
    d = vectors.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v").mapInArrow(_pack, "tile long, ids binary, vectors binary")
    q, d = materialize(q, "query-tiles"), materialize(d, "vector-tiles")
    # tiles fall into groups of about MEET; a tile of queries goes once to each group
    groups = max(1, -(-d.count() // MEET))
    left = q.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    met = left.join(d.select(F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int").alias("group"), F.col("ids").alias("d_ids"), F.col("vectors").alias("d_vectors")), "group")
    near = met.select("q_ids", "q_vectors", "d_ids", "d_vectors").mapInArrow(_nearest(k, others_only), "query long, id long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fused_scores(*signals: DataFrame, group: str = "query", key: str = "id", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (group, key, rank) lists: (group, key, score)."""
    parts = signals[0].select(group, key, "rank")
    for s in signals[1:]:
        parts = parts.unionByName(s.select(group, key, "rank"))
    return parts.groupBy(group, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 15).alias("score"))


def fuse(*signals: DataFrame, group: str = "query", key: str = "id", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (group, key, rank) lists: (group, key, place)."""
    score = fused_scores(*signals, group=group, key=key, k=k)
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), key)
    return score.select(group, key, F.row_number().over(w).alias("place"))


def mutual_pairs(first: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that name each other as the first: ``first`` has (query, id)."""
    a = first.select(F.col("query").alias("a"), F.col("id").alias("b"))
    b = first.select(F.col("query").alias("b"), F.col("id").alias("a"))
    return a.join(b, ["a", "b"]).where("a < b")
