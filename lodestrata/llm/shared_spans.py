"""Long stretches of code that two passages have in common.

A passage is a series of fingerprint rows (hash, ordinal). Rows whose hash lies
in one place only can be shared with nothing and are left out. The series is
cut into content-defined chunks: a gear hash of each row says whether a chunk
ends there, as one does where the next row is too far for a stretch, and a
chunk's digest takes in its rows' hashes and distances. Chunks with equal
digests in two passages are parts of stretches on their diagonal (one difference
of ordinals), where parts near enough to each other are put together. Where a
chunk ends depends on content alone, so chunks move along with insertions.

One cut as in backups would lose stretches, for the shortest hold four rows. So
the series is cut twice, by a bit of the gear hash and by its complement: of
three rows that follow each other two end a chunk of the same cut, so any three
rows that two passages hold without others between give them an equal chunk.
Two kinds of places are left, and are met in ways that keep the result whole:

* Rows of two passages with one hash whose chunks differ in both cuts, because
  there are other rows between: such rows are parts by themselves.
* Rows of a hash that very many passages hold say too little, alone or in a
  chunk of their like. They are looked for on the diagonals known so far, and
  open others by a chunk as long as a stretch: a row, one
  further on that makes it that long, and one in between. A stretch of common
  hashes alone holds such a chunk: its rows are at most ``reach`` apart, so from
  the first one there is a row ``reach`` to ``2 reach - 1`` tokens on, and one
  ``least - kgram`` to ``least - kgram + reach - 1`` on. Such chunks are as good
  as stretches, so their pairs don't outgrow the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.runtime import materialize

KGRAM, REACH, LEAST = 16, 17, 64
#: A hash in more places than this is common.
COMMON = 64
#: Ordinals of one passage that one task reads; a hot passage is read in blocks of these.
BLOCK = 4096

_U = np.uint64


def _gear(h: np.ndarray) -> np.ndarray:
    """A gear table's entry for each value."""
    x = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _long_chunks(reach: int, far: int, block: int):
    """Chunks of three rows: a first, one ``reach`` to ``2 reach - 1`` on, one ``far`` to ``far + reach - 1`` on.

    Takes (passage_id, block, token_ordinal, hash) sorted by the first three and
    gives (digest, passage_id, token_ordinal). Only rows within the length of a
    chunk from the batch's end are kept for the next batch.
    """
    span = max(far + reach - 1, 2 * reach - 1)

    def partners(series, o, first, low, high):
        """(index into first, row) for all rows low to high tokens after each of ``first``."""
        wide = np.int64(1) << 32
        place = series * wide + o
        a = np.searchsorted(place, place[first] + low, "left")
        z = np.searchsorted(place, place[first] + high, "right")
        n = z - a
        who = np.repeat(np.arange(len(first)), n)
        return who, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + a[who]

    def chunks(p, b, o, h, own):
        series = np.concatenate(([0], np.cumsum((p[1:] != p[:-1]) | (b[1:] != b[:-1]))))
        first = np.flatnonzero(own)
        who, middle = partners(series, o, first, reach, 2 * reach - 1)
        start = first[who]
        again, end = partners(series, o, start, far, far + reach - 1)
        start, middle = start[again], middle[again]
        ok = end > middle
        start, middle, end = start[ok], middle[ok], end[ok]
        g = _gear(h[start])
        for x, y in ((start, middle), (middle, end)):
            g = (g << _U(1)) + _gear(h[y] + _gear((o[y] - o[x]).astype(_U)))
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(p[start]), pa.array(o[start].astype(np.int32))], ["digest", "passage_id", "token_ordinal"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("passage_id", "block", "token_ordinal")] + [batch.column("hash").to_numpy(zero_copy_only=False).view(_U)]
            if held is not None:
                cols = [np.concatenate((x, y)) for x, y in zip(held, cols)]
            p, b, o, h = cols
            # starts too near to the end wait for the next batch
            waits = (p == p[-1]) & (b == b[-1]) & (o >= o[-1] - span)
            cut = int(np.flatnonzero(~waits)[-1]) + 1 if not waits.all() else 0
            yield chunks(p, b, o, h, (np.arange(len(p)) < cut) & (o // block == b))
            held = [x[cut:] for x in cols]
        if held is not None:
            p, b, o, h = held
            yield chunks(p, b, o, h, o // block == b)

    return run


_CHUNKED = "passage_id long, token_ordinal int, hash long, ordinary boolean" + "".join(f", chunk_{k} long, at_{k} int, last_{k} int, tells_{k} boolean" for k in (0, 1))


def _cut_twice(reach: int):
    """The chunks of both cuts each row lies in.

    Takes (passage_id, block, token_ordinal, hash, ordinary) sorted by the first
    three and the hash, repeated rows perhaps among them, and gives each row once:
    (passage_id, token_ordinal, hash, ordinary, chunk_0, at_0, last_0, tells_0,
    the same for cut 1): the chunk's digest, the row's distance from its start,
    the chunk's last ordinal, and whether it holds an ordinary row. A batch's
    last passage waits for the next batch.
    """

    def cut(p, b, o, h, ordinary):
        new = np.concatenate(([True], (p[1:] != p[:-1]) | (o[1:] != o[:-1]) | (h[1:] != h[:-1])))
        p, b, o, h, ordinary = (x[new] for x in (p, b, o, h, ordinary))
        first = np.concatenate(([True], (p[1:] != p[:-1]) | (b[1:] != b[:-1]) | (o[1:] - o[:-1] > reach)))
        ends = _gear(h) >> _U(63) == 1
        out = [pa.array(p), pa.array(o.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(ordinary)]
        for k, here in ((0, ends), (1, ~ends)):
            start = first.copy()
            start[1:] |= here[:-1]
            at = np.flatnonzero(start)
            chunk = np.cumsum(start) - 1
            place = o - o[at][chunk]
            digest = _gear(np.add.reduceat(_gear(h + _gear(place.astype(_U) + _U(1))), at) + _U(k))
            last = o[np.concatenate((at[1:], [len(o)])) - 1]
            out += [pa.array(digest.view(np.int64)[chunk]), pa.array(place.astype(np.int32)), pa.array(last[chunk].astype(np.int32)), pa.array(np.logical_or.reduceat(ordinary, at)[chunk])]
        return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in _CHUNKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("passage_id", "block", "token_ordinal")]
            cols += [batch.column("hash").to_numpy(zero_copy_only=False).view(_U), batch.column("ordinary").to_numpy(zero_copy_only=False).astype(bool)]
            if held is not None:
                cols = [np.concatenate((x, y)) for x, y in zip(held, cols)]
            other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            done = int(other[-1]) + 1 if len(other) else 0
            if done:
                yield cut(*(x[:done] for x in cols))
            held = [x[done:] for x in cols]
        if held is not None:
            yield cut(*held)

    return run


def _diagonal(p: str, o: str, q: str, s: str):
    """(passage_a, passage_b, shift) of places (p, o) and (q, s)."""
    first = F.col(p) < F.col(q)
    return [F.least(p, q).alias("passage_a"), F.greatest(p, q).alias("passage_b"), F.when(first, F.col(o) - F.col(s)).otherwise(F.col(s) - F.col(o)).alias("shift")]


def _few_met(places: DataFrame, key: str) -> DataFrame:
    """(_p, _o, _q, _s, others of both sides) of each two places of a key in two passages; a key has COMMON places at most."""
    others = [c for c in places.columns if c not in (key, "passage_id", "token_ordinal")]
    x = places.select(key, F.col("passage_id").alias("_p"), F.col("token_ordinal").alias("_o"), *[F.col(c).alias(f"{c}_x") for c in others])
    y = places.select(key, F.col("passage_id").alias("_q"), F.col("token_ordinal").alias("_s"), *[F.col(c).alias(f"{c}_y") for c in others])
    return x.join(y, key).where("_p < _q")


def _many_met(places: DataFrame, key: str, block: int = 1024) -> DataFrame:
    """(_p, _o, _q, _s) of each two places of a key in two passages, however many places a key has.

    The places of a key that has more than ``block`` are met in blocks, each two
    of them (and each with itself) a join key of their own, so that no key is a
    single task's work. A key in one place alone gives nothing.
    """
    counts = places.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.ceil(F.col("_n") / block).alias("_blocks"))
    placed = places.join(counts, key).withColumn("_block", F.pmod(F.xxhash64("passage_id", "token_ordinal"), F.col("_blocks")))
    x = placed.select(key, F.col("_block").alias("_x"), F.explode(F.sequence("_block", F.col("_blocks") - 1)).alias("_y"), F.col("passage_id").alias("_p"), F.col("token_ordinal").alias("_o"))
    y = placed.select(key, F.explode(F.sequence(F.lit(0).cast("long"), "_block")).alias("_x"), F.col("_block").alias("_y"), F.col("passage_id").alias("_q"), F.col("token_ordinal").alias("_s"))
    return x.join(y, [key, "_x", "_y"]).where("(_x < _y AND _p <> _q) OR (_x = _y AND _p < _q)")


def shared_stretches(fingerprints: DataFrame, least: int = LEAST, reach: int = REACH, kgram: int = KGRAM, common: int = COMMON, block: int = BLOCK) -> DataFrame:
    """The stretches two passages share: passage_a < passage_b, start_a, start_b, tokens.

    A stretch is a longest series of equal hashes at one difference of ordinals
    with neighbours at most ``reach`` apart; it counts when it covers ``least``
    tokens. Null values match nothing, repeated rows count once, and empty input
    gives an empty result. A passage is not compared with itself. ``common``
    (places of a hash that tell too little) and ``block`` change no result.
    """
    known = fingerprints.where("hash IS NOT NULL AND passage_id IS NOT NULL AND token_ordinal IS NOT NULL").select("hash", F.col("passage_id").cast("long").alias("passage_id"), F.col("token_ordinal").cast("int").alias("token_ordinal"))
    # repeated rows may count here: they only make a hash look shared, or common, that isn't
    counts = known.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = F.floor(F.col("token_ordinal") / block).cast("int")
    shared = known.join(counts, "hash").select("passage_id", at.alias("block"), "token_ordinal", "hash", (F.col("n") <= common).alias("ordinary"))
    rows = materialize(shared.repartition("passage_id", "block").sortWithinPartitions("passage_id", "block", "token_ordinal", "hash").mapInArrow(_cut_twice(reach), _CHUNKED), "chunked")
    # equal chunks of either cut; one with an ordinary row has no more places than that row's hash
    starts = [rows.where(f"at_{k} = 0 AND tells_{k}").select(F.col(f"chunk_{k}").alias("digest"), "passage_id", "token_ordinal", F.col(f"last_{k}").alias("last")) for k in (0, 1)]
    chunks = _few_met(starts[0].unionByName(starts[1]), "digest").select(*_diagonal("_p", "_o", "_q", "_s"), F.col("_o").alias("low"), F.col("last_x").alias("high"))
    # ordinary rows of one hash that lie in different chunks of both cuts
    place = [F.struct(f"chunk_{k}", f"at_{k}").alias(f"c{k}") for k in (0, 1)]
    alone = _few_met(rows.where("ordinary").select("hash", "passage_id", "token_ordinal", *place), "hash").where("c0_x <> c0_y AND c1_x <> c1_y")
    alone = alone.select(*_diagonal("_p", "_o", "_q", "_s"), F.col("_o").alias("low"), F.col("_o").alias("high"))
    parts = materialize(chunks.unionByName(alone), "parts")
    # common rows in chunks as long as a stretch; blocks overlap by a chunk's length
    many = materialize(rows.where("NOT ordinary").select("passage_id", "token_ordinal", "hash"), "common-rows")
    early = F.floor((F.col("token_ordinal") - max(least - kgram + reach, 2 * reach)) / block).cast("int")
    blocks = many.withColumn("block", F.explode(F.sequence(F.greatest(early, F.lit(0)), F.greatest(at, F.lit(0)))))
    grown = blocks.select("passage_id", "block", "token_ordinal", "hash").repartition("passage_id", "block").sortWithinPartitions("passage_id", "block", "token_ordinal").mapInArrow(_long_chunks(reach, least - kgram, block), "digest long, passage_id long, token_ordinal int")
    longer = _many_met(materialize(grown.distinct(), "chunks"), "digest").select(*_diagonal("_p", "_o", "_q", "_s"))
    # common rows that both passages hold on a known diagonal
    diagonals = parts.select("passage_a", "passage_b", "shift").unionByName(longer).distinct()
    a = many.select(F.col("passage_id").alias("passage_a"), F.col("token_ordinal").alias("low"), "hash")
    b = many.select(F.col("passage_id").alias("passage_b"), F.col("token_ordinal").alias("ob"), "hash")
    more = diagonals.join(a, "passage_a").withColumn("ob", F.col("low") - F.col("shift")).join(b, ["passage_b", "ob", "hash"])
    every = parts.unionByName(more.select("passage_a", "passage_b", "shift", "low", F.col("low").alias("high")))
    w = Window.partitionBy("passage_a", "passage_b", "shift").orderBy("low")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = every.withColumn("new", F.coalesce((F.col("low") - before > reach).cast("int"), F.lit(1)))
    runs = begun.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("passage_a", "passage_b", "shift", "run").agg(F.min("low").alias("start_a"), F.max("high").alias("last"))
    tokens = (F.col("last") - F.col("start_a") + kgram).cast("int")
    return runs.where(tokens >= least).select("passage_a", "start_a", "passage_b", (F.col("start_a") - F.col("shift")).cast("int").alias("start_b"), tokens.alias("tokens"))


def shared_tokens(fingerprints: DataFrame, passages: DataFrame, **options) -> DataFrame:
    """(passage_id, shared_tokens, stretches): how much of each passage is shared elsewhere.

    Every passage of ``passages`` (id) comes once, with 0 where nothing is
    shared. Stretches that overlap count their tokens once. Passages with the
    same rows form a class: one stands for all, a second one for what they share
    among themselves, and stretches are multiplied by the classes' sizes, so
    copies are never paired. Ids are of at most 62 bits.
    """
    known = fingerprints.where("hash IS NOT NULL AND passage_id IS NOT NULL AND token_ordinal IS NOT NULL").select(F.col("passage_id").cast("long").alias("passage_id"), "hash", "token_ordinal").distinct()
    # a class's name: its rows' hashes added up in four ways, and their number
    each = [F.sum(F.xxhash64(F.lit(k), "hash", "token_ordinal").cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    names = known.groupBy("passage_id").agg(F.count(F.lit(1)).alias("rows"), *each)
    key = ["rows", "s0", "s1", "s2", "s3"]
    classes = materialize(names.groupBy(*key).agg(F.min("passage_id").alias("rep"), F.count(F.lit(1)).alias("size")), "classes")
    # passage 2 r is a class's first, 2 r + 1 the one to share with it
    stand = classes.select(F.col("rep").alias("passage_id"), F.when(F.col("size") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("k"))
    rows = known.join(stand, "passage_id").select((F.col("passage_id") * 2).alias("p"), "hash", "token_ordinal", F.explode("k").alias("k")).select((F.col("p") + F.col("k")).alias("passage_id"), "hash", "token_ordinal")
    found = materialize(shared_stretches(rows, **options), "stretches")
    one = found.select(F.col("passage_a").alias("me"), F.col("passage_b").alias("other"), F.col("start_a").alias("start"), "tokens").unionByName(found.select(F.col("passage_b").alias("me"), F.col("passage_a").alias("other"), F.col("start_b").alias("start"), "tokens"))
    # of a first the stretches with other firsts and with its own second
    one = one.where("me % 2 = 0 AND (other % 2 = 0 OR other = me + 1)").select(F.shiftright("me", 1).alias("rep"), F.shiftright("other", 1).alias("with"), "start", "tokens")
    sizes = classes.select(F.col("rep").alias("with"), "size")
    places = one.join(sizes, "with").groupBy("rep", "start").agg(F.max("tokens").alias("tokens"), F.sum(F.when(F.col("rep") == F.col("with"), F.col("size") - 1).otherwise(F.col("size"))).alias("n")).withColumn("end", F.col("start") + F.col("tokens"))
    w = Window.partitionBy("rep").orderBy("start")
    reached = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = places.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)))
    sums = fresh.groupBy("rep").agg(F.sum("fresh").alias("shared_tokens"), F.sum("n").alias("stretches"))
    of = names.join(classes.select(*key, "rep"), key).select("passage_id", "rep").join(sums, "rep")
    every = passages.where("id IS NOT NULL").select(F.col("id").alias("passage_id")).distinct()
    return every.join(of, "passage_id", "left").select("passage_id", F.coalesce("shared_tokens", F.lit(0)).alias("shared_tokens"), F.coalesce("stretches", F.lit(0)).alias("stretches"))
