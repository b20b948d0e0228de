"""Texts that share most of their word runs, found by bit-sliced comparison.

Likeness is the share of different three-word runs two texts have in common.
The search is exact and never looks at all pairs:

* Equal sets of runs form a class; classes are compared, copies are not.
* Two sets alike to at least ``t`` share a run among the first
  ``n - ceil(t n) + 1`` of each, in any common order of runs. The order puts
  frequent runs last, by counts over all texts: two tables of 32-bit counts of a
  fixed size, of which the lesser holds, so a heavy run stands out however many
  texts there are. Classes that share such a run meet in a block, and the
  classes of a heavy run are spread over as many tiles as its count asks for
  before anything is shuffled.
* In a block, sketches are compared bit-sliced: one machine word holds the same
  sketch bit of 64 classes, a shift lines up each class with the one ``d``
  places on, carry-save adders count the differing bits of 64 pairs at once,
  and words whose pairs have all exceeded their radius are abandoned.
  A sketch holds at each bit the parity of the runs that fall on it, so the
  number of differing bits never exceeds the size of the symmetric difference,
  and the radius ``(1-t)/(1+t) (n_a + n_b)`` loses no pair.
* What is left is checked exactly on the sets of runs. Only sets of candidates
  are shuffled for it: a bit table of a fixed size, sent along, holds back nearly
  all others, and a join the rest. Run sets and other steps are removed as soon
  as nothing reads them any more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.lexing import WORD
from lodestrata.runtime import discard, materialize, spread

RUN = 3
LIKENESS = 0.6
LEAST_TOKENS = 40
#: Bits of a sketch, planes compared between two looks at the radius, and rows of a block's tile.
BITS, ROUND, TILE = 512, 128, 4096
#: Places of each of the two tables of counts that order the runs, and rows they are sent in.
BUCKETS, CHUNKS = 1 << 21, 64
#: Bits of the table that marks the sets of candidates.
MARKS = 1 << 26

_U = np.uint64
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)]


class _WordHashes(dict):
    """Word to 64-bit hash; forgets everything when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _cid(fp: bytes) -> int:
    """A class's short name; two classes with the same name are told apart by ``fp``."""
    return int.from_bytes(fp[:8], "little", signed=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def run_sets(texts: list[str], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted different run hashes of text i are hashes[offsets[i]:offsets[i+1]]."""
    words: list[str] = []
    lengths = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = WORD.findall(t.lower())
        lengths[i] = len(w)
        words += w
    ids = np.fromiter(map(cache.__getitem__, words), _U, len(words))
    owner = np.repeat(np.arange(len(texts)), lengths)
    m = max(0, len(ids) - RUN + 1)
    h = np.zeros(m, _U)
    for k in range(RUN):
        h = _mix(h + ids[k : k + m] * _ODD[k % 3])
    keep = owner[:m] == owner[len(ids) - m :] if m else np.zeros(0, bool)
    h, owner = h[keep], owner[:m][keep]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
        h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def sketches(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity sketches, one row of BITS / 8 bytes per set."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    place = owner * BITS + (h % _U(BITS)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
    return np.packbits(odd, axis=1, bitorder="little")


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run is counted in the two tables."""
    return (h >> _U(20)).astype(np.int64) % BUCKETS, BUCKETS + (_mix(h) >> _U(24)).astype(np.int64) % BUCKETS


def _pack(counts: np.ndarray) -> bytes:
    """Compressed 32-bit counts, byte by byte: the high bytes are nearly all 0."""
    return zlib.compress(np.ascontiguousarray(counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its set's fingerprint, size and sketch, and the set itself where the task sees it first; per task the counts of its runs."""
    cache, seen = _WordHashes(), set()
    counts = np.zeros(2 * BUCKETS, np.uint32)
    names = ["id", "at", "key", "fp", "cid", "n", "sketch", "runs", "chunk", "counts"]
    at_type = None
    for b in batches:
        at_type = b.column("at").type
        h, off = run_sets(b.column("text").to_pylist(), cache)
        for places in _places(h):
            where, n = np.unique(places, return_counts=True)
            counts[where] += n.astype(np.uint32)
        sk = sketches(h, off)
        blobs = [h[a:z].tobytes() for a, z in zip(off[:-1], off[1:])]
        fps = [blake2b(x, digest_size=16).digest() for x in blobs]
        runs = []
        for fp, x in zip(fps, blobs):
            runs.append(None if fp in seen else x)
            seen.add(fp)
        if len(seen) > 1_000_000:
            seen.clear()
        k = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("at"), b.column("key"), pa.array(fps, pa.binary()), pa.array([_cid(x) for x in fps], pa.int64()), pa.array(np.diff(off).astype(np.int32)), pa.array([x.tobytes() for x in sk], pa.binary()), pa.array(runs, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
            names,
        )
    if at_type is None:
        return
    blobs = [_pack(p) for p in counts.reshape(CHUNKS, -1)]
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(CHUNKS, t) for t in (pa.string(), at_type, pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary())] + [pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array(blobs, pa.binary())],
        names,
    )


def _sum_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(2 * BUCKETS // CHUNKS, np.int64)
    for blob in pdf["counts"]:
        total += _unpack(blob)
    return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "counts": [_pack(np.minimum(total, 2**32 - 1))]})


def _prefixes(likeness: float, table, tile: int):
    """(run, tile, last, cid) for the runs of each set that any set alike to it must share one of.

    ``tile`` is the part of the run's classes this one belongs to, ``last`` the
    number of the run's last part; both follow from the run's count alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(zlib.decompress(table.value), np.uint32)
        for b in batches:
            blobs = b.column("runs").to_pylist()
            n = np.fromiter((len(x) // 8 for x in blobs), np.int64, len(blobs))
            h = np.frombuffer(b"".join(blobs), _U)
            owner = np.repeat(np.arange(len(n)), n)
            first, second = _places(h)
            weight = np.minimum(often[first], often[second])
            order = np.lexsort((h, weight, owner))
            off = np.concatenate(([0], np.cumsum(n)))
            rank = np.arange(len(h)) - np.repeat(off[:-1], n)
            least = np.ceil(likeness * n - 1e-9).astype(np.int64)
            # runs counted once over all texts are in no other set
            keep = (rank < np.repeat(n - least + 1, n)) & (weight[order] > 1)
            cid = b.column("cid").to_numpy(zero_copy_only=False)[owner[keep]]
            picked = order[keep]
            parts = -(-weight[picked].astype(np.int64) // tile)
            part = (_mix(cid.view(_U)) % parts.astype(_U)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h[picked].view(np.int64)), pa.array(part), pa.array((parts - 1).astype(np.int32)), pa.array(cid)], ["run", "tile", "last", "cid"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (run, tile, last, cid) sorted by run, tile and cid: different rows, those left out whose run has one tile and there one cid.

    Remembers one row: the last different one, with whether it still waits for a second cid.
    """
    names = ["run", "tile", "last", "cid"]
    held = None  # (run, tile, last, cid, waiting)
    for b in batches:
        if not b.num_rows:
            continue
        run, tile, last, cid = (b.column(c).to_numpy(zero_copy_only=False) for c in names)
        if held is not None:
            run, tile, last, cid = (np.concatenate(([x], y)) for x, y in zip(held[:4], (run, tile, last, cid)))
        same = (run[1:] == run[:-1]) & (tile[1:] == tile[:-1])
        new = np.concatenate(([True], ~same | (cid[1:] != cid[:-1])))
        run, tile, last, cid = run[new], tile[new], last[new], cid[new]
        starts = np.concatenate(([True], (run[1:] != run[:-1]) | (tile[1:] != tile[:-1])))
        group = np.cumsum(starts) - 1
        waits = (np.bincount(group)[group] == 1) & (last == 0)
        emit = ~waits
        if held is not None and not held[4]:
            # it was given out before; its run has several cids, so none of its group waits
            waits[group == 0] = False
            emit[group == 0] = True
            emit[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(x[emit].astype(t)) for x, t in zip((run, tile, last, cid), (np.int64, np.int32, np.int32, np.int64))], names)
        held = (run[-1], tile[-1], last[-1], cid[-1], bool(waits[-1]))


def _slices(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers per lane to vertical bit slices: (bits, lanes / 64)."""
    return np.stack([np.packbits((values >> k & 1).astype(np.uint8), bitorder="little").view(_U) for k in range(bits)])


def _count(planes: np.ndarray) -> list[np.ndarray]:
    """Carry-save count of the set planes of every lane, as bit slices from low to high."""
    numbers = [planes]
    while numbers[0].shape[0] > 1:
        half = numbers[0].shape[0] // 2
        carry, out = None, []
        for x in numbers:
            a, b = x[:half], x[half:]
            if carry is None:
                out.append(a ^ b)
                carry = a & b
            else:
                ab = a ^ b
                out.append(ab ^ carry)
                carry = (a & b) | (ab & carry)
        numbers = out + [carry]
    return [x[0] for x in numbers]


def close_pairs(sketch: np.ndarray, n: np.ndarray, group: np.ndarray, tile: np.ndarray, cross: np.ndarray, likeness: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group whose sketches lie within their radius.

    Rows of a group are neighbours. Where ``cross`` is set only rows of
    different tiles are compared.
    """
    rows, depth = len(n), 10
    if rows < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = sketch.shape[1] * 8
    words = -(-rows // 64)
    size = np.bincount(group)
    longest = int(size.max())
    lanes = words * 64
    planes = np.zeros((bits, words + longest // 64 + 2), _U)
    spread = np.zeros((lanes, bits), np.uint8)
    spread[:rows] = np.unpackbits(sketch, axis=1, bitorder="little")
    planes[:, :words] = np.packbits(np.ascontiguousarray(spread.T), axis=1, bitorder="little").view(_U)
    del spread
    slack = (1 - likeness) / (1 + likeness)
    left, right = [], []
    members = np.arange(rows)
    for d in range(1, longest):
        members = members[size[group[members]] > d]
        i = members[(members + d < rows)]
        i = i[group[np.minimum(i + d, rows - 1)] == group[i]]
        j = i + d
        ok = np.minimum(n[i], n[j]) >= likeness * np.maximum(n[i], n[j]) - 1e-9
        ok &= ~cross[i] | (tile[i] != tile[j])
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        active = np.unique(i // 64)
        lane = np.searchsorted(active, i // 64) * 64 + i % 64
        radius = np.zeros(len(active) * 64, np.int64)
        valid = np.zeros(len(active) * 64, np.uint8)
        radius[lane] = np.minimum(np.floor(slack * (n[i] + n[j]) + 1e-9), 2**depth - 1)
        valid[lane] = 1
        # the counter starts so far below its top that exceeding the radius overflows it
        counter = _slices(2**depth - 1 - radius, depth)
        alive = np.packbits(valid, bitorder="little").view(_U)
        q, r = divmod(d, 64)
        for start in range(0, bits, ROUND):
            block = planes[start : start + ROUND]
            other = block[:, active + q] if r == 0 else (block[:, active + q] >> _U(r)) | (block[:, active + q + 1] << _U(64 - r))
            added = _count(block[:, active] ^ other)
            carry = np.zeros(len(active), _U)
            for k in range(depth):
                a, b = counter[k], added[k] if k < len(added) else None
                if b is None:
                    counter[k], carry = a ^ carry, a & carry
                else:
                    ab = a ^ b
                    counter[k], carry = ab ^ carry, (a & b) | (ab & carry)
            alive &= ~carry
            live = alive != 0
            if not live.all():
                active, alive, counter = active[live], alive[live], counter[:, live]
                if not len(active):
                    break
        if len(active):
            lane_alive = np.unpackbits(alive.view(np.uint8), bitorder="little").reshape(len(active), 64)
            w, o = np.nonzero(lane_alive)
            i = active[w] * 64 + o
            left.append(i)
            right.append(i + d)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _compare(likeness: float, tile: int):
    def pairs(part: pa.Table) -> pa.RecordBatch:
        run = part.column("run").to_numpy()
        a, z = part.column("low").to_numpy(), part.column("high").to_numpy()
        new = np.concatenate(([True], (run[1:] != run[:-1]) | (a[1:] != a[:-1]) | (z[1:] != z[:-1])))
        fps = part.column("fp").to_pylist()
        sk = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(len(fps), -1)
        i, j = close_pairs(sk, part.column("n").to_numpy().astype(np.int64), np.cumsum(new) - 1, part.column("tile").to_numpy(), a != z, likeness)
        found = {(min(fps[x], fps[y]), max(fps[x], fps[y])) for x, y in zip(i.tolist(), j.tolist()) if fps[x] != fps[y]}
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["fp_a", "fp_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0

        for b in batches:
            if not b.num_rows:
                continue
            waiting.append(b)
            rows += b.num_rows
            if rows < 4 * tile:
                continue
            t = pa.Table.from_batches(waiting).combine_chunks()
            # the last block may go on in the next batch
            key = [t.column(c).to_numpy() for c in ("run", "low", "high")]
            other = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield pairs(t.slice(0, cut).combine_chunks())
            waiting, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if waiting:
            yield pairs(pa.Table.from_batches(waiting).combine_chunks())

    return run


def _mark_places(fps: pa.Array) -> np.ndarray:
    """Two places in the table of marks for each fingerprint."""
    return np.frombuffer(b"".join(fps.to_pylist()), "<u4").reshape(-1, 4)[:, 2:].astype(np.int64) % MARKS


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task the table of marks of the fingerprints in (fp_a, fp_b), in parts."""
    marks = np.zeros(MARKS // 8, np.uint8)
    for b in batches:
        for fps in b.columns:
            at = _mark_places(fps).ravel()
            np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))
    parts = [(k, zlib.compress(p.tobytes(), 1)) for k, p in enumerate(marks.reshape(CHUNKS, -1)) if p.any()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["chunk", "marks"])


def _join_marks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(MARKS // 8 // CHUNKS, np.uint8)
    for blob in pdf["marks"]:
        total |= np.frombuffer(zlib.decompress(blob), np.uint8)
    return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "marks": [zlib.compress(total.tobytes(), 1)]})


def _marked(table):
    """Rows whose fingerprint is marked: all that were marked, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(zlib.decompress(table.value), np.uint8)
        for b in batches:
            at = _mark_places(b.column("fp"))
            yield b.filter(pa.array((marks[at >> 3] >> (at & 7) & 1).all(axis=1)))

    return run


def _verify(likeness: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("runs_a").to_pylist(), b.column("runs_b").to_pylist()):
                p, q = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = np.concatenate((p, q))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common / (len(p) + len(q) - common))
            likes = np.array(keep)
            ok = pa.array(likes >= likeness - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("fp_a").filter(ok), b.column("fp_b").filter(ok), pa.array(likes).filter(ok)], ["fp_a", "fp_b", "likeness"])

    return run


def _marks(candidates: DataFrame):
    """The table of marks of all candidates, sent to the executors; MARKS / 8 bytes whatever the data."""
    parts = candidates.select("fp_a", "fp_b").mapInArrow(_mark, "chunk int, marks binary")
    summed = materialize(parts.groupBy("chunk").applyInPandas(_join_marks, "chunk int, marks binary"), "near-marks")
    whole = np.zeros((CHUNKS, MARKS // 8 // CHUNKS), np.uint8)
    for r in summed.collect():
        whole[r["chunk"]] = np.frombuffer(zlib.decompress(r["marks"]), np.uint8)
    discard(summed)
    return candidates.sparkSession.sparkContext.broadcast(zlib.compress(whole.tobytes(), 1))


class Search:
    """The steps of one search over (id, at, key, text) rows; see the module's text."""

    def __init__(self, items: DataFrame, likeness: float = LIKENESS, tile: int = TILE):
        self.likeness = likeness
        spark = items.sparkSession
        at = dict(items.dtypes)["at"]
        profile = materialize(items.mapInArrow(_profile, f"id string, at {at}, key string, fp binary, cid long, n int, sketch binary, runs binary, chunk int, counts binary"), "near-profile")
        summed = materialize(profile.where("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInPandas(_sum_counts, "chunk int, counts binary"), "near-counts")
        # CHUNKS rows of fixed length: the tables' size doesn't depend on the data
        whole = b"".join(_unpack(r["counts"]).tobytes() for r in sorted(summed.collect(), key=lambda r: r["chunk"])) or bytes(8 * BUCKETS)
        discard(summed)
        table = spark.sparkContext.broadcast(zlib.compress(whole, 1))
        order = F.struct(F.col("at").isNotNull().alias("a"), F.col("at").alias("b"), F.col("key").alias("key"), F.col("fp").alias("fp"), F.col("n").alias("n"))
        known = profile.where("chunk IS NULL AND n > 0")
        classes = known.groupBy("fp").agg(F.first("cid").alias("cid"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        sets = known.where("runs IS NOT NULL")
        thin = sets.select("cid", "runs").mapInArrow(_prefixes(likeness, table, tile), "run long, tile int, last int, cid long")
        shared = materialize(thin.repartition("run", "tile").sortWithinPartitions("run", "tile", "cid").mapInArrow(_shared, "run long, tile int, last int, cid long"), "near-shared")
        # a run of more classes than fit a tile: its tiles meet pairwise
        blocks = shared.join(classes.select("cid", "fp", "n", "sketch"), "cid")
        met = F.transform(F.sequence(F.lit(0), F.col("last")), lambda t: F.struct(F.least(t, F.col("tile")).alias("low"), F.greatest(t, F.col("tile")).alias("high")))
        blocks = blocks.withColumn("met", F.explode(met)).select("run", "met.low", "met.high", "tile", "fp", "n", "sketch")
        near = blocks.repartition("run", "low", "high").sortWithinPartitions("run", "low", "high").mapInArrow(_compare(likeness, tile), "fp_a binary, fp_b binary")
        candidates = materialize(near.distinct(), "near-candidates")
        discard(shared)
        wanted = candidates.select(F.col("fp_a").alias("fp")).union(candidates.select(F.col("fp_b").alias("fp"))).distinct()
        marked = sets.select("fp", "runs").mapInArrow(_marked(_marks(candidates)), "fp binary, runs binary")
        sets = materialize(marked.join(wanted, "fp", "left_semi").dropDuplicates(["fp"]), "near-sets")
        #: One row (id, key, fp, n) per item with at least one run.
        self.members = materialize(known.groupBy("id").agg(F.max(order).alias("m")).select("id", "m.key", "m.fp", "m.n"), "near-members")
        discard(profile)
        both = candidates.join(sets.select(F.col("fp").alias("fp_a"), F.col("runs").alias("runs_a")), "fp_a").join(sets.select(F.col("fp").alias("fp_b"), F.col("runs").alias("runs_b")), "fp_b")
        #: Pairs (fp_a, fp_b, likeness) of different classes that are alike.
        self.class_pairs = materialize(both.mapInArrow(_verify(likeness), "fp_a binary, fp_b binary, likeness double"), "near-pairs")
        discard(sets)
        discard(candidates)

    def pairs(self) -> DataFrame:
        """(a, b): alike items whose keys differ, a < b; a null key equals none.

        Copies are only written out where their keys differ: classes are first
        split by key, and only groups with different keys are joined.
        """
        members = self.members.withColumn("group", F.coalesce(F.concat(F.lit("k"), "key"), F.concat(F.lit("i"), "id")))
        groups = members.select("fp", "group").distinct()
        several = groups.groupBy("fp").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select(F.col("fp").alias("fp_a"), F.col("fp").alias("fp_b"))
        met = self.class_pairs.select("fp_a", "fp_b").unionByName(several)
        a = groups.select(F.col("fp").alias("fp_a"), F.col("group").alias("group_a"))
        b = groups.select(F.col("fp").alias("fp_b"), F.col("group").alias("group_b"))
        keyed = met.join(a, "fp_a").join(b, "fp_b").where((F.col("group_a") != F.col("group_b")) & ((F.col("fp_a") != F.col("fp_b")) | (F.col("group_a") < F.col("group_b"))))
        left = members.select(F.col("fp").alias("fp_a"), F.col("group").alias("group_a"), F.col("id").alias("id_a"))
        right = members.select(F.col("fp").alias("fp_b"), F.col("group").alias("group_b"), F.col("id").alias("id_b"))
        out = keyed.join(left, ["fp_a", "group_a"]).join(right, ["fp_b", "group_b"])
        return out.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def near_duplicates(symbols: DataFrame, likeness: float = LIKENESS, least_tokens: int = LEAST_TOKENS, tile: int = TILE) -> DataFrame:
    """Pairs (canonical_id_a, canonical_id_b), a < b, of alike symbols with different substitution keys.

    Symbols need an id, a text and at least ``least_tokens`` clone tokens. Texts
    of fewer than three words are like nothing. A null key differs from every
    other. Of a symbol delivered again the latest row holds. Empty input gives
    an empty result; extra columns are ignored.
    """
    return Search(_items(symbols, least_tokens), likeness, tile).pairs().select(F.col("a").alias("canonical_id_a"), F.col("b").alias("canonical_id_b"))


def near_groups(symbols: DataFrame, likeness: float = LIKENESS, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """One row (canonical_id, group_id, links) per symbol: its connected group's least id and its alike classes.

    ``links`` counts other classes of equal texts alike to the symbol's own;
    copies within a class are linked without being counted.
    """
    from lodestrata.operators.components import connected_components

    search = Search(_items(symbols, least_tokens), likeness)
    pairs, nodes = search.class_pairs.select("fp_a", "fp_b"), search.members
    ids = nodes.groupBy("fp").agg(F.min("id").alias("rep"))
    edges = pairs.join(ids.select(F.col("fp").alias("fp_a"), F.col("rep").alias("src")), "fp_a").join(ids.select(F.col("fp").alias("fp_b"), F.col("rep").alias("dst")), "fp_b").select("src", "dst")
    groups = connected_components(edges)
    degree = edges.select(F.col("src").alias("rep")).unionAll(edges.select(F.col("dst").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    out = nodes.join(ids, "fp").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    return out.select(F.col("id").alias("canonical_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _items(symbols: DataFrame, least_tokens: int) -> DataFrame:
    wanted = (F.col("clone_token_count") >= least_tokens) & F.col("span_text").isNotNull() & F.col("canonical_id").isNotNull()
    return spread(symbols.where(wanted).select(F.col("canonical_id").alias("id"), F.col("indexed_at").alias("at"), F.col("clone_substitution_key").alias("key"), F.col("span_text").alias("text")))
