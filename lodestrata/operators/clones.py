"""Copies of code by keys and by token fingerprints."""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.tokens import BOUNDARY, IDENTIFIER, LITERAL, Token, tokens_of
from lodestrata.operators.intervals import overlapping
from lodestrata.operators.similarity import contributes
from lodestrata.runtime import bounded, materialize, spread

#: Fingerprints: tokens of a run, and runs of a window (fixed values).
KGRAM, WINDOW = 16, 17
#: Pairs with more seeds than this are named and not compared (fixed value).
MOST_SEEDS = 1_000_000


def _hash_parts(parts: list[bytes]) -> "hashlib._Hash":
    h = hashlib.sha256()
    for p in parts:
        h.update(struct.pack("<Q", len(p)))
        h.update(p)
    return h


def clone_keys(tokens: list[Token]) -> tuple[str, str]:
    """(formatting key, substitution key) of a token series.

    The first stands for the tokens as spelled. For the second each identifier
    and each literal is replaced by its class and the ordinal of its first
    appearance in that class, so consistent renaming leaves it unchanged.
    """
    spelled = [t.text.encode() for t in tokens]
    seen: dict[tuple[str, str], int] = {}
    count = {IDENTIFIER: 0, LITERAL: 0}
    replaced = []
    for t in tokens:
        if t.kind in count:
            k = (t.kind, t.text)
            if k not in seen:
                seen[k] = count[t.kind]
                count[t.kind] += 1
            replaced.append(f"{t.kind}{seen[k]}".encode())
        else:
            replaced.append(t.text.encode())
    return _hash_parts(spelled).hexdigest(), _hash_parts(replaced).hexdigest()


def comparable_tokens(text: str, path: str, contained: list[tuple]) -> list[Token]:
    """Tokens of a text in which each contained span (start, end, and its symbol if known; overlapping ones as one) counts as one boundary token.

    The boundary is spelled as the symbol of the merged span: the earliest, then longest, then least one.
    """
    merged: list[list] = []
    for a, z, *name in sorted(contained, key=lambda c: (c[0], -c[1], *c[2:])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z, *(name or [""])])
    starts = [m[0] for m in merged]
    out = [Token(BOUNDARY, name, a) for a, _, name in merged]
    for t in tokens_of(text, path):
        k = bisect_right(starts, t.start) - 1
        if k < 0 or t.start >= merged[k][1]:
            out.append(t)
    return sorted(out, key=lambda t: t.start)


def _tokens(text: str, path: str, start: int | None, end: int | None, contained: list[dict] | None) -> list[Token]:
    """Comparable tokens of a symbol; spans count characters or bytes, whichever its text is as long as."""
    if not contained:
        return tokens_of(text, path)
    raw = None if end - start == len(text) else text.encode()
    at = lambda o: o - start if raw is None else len(raw[: o - start].decode(errors="ignore"))
    return comparable_tokens(text, path, [(at(c["start"]), at(c["end"]), c["id"]) for c in contained])


_TEXT_COLUMNS = ("text", "path", "start", "end", "contained")
#: Kinds that are read around the symbols they contain; others that contain symbols give nothing.
CALLABLE = ["function", "method"]


def _texts(symbols: DataFrame) -> DataFrame:
    """(id, text, path, start, end, contained): texts with the symbols that lie within them in the same document.

    Contained symbols say more than their name and differ in extent. Types and
    modules that contain any are left out.
    """
    have = lambda c: F.col(c) if c in symbols.columns else F.lit(None).cast("string")
    known = symbols.where("canonical_id IS NOT NULL AND span_text IS NOT NULL")
    rows = known.select(F.col("canonical_id").alias("id"), F.col("span_text").alias("text"), F.col("document_path").alias("path"), F.lower(F.trim(have("kind"))).alias("kind"), have("span_start").cast("long").alias("start"), have("span_end").cast("long").alias("end"))
    says = contributes(have("display_name"), have("signature_text"), have("interface_text"), F.col("span_text"))
    spans = known.select("canonical_id", F.concat_ws("\0", have("workspace_id"), "document_path").alias("document_path"), have("span_start").cast("long").alias("start"), have("span_end").cast("long").alias("end"), F.coalesce(says, F.lit(True)).alias("says"))
    spans = spans.where("document_path IS NOT NULL AND start IS NOT NULL AND `end` IS NOT NULL").dropDuplicates(["canonical_id"])
    outer = spans.select("document_path", F.col("canonical_id").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    inner = spans.where("says").select("document_path", F.col("canonical_id").alias("b"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    within = overlapping(outer, inner).where("a <> b AND a_start <= b_start AND b_end <= a_end AND (a_start < b_start OR b_end < a_end)")
    within = materialize(within.select(F.col("a").alias("id"), F.struct(F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.col("b").alias("id")).alias("c")), "contained")
    lists = within.groupBy("id").agg(F.sort_array(F.collect_list("c")).alias("contained"))
    out = rows.join(F.broadcast(lists) if bounded(within, 100_000) else lists, "id", "left")
    return out.where(F.col("contained").isNull() | F.col("kind").isin(CALLABLE)).select("id", *_TEXT_COLUMNS)


def run_hash(tokens: list[Token]) -> int:
    """A run of tokens as a signed 64-bit number: identifiers and literals count by class."""
    parts = [t.kind.encode() if t.kind in (IDENTIFIER, LITERAL) else t.text.encode() for t in tokens]
    return int.from_bytes(_hash_parts(parts).digest()[:8], "little", signed=True)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places picked from a series of hashes: in each window the rightmost least, each once."""
    n = len(hashes)
    if n == 0:
        return []
    if n < window:
        return [int(n - 1 - np.argmin(hashes[::-1]))]
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    picked = np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1)
    return sorted(set(picked.tolist()))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for x in zip(*(b.column(c).to_pylist() for c in _TEXT_COLUMNS)):
            tokens = _tokens(*x)
            rows.append((*((None, None) if x[-1] else clone_keys(tokens)), len(tokens)))
        f, s, n = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(f, pa.string()), pa.array(s, pa.string()), pa.array(n, pa.int32())], ["id", "formatting_key", "substitution_key", "token_count"])


def keyed(symbols: DataFrame) -> DataFrame:
    """(canonical_id, formatting_key, substitution_key, token_count) computed from the texts.

    A function that contains other symbols has the count of its own tokens but no keys.
    """
    return spread(_texts(symbols)).mapInArrow(_keyed, "id string, formatting_key string, substitution_key string, token_count int").dropDuplicates(["id"]).withColumnRenamed("id", "canonical_id")


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rows = [], []
        for i, *x in zip(*(b.column(c).to_pylist() for c in ("id", *_TEXT_COLUMNS))):
            tokens = _tokens(*x)
            ids += [i] * len(tokens)
            rows += [(k, *t) for k, t in enumerate(tokens)]
        n, kind, text, start = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(n, pa.int32()), pa.array(kind, pa.string()), pa.array(text, pa.string()), pa.array(start, pa.int32())], ["canonical_id", "ordinal", "kind", "text", "start"])


def spelled_tokens(symbols: DataFrame) -> DataFrame:
    """(canonical_id, ordinal, kind, text, start): the tokens of each text as they are compared, comments and documentation left out."""
    return spread(_texts(symbols)).mapInArrow(_spelled, "canonical_id string, ordinal int, kind string, text string, start int").dropDuplicates(["canonical_id", "ordinal"])


def _picked(tokens: list[Token], k: int, window: int) -> list[tuple[int, int]]:
    # run_hash of each run, its tokens packed once
    parts = [t.kind.encode() if t.kind in (IDENTIFIER, LITERAL) else t.text.encode() for t in tokens]
    packed = [struct.pack("<Q", len(p)) + p for p in parts]
    at = [0, *accumulate(map(len, packed))]
    whole = b"".join(packed)
    digests = b"".join([hashlib.sha256(whole[a:z]).digest()[:8] for a, z in zip(at, at[k:])])
    series = np.frombuffer(digests, "<i8")
    return [(int(series[at]), at) for at in winnow(series, window)]


def _fingerprinted(k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, places = [], [], []
            for i, *x in zip(*(b.column(c).to_pylist() for c in ("id", *_TEXT_COLUMNS))):
                for h, at in _picked(_tokens(*x), k, window):
                    ids.append(i)
                    hashes.append(h)
                    places.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(hashes, pa.int64()), pa.array(places, pa.int32())], ["canonical_id", "hash", "token_ordinal"])

    return run


def fingerprints(symbols: DataFrame, k: int = KGRAM, window: int = WINDOW) -> DataFrame:
    """(canonical_id, hash, token_ordinal): picked runs of k tokens of each text, contained symbols read as one token each."""
    return spread(_texts(symbols)).mapInArrow(_fingerprinted(k, window), "canonical_id string, hash long, token_ordinal int").distinct()


def clone_groups(keys: DataFrame) -> DataFrame:
    """Members of substitution keys that two or more symbols share.

    ``keys`` has canonical_id, substitution_key, formatting_key, token_count.
    Result: group_id (the least member), canonical_id, members, token_count,
    exact_set (ordinal of the formatting key by its first member, from 0) and
    exact (whether the group has one formatting key). Null keys are in no group;
    a null formatting key is a set of its own. Counting is done by aggregation,
    so a key that a third of all symbols share is no single task's group.
    """
    rows = keys.where("substitution_key IS NOT NULL AND canonical_id IS NOT NULL").withColumn("f", F.coalesce("formatting_key", F.concat(F.lit("?"), "canonical_id")))
    sets = rows.groupBy("substitution_key", "f").agg(F.min("canonical_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("token_count").alias("tokens"))
    groups = sets.groupBy("substitution_key").agg(F.min("first").alias("group_id"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("sets"), F.max("tokens").alias("token_count")).where("members > 1")
    order = Window.partitionBy("substitution_key").orderBy("first")
    numbered = sets.select("substitution_key", "f", (F.row_number().over(order) - 1).alias("exact_set"))
    out = rows.select("canonical_id", "substitution_key", "f").join(groups, "substitution_key").join(numbered, ["substitution_key", "f"])
    return out.select("group_id", "canonical_id", "members", "token_count", "exact_set", (F.col("sets") == 1).alias("exact"))


def in_order(groups: DataFrame) -> DataFrame:
    """(canonical_id, place) of each member in its group: those spelled as its first ahead of variants, then by id."""
    w = Window.partitionBy("group_id").orderBy(F.when(F.col("exact_set") == 0, 0).otherwise(1), "canonical_id")
    return groups.select("canonical_id", F.row_number().over(w).alias("place"))


def fragment_seeds(fingerprint_rows: DataFrame, most: int = MOST_SEEDS, common: int = 64) -> DataFrame:
    """(passage_a, passage_b, seeds, compared): pairs of passages by the fingerprints they share.

    Every place of a hash in one passage meets every place in the other. Counts
    are multiplied per hash before pairs are summed, so places are never paired.
    Every shared hash starts pairs. A hash in more than ``common`` passages is
    met in blocks of about that many, each two of them (and each with itself)
    a join key of their own, so it is no single task's work. The pairs of such
    a hash are as many as its passages squared, and so is the result.
    """
    per = fingerprint_rows.where("hash IS NOT NULL AND passage_id IS NOT NULL").select("hash", "passage_id", "token_ordinal").distinct().groupBy("hash", "passage_id").agg(F.count(F.lit(1)).alias("n"))
    blocks = per.groupBy("hash").agg(F.count(F.lit(1)).alias("passages")).where("passages > 1").select("hash", F.ceil(F.col("passages") / common).alias("blocks"))
    placed = materialize(per.join(blocks, "hash").withColumn("block", F.pmod(F.xxhash64("passage_id"), F.col("blocks"))), "seeds")
    left = placed.select("hash", F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"), F.col("passage_id").alias("l"), F.col("n").alias("nl"))
    right = placed.select("hash", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("x"), F.col("block").alias("y"), F.col("passage_id").alias("r"), F.col("n").alias("nr"))
    met = left.join(right, ["hash", "x", "y"]).where("x < y OR l < r")
    pairs = met.groupBy(F.least("l", "r").alias("passage_a"), F.greatest("l", "r").alias("passage_b")).agg(F.sum(F.col("nl") * F.col("nr")).alias("seeds"))
    return pairs.select("passage_a", "passage_b", "seeds", (F.col("seeds") <= most).alias("compared"))


def _outer_runs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which runs of one pair lie in no longer one, of equal ones the first; the longest are looked at first.

    Only runs that were kept can hold another, so each is held against those alone.
    """
    order = np.lexsort((b, a, -n))
    keep = np.zeros(len(n), bool)
    kept = np.zeros((3, len(n)), np.int64)
    count = 0
    for i in order:
        x, y, m = kept[:, :count]
        if not ((x <= a[i]) & (a[i] + n[i] <= x + m) & (y <= b[i]) & (b[i] + n[i] <= y + m)).any():
            keep[i] = True
            kept[:, count] = a[i], b[i], n[i]
            count += 1
    return keep


def _uncontained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pair; the last pair of a batch waits for the next."""
    held = None

    def kept(t: pa.Table, new: np.ndarray) -> pa.Table:
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(new))
        a, b, n = (t.column(c).to_numpy().astype(np.int64) for c in ("a_start", "b_start", "length"))
        keep = np.ones(len(new), bool)
        for x, y in zip(starts, ends):
            if y - x > 1:
                keep[x:y] = _outer_runs(a[x:y], b[x:y], n[x:y])
        return t.filter(pa.array(keep))

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        p, q = t.column("passage_a").to_numpy(zero_copy_only=False), t.column("passage_b").to_numpy(zero_copy_only=False)
        new = np.concatenate(([True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield from kept(t.slice(0, cut), new[:cut]).to_batches()
        held = t.slice(cut)
    if held is not None:
        yield from kept(held, np.arange(held.num_rows) == 0).to_batches()


def drop_contained(runs: DataFrame) -> DataFrame:
    """Runs (passage_a, passage_b, a_start, b_start, length) that lie in no longer run of their pair in both passages."""
    pair = ["passage_a", "passage_b"]
    return runs.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(_uncontained, runs.schema)


def data_flags(tokens: list[Token], rust: bool) -> list[bool]:
    """Which tokens are data: literals, signs of numbers, and brackets and separators (in Rust also the mark of a borrow)."""
    out = []
    for i, t in enumerate(tokens):
        if t.kind == LITERAL or (t.text and all(c in ",;:()[]{}" for c in t.text)) or (rust and t.text == "&"):
            out.append(True)
            continue
        following = tokens[i + 1] if i + 1 < len(tokens) else None
        number = following is not None and following.kind == LITERAL and following.text[:1].isdigit()
        operand = i > 0 and (tokens[i - 1].kind in (IDENTIFIER, LITERAL) or tokens[i - 1].text in (")", "]"))
        out.append(t.text in ("-", "+") and number and not operand)
    return out


def data_breaks(a: list[Token], b: list[Token], data_a: list[bool], data_b: list[bool], shift: int, least: int) -> set[int]:
    """Places in ``a`` on the diagonal of ``shift`` where a stretch of data is spelled differently.

    A stretch is a longest one of places at which both sides hold data; only
    those of ``least`` tokens or more count, wherever a run begins or ends.
    """
    out: set[int] = set()
    begun = None
    first, end = max(0, shift), min(len(a), len(b) + shift)
    for k in range(first, end + 1):
        if k < end and data_a[k] and data_b[k - shift]:
            begun = k if begun is None else begun
        elif begun is not None:
            if k - begun >= least:
                out.update(m for m in range(begun, k) if a[m].text != b[m - shift].text)
            begun = None
    return out


def shared_runs(a: list[Token], b: list[Token], least: int = KGRAM, shifts: Iterable[int] | None = None, data: tuple[list[bool], list[bool], int] | None = None) -> list[tuple[int, int, int]]:
    """Longest runs (start in a, start in b, length) two token series share under a one-to-one renaming.

    Tokens are equal where their classes and, but for identifiers and literals,
    their spellings are; within a run the renaming of identifiers and of
    literals is one-to-one. Runs contained in another in both series are left out.
    A boundary is in no run. Where ``shifts`` are given, only runs whose starts
    differ by one of them are looked for. ``data`` gives which tokens of both
    are data and how long a stretch of them has to be for its spelling to count.
    """

    def same(x: Token, y: Token) -> bool:
        return x.kind == y.kind != BOUNDARY and (x.kind in (IDENTIFIER, LITERAL) or x.text == y.text)

    found = []
    for shift in range(-(len(b) - 1), len(a)) if shifts is None else sorted(set(shifts)):
        i, end = max(0, shift), min(len(a), len(b) + shift)
        start, there, back = i, {}, {}
        broken = data_breaks(a, b, data[0], data[1], shift, data[2]) if data else ()
        k = i
        while k < end:
            x, y = a[k], b[k - shift]
            kx, ky = (x.kind, x.text), (y.kind, y.text)
            if not same(x, y) or k in broken:
                if k - start >= least:
                    found.append((start, start - shift, k - start))
                start, there, back = k + 1, {}, {}
            elif x.kind in (IDENTIFIER, LITERAL) and (there.get(kx, (ky,))[0] != ky or back.get(ky, (kx,))[0] != kx):
                if k - start >= least:
                    found.append((start, start - shift, k - start))
                # go on behind the last place that disagrees
                cut = max(there.get(kx, (ky, -1))[1] if there.get(kx, (ky,))[0] != ky else -1, back.get(ky, (kx, -1))[1] if back.get(ky, (kx,))[0] != kx else -1) + 1
                start, there, back = cut, {}, {}
                for m in range(cut, k):
                    p, q = a[m], b[m - shift]
                    if p.kind in (IDENTIFIER, LITERAL):
                        there[(p.kind, p.text)], back[(q.kind, q.text)] = ((q.kind, q.text), m), ((p.kind, p.text), m)
                there[kx], back[ky] = (ky, k), (kx, k)
            elif x.kind in (IDENTIFIER, LITERAL):
                there[kx], back[ky] = (ky, k), (kx, k)
            k += 1
        if end - start >= least:
            found.append((start, start - shift, end - start))
    found.sort(key=lambda r: (-r[2], r[0], r[1]))
    kept: list[tuple[int, int, int]] = []
    for s, t, n in found:
        if not any(x <= s and s + n <= x + m and y <= t and t + n <= y + m for x, y, m in kept):
            kept.append((s, t, n))
    return kept


def _compared(k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(2_000)
        def read(text, path, start, end, contained):
            tokens = _tokens(text, path, start, end, [dict(zip(("start", "end", "id"), c)) for c in contained])
            places: dict[int, list[int]] = {}
            for h, at in _picked(tokens, k, window):
                places.setdefault(h, []).append(at)
            return tokens, places, None if contained else clone_keys(tokens)[1], data_flags(tokens, bool(path) and path.endswith(".rs"))

        def side(x: dict):
            return read(*(x[c] for c in _TEXT_COLUMNS[:-1]), tuple((c["start"], c["end"], c["id"]) for c in x["contained"] or ()))

        for batch in batches:
            out: list[tuple] = []
            for i, j, x, y in zip(*(batch.column(c).to_pylist() for c in ("symbol_a", "symbol_b", "a", "b"))):
                (a, at_a, key_a, data_a), (b, at_b, key_b, data_b) = side(x), side(y)
                if key_a is not None and key_a == key_b:  # clones as a whole
                    continue
                shifts = {p - q for h in at_a.keys() & at_b.keys() for p in at_a[h] for q in at_b[h]}
                for p, q, n in shared_runs(a, b, k + window - 1, shifts, (data_a, data_b, k)):
                    out.append((i, j, True, p, q, n, all(t.text == u.text for t, u in zip(a[p : p + n], b[q : q + n]))))
            yield pa.RecordBatch.from_pylist([dict(zip(_FRAGMENTS.names, r)) for r in out], schema=_FRAGMENTS)

    return run


_FRAGMENTS = pa.schema([("symbol_a", pa.string()), ("symbol_b", pa.string()), ("compared", pa.bool_()), ("a_start", pa.int32()), ("b_start", pa.int32()), ("length", pa.int32()), ("exact", pa.bool_())])


def fragment_clones(symbols: DataFrame, k: int = KGRAM, window: int = WINDOW, most: int = MOST_SEEDS, subject: str | None = None) -> DataFrame:
    """(symbol_a, symbol_b, compared, a_start, b_start, length, exact): runs of tokens that two symbols share.

    Pairs come from the fingerprints they share; one of more than ``most`` seeds
    is named once with null runs. Every shared run of k + window - 1 tokens or
    more is found, as its start in both token series; exact where it is spelled
    alike. Symbols that are clones as a whole are no pair. With ``subject``, only
    its own pairs, the subject as symbol_a. Without, the pairs of a corpus are up
    to its symbols squared.
    """
    prints = fingerprints(symbols, k, window).withColumnRenamed("canonical_id", "passage_id")
    if subject is None:
        seeds = fragment_seeds(prints, most)
    else:
        per = prints.groupBy("hash", "passage_id").agg(F.count(F.lit(1)).alias("n"))
        mine = per.where(F.col("passage_id") == subject).select("hash", F.col("passage_id").alias("passage_a"), F.col("n").alias("na"))
        met = per.where(F.col("passage_id") != subject).join(mine, "hash").groupBy("passage_a", F.col("passage_id").alias("passage_b")).agg(F.sum(F.col("n") * F.col("na")).alias("seeds"))
        seeds = met.withColumn("compared", F.col("seeds") <= most)
    seeds = materialize(seeds.select(F.col("passage_a").alias("symbol_a"), F.col("passage_b").alias("symbol_b"), "compared"), "pairs")
    texts = _texts(symbols).dropDuplicates(["id"]).select("id", F.struct(*_TEXT_COLUMNS).alias("t"))
    pairs = seeds.where("compared").join(texts.toDF("symbol_a", "a"), "symbol_a").join(texts.toDF("symbol_b", "b"), "symbol_b")
    found = pairs.mapInArrow(_compared(k, window), "symbol_a string, symbol_b string, compared boolean, a_start int, b_start int, length int, exact boolean")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("a_start", "int"), ("b_start", "int"), ("length", "int"), ("exact", "boolean"))]
    return found.unionByName(seeds.where("NOT compared").select("symbol_a", "symbol_b", "compared", *none))
