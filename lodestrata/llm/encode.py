"""Encoding of a corpus with a byte-level BPE through a table of its distinct words."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.runtime import materialize, spread

#: Where the vocabulary files lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("LODESTRATA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: The most words sent to every executor, and the longest of them in bytes: at most about 6 MB.
HOT_WORDS, HOT_BYTES = 65_536, 64

# White space by its Unicode property, spelled out because the short form differs between engines.
_SPACE = r"\x09-\x0d\x20\x85\xa0  -     　"
#: The vocabulary's own rule for words (fixed values).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


#: Follows each word of a split text; no text split by the engine holds it, for Unicode will never assign it.
_MARK = "\U0010ffff"


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read by the driver and sent to the executors, which need not have it."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoder(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabulary.value)
    t.encode_special_tokens = True
    return t


def _encode_words(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = None
        for b in batches:
            t = t or _encoder(vocabulary)
            got = [e.ids for e in t.encode_batch(b.column("word").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(got, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return run


def _split_in_python(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = None
        for b in batches:
            t = t or _encoder(vocabulary)
            words = [[x[a:z] for _, (a, z) in t.pre_tokenizer.pre_tokenize_str(x)] for x in b.column("open_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.list_(pa.string()))], ["doc_id", "words"])

    return run


def split_words(documents: DataFrame, vocabulary) -> list[DataFrame]:
    """The words of each text, in order, written once; null texts have none.

    Two tables that together hold every document. In (doc_id, marked) each word
    is followed by a mark: the engine's regular expressions split nearly all
    texts, and one string a text is handed on far faster than an array. Its
    tables of letters end at an older Unicode than the vocabulary's, so texts
    with characters unknown to it, the mark among them, are split by the
    vocabulary's own splitter: (doc_id, words).
    """
    kind = dict(documents.dtypes)["doc_id"]
    # a text of ASCII alone, told by its lengths, needs no look at its characters
    unknown = F.coalesce((F.octet_length("text") > F.length("text")) & F.col("text").rlike(r"\p{Cn}"), F.lit(False))
    looked = documents.select("doc_id", "text", unknown.alias("unknown"))
    marked = F.when(~F.col("unknown"), F.regexp_replace("text", PATTERN, f"$0{_MARK}"))
    split = materialize(looked.select("doc_id", marked.alias("marked"), F.when(F.col("unknown"), F.col("text")).alias("open_text")), "split")
    rest = split.where("open_text IS NOT NULL").select("doc_id", "open_text").mapInArrow(_split_in_python(vocabulary), f"doc_id {kind}, words array<string>")
    return [split.where("open_text IS NULL").select("doc_id", "marked"), rest]


def _flat(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """(all words of a batch, offsets of its rows among them); empty words stand for nothing."""
    if "marked" in batch.schema.names:
        column = pc.split_pattern(batch.column("marked").fill_null(""), _MARK)
    else:
        column = batch.column("words")
    offsets = column.offsets.to_numpy()
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each batch with their counts."""
    for b in batches:
        counts = pc.value_counts(_flat(b)[0])
        yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])


def _each(split: list[DataFrame], function, schema: str) -> DataFrame:
    """``function`` over both tables of split texts."""
    return split[0].mapInArrow(function, schema).unionByName(split[1].mapInArrow(function, schema))


def word_table(split: list[DataFrame], vocabulary) -> DataFrame:
    """(word, n, ids): every distinct word of all texts, its count and its token ids, encoded once."""
    counted = _each(split, _counted, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted.mapInArrow(_encode_words(vocabulary), "word string, n long, ids array<int>"), "words")


def hot_words(words: DataFrame, most: int = HOT_WORDS) -> dict[str, list[int]]:
    """The most frequent short words, ``most`` at the outside.

    The least count that keeps them within the bound is read off a histogram of
    counts by powers of two (at most 64 rows), so nothing is sorted.
    """
    short = words.where(F.octet_length("word") <= HOT_BYTES)
    bins = {r["k"]: r["c"] for r in short.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}
    taken, least = 0, None
    for k in sorted(bins, reverse=True):
        if taken + bins[k] > most:
            break
        taken, least = taken + bins[k], k
    if least is None:
        return {}
    return {r["word"]: r["ids"] for r in short.where(F.floor(F.log2("n")) >= least).select("word", "ids").collect()}


def _hot_table(hot: dict[str, list[int]]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(word to row, offsets of the rows, all ids one after another); the empty word has no ids."""
    hot = {"": []} | hot
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in hot.values()], dtype=np.int64))).astype(np.int64)
    return {w: k for k, w in enumerate(hot)}, offsets, np.fromiter((i for x in hot.values() for i in x), np.int32)


def _looked_up(batch: pa.RecordBatch, table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Per word of a batch: its row in the table (-1: none) and number of ids; the rows' offsets among the words; the table's offsets; the words."""
    words, offsets = _flat(batch)
    coded = words.dictionary_encode()
    rows = np.fromiter((table[0].get(w, -1) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    row = rows[coded.indices.to_numpy()] if len(rows) else np.zeros(0, np.int64)
    size = np.where(row >= 0, table[1][row + 1] - table[1][row], 0)
    return row, size, offsets, table[1], coded


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _known(table):
    names = ["doc_id", "known", "at", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, size, offsets, starts, coded = _looked_up(b, table.value)
            before = np.concatenate(([0], np.cumsum(size)))
            have = row >= 0
            # the ids of all known words, one after another
            n = size[have]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[row[have]], n)
            missing = np.flatnonzero(~have)
            rare = np.searchsorted(missing, offsets)
            doc = np.searchsorted(offsets, missing, "right") - 1
            places = before[missing] - before[offsets[doc]]
            values = coded.dictionary.take(pa.array(coded.indices.to_numpy()[missing])) if len(missing) else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(before[offsets], pa.array(table.value[2][at])), _lists(rare, pa.array(places.astype(np.int32))), _lists(rare, values)], names)

    return run


def _known_sizes(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, size, offsets, _, coded = _looked_up(b, table.value)
            before = np.concatenate(([0], np.cumsum(size)))
            missing = np.flatnonzero(row < 0)
            values = coded.dictionary.take(pa.array(coded.indices.to_numpy()[missing])) if len(missing) else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(before[offsets[1:]] - before[offsets[:-1]]), _lists(np.searchsorted(missing, offsets), values)], ["doc_id", "known", "word"])

    return run


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the ids of the words that weren't known at their places."""
    for b in batches:
        out = []
        for known, parts in zip(b.column("known").to_pylist(), b.column("parts").to_pylist()):
            ids, done = [], 0
            for p in sorted(parts, key=lambda p: p["k"]):
                ids += known[done : p["at"]]
                done = p["at"]
                ids += p["ids"]
            out.append(ids + known[done:])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _prepared(documents: DataFrame, tokenizers: str, vocabulary: str, most_hot: int):
    """(split texts, table of words, broadcast table of hot words, type of doc_id)."""
    spark = documents.sparkSession
    docs = spread(documents.where("doc_id IS NOT NULL").select("doc_id", "text"))
    sent = _vocabulary(spark, os.path.join(tokenizers, vocabulary))
    split = split_words(docs, sent)
    words = word_table(split, sent)
    return split, words, spark.sparkContext.broadcast(_hot_table(hot_words(words, most_hot))), dict(docs.dtypes)["doc_id"]


def token_sizes(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, most_hot: int = HOT_WORDS) -> DataFrame:
    """(doc_id, tokens): the number of each document's token ids, by the same table of words, with no ids put together."""
    split, words, table, kind = _prepared(documents, tokenizers, vocabulary, most_hot)
    known = materialize(_each(split, _known_sizes(table), f"doc_id {kind}, known long, word array<string>"), "known-sizes")
    rare = known.where(F.size("word") > 0).select("doc_id", F.explode("word").alias("word")).join(words.select("word", F.size("ids").cast("long").alias("tokens")), "word")
    return known.select("doc_id", F.col("known").alias("tokens")).unionByName(rare.select("doc_id", "tokens")).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"))


def encode(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, most_hot: int = HOT_WORDS) -> DataFrame:
    """(doc_id, ids): each document's token ids, without special tokens.

    Texts are split into words by Spark; every distinct word is encoded once.
    Ids of frequent words come from a table of bounded size on every executor;
    the other words meet the table of words in a join and return to their
    places. Null and empty texts give an empty list; strings that look like
    special tokens are ordinary text. Rows without doc_id give none; doc_id is
    taken to be unique. Extra columns are ignored.
    """
    split, words, table, kind = _prepared(documents, tokenizers, vocabulary, most_hot)
    known = materialize(_each(split, _known(table), f"doc_id {kind}, known array<int>, at array<int>, word array<string>"), "known-ids")
    whole = known.where(F.size("word") == 0).select("doc_id", F.col("known").alias("ids"))
    open_docs = known.where(F.size("word") > 0)
    rare = open_docs.select("doc_id", F.posexplode(F.arrays_zip("at", "word")).alias("k", "p")).select("doc_id", "k", F.col("p.at").alias("at"), F.col("p.word").alias("word"))
    found = rare.join(words.select("word", "ids"), "word")
    parts = found.groupBy("doc_id").agg(F.collect_list(F.struct("k", "at", "ids")).alias("parts"))
    filled = open_docs.select("doc_id", "known").join(parts, "doc_id").mapInArrow(_fill, f"doc_id {kind}, ids array<int>")
    return whole.unionByName(filled)


def _unmapped() -> dict[str, int]:
    """The printable stand-ins a byte-level vocabulary writes for bytes, back to the bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def pieces(spark: SparkSession, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece): the bytes of each id of the vocabulary, in hex."""
    with open(os.path.join(tokenizers, vocabulary), encoding="utf-8") as f:
        raw = json.load(f)
    back = _unmapped()
    rows = [(i, bytes(back[c] for c in piece).hex()) for piece, i in raw["model"]["vocab"].items()]
    rows += [(t["id"], t["content"].encode().hex()) for t in raw["added_tokens"] if t["id"] not in {i for i, _ in rows}]
    return spark.createDataFrame(pa.table({"id": pa.array(np.array([i for i, _ in rows], np.int32)), "piece": [p for _, p in rows]}))


def decode(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) through a join of ids with their pieces.

    Empty lists give an empty text. Bytes that are no UTF-8 become U+FFFD.
    """
    each = encoded.select("doc_id", F.posexplode("ids").alias("at", "id"))
    joined = each.join(table, "id").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("hex"))
    return encoded.select("doc_id").join(joined, "doc_id", "left").select("doc_id", F.decode(F.unhex(F.coalesce("hex", F.lit(""))), "UTF-8").alias("text"))
