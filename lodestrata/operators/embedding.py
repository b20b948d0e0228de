"""Vectors of texts from a table of token vectors, their byte form, and token counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import spread


def static_embeddings(tokens: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """(key, embedding): the mean of a text's token vectors, scaled to length 1.

    ``tokens`` (key, token) has a row for each token of each text, ``table``
    (token, vector) a vector per token; tokens without one say nothing, and a
    text of such alone has none. Equal tokens of a text are counted first, so
    the table is met once per different token; a text's different tokens are
    what one task holds. A mean of length 0 stays as it is.
    """
    counted = tokens.where(F.col(key).isNotNull() & F.col("token").isNotNull()).groupBy(key, "token").agg(F.count(F.lit(1)).cast("double").alias("n"))
    met = counted.join(table.select("token", "vector"), "token")
    parts = met.groupBy(key).agg(F.sum("n").alias("_all"), F.collect_list(F.transform("vector", lambda x: x.cast("double") * F.col("n"))).alias("v"))
    total = F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.element_at("v", 1), lambda done, x: F.zip_with(done, x, lambda a, b: a + b))
    mean = parts.select(key, F.transform(total, lambda x: x / F.col("_all")).alias("m"))
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda done, x: done + x * x))
    sized = mean.withColumn("_l", length)
    return sized.select(key, F.transform("m", lambda x: F.when(F.col("_l") > 0, x / F.col("_l")).otherwise(x)).alias("embedding"))


def vector_bytes(vector):
    """A column of vectors as bytes: 32-bit floats, the low byte first; null stays null."""
    return F.pandas_udf(_bytes, "binary")(vector)


def _bytes(vectors: pd.Series) -> pd.Series:
    import numpy as np

    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def token_counts(texts: DataFrame, vocabulary: str, key: str = "id", text: str = "text") -> DataFrame:
    """(key, tokens): how many tokens each text has under a public tokenizer's vocabulary file, special tokens left out.

    The file is read by the driver and sent to the executors. Null texts have 0.
    """
    with open(vocabulary, encoding="utf-8") as f:
        sent = texts.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = None
        for b in batches:
            t = t or Tokenizer.from_str(sent.value)
            t.encode_special_tokens = True
            got = t.encode_batch([x or "" for x in b.column("text").to_pylist()], add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(e.ids) for e in got], pa.int32())], ["key", "tokens"])

    rows = texts.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]
    return spread(rows).mapInArrow(run, f"key {kind}, tokens int").withColumnRenamed("key", key)
