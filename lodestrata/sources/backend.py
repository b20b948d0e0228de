"""The one plug-in point: sources of semantic indexes, as readers of Spark.

A backend lists its documents and says what each holds; its tasks do the work.
``register`` makes it a format of ``spark.read``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class Capabilities:
    """What a backend can do; what is not declared is absent."""

    enclosure: bool = False
    base_index: bool = False
    live_updates: bool = False


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class IndexBackend(DataSource):
    """A backend to subclass: ``documents`` and ``occurrences`` are its own."""

    capabilities = Capabilities()
    per_partition = 64

    @classmethod
    def name(cls) -> str:
        return cls.__name__.lower()

    def schema(self) -> str:
        return "document_path string, symbol string, start_line int, start_character int, end_line int, end_character int, is_definition boolean"

    def documents(self) -> list[str]:
        raise NotImplementedError

    def occurrences(self, path: str) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, backend: IndexBackend):
        self.backend = backend

    def partitions(self) -> list[InputPartition]:
        paths, n = self.backend.documents(), self.backend.per_partition
        return [_Part(paths[i : i + n]) for i in range(0, len(paths), n)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path in partition.paths:
            for row in self.backend.occurrences(path):
                yield (path, *row)


def register(spark: SparkSession, backend: type[IndexBackend]) -> str:
    spark.dataSource.register(backend)
    return backend.name()


def conformance(occurrences: DataFrame) -> DataFrame:
    """(clause, violations) of rows a backend gives: symbols there, ranges in order, no negative places, paths relative."""
    bad = {
        "symbol": F.coalesce(F.col("symbol"), F.lit("")) == "",
        "path": F.coalesce(F.col("document_path"), F.lit("")).rlike(r"^$|^/|\\|(^|/)\.\.?(/|$)"),
        "range": (F.struct("end_line", "end_character") < F.struct("start_line", "start_character")) | (F.least("start_line", "start_character", "end_line", "end_character") < 0),
        "role": F.col("is_definition").isNull(),
    }
    counts = occurrences.agg(*[F.count_if(c).alias(k) for k, c in bad.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in bad]), F.array(*[F.col(k) for k in bad]))).alias("clause", "violations"))


def split_duplicates(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, references): one symbol a definition where a symbol string is defined more than once.

    ``symbols``: symbol, duplicate_group (null where it is defined once),
    document_path, start_line. ``references``: rows with symbol or duplicate_group.
    """
    definitions = occurrences.where("is_definition").select("symbol", "document_path", "start_line", "start_character").distinct()
    n = definitions.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    counted = definitions.join(n, "symbol")
    symbols = counted.select(F.when(F.col("n") > 1, F.concat_ws("@", "symbol", "document_path", F.col("start_line").cast("string"), F.col("start_character").cast("string"))).otherwise(F.col("symbol")).alias("symbol"), F.when(F.col("n") > 1, F.col("symbol")).alias("duplicate_group"), "document_path", "start_line")
    refs = occurrences.where("NOT is_definition").join(n, "symbol", "left")
    many = F.col("n") > 1
    return symbols, refs.select(F.when(~F.coalesce(many, F.lit(False)), F.col("symbol")).alias("symbol"), F.when(many, F.col("symbol")).alias("duplicate_group"), "document_path", "start_line", "start_character")
