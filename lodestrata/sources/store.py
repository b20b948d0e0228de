"""A store of tables published as whole builds.

A build's tables are written to a folder of their own; a small manifest that
names the folder is put in place last. Readers resolve the manifest once and so
see one build throughout, whatever is published meanwhile.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK, VERSION = "lodestrata-store", 1


class StoreError(Exception):
    """The folder holds no store of ours, or one of another version."""


def _paths(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _read(spark: SparkSession, path: str) -> str | None:
    jvm, fs, where = _paths(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    """Write beside and rename over, so readers see the old text or the new."""
    jvm, fs, where = _paths(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    # one step that replaces: at no moment is there no manifest
    modes = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    modes[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    full = fs.makeQualified(where)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), full, modes)


def manifest(spark: SparkSession, root: str, older: bool = False) -> dict | None:
    """The manifest of a store: null where there is none, an error where it isn't ours or of another version; with ``older`` one of an older version is given too."""
    text = _read(spark, f"{root}/manifest.json")
    if text is None:
        return None
    try:
        found = json.loads(text)
    except ValueError as e:
        raise StoreError(f"{root} holds no store of ours") from e
    if not isinstance(found, dict) or found.get("mark") != MARK:
        raise StoreError(f"{root} holds no store of ours")
    if found["version"] != VERSION and not (older and isinstance(found["version"], int) and found["version"] < VERSION):
        raise StoreError(f"{root} has version {found['version']}; rebuild it")
    return found


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], facts: dict | None = None) -> str:
    """Write all tables as one build and put it in place; a failure leaves the build before it.

    A store of an older version is replaced; what isn't ours, or of a newer version, is refused.
    """
    manifest(spark, root, older=True)
    build = uuid.uuid4().hex
    for name, df in tables.items():
        if name == "symbols" and "class" in df.columns and "document_path" in df.columns:
            stray = (F.col("class") == "external") & F.col("document_path").isNotNull()
            df = df.withColumn("class", F.when(stray, F.raise_error(F.lit("an external symbol carries a definition"))).otherwise(F.col("class")))
        if name == "edges":
            df = df.dropDuplicates(["kind", "src", "dst"])
        df.write.parquet(f"{root}/builds/{build}/{name}")
    _write(spark, f"{root}/manifest.json", json.dumps({"mark": MARK, "version": VERSION, "build": build, "tables": sorted(tables), "facts": facts or {}}, sort_keys=True))
    return build


class Snapshot:
    """One build of a store, as it was when this was made."""

    def __init__(self, spark: SparkSession, root: str):
        found = manifest(spark, root)
        if found is None:
            raise StoreError(f"{root} holds no store")
        self.spark, self.root, self.facts, self.build, self.names = spark, root, found["facts"], found["build"], found["tables"]

    def semantic_identity(self) -> dict | None:
        """What its vectors were made with: model, corpus version and chunk parameters; null where the build names no model."""
        if self.facts.get("model") is None:
            return None
        return {k: self.facts.get(k) for k in ("model", "corpus_version", "chunk_size", "chunk_overlap")}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/builds/{self.build}/{name}")
