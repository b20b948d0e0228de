"""Source trees as tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import is_discovered


def _relative(path: str, root: str):
    """A file's path below ``root``, whichever way a local root is written."""
    base = re.sub(r"^file:/+", "/", root.rstrip("/")) + "/"
    return F.substr(F.col(path), F.locate(base, F.col(path)) + F.lit(len(base)))


def scan_sources(spark: SparkSession, root: str, extension: str, skipped: tuple[str, ...] = ("target", "venv")) -> DataFrame:
    """(document_path, text) of the files below ``root`` with the extension.

    Paths are relative with ``/``. Hidden and ``skipped`` folders are left out,
    and so are files that are no UTF-8. Files are listed and read by tasks.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(root)
    rows = raw.select(_relative("path", root).alias("document_path"), "content")
    rows = rows.where(is_discovered(F.col("document_path"), extension, skipped) & F.is_valid_utf8(F.col("content").cast("string")))
    return rows.select("document_path", F.decode("content", "UTF-8").alias("text"))


def hashed(files: DataFrame) -> DataFrame:
    """(document_path, content_hash): SHA-256 of each text in hex."""
    return files.select("document_path", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(reference): one a line, blanks trimmed, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("reference")).where("reference <> ''")


def read_trials(spark: SparkSession, path: str, arm: str | None = None, version: str | None = None) -> DataFrame:
    """Trials from exported JSON lines, one object each, for one arm or all, and of one version of their parameters or all."""
    schema = "instance_id string, arm string, attempt long, started_at double, terminal_state string, params map<string,string>, metrics map<string,double>"
    rows = spark.read.schema(schema).json(path)
    rows = rows if arm is None else rows.where(F.col("arm") == arm)
    return rows if version is None else rows.where(F.col("params")["version"] == version)


def trial_key(*columns: str):
    """The first 24 hex digits of the SHA-256 over fields joined by U+001F."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns]), 256), F.lit(24))


def build_targets(metadata: DataFrame, column: str = "json") -> DataFrame:
    """(package, kind, name, root, manifest) of each build target in build-metadata JSON."""
    schema = "struct<packages:array<struct<name:string,manifest_path:string,targets:array<struct<kind:array<string>,name:string,src_path:string>>>>>"
    packages = metadata.select(F.explode(F.from_json(column, schema)["packages"]).alias("p"))
    targets = packages.select(F.col("p.name").alias("package"), F.col("p.manifest_path").alias("manifest"), F.explode("p.targets").alias("t"))
    return targets.select("package", F.element_at("t.kind", 1).alias("kind"), F.col("t.name").alias("name"), F.col("t.src_path").alias("root"), "manifest")


def directory_digest(spark: SparkSession, root: str, without: str | None = None, named: str | None = None) -> str:
    """SHA-256 over the paths and hashes of all files below ``root``, whatever their order.

    ``without`` is a folder to leave out; ``named`` a pattern whose first group
    stands for a path, where paths hold parts that mean nothing.

    The lines of paths and hashes, not the files, are what one task puts in order.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = raw.select(_relative("path", root).alias("p"), F.sha2("content", 256).alias("h"))
    if without:
        rows = rows.where(~F.col("p").startswith(without.rstrip("/") + "/"))
    if named:
        rows = rows.where(F.col("p").rlike(named)).select(F.regexp_extract("p", named, 1).alias("p"), "h")
    lines = rows.select(F.concat_ws("\x1f", "p", "h").alias("l"))
    return lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256)).first()[0]


def environment_facts(spark: SparkSession, root: str, version: str) -> DataFrame:
    """One row (version, path, fingerprint): the packages installed below ``root``, as a digest of their sorted names."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "METADATA").load(root)
    names = raw.select(F.regexp_extract("path", r"([^/]+)\.dist-info/METADATA$", 1).alias("n")).where("n <> ''").distinct()
    print_ = F.sha2(F.array_join(F.array_sort(F.collect_list("n")), "\n"), 256)
    return names.agg(print_.alias("fingerprint")).select(F.lit(version).alias("version"), F.lit(root).alias("path"), "fingerprint")
