"""Session helpers: where intermediate tables go and how base tables are read."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where the session names none and runs on one machine (master ``local``), a
    temporary folder is made, once a process. On a cluster no folder of one
    machine would do, so there a session without the setting is an error.
    """
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(-cluster)?(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="lodestrata-"))
    return _made[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; its folder goes with it
        pass


def materialize(df: DataFrame, label: str = "table", keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage: executors lost later do not cause a recomputation, and
    several consumers read columns instead of repeating the work.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        if before is not None:  # the shuffles of this write are of no use once the table is there
            spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    if not keep:
        atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestrata_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` gave, once nothing reads it any more."""
    _remove(df.sparkSession, df._lodestrata_path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lodestrata-")) / "lodestrata.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._lodestrata_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def bounded(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than it must."""
    return df.limit(most + 1).count() <= most


def broadcast_within(df: DataFrame, most: int) -> DataFrame:
    """Hint a broadcast only where the row count has been checked."""
    return F.broadcast(df) if bounded(df, most) else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that is heavy a row.

    Only an input of a few files is moved; one of many partitions stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def latest_per_key(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """One row per ``key``: of rows delivered again the latest by ``at`` holds.

    Ties are settled by the greatest payload. Rows with a null ``at`` count as
    the earliest. Partial aggregation keeps one row per key and task before the
    shuffle, so that a key holding a third of the rows costs no more than others.
    """
    order = F.struct(F.col(at).isNotNull().alias("k0"), F.col(at).alias("k1"), *[F.col(c).alias(f"v_{c}") for c in columns])
    return df.groupBy(key).agg(F.max(order).alias("_m")).select(key, *[F.col(f"_m.v_{c}").alias(c) for c in columns])
