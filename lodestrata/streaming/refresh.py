"""Keeping derived tables up to date as deliveries arrive.

The batch operators are the same; a stream only decides when they run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = T.StructType([T.StructField("workspace_id", T.StringType()), T.StructField("snapshot_no", T.IntegerType()), T.StructField("document_path", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("delivered_at", T.TimestampNTZType())])


def deliveries(spark: SparkSession, folder: str, schema: T.StructType = FILES, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def on_each_batch(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``refresh`` (batch, number) for each batch of a stream until all that is there has been read."""
    return stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(stream: DataFrame, at: str = "delivered_at", window: str = "1 day", late: str = "14 days") -> DataFrame:
    """Deliveries a window and workspace, rows later than ``late`` behind the newest left out."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", window), "workspace_id").agg(F.count(F.lit(1)).alias("deliveries"))
