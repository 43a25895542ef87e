"""A stream over a folder of metadata files: each set once, whatever is delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quireflow.sources.files import METADATA


def landed(spark: SparkSession, pattern: str, files_per_batch: int = 1000) -> DataFrame:
    """Metadata files as they arrive; files that do not parse have no set and are left out."""
    stream = spark.readStream.schema(METADATA).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch)
    return stream.json(pattern).filter(F.col("set").isNotNull()).dropDuplicates(["set", "locale"])


def drain(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there to a folder of Parquet files and ends."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
