"""The results log as a stream: new records are appended as they come, the latest of each experiment kept by upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the log's records."""
    lines = spark.readStream.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def append_to(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there now to a Parquet log, exactly once, and stops."""
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
