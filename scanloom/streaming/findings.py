"""Extension: findings as a stream.  The batch pipeline's filter and summary over arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_table(spark: SparkSession, directory: str, schema: T.StructType, per_trigger: int = 10) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(directory)


def windowed_summary(findings: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str | None = "7 days") -> DataFrame:
    """(start, by, findings) in time windows; rows later than ``late`` behind the newest are dropped, nulls in time too.

    ``late`` is None where the stream has its watermark already.
    """
    w = F.window(time, width)
    return (findings.withWatermark(time, late) if late else findings).groupBy(w.alias("w"), *by).agg(F.count("*").alias("findings")).select(F.col("w.start").alias("start"), *by, "findings")


def once_each(findings: DataFrame, key: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Findings without redelivery within the watermark."""
    return findings.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def confident(findings: DataFrame, confidence: str, threshold: float) -> DataFrame:
    """Findings of at least a confidence; stateless."""
    return findings.where(F.coalesce(F.col(confidence) >= threshold, F.lit(False)))


def write_batches(stream: DataFrame, path: str, checkpoint: str, name: str):
    """A query that appends finished rows to parquet, exactly once, and ends when the input is read."""
    return stream.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
