"""Packet tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quietwire.schemas import PACKET


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKET).parquet(path)


def packet_stream(
    spark: SparkSession, path: str, max_files: int = 32, delay: str | None = None
) -> DataFrame:
    """Packet files as a stream, oldest files first; ``delay`` sets a watermark on ``ts``."""
    stream = (
        spark.readStream.schema(PACKET)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
        .withColumn("ts", F.timestamp_micros("t_us"))
    )
    return stream if delay is None else stream.withWatermark("ts", delay)
