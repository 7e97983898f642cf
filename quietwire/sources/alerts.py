"""The alert table: Parquet partitioned by date, clustered by address.

Rows are dealt by date and address and stand in the order of address and time, in small row groups with Bloom filters on the
address: a search for an address opens the footers of its days' files and reads the row groups that may hold it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from quietwire.operators.analytics import newest_alerts
from quietwire.schemas import ALERTS


def storable(alerts: DataFrame) -> DataFrame:
    """Alert rows as stored: time to the second, score 0.0 where none is given, date column."""
    ts = F.date_trunc("second", F.col("ts"))
    return alerts.select(*ALERTS.fieldNames()).withColumns(
        {
            "ts": ts,
            "anomaly_score": F.coalesce(F.col("anomaly_score"), F.lit(0.0)),
            "date": F.to_date(ts),
        }
    )


ROW_GROUP_BYTES = 4 << 20
ADDRESSES = 100_000
"""Addresses the Bloom filter of a row group is sized for; with more it only skips less."""


def _clustered() -> dict[str, str]:
    return {
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.bloom.filter.enabled#ip_address": "true",
        "parquet.bloom.filter.expected.ndv#ip_address": str(ADDRESSES),
    }


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append to the table. The rebalance by date and address keeps files few and lets AQE split a heavy one."""
    rows = storable(alerts).hint("rebalance", "date", "ip_address").sortWithinPartitions("date", "ip_address", "ts")
    rows.write.mode("append").options(**_clustered()).partitionBy("date").parquet(path)


def append_alert_stream(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to the table, exactly once by the file sink's log; a micro-batch's files are not clustered."""
    rows = storable(alerts)
    return (
        rows.writeStream.format("parquet")
        .options(**_clustered())
        .partitionBy("date")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def alert_table(spark: SparkSession, path: str) -> DataFrame:
    """All stored alerts; an absent table reads as an empty one."""
    schema = T.StructType([*ALERTS.fields, T.StructField("date", T.DateType())])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def between(alerts: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Alerts from ``start`` to ``end``, both included; the date column prunes partitions."""
    if start is not None:
        alerts = alerts.where((F.col("ts") >= F.lit(start)))
        if "date" in alerts.columns:
            alerts = alerts.where(F.col("date") >= F.lit(start.date()))
    if end is not None:
        alerts = alerts.where(F.col("ts") <= F.lit(end))
        if "date" in alerts.columns:
            alerts = alerts.where(F.col("date") <= F.lit(end.date()))
    return alerts


def load_alerts(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The alerts of a period, newest first: all of them, or the ``limit`` newest."""
    return newest_alerts(between(alert_table(spark, path), start, end), limit)


def alerts_of(
    spark: SparkSession, path: str, address: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """The alerts of one address, newest first. Equality reaches the row groups' statistics and Bloom filters."""
    return newest_alerts(between(alert_table(spark, path), start, end).where(F.col("ip_address") == address), None)


def export_alerts_csv(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
