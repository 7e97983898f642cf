"""Alerts as text log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quietwire import config as C
from quietwire.functions.text import group_or_null


def log_line(name: str = "quietwire") -> Column:
    """``time - name - INFO - [TYPE] subject - body`` from alert table columns."""
    return F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.lit(f" - {name} - INFO - ["),
        F.col("stored_type"),
        F.lit("] "),
        F.col("description"),
    )


def write_alert_log(alerts: DataFrame, path: str) -> None:
    """Write the limited alerts (those with ``subject - body``) as log lines."""
    alerts.select(log_line().alias("value")).write.mode("append").text(path)


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Alert rows from log lines; lines without a time or without an ML or RULE alert drop out."""
    line = F.col(column)
    ml_ip = group_or_null(line, C.LOG_ML_ALERT, 1)
    ml_score = group_or_null(line, C.LOG_ML_ALERT, 2).try_cast("double")
    body = group_or_null(line, C.LOG_RULE_ALERT, 1)
    source = F.coalesce(
        group_or_null(body, C.LOG_SOURCE), group_or_null(body, C.LOG_ANY_IP), F.lit("unknown")
    )
    is_ml = F.col("ml_ip").isNotNull()
    return (
        lines.select(
            F.try_to_timestamp(group_or_null(line, C.LOG_TIMESTAMP), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
            ml_ip.alias("ml_ip"),
            ml_score.alias("ml_score"),
            body.alias("body"),
            source.alias("source"),
        )
        .where(F.col("ts").isNotNull() & ((is_ml & F.col("ml_score").isNotNull()) | (~is_ml & F.col("body").isNotNull())))
        .select(
            "ts",
            F.when(is_ml, F.col("ml_ip")).otherwise(F.col("source")).alias("ip_address"),
            F.when(is_ml, F.col("ml_score")).otherwise(F.lit(0.0)).alias("anomaly_score"),
            F.when(is_ml, F.lit("ML")).otherwise(F.lit("RULE")).alias("stored_type"),
            F.when(is_ml, F.format_string("ML-detected anomaly (score: %.3f)", F.col("ml_score")))
            .otherwise(F.col("body"))
            .alias("description"),
        )
    )


def read_alert_log(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Alert rows of the ``last`` lines of a log (all lines for None)."""
    lines = spark.read.text(path)
    if last is not None:
        lines = (
            lines.select(
                "value",
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            )
            .orderBy(F.col("file").desc(), F.col("block").desc(), F.col("row").desc())
            .limit(last)
        )
    return parse_log_lines(lines)
