"""Daily summaries of the alert table: partial aggregates that add up to the analytics of any period of whole days.

Two tables below one path, both partitioned by date. ``counts``: alerts by type, port and hour. ``sources``: alerts by address and
type, and per day one row (address null) with a sketch of its distinct addresses. Only days that are new, or
may have grown, are read from the alert table.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quietwire.functions.text import target_port
from quietwire.operators.lookups import day_hour_grid, fill_grid
from quietwire.sources.alerts import alert_table

COUNTS = "stored_type string, port int, hour int, alerts bigint, date date"
SOURCES = "ip_address string, stored_type string, alerts bigint, sketch binary, date date"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def day_counts(spark: SparkSession, days: str) -> DataFrame:
    return _stored(spark, f"{days}/counts", COUNTS)


def day_sources(spark: SparkSession, days: str) -> DataFrame:
    return _stored(spark, f"{days}/sources", SOURCES)


def refresh_days(spark: SparkSession, alerts: str, days: str) -> list[date]:
    """Summarise the days that are not yet, and again the last one that was, which may have grown; returns them.

    Days are found from the partitions alone. A day's summary replaces an earlier one.
    """
    table = alert_table(spark, alerts)
    there = {r.date for r in table.select("date").distinct().collect()}
    done = {r.date for r in day_counts(spark, days).select("date").distinct().collect()}
    todo = sorted(there - done | ({max(done)} & there if done else set()))
    if not todo:
        return []
    rows = table.where(F.col("date").isin(todo))
    n = F.count(F.lit(1)).alias("alerts")
    counts = rows.groupBy("stored_type", target_port(F.col("description")).alias("port"), F.hour("ts").alias("hour"), "date")
    by_source = rows.groupBy("ip_address", "stored_type", "date").agg(n)
    per_day = rows.groupBy("date").agg(F.hll_sketch_agg("ip_address").alias("sketch"))
    null = lambda kind: F.lit(None).cast(kind)
    sources = by_source.select("ip_address", "stored_type", "alerts", null("binary").alias("sketch"), "date").unionByName(
        per_day.select(
            null("string").alias("ip_address"),
            null("string").alias("stored_type"),
            F.lit(0).cast("bigint").alias("alerts"),
            "sketch",
            "date",
        )
    )
    for name, made in (("counts", counts.agg(n).select("stored_type", "port", "hour", "alerts", "date")), ("sources", sources)):
        made.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "date"
        ).parquet(f"{days}/{name}")
    return todo


def between_days(rows: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """Summaries of the days from ``first`` to ``last``, both included; other partitions are not read."""
    if first is not None:
        rows = rows.where(F.col("date") >= F.lit(first))
    return rows if last is None else rows.where(F.col("date") <= F.lit(last))


def _alerts(condition: Column | None = None) -> Column:
    counted = F.col("alerts") if condition is None else F.when(condition, F.col("alerts"))
    return F.coalesce(F.sum(counted), F.lit(0)).cast("bigint")


def stats_of_days(sources: DataFrame, approximate: bool = False) -> DataFrame:
    """``total_alerts, ml_alerts, rule_alerts, unique_ips``; addresses exactly, or from the merged sketches of the days."""
    model = F.col("stored_type") == "ML"
    if approximate:
        distinct = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("bigint")
    else:
        distinct = F.count_distinct("ip_address")
    return sources.agg(
        _alerts().alias("total_alerts"),
        _alerts(model).alias("ml_alerts"),
        _alerts(~model).alias("rule_alerts"),
        distinct.alias("unique_ips"),
    )


def types_of_days(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.col("stored_type").alias("alert_type")).agg(_alerts().alias("alerts"))


def ports_of_days(counts: DataFrame, n: int = 15) -> DataFrame:
    by_port = counts.where(F.col("port").isNotNull()).groupBy("port").agg(_alerts().alias("alerts"))
    return by_port.orderBy(F.col("alerts").desc(), "port").limit(n)


def top_ips_of_days(sources: DataFrame, n: int = 10) -> DataFrame:
    by_source = sources.where(F.col("ip_address").isNotNull()).groupBy("ip_address").agg(_alerts().alias("alerts"))
    return by_source.orderBy(F.col("alerts").desc(), "ip_address").limit(n)


def hours_of_days(counts: DataFrame) -> DataFrame:
    """Alerts by weekday (0 Monday) and hour, all 168 of them."""
    by_hour = counts.groupBy(F.weekday("date").alias("day_no"), "hour").agg(_alerts().alias("alerts"))
    return fill_grid(by_hour, day_hour_grid(counts.sparkSession), ["day_no", "hour"], "alerts")
