"""Alert and traffic analytics: counts, buckets, top lists, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quietwire import config as C
from quietwire.functions.text import target_port
from quietwire.operators.lookups import (
    bucket_grid,
    day_hour_grid,
    enrich_known_ips,
    fill_grid,
)

IS_ML = "stored_type = 'ML'"


def traffic_summary(packets: DataFrame) -> DataFrame:
    return count_by(packets, F.col("src_ip"), "src_ip", "packets")


def tracked_sources(packets: DataFrame) -> DataFrame:
    return packets.select("src_ip").distinct()


def count_by(rows: DataFrame, key: Column, name: str, count: str) -> DataFrame:
    """Counts per key, most frequent first; ties in key order."""
    return (
        rows.groupBy(key.alias(name))
        .agg(F.count(F.lit(1)).alias(count))
        .orderBy(F.col(count).desc(), F.col(name).asc())
    )


def alert_stats(alerts: DataFrame, approximate: bool = False) -> DataFrame:
    """Totals over the whole table; here everything that is not ML counts as a rule alert."""
    sources = F.approx_count_distinct("ip_address") if approximate else F.countDistinct("ip_address")
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.expr(IS_ML)).alias("ml_alerts"),
        F.count_if(~F.expr(IS_ML)).alias("rule_alerts"),
        sources.alias("unique_ips"),
    )


def period_stats(alerts: DataFrame) -> DataFrame:
    """Totals of a period; here only the stored type RULE counts as a rule alert."""
    ml_score = F.when(F.expr(IS_ML), F.col("anomaly_score"))
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.expr(IS_ML)).alias("ml_alerts"),
        F.count_if(F.col("stored_type") == "RULE").alias("rule_alerts"),
        F.countDistinct("ip_address").alias("unique_ips"),
        F.avg(ml_score).alias("avg_score"),
    )


def newest_alerts(alerts: DataFrame, limit: int | None) -> DataFrame:
    """Alerts, newest first (all, or the ``limit`` newest); equal times by packet and rule."""
    newest = alerts.orderBy(
        F.col("ts").desc(), F.col("packet_id").desc(), F.col("rule").asc(), F.col("anomaly_score").asc()
    )
    return newest if limit is None else newest.limit(limit)


def alert_view(alerts: DataFrame, n: int | None = None) -> DataFrame:
    return newest_alerts(alerts, n).select(
        F.col("ts").alias("timestamp"),
        "ip_address",
        F.col("stored_type").alias("alert_type"),
        "anomaly_score",
        "description",
    )


def ml_score_stats(alerts: DataFrame, last: int | None = None) -> DataFrame:
    """Scores of the ML rows, of all alerts or of the ``last`` newest; zeros where there are none."""
    zero = F.lit(0.0)
    return (
        (alerts if last is None else newest_alerts(alerts, last))
        .where(IS_ML)
        .agg(
            F.coalesce(F.avg("anomaly_score"), zero).alias("avg_score"),
            F.coalesce(F.min("anomaly_score"), zero).alias("min_score"),
            F.coalesce(F.max("anomaly_score"), zero).alias("max_score"),
        )
    )


def score_timeline(alerts: DataFrame, threshold: float = C.SCORE_TIMELINE_THRESHOLD) -> DataFrame:
    return (
        alerts.where(IS_ML)
        .select(
            F.col("ts").alias("timestamp"),
            "anomaly_score",
            "ip_address",
            (F.col("anomaly_score") < threshold).alias("below_threshold"),
        )
        .orderBy("timestamp")
    )


def alert_rate(alerts: DataFrame, interval: str = "1H") -> DataFrame:
    """Alerts per interval between the first and the last one, empty intervals included."""
    step = C.ALERT_INTERVALS_US[interval]
    bucket = (F.floor(F.unix_micros("ts") / step) * step).cast("bigint")
    counts = alerts.groupBy(bucket.alias("bucket_us")).agg(F.count(F.lit(1)).alias("alerts"))
    bounds = counts.agg(F.min("bucket_us").alias("first_us"), F.max("bucket_us").alias("last_us"))
    return fill_grid(counts, bucket_grid(bounds, step), ["bucket_us"], "alerts").select(
        F.timestamp_micros("bucket_us").alias("bucket"), "alerts"
    )


def score_histogram(alerts: DataFrame, bins: int = 30) -> DataFrame:
    """ML scores in equal bins between the lowest and the highest score, empty bins included."""
    ml = alerts.where(IS_ML).select("anomaly_score")
    bounds = ml.agg(
        F.struct(F.min("anomaly_score").alias("low"), F.max("anomaly_score").alias("high"))
    ).scalar()
    low, high = bounds.getField("low"), bounds.getField("high")
    width = (high - low) / bins
    score = F.col("anomaly_score")
    bin_no = F.when(
        width > 0, F.least(F.floor((score - low) / F.when(width > 0, width)), F.lit(bins - 1))
    ).otherwise(F.lit(0))
    counts = ml.select(bin_no.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("alerts"))
    grid = ml.limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return fill_grid(counts, grid, ["bin"], "alerts").withColumn("bin_start", low + F.col("bin") * width)


def top_ips(alerts: DataFrame, n: int = 10) -> DataFrame:
    return count_by(alerts, F.col("ip_address"), "ip_address", "alerts").limit(n)


def alert_type_distribution(alerts: DataFrame) -> DataFrame:
    return count_by(alerts, F.col("stored_type"), "alert_type", "alerts")


def port_distribution(alerts: DataFrame, n: int = 15) -> DataFrame:
    """Ports named in alert descriptions; alerts that name none do not count."""
    ports = alerts.select(target_port(F.col("description")).alias("port")).where("port IS NOT NULL")
    return count_by(ports, F.col("port"), "port", "alerts").limit(n)


def day_no(ts: Column) -> Column:
    """0 for Monday .. 6 for Sunday."""
    return F.weekday(ts)


def hour_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per (day, hour), all 168 cells."""
    counts = alerts.groupBy(day_no(F.col("ts")).alias("day_no"), F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("alerts")
    )
    return fill_grid(counts, day_hour_grid(alerts.sparkSession), ["day_no", "hour"], "alerts")


def hour_heatmap(alerts: DataFrame) -> DataFrame:
    """Seven rows, Monday first, with columns h0..h23."""
    names = F.array(*[F.lit(d) for d in C.DAY_NAMES])
    wide = hour_counts(alerts).groupBy("day_no").pivot("hour", list(range(24))).agg(F.first("alerts"))
    return wide.orderBy("day_no").select(
        F.get(names, F.col("day_no")).alias("day_name"),
        *[F.col(f"`{h}`").alias(f"h{h}") for h in range(24)],
    )


def ip_category_distribution(alerts: DataFrame) -> DataFrame:
    """Alerts per category; addresses are counted first, so each is looked up once."""
    per_ip = alerts.groupBy("ip_address").agg(F.count(F.lit(1)).alias("n"))
    return (
        enrich_known_ips(per_ip)
        .groupBy("category")
        .agg(F.sum("n").alias("alerts"))
        .orderBy(F.col("alerts").desc(), "category")
    )


def known_ips_table(alerts: DataFrame) -> DataFrame:
    per_ip = alerts.groupBy("ip_address").agg(F.count(F.lit(1)).alias("alerts"))
    return (
        enrich_known_ips(per_ip)
        .where(~F.col("category").isin(*C.GENERIC_CATEGORIES))
        .select("ip_address", F.col("category").alias("entity"), "alerts")
        .orderBy(F.col("alerts").desc(), "ip_address")
    )
