"""Row filters and clean-up projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quietwire.config import FEATURE_NAMES, TRUSTED_SUBNETS
from quietwire.functions import ip as ipf
from quietwire.operators.ordering import running_totals, take_per_source


def valid_source(ip: Column, trusted: Sequence[str] = TRUSTED_SUBNETS, parse_only: bool = False) -> Column:
    """An IPv4 or IPv6 address; unless ``parse_only``, outside loopback, link-local and trusted networks."""
    if parse_only:
        return ipf.is_ip(ip)
    out4 = ipf.is_ipv4(ip) & ~ipf.in_networks(ip, (*ipf.LOOPBACK, *ipf.LINK_LOCAL, *trusted))
    out6 = ipf.is_ipv6(ip) & ~ipf.in_networks6(ip, (*ipf.LOOPBACK6, *ipf.LINK_LOCAL6, *trusted))
    return F.when(F.contains(ip, F.lit(":")), out6).otherwise(out4)


def valid_sources(
    packets: DataFrame, trusted: Sequence[str] = TRUSTED_SUBNETS, parse_only: bool = False
) -> DataFrame:
    """Packets whose source may be analysed.

    Detection drops loopback, link-local and trusted networks; training (``parse_only``) only
    drops what is no address.
    """
    return packets.where(valid_source(F.col("src_ip"), trusted, parse_only))


def per_source_budget(packets: DataFrame, cap: int = 10_000) -> DataFrame:
    """The first ``cap`` packets of each source, with their running count ``seq``."""
    return take_per_source(packets, cap, rank="seq")


def valid_port(protocol: Column, port: Column) -> Column:
    """TCP or UDP with a usable destination port; other packets get no port or payload rules."""
    return protocol.isin("TCP", "UDP") & F.coalesce(port.between(0, 65535), F.lit(False))


def ml_ready(running: DataFrame, min_packets: int = 10) -> DataFrame:
    return running.where(F.col("seq") >= max(min_packets, 3))


def usable_label(ip: Column) -> Column:
    """Whether a training row may keep its address: any but loopback and link-local."""
    return F.coalesce(valid_source(ip, trusted=()), F.lit(False))


def label_training_ips(
    rows: DataFrame, ip: str = "src_ip", order: Sequence[str] = ("packet_id",)
) -> DataFrame:
    """Add ``label``: the address, or ``invalid_ip_{k}`` for the k-th unusable one in row order."""
    usable = usable_label(F.col(ip))
    counted = running_totals(
        rows, {"_invalid": F.when(usable, 0).otherwise(1).cast("bigint")}, keys=(), order=order
    )
    return counted.select(
        *rows.columns,
        F.when(usable, F.col(ip))
        .otherwise(F.concat(F.lit("invalid_ip_"), (F.col("_invalid") - 1).cast("string")))
        .alias("label"),
    )


def finite(value: Column) -> Column:
    """NaN and null become 0, infinities become ±1e6."""
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(0.0))
        .when(value == F.lit(float("inf")), F.lit(1e6))
        .when(value == F.lit(float("-inf")), F.lit(-1e6))
        .otherwise(value)
    )


def clean_features(features: DataFrame, columns: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    return features.withColumns({c: finite(F.col(c)) for c in columns})


def recent_alerts(alerts: DataFrame, minutes: int, as_of: Column) -> DataFrame:
    return alerts.where(F.col("ts") >= as_of - F.make_dt_interval(mins=F.lit(minutes)))


def alerts_last_days(alerts: DataFrame, days: int, as_of: Column) -> DataFrame:
    return alerts.where(F.col("ts") >= as_of - F.make_dt_interval(days=F.lit(days)))


def latest_time(alerts: DataFrame) -> Column:
    """The newest alert time, as a scalar subquery: 'now' for repeatable look-backs."""
    return alerts.agg(F.max("ts")).scalar()


def search_alerts(
    alerts: DataFrame, ip_pattern: str = "", alert_type: str = "All", min_score: float = 0.0
) -> DataFrame:
    """Search form: address pattern (a regex, any case), type, and the highest score to show.

    The score test applies for types All and ML and never removes RULE rows.
    """
    found = alerts
    if ip_pattern:
        found = found.where(F.coalesce(F.col("ip_address").rlike(f"(?i){ip_pattern}"), F.lit(False)))
    if alert_type != "All":
        found = found.where(F.col("stored_type") == alert_type)
    if alert_type in ("All", "ML"):
        found = found.where((F.col("stored_type") == "RULE") | (F.col("anomaly_score") <= min_score))
    return found


def ml_score_valid(score: Column) -> Column:
    return F.coalesce(~F.isnan(score) & (F.abs(score) <= 10), F.lit(False))
