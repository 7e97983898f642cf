"""The incident report as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from quietwire.operators.analytics import period_stats, top_ips
from quietwire.operators.filters import alerts_last_days, latest_time


def report_tables(alerts: DataFrame, days: int = 1, as_of: Column | None = None) -> dict[str, DataFrame]:
    """Summary and the five most frequent sources of the last days."""
    now = latest_time(alerts) if as_of is None else as_of
    recent = alerts_last_days(alerts, days, now)
    return {"summary": period_stats(recent).drop("avg_score"), "top_ips": top_ips(recent, 5)}
