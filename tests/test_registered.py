"""A cross-section of the registered queries against DuckDB; `python -m checks.compare` runs all."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks.compare import connect, rows_of
from tests.conftest import DATA

NAMES = """flagship valid_sources label_training_ips per_source_budget_100 running_count rate_spikes
all_candidates limit_alerts limit_alerts_quiet_split detection_rules_only ml_alert_rows running_features_parts
alert_rate_1h hour_heatmap score_histogram known_ips_table outside_networks ip_functions
byte_entropy_documents payload_stats redact alert_log feature_scaler feature_correlation stream_rates
stream_traffic_rounds""".split()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    df = contract.queries()[name](spark, DATA)
    cursor = connect(DATA).execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
