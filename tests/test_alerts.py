from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quietwire.operators import analytics as an, filters as flt
from quietwire.plans.report import report_tables
from quietwire.schemas import ALERTS
from quietwire.sources import alert_days, alert_log, alerts as store

NOW = datetime(2024, 3, 4, 10, 0, 0)  # a Monday


def alert(n, minutes, ip, kind="RULE", score=0.0, text="to port 22, which"):
    return (NOW + timedelta(minutes=minutes), n, ip, "r", kind, kind, text, score, None, None)


def table(spark, rows):
    return spark.createDataFrame(rows, ALERTS)


ROWS = [
    alert(1, 0, "8.8.8.8"),
    alert(2, 1, "10.0.0.1", "ML", -0.5, "IP 10.0.0.1 flagged"),
    alert(3, 61, "10.0.0.1", "UNKNOWN"),
    alert(4, 190, "10.0.0.2", "ML", 0.0, "x"),
    alert(5, 190, "10.0.0.1", text="PORT 8080"),
]


def test_store(spark, tmp_path):
    path = f"{tmp_path}/alerts"
    assert store.load_alerts(spark, path).count() == 0
    store.append_alerts(table(spark, ROWS[:3]), path)
    store.append_alerts(table(spark, ROWS[3:]), path)
    ids = lambda **kw: [r.packet_id for r in store.load_alerts(spark, path, **kw).collect()]
    assert ids() == [5, 4, 3, 2, 1]
    assert ids(start=NOW + timedelta(minutes=1), end=NOW + timedelta(minutes=61)) == [3, 2]
    assert ids(limit=2) == [5, 4]
    plan = store.load_alerts(spark, path, start=NOW, limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PartitionFilters: [isnotnull(date" in plan
    assert "GreaterThanOrEqual(ts" in plan


def test_log_round_trip(spark, tmp_path):
    rows = [
        alert(1, 0, "8.8.8.8", text="ALERT: Traffic on uncommon port 22 from 8.8.8.8 - body"),
        alert(2, 1, "1.2.3.4", "ML", text="ML ANOMALY DETECTED: 1.2.3.4 - IP x. Anomaly score: -0.1234 (lower"),
        alert(3, 2, "5.5.5.5", "UNKNOWN", text="ALERT: Possible ICMP attack (ping flood) from 5.5.5.5 - b"),
        alert(4, 3, "6.6.6.6", text="ALERT: odd 6.6.6.6 - b"),
        alert(5, 4, "7.7.7.7", text="ALERT: nothing - b"),
    ]
    path = f"{tmp_path}/log"
    alert_log.write_alert_log(table(spark, rows).coalesce(1), path)
    got = {r.ip_address: r for r in alert_log.read_alert_log(spark, path).collect()}
    assert set(got) == {"8.8.8.8", "1.2.3.4", "6.6.6.6", "unknown"}
    assert got["1.2.3.4"].description == "ML-detected anomaly (score: -0.123)"
    assert got["1.2.3.4"].anomaly_score == -0.1234 and got["8.8.8.8"].stored_type == "RULE"
    assert got["8.8.8.8"].ts == NOW
    (tmp_path / "plain.log").write_text("no time [RULE] ALERT: x from 1.1.1.1\n2024-01-01 00:00:00 - n - INFO - started\n2024-01-01 00:00:01 - n - INFO - [RULE] ALERT: a from 1.1.1.1\n2024-13-01 00:00:01 - [RULE] ALERT: a from 2.2.2.2\n2024-01-01 00:00:02 - [RULE] ALERT: a from 3.3.3.3\n")
    read = lambda last: [r.ip_address for r in alert_log.read_alert_log(spark, f"{tmp_path}/plain.log", last).collect()]
    assert sorted(read(10_000)) == ["1.1.1.1", "3.3.3.3"] and read(1) == ["3.3.3.3"]


def test_stats(spark):
    alerts = table(spark, ROWS)
    s = an.alert_stats(alerts).first()
    assert (s.total_alerts, s.ml_alerts, s.rule_alerts, s.unique_ips) == (5, 2, 3, 3)
    p = an.period_stats(alerts).first()
    assert (p.total_alerts, p.ml_alerts, p.rule_alerts, p.unique_ips, p.avg_score) == (5, 2, 2, 3, -0.25)
    m = an.ml_score_stats(alerts, last=4).first()
    assert (m.avg_score, m.min_score, m.max_score) == (-0.25, -0.5, 0.0)
    none = an.ml_score_stats(alerts.where("stored_type = 'RULE'")).first()
    assert (none.avg_score, none.min_score, none.max_score) == (0.0, 0.0, 0.0)


def test_rate_fills_gaps(spark):
    got = [(r.bucket.hour, r.alerts) for r in an.alert_rate(table(spark, ROWS), "1H").orderBy("bucket").collect()]
    assert got == [(10, 2), (11, 1), (12, 0), (13, 2)]
    assert an.alert_rate(table(spark, []), "1H").count() == 0


def test_heatmap(spark):
    got = an.hour_heatmap(table(spark, ROWS)).collect()
    assert [r.day_name for r in got][0] == "Monday" and len(got) == 7
    assert (got[0].h10, got[0].h11, got[0].h12, got[0].h13) == (2, 1, 0, 2)
    assert sum(sum(r[f"h{h}"] for h in range(24)) for r in got) == 5


def test_top_and_ports(spark):
    alerts = table(spark, ROWS)
    assert [(r.ip_address, r.alerts) for r in an.top_ips(alerts, 2).collect()] == [("10.0.0.1", 3), ("10.0.0.2", 1)]
    assert [(r.port, r.alerts) for r in an.port_distribution(alerts).collect()] == [(22, 2), (8080, 1)]
    cats = {r.category: r.alerts for r in an.ip_category_distribution(alerts).collect()}
    assert cats == {"Local Network (Private)": 4, "Google DNS (Primary)": 1}
    known = [(r.ip_address, r.entity, r.alerts) for r in an.known_ips_table(alerts).collect()]
    assert known == [("8.8.8.8", "Google DNS (Primary)", 1)]


def test_search(spark):
    alerts = table(spark, ROWS)
    ids = lambda *a: sorted(r.packet_id for r in flt.search_alerts(alerts, *a).collect())
    assert ids("", "All", -0.1) == [1, 2, 5]  # UNKNOWN rows need the score too
    assert ids("", "All", 0.0) == [1, 2, 3, 4, 5]
    assert ids("10.0.0", "ML", -0.1) == [2]
    assert ids("", "RULE", -9.0) == [1, 5]


def test_recent_and_report(spark):
    alerts = table(spark, ROWS + [alert(6, -3 * 1440, "9.9.9.9")])
    assert flt.recent_alerts(alerts, 129, flt.latest_time(alerts)).count() == 3
    assert flt.recent_alerts(alerts, 128, F.lit(NOW + timedelta(minutes=190))).count() == 2
    report = report_tables(alerts, 1)
    assert report["summary"].first().total_alerts == 5
    assert report["top_ips"].first().ip_address == "10.0.0.1"


def test_histogram(spark):
    rows = [alert(i, 0, "1.1.1.1", "ML", -i / 100) for i in range(61)]
    got = {r.bin: r.alerts for r in an.score_histogram(table(spark, rows)).collect()}
    assert sum(got.values()) == 61 and max(got) == 29 and min(got) == 0
    same = an.score_histogram(table(spark, [alert(1, 0, "1.1.1.1", "ML", -0.5)] * 3)).collect()
    assert sorted((r.bin, r.alerts) for r in same) == [(0, 3)] + [(i, 0) for i in range(1, 30)]
    two = an.score_histogram(table(spark, [alert(i, 0, "1.1.1.1", "ML", -i / 2) for i in (0, 1)])).collect()
    assert {r.bin: r.alerts for r in two} == {i: int(i in (0, 29)) for i in range(30)}
    assert an.score_histogram(table(spark, [])).count() == 0


def test_export(spark, tmp_path):
    rows = [alert(1, 0, "1.1.1.1", text='say "hi", there')]
    store.export_alerts_csv(table(spark, rows).select("ip_address", "description"), f"{tmp_path}/out")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out").first()
    assert back.description == 'say "hi", there'


def test_a_search_by_address_reads_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROW_GROUP_BYTES", 64 << 10)
    monkeypatch.setattr(store, "ADDRESSES", 500)
    path = str(tmp_path / "clustered")
    hashed = "concat('10.', pmod(hash(id), 7), '.', pmod(hash(id, 1), 9), '.', pmod(hash(id, 2), 30))"
    rows = spark.range(60_000).selectExpr(
        "timestamp_seconds(1704067200 + id * 4) AS ts", "id AS packet_id", f"{hashed} AS ip_address", "'r' AS rule",
        "'RULE' AS alert_type", "'RULE' AS stored_type", "concat('text ', id) AS description", "0.0D AS anomaly_score",
        "CAST(NULL AS STRING) AS raw_data", "1 AS target_port",
    )
    store.append_alerts(rows, path)
    want = sorted(r.packet_id for r in rows.where("ip_address = '10.3.4.5'").collect())
    found = store.alert_table(spark, path).where(F.col("ip_address") == "10.3.4.5")
    plan = found._jdf.queryExecution().executedPlan()
    assert sorted(r.packet_id for r in found.collect()) == want and want
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    found._jdf.queryExecution().toRdd().count()
    read = leaf.metrics().apply("numOutputRows").value()
    assert "PushedFilters" in plan.toString() and 0 < read < 60_000 * 0.25
    assert [r.packet_id for r in store.alerts_of(spark, path, "10.3.4.5").collect()] == want[::-1]
    assert store.alerts_of(spark, path, "1.1.1.1").count() == 0


def test_daily_summaries_read_new_days_only(spark, tmp_path):
    path, days = str(tmp_path / "alerts"), str(tmp_path / "days")
    day = 24 * 60
    first = [alert(i, (i % 3) * day, f"10.0.0.{i % 50}", "ML" if i % 4 == 0 else "RULE") for i in range(300)]
    store.append_alerts(table(spark, first), path)
    assert [d.day for d in alert_days.refresh_days(spark, path, days)] == [4, 5, 6]
    assert [d.day for d in alert_days.refresh_days(spark, path, days)] == [6]
    more = [alert(1000 + i, 2 * day + 60 + (i % 2) * day, f"10.0.1.{i % 70}") for i in range(200)]
    store.append_alerts(table(spark, more), path)
    assert [d.day for d in alert_days.refresh_days(spark, path, days)] == [6, 7]
    alerts = store.alert_table(spark, path)
    counts, sources = alert_days.day_counts(spark, days), alert_days.day_sources(spark, days)
    assert alert_days.stats_of_days(sources).collect() == an.alert_stats(alerts).collect()
    about = alert_days.stats_of_days(sources, approximate=True).first()
    assert abs(about.unique_ips - 120) <= 6 and about.total_alerts == 500
    assert alert_days.top_ips_of_days(sources).collect() == an.top_ips(alerts, 10).collect()
    assert alert_days.ports_of_days(counts).collect() == an.port_distribution(alerts).collect()
    key = lambda r: (r.day_no, r.hour)
    assert sorted(alert_days.hours_of_days(counts).collect(), key=key) == sorted(an.hour_counts(alerts).collect(), key=key)
    one = alert_days.between_days(sources, NOW.date(), NOW.date())
    assert alert_days.stats_of_days(one).first().total_alerts == 100
    empty = alert_days.stats_of_days(alert_days.day_sources(spark, str(tmp_path / "none")), approximate=True).first()
    assert empty.total_alerts == 0 and empty.unique_ips == 0
