from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietwire.config import FEATURE_COMMON_PORTS, FEATURE_NAMES
from quietwire.functions.payload import describe_payload
from quietwire.operators import features as feat, ordering
from tests.conftest import T0, packet, packets_df, random_packets
from tests.test_payload import entropy


def brute(rows: list[tuple], now: int, history: int) -> dict[str, float]:
    """Features of one source from its packets so far, by the definitions."""
    frame = rows[-history:]
    times = [r[1] for r in frame]
    gaps = np.diff(times) / 1e6
    ports = [r[4] for r in frame if r[4] is not None]
    lengths = [len(r[6]) for r in frame if r[6]]
    entropies = [e for e in (entropy(r[6]) for r in frame if r[6]) if e > 0]
    age = (now - rows[0][1]) / 1e6
    share = lambda p: sum(r[3] == p for r in rows) / len(rows)
    values = [
        len(rows) / max(age, 0.001),
        sum(r[5] for r in rows) / max(age, 0.001),
        np.mean([r[5] for r in frame]),
        np.var([r[5] for r in frame]),
        len(rows),
        sum(r[5] for r in rows),
        gaps.mean() if len(gaps) else 0.0,
        gaps.std() if len(gaps) > 1 else 0.0,
        sum(t > now - 5_000_000 for t in times) / 5,
        age,
        share("TCP"),
        share("UDP"),
        share("ICMP"),
        len(set(ports)),
        sum(p not in FEATURE_COMMON_PORTS for p in ports) / len(ports) if ports else 0.0,
        np.mean(entropies) if entropies else 0.0,
        np.mean(lengths) if lengths else 0.0,
        np.var(lengths) if lengths else 0.0,
    ]
    return dict(zip(FEATURE_NAMES, map(float, values)))


def by_source(rows):
    grouped = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        grouped[r[2]].append(r)
    return grouped


def assert_close(row, want):
    for name in FEATURE_NAMES:
        assert row[name] == pytest.approx(want[name], rel=1e-9, abs=1e-9), name


@pytest.mark.parametrize("history", [1000, 20])
def test_snapshot_against_brute_force(spark, history):
    rows = random_packets()
    got = feat.snapshot_features(packets_df(spark, rows), history=history).collect()
    now = max(r[1] for r in rows)
    grouped = by_source(rows)
    assert {r.src_ip for r in got} == {ip for ip, p in grouped.items() if len(p) >= 3}
    for row in got:
        assert_close(row, brute(grouped[row.src_ip], now, history))


@pytest.mark.parametrize("history,part_rows", [(1000, None), (20, None), (20, 25), (20, 20), (7, 300)])
def test_running_against_brute_force(spark, history, part_rows):
    rows = random_packets(n=700)
    described = describe_payload(packets_df(spark, rows))
    if part_rows is None:
        sequenced = ordering.take_per_source(described, 10_000)
    else:
        sequenced = ordering.running_count(described)
    got = feat.running_features(sequenced, history, part_rows=part_rows).collect()
    grouped = by_source(rows)
    assert len(got) == sum(max(0, len(p) - 9) for p in grouped.values())
    for row in got:
        mine = grouped[row.src_ip][: row.seq]
        assert mine[-1][0] == row.packet_id
        assert_close(row, brute(mine, mine[-1][1], history))


@pytest.mark.parametrize("part_rows", [None, 90])
def test_running_across_arrow_batches(spark, part_rows):
    rows = random_packets(n=700)
    described = describe_payload(packets_df(spark, rows))
    sequenced = ordering.running_count(described).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = feat.running_features(sequenced, 60, part_rows=part_rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    grouped = by_source(rows)
    assert len(got) == sum(max(0, len(p) - 9) for p in grouped.values())
    for row in got:
        mine = grouped[row.src_ip][: row.seq]
        assert_close(row, brute(mine, mine[-1][1], 60))


def test_a_decade_leaves_no_error_behind(spark):
    ten_years = 10 * 365 * 86_400
    rows = [packet(i, i * (1 + i % 3) / 7 + 60 * i + (ten_years if i > 15 else 0), "1.1.1.1", size=2**31 - 1 if i < 9 else 60 + i % 2) for i in range(90)]
    sequenced = ordering.running_count(describe_payload(packets_df(spark, rows)))
    for row in feat.running_features(sequenced, 20).collect():
        mine = rows[: row.seq]
        want = brute(mine, mine[-1][1], 20)
        assert row.inter_arrival_std == pytest.approx(want["inter_arrival_std"], rel=1e-9)
        assert row.packet_size_variance == pytest.approx(want["packet_size_variance"], rel=1e-9)


def test_gaps_of_years(spark):
    ten_years = 10 * 365 * 86_400
    rows = [packet(i, i + (ten_years if i > 15 else 0), "1.1.1.1") for i in range(40)]
    sequenced = ordering.running_count(describe_payload(packets_df(spark, rows)))
    got = feat.running_features(sequenced, 1000).collect()
    assert len(got) == 31
    for row in got:
        mine = rows[: row.seq]
        assert row.inter_arrival_std == pytest.approx(brute(mine, mine[-1][1], 1000)["inter_arrival_std"], rel=1e-9)


def test_null_sources_are_a_source(spark):
    rows = [packet(i, i, None if i % 2 else "1.1.1.1") for i in range(20)]
    got = ordering.running_count(packets_df(spark, rows)).collect()
    assert sorted((r.packet_id, r.seq) for r in got) == [(i, i // 2 + 1) for i in range(20)]
    described = describe_payload(packets_df(spark, rows))
    assert feat.snapshot_features(described.withColumn("payload", F.lit(None).cast("binary")), 100).count() == 2


def test_protocol_mix_and_too_few(spark):
    rows = [packet(0, 0, "1.1.1.1", "TCP", 80), packet(1, 1, "1.1.1.1", "TCP", 443)]
    rows += [packet(2, 2, "1.1.1.1", "UDP", 53), packet(3, 3, "1.1.1.1", "ICMP", None), packet(4, 4, "2.2.2.2")]
    got = feat.snapshot_features(packets_df(spark, rows), 1000).collect()
    assert len(got) == 1
    assert (got[0].tcp_ratio, got[0].udp_ratio, got[0].icmp_ratio) == (0.5, 0.25, 0.25)
    assert got[0].unique_ports == 3 and got[0].uncommon_port_ratio == 0


def test_running_count_on_a_hot_source(spark):
    rows = [packet(i, (i * 7919) % 1000 / 10, "9.9.9.9" if i % 3 else f"8.0.0.{i % 50}") for i in range(3000)]
    got = ordering.running_count(packets_df(spark, rows)).collect()
    for ip, mine in by_source(rows).items():
        want = {r[0]: i + 1 for i, r in enumerate(mine)}
        assert {r.packet_id: r.seq for r in got if r.src_ip == ip} == want


def test_take_per_source_first_and_newest(spark):
    rows = random_packets(n=900)
    df = packets_df(spark, rows)
    first = ordering.take_per_source(df, 50).collect()
    newest = ordering.take_per_source(df, 50, newest=True, rank="age").collect()
    for ip, mine in by_source(rows).items():
        assert [r.packet_id for r in sorted(first, key=lambda r: r.seq) if r.src_ip == ip] == [p[0] for p in mine[:50]]
        assert [r.packet_id for r in sorted(newest, key=lambda r: r.age) if r.src_ip == ip] == [p[0] for p in mine[::-1][:50]]


def test_no_window_over_a_whole_source(spark):
    """History is picked by a limit inside Spark before the shuffle, and again per salt."""
    plan = feat.snapshot_features(packets_df(spark, random_packets(n=50)), 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3


def test_as_of_in_the_future(spark):
    rows = [packet(i, i, "1.1.1.1") for i in range(5)]
    got = feat.snapshot_features(packets_df(spark, rows), 1000, as_of_us=T0 + 100_000_000).first()
    assert got.session_duration == 100.0 and got.burst_rate == 0.0
    assert math.isclose(got.packets_per_second, 0.05)
    assert got.inter_arrival_mean == 1.0 and got.inter_arrival_std == 0.0


def test_finite(spark):
    from quietwire.operators.filters import clean_features

    rows = [(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.5,)]
    got = clean_features(spark.createDataFrame(rows, "v double"), ["v"]).select(F.collect_list("v")).first()[0]
    assert got == [0.0, 1e6, -1e6, 0.0, 2.5]
