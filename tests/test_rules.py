from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietwire.config import DetectorConfig
from quietwire.operators import limiter as lim, rules as R
from quietwire.plans.detection import detect
from tests.conftest import T0, packet, packets_df, random_packets


def descriptions(spark, rows, cfg=DetectorConfig(), start=T0):
    signals = R.packet_signals(packets_df(spark, rows), F.lit(start), cfg)
    subject, body = R.alert_text(R.packet_rules(cfg))
    found = R.rule_candidates(signals, cfg).select("packet_id", "rule", subject.alias("s"), body.alias("b"))
    return {(r.packet_id, r.rule): (r.s, r.b) for r in found.collect()}


def test_alert_texts(spark):
    rows = [
        packet(1, 1, "10.0.0.1", "TCP", 9999),
        packet(2, 1, "10.0.0.2", "UDP", 53, payload=b"A" * 150),
        packet(3, 1, "10.0.0.3", "TCP", 80, payload=b"x union select y"),
        packet(4, 1, "192.168.65.5", "TCP", 9999),
        packet(5, 1, "10.0.0.4", "TCP", 70000, payload=b"UNION SELECT" + b"A" * 200),
        packet(6, 1, "10.0.0.5", "ICMP", None, payload=b"UNION SELECT" + b"A" * 200),
        packet(7, 1, "10.0.0.6", "TCP", 80, payload=b"A" * 100),
    ] + [packet(100 + i, 2 + i, "10.0.0.9", "ICMP", None) for i in range(52)]
    assert descriptions(spark, rows) == {
        (1, "uncommon_port"): (
            "ALERT: Traffic on uncommon port 9999 from 10.0.0.1",
            "Traffic detected from IP 10.0.0.1 to port 9999, which is unusual.",
        ),
        (2, "large_payload"): (
            "ALERT: Unusually large payload from 10.0.0.2",
            "A payload of 150 bytes was detected from 10.0.0.2 to port 53.",
        ),
        (3, "malicious_payload"): (
            "ALERT: Malicious payload detected from 10.0.0.3",
            "The pattern 'UNION SELECT' was detected in traffic from 10.0.0.3 to port 80.",
        ),
        **{
            (150 + i, "icmp_flood"): (
                "ALERT: Possible ICMP attack (ping flood) from 10.0.0.9",
                "IP 10.0.0.9 has sent more than 50 ICMP packets.",
            )
            for i in range(2)
        },
    }


def test_flood_counts_all_packets(spark):
    rows = [packet(i, i, "10.0.0.1", "TCP", 80) for i in range(50)] + [packet(50, 51, "10.0.0.1", "ICMP", None)]
    assert list(descriptions(spark, rows)) == [(50, "icmp_flood")]


def test_rates_and_spike_text(spark):
    rows = [packet(0, 0, "10.0.0.1"), packet(1, 100, "10.0.0.1")]
    rows += [packet(2 + i, 101 + i / 100, "10.0.0.1") for i in range(30)]
    signals = R.packet_signals(packets_df(spark, rows), F.lit(T0)).orderBy("packet_id").collect()
    assert signals[0].rate is None and signals[0].avg_rate is None
    rates = []
    for row in signals[1:]:
        rates.append(row.seq / ((row.t_us - T0) / 1e6))
        assert row.rate == pytest.approx(rates[-1])
        assert row.avg_rate == pytest.approx(sum(rates[-10:]) / len(rates[-10:]))
    cfg = DetectorConfig(spike_multiplier=1.5)
    found = descriptions(spark, rows, cfg)
    assert found and all(rule == "spike" for _, rule in found)
    pid = min(p for p, _ in found)
    row = signals[pid]
    assert found[(pid, "spike")] == (
        "ALERT: Traffic spike from 10.0.0.1",
        f"IP 10.0.0.1 has a traffic rate of {row.rate:.2f} packets/sec, which is significantly higher "
        f"than the average of {row.avg_rate:.2f} packets/sec.",
    )
    assert not descriptions(spark, rows)  # the default multiplier can never be reached


def test_rates_in_parts(spark):
    from quietwire.functions.payload import describe_payload
    from quietwire.operators.ordering import running_count, take_per_source

    packets = describe_payload(packets_df(spark, random_packets(n=600)))
    whole = R.packet_rates(take_per_source(packets, 10_000), F.lit(T0))
    parts = R.packet_rates(running_count(packets), F.lit(T0), part_rows=20)
    pick = lambda df: {r.packet_id: r.avg_rate for r in df.collect()}
    a, b = pick(whole), pick(parts)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_budget(spark):
    rows = [packet(i, i, "10.0.0.1", "TCP", 9999) for i in range(30)]
    assert len(descriptions(spark, rows, DetectorConfig(packets_per_source=12))) == 12


def test_a_busy_source_is_seen_to_its_end(spark):
    rows = [packet(i, i / 100, "10.0.0.1", "TCP", 9999) for i in range(30_000)]
    found = R.uncommon_port_alerts(R.packet_signals(packets_df(spark, rows)))
    assert found.count() == 30_000 and found.agg(F.max("seq")).first()[0] == 30_000


def candidates(spark, rows):
    """rows: (packet_id, t_s, ip, alert_type)"""
    full = [(p, T0 + int(t * 1e6), ip, "r", 3, kind, 1, None, None, None, None, None, None, None) for p, t, ip, kind in rows]
    schema = (
        "packet_id bigint, t_us bigint, src_ip string, rule string, rule_seq int, alert_type string, seq bigint, "
        "dst_port int, rate double, avg_rate double, payload_len int, pattern string, score double, raw_data string"
    )
    return spark.createDataFrame(full, schema)


def brute_limit(rows, cooldown=60.0, most=3):
    kept, out = defaultdict(list), set()
    for p, t, ip, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        if sum(t - k <= cooldown for k in kept[ip, kind]) < most:
            kept[ip, kind].append(t)
            out.add(p)
    return out


def test_three_of_five(spark):
    rows = [(i, 1.0, "10.0.0.1", "RULE") for i in range(5)]
    assert sorted(r.packet_id for r in lim.limit_alerts(candidates(spark, rows)).collect()) == [0, 1, 2]


@pytest.mark.parametrize("chunk_s", [60, 600, 10**6])
@pytest.mark.parametrize("seed", [1, 2])
def test_limiter_against_brute_force(spark, seed, chunk_s):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(3000):
        t += rng.choice([0, 0, 1, 3, 30, 60, 61, 200]) if rng.random() < 0.3 else 0.5
        ip = "10.0.0.1" if rng.random() < 0.6 else f"10.0.0.{rng.randint(2, 9)}"
        rows.append((i, t, ip, rng.choice(["RULE", "RULE", "ML"])))
    got = lim.limit_alerts(candidates(spark, rows), chunk_s=chunk_s)
    assert {r.packet_id for r in got.collect()} == brute_limit(rows)


@pytest.mark.parametrize(("fanout", "most"), [(2, 3), (3, 1), (2, 5), (32, 2)])
def test_transition_tables_compose(fanout, most):
    """Tables, composition and walk by themselves, against a plain fold: many chunks, bursts, gaps and equal times."""
    for seed in range(60):
        rng = random.Random(seed)
        t, times = 0, []
        for _ in range(rng.randint(1, 250)):
            t += rng.choice([0, 0, 1, 1, 2, 5, 9, 30]) if rng.random() < 0.8 else rng.randint(0, 20)
            times.append(t)
        cooldown = rng.choice([3, 10, 40])
        times = np.array(times, dtype=np.int64)
        cuts = sorted(rng.sample(range(len(times)), min(len(times) - 1, rng.randint(0, 12))) + [0])
        chunks = [c for c in np.split(times, cuts) if len(c)]
        tables, before = [], lim.NEVER
        for c in chunks:
            tables.append(lim.transition_table(c, before, cooldown, most, most * 3))
            before = int(c[-1])
        kept: list[int] = []
        state = np.full((1, most), lim.NEVER, dtype=np.int64)
        for c, table in zip(chunks, tables, strict=True):
            assert [x for x in state[0].tolist() if x > lim.NEVER] == kept
            total, new = lim.through(state, table, cooldown, most)
            state = lim._newest(total, new, state[:, ::-1], most)[:, ::-1]
            assert int(total[0]) == len(lim.kept_positions(c, kept, cooldown, most))
        for start in range(len(chunks)):
            run = chunks[start : start + fanout]
            before = int(chunks[start - 1][-1]) if start else lim.NEVER
            found = lim.composed(tables[start], tables[start + 1 : start + fanout], before, cooldown, most)
            whole = lim.transition_table(np.concatenate(run), before, cooldown, most, 2 * most)
            assert all((x == y).all() for x, y in zip(found, whole, strict=True))


@pytest.mark.parametrize(("chunk_s", "seed"), [(60, 3), (7, 4)])
def test_limiter_composes_levels_of_tables(spark, monkeypatch, chunk_s, seed):
    monkeypatch.setattr(lim, "FANOUT", 2)
    rng, rows, t = random.Random(seed), [], 0.0
    for i in range(1500):
        t += rng.choice([0, 0.5, 1, 3]) if rng.random() < 0.97 else rng.choice([50, 61, 300])
        rows.append((i, t, rng.choice(["10.0.0.1", "10.0.0.1", None]), rng.choice(["RULE", "ML"])))
    rounds: list[str] = []
    got = lim.limit_alerts(candidates(spark, rows), chunk_s=chunk_s, rounds=rounds)
    assert {r.packet_id for r in got.collect()} == brute_limit(rows)
    assert rounds.count("compose") >= 2 and rounds.count("walk") == rounds.count("compose") + 1


@pytest.mark.parametrize(("every_us", "jitter_us"), [(1_000_000, 1), (1_500_000, 1_400_000)])
def test_a_key_busy_for_a_week_takes_few_rounds(spark, every_us, jitter_us):
    rows = spark.range(7 * 86_400_000_000 // every_us).selectExpr(
        "id AS packet_id",
        f"{T0} + id * {every_us} + pmod(xxhash64(id), {jitter_us}) AS t_us",
        "'10.0.0.1' AS src_ip",
        "'RULE' AS alert_type",
        "3 AS rule_seq",
    )
    rounds: list[str] = []
    got = [r.t_us for r in lim.limit_alerts(rows, rounds=rounds).select("t_us").orderBy("t_us").collect()]
    times = np.sort(np.array([r[0] for r in rows.select("t_us").collect()]))
    want = times[lim.kept_positions(times, [], 60_000_000, 3)].tolist()
    assert got == want and 0 < len(rounds) <= 10


def test_a_busy_hour_is_cut_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(lim, "CHUNK_ROWS", 300)
    rng = random.Random(6)
    rows = [(i, rng.randrange(12_000) / 4, "10.0.0.1" if i % 5 else None, "RULE") for i in range(4000)]
    rounds: list[str] = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.packet_id for r in lim.limit_alerts(candidates(spark, rows), rounds=rounds).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_limit(rows) and rounds == ["ranges", "tables", "walk"]


def test_limiter_across_arrow_batches(spark):
    rows = [(i, i * 0.7, "10.0.0.1", "RULE") for i in range(2000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.packet_id for r in lim.limit_alerts(candidates(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_limit(rows)


def test_stored_types_and_rows(spark):
    rows = [packet(i, i, "10.0.0.9", "ICMP", None) for i in range(53)] + [packet(90, 60, "10.0.0.1", "TCP", 1)]
    alerts = detect(packets_df(spark, rows)).collect()
    assert {(a.rule, a.alert_type, a.stored_type) for a in alerts} == {
        ("icmp_flood", "ICMP_FLOOD", "UNKNOWN"),
        ("uncommon_port", "RULE", "RULE"),
    }
    assert all(a.anomaly_score == 0.0 and a.ts.microsecond == 0 for a in alerts)


def test_bad_scores_give_no_alert(spark):
    from quietwire.config import FEATURE_NAMES

    names = ", ".join(f"{n} double" for n in FEATURE_NAMES)
    rows = [(i, T0, "10.0.0.1", 10, s, 1, *[1.0] * 18) for i, s in enumerate([999.0, -0.5, float("nan"), 0.3, -10.5])]
    scored = spark.createDataFrame(
        rows, f"packet_id bigint, t_us bigint, src_ip string, seq bigint, anomaly_score double, prediction int, {names}"
    )
    assert [r.packet_id for r in R.ml_candidates(scored).collect()] == [1]
    assert R.ml_candidates(scored, None).count() == 0
    direct = R.ml_direct_rows(R.ml_candidates(scored)).first()
    assert direct.description == (
        "IP 10.0.0.1 flagged as anomalous by ML model. Anomaly score: -0.5000 (lower = more anomalous). Total packets: 10"
    )
    assert direct.raw_data == '{"features":[' + ",".join(["1.0"] * 18) + "]}"


def test_config_checks():
    with pytest.raises(ValueError):
        DetectorConfig(spike_multiplier=1.0)
    with pytest.raises(ValueError):
        DetectorConfig(icmp_threshold=0)
