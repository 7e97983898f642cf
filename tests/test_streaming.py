from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quietwire.config import FEATURE_NAMES, DetectorConfig
from quietwire.operators import features as feat, limiter as lim, rules as R
from quietwire.sources.packets import packet_stream
from quietwire.streaming import detection as st
from tests.conftest import T0, packet, packets_df, random_packets


@pytest.fixture
def replay(spark, tmp_path):
    """Write packets as several files, oldest first, so each file is one micro-batch."""

    def write(rows, files=4, delay=None):
        path = str(tmp_path / "packets")
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        step = -(-len(rows) // files)
        for i in range(0, len(rows), step):
            packets_df(spark, rows[i : i + step]).coalesce(1).write.mode("append").parquet(path)
        return packet_stream(spark, path, max_files=1, delay=delay)

    return write


@pytest.fixture
def drain(spark, tmp_path):
    counter = iter(range(100))

    def run(rows):
        n = next(counter)
        st.write_stream(rows, f"{tmp_path}/out{n}", f"{tmp_path}/cp{n}").awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{tmp_path}/out{n}")

    return run


def test_rates_equal_batch(spark, replay, drain):
    rows = random_packets(n=800)
    cfg = DetectorConfig(packets_per_source=150)
    got = {r.packet_id: (r.seq, r.rate, r.avg_rate) for r in drain(st.rate_signals(replay(rows), T0, cfg)).collect()}
    batch = R.packet_signals(packets_df(spark, rows), F.lit(T0), cfg).collect()
    assert got.keys() == {r.packet_id for r in batch}
    for r in batch:
        assert got[r.packet_id] == pytest.approx((r.seq, r.rate, r.avg_rate))


def test_features_equal_batch(spark, replay, drain):
    rows = random_packets(n=800)
    cfg = DetectorConfig(history=25, packets_per_source=200)
    got = {r.packet_id: r for r in drain(st.running_features(replay(rows), cfg)).collect()}
    batch = feat.running_features(R.analysed_packets(packets_df(spark, rows), cfg), 25).collect()
    assert got.keys() == {r.packet_id for r in batch}
    for r in batch:
        for name in FEATURE_NAMES:
            assert got[r.packet_id][name] == pytest.approx(r[name], rel=1e-7, abs=1e-7), name


def test_limiter_equals_batch(spark, replay, drain, tmp_path):
    rows = random_packets(n=800)
    found = st.stateless_candidates(replay(rows))
    path = f"{tmp_path}/candidates"
    st.write_stream(found, path, f"{tmp_path}/cpc").awaitTermination()
    table = spark.read.schema(found.schema).parquet(path)
    ordered = f"{tmp_path}/ordered"
    cut = table.agg(F.percentile("t_us", F.lit(0.5))).first()[0]
    table.where(F.col("t_us") <= cut).coalesce(1).write.parquet(ordered)
    table.where(F.col("t_us") > cut).coalesce(1).write.mode("append").parquet(ordered)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(ordered)
    pick = lambda df: {(r.packet_id, r.rule) for r in df.collect()}
    assert pick(drain(st.limited_alerts(stream))) == pick(lim.limit_alerts(table))


def test_late_packets_and_rounds(spark, replay, drain):
    rows = [packet(i, i, "10.0.0.1") for i in range(130)]
    rows += [packet(500, 1000, "10.0.0.2"), packet(501, 5000, "10.0.0.2")]
    stream = replay(rows, files=1, delay="10 seconds")
    got = {(r["round"].minute, r.src_ip): r.packets for r in drain(st.traffic_rounds(stream)).collect()}
    assert got[(0, "10.0.0.1")] == 60 and got[(1, "10.0.0.1")] == 60 and got[(2, "10.0.0.1")] == 10


def test_late_data_is_dropped(spark, tmp_path, drain):
    path = str(tmp_path / "late")
    # Lateness is judged by the watermark the previous micro-batch started with.
    for batch in (
        [packet(1, 10, "a")],
        [packet(2, 500, "a")],
        [packet(6, 502, "a")],
        [packet(3, 11, "a"), packet(4, 503, "a")],
        [packet(5, 9000, "a")],
    ):
        packets_df(spark, batch).coalesce(1).write.mode("append").parquet(path)
    got = drain(st.traffic_rounds(packet_stream(spark, path, 1, "10 seconds"))).collect()
    assert sum(r.packets for r in got if r["round"].minute == 0) == 1  # packet 3 came too late


def test_totals(spark, replay, tmp_path):
    rows = random_packets(n=300)
    st.write_updates(st.traffic_totals(replay(rows)), f"{tmp_path}/t", f"{tmp_path}/tc").awaitTermination()
    got = {r.src_ip: r.packets for r in st.latest_updates(spark, f"{tmp_path}/t", ["src_ip"], ["packets"]).collect()}
    assert sum(got.values()) == 300 and got["10.0.0.1"] == sum(r[2] == "10.0.0.1" for r in rows)


def test_idle_state_expires(spark, replay, drain):
    rows = [packet(i, i, "10.0.0.1") for i in range(10)] + [packet(50, 1000, "10.0.0.2")]
    rows += [packet(60, 2000, "10.0.0.2"), packet(70, 2001, "10.0.0.1")]
    rows = sorted(rows, key=lambda r: r[1])
    stream = replay(rows, files=13, delay="1 second")
    got = {r.packet_id: r.seq for r in drain(st.rate_signals(stream, T0, ttl_s=60)).collect()}
    assert got[9] == 10 and got[70] == 1 and got[60] <= 2


def test_idle_state_over_budget_expires(spark, replay, drain):
    rows = [packet(i, i, "10.0.0.1") for i in range(10)] + [packet(50, 1000, "10.0.0.2")]
    rows += [packet(60, 2000, "10.0.0.2"), packet(70, 2001, "10.0.0.1")]
    stream = replay(rows, files=13, delay="1 second")
    cfg = DetectorConfig(packets_per_source=4)
    got = {r.packet_id: r.seq for r in drain(st.rate_signals(stream, T0, cfg, ttl_s=60)).collect()}
    assert got[3] == 4 and 9 not in got and got[70] == 1


def test_earliest_rows_in_chunks():
    import pandas as pd

    from quietwire.streaming.state import earliest

    frame = pd.DataFrame({"t_us": [(i * 37) % 100 for i in range(100)], "packet_id": range(100)})
    chunks = [frame.iloc[i : i + 7] for i in range(0, 100, 7)]
    rows, total, newest = earliest(iter(chunks), ["t_us", "packet_id"], 10)
    assert total == 100 and newest == 99 and rows["t_us"].tolist() == list(range(10))
    assert earliest(iter(chunks), ["t_us"], 0) == (None, 100, 99)
