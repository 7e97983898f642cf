from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietwire.config import FEATURE_NAMES, DetectorConfig, ForestConfig
from quietwire.operators.features import running_features
from quietwire.operators.rules import analysed_packets
from quietwire.plans import training
from quietwire.plans.detection import detect
from quietwire.sources.alerts import alert_table
from quietwire.sources.packets import packet_stream
from quietwire.streaming import job
from tests.conftest import T0, packet, packets_df, random_packets

SHOWN = ["packet_id", "ip_address", "rule", "alert_type", "stored_type", "description", "anomaly_score", "target_port"]


@pytest.fixture
def streamed(spark, tmp_path):
    """Alerts of the job over packets that arrive in several files, out of order within the delay."""

    def run(files, **kw):
        path = str(tmp_path / "packets")
        # A last packet moves the watermark past all others, and stays in state.
        end = max(r[1] for f in files for r in f) + 10**10
        for rows in [*files, [(-1, end, "8.8.4.4", "TCP", 443, 0, None)]]:
            packets_df(spark, rows).coalesce(1).write.mode("append").parquet(path)
        stream = packet_stream(spark, path, max_files=1, delay="30 seconds")
        out, checkpoint = str(tmp_path / "alerts"), str(tmp_path / "checkpoint")
        job.run(stream, T0, out, checkpoint, **kw).awaitTermination()
        return alert_table(spark, out)

    return run


def shown(df):
    rows = df.select(*SHOWN).collect()
    return sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in rows)


def in_files(rows, n, seed=3):
    """Five files by time; some packets stand in the file after theirs."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    step = -(-len(rows) // n)
    files = [rows[i : i + step] for i in range(0, len(rows), step)]
    for a, b in zip(files[:-1], files[1:], strict=True):
        newest = max(r[1] for r in a)
        late = [r for r in a if r[1] > newest - 10_000_000 and rng.random() < 0.5 and r[1] < newest]
        for r in late:
            a.remove(r)
            b.append(r)
    for f in files:
        rng.shuffle(f)
    return files


def test_the_job_equals_the_batch_with_rules_and_model(spark, streamed):
    rows = random_packets(n=900)
    table = packets_df(spark, rows)
    cfg = DetectorConfig(history=40, spike_multiplier=1.5)
    features = running_features(analysed_packets(table, cfg), 40)
    forest = training.train(features, ForestConfig(n_trees=10), key="packet_id").forest
    got = streamed(in_files(rows, 5), forest=forest, cfg=cfg)
    want = detect(table, forest, F.lit(T0), cfg)
    assert shown(got) == shown(want) and {r.rule for r in got.select("rule").collect()} >= {"ml", "uncommon_port"}


def test_a_hot_source_in_one_micro_batch_is_taken_slice_by_slice(spark, streamed):
    rows = [packet(i, i / 2000, "10.0.0.1", "TCP", 9999) for i in range(60_000)]
    got = streamed([rows], slice_us=1_000_000)
    assert shown(got) == shown(detect(packets_df(spark, rows), start_us=F.lit(T0)))


def test_late_packets_are_dropped_and_idle_sources_forgotten(spark, streamed):
    first = [packet(i, i, "10.0.0.1", "ICMP", None) for i in range(60)]
    second = [packet(100, 5000, "10.0.0.2", "TCP", 9)]
    # Long after: the first source has been forgotten, and one packet is far too late.
    third = [packet(101, 5050, "10.0.0.2", "TCP", 9), packet(7, 20, "10.0.0.1", "TCP", 9)]
    fourth = [packet(102, 5200, "10.0.0.1", "ICMP", None), packet(103, 5201, "10.0.0.1", "TCP", 9)]
    got = {(r.packet_id, r.rule) for r in streamed([first, second, third, fourth], ttl_s=60).collect()}
    assert (7, "uncommon_port") not in got and (102, "icmp_flood") not in got
    assert {(100, "uncommon_port"), (101, "uncommon_port"), (103, "uncommon_port"), (50, "icmp_flood")} <= got


def test_features_of_slices_join_up(spark):
    import pandas as pd

    rows = pd.DataFrame(random_packets(n=400), columns=["packet_id", "t_us", "src_ip", "protocol", "dst_port", "size", "payload"])
    rows = rows[rows["src_ip"] == "10.0.0.1"].reset_index(drop=True)
    rows["payload_len"], rows["entropy"], rows["pattern"] = rows["payload"].map(lambda p: len(p or b"")), 1.0, None
    one, parts = job.SourceProcessor(T0, DetectorConfig(history=30), None, 10), job.SourceProcessor(T0, DetectorConfig(history=30), None, 10)
    whole = one.advance({}, rows, 0)
    value: dict = {}
    cut = pd.concat([parts.advance(value, rows.iloc[i : i + 17].reset_index(drop=True), 0) for i in range(0, len(rows), 17)])
    for name in ["seq", "rate", "avg_rate", *FEATURE_NAMES]:
        assert np.allclose(whole[name].to_numpy(float), cut[name].to_numpy(float), equal_nan=True), name


def test_short_slices_are_handled_together(spark, streamed, monkeypatch):
    rows = [packet(i, i / 10, "10.0.0.1", "TCP", 9999 if i % 3 else None) for i in range(5_000)]
    got = streamed([rows], slice_us=1_000_000)
    assert shown(got) == shown(detect(packets_df(spark, rows), start_us=F.lit(T0)))

    class State(dict):
        updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.__delitem__

    part = job.SourceProcessor(T0, DetectorConfig(), None, 1_000_000)
    part.parts, value = State(), {"pending": {}}
    frame = packets_df(spark, rows).toPandas()[["packet_id", "t_us", "dst_port"]]
    shuffled = frame.sample(frac=1, random_state=1)
    # Ports are whole numbers in one chunk, and null in all of another's rows.
    chunks = [shuffled[shuffled["dst_port"].notna()].astype({"dst_port": "int32"}), shuffled[shuffled["dst_port"].isna()]]
    assert len(part.store(value, iter(chunks))) == 500
    frames = list(part.take(value, T0 // 1_000_000 + 400))
    assert len(frames) == 1 and len(value["pending"]) == 100  # one frame for 400 slices
    assert frames[0].equals(frame.iloc[:4_000].astype(frames[0].dtypes.to_dict()))
    monkeypatch.setattr(job, "LEAST_ROWS", 15)
    assert [len(x) for x in part.take(value, None)] == [20] * 50 and not part.parts

