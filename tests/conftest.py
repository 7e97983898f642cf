from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quietwire.schemas import PACKET  # noqa: E402

DATA = "/root/testdata/sf0.001"
T0 = 1_704_067_200_000_000


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def packet(n, t_s, ip, protocol="TCP", port=80, size=60, payload=None):
    return (n, T0 + int(round(t_s * 1e6)), ip, protocol, port, size, payload)


def packets_df(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, PACKET)


def random_packets(seed: int = 7, n: int = 1500, hot_share: float = 0.4) -> list[tuple]:
    """Packets of a few sources, one of them hot, with equal times and mixed payloads."""
    rng = random.Random(seed)
    rows, t = [], 1.0
    for i in range(n):
        t += rng.choice([0.0, 0.0, 0.01, 0.2, 0.4, 7.0])
        ip = "10.0.0.1" if rng.random() < hot_share else f"10.0.0.{rng.randint(2, 6)}"
        protocol = rng.choice(["TCP", "TCP", "UDP", "ICMP", None])
        port = rng.choice([80, 443, 53, 8080, 4444, 31337]) if protocol in ("TCP", "UDP") else None
        payload = rng.choice([None, b"", b"AAAA", bytes(rng.randbytes(rng.randint(1, 150)))])
        rows.append(packet(i, t, ip, protocol, port, rng.randint(40, 1500), payload))
    return rows
