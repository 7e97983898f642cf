"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each job is run once to warm up and then three times; the median counts. Results go to the noop
sink, so nothing is left out of the plan and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import queries as q  # noqa: E402
from quietwire.config import ForestConfig  # noqa: E402
from quietwire.operators import analytics as an, features as feat, forest as fo  # noqa: E402
from quietwire.operators import limiter as lim, rules as R  # noqa: E402
from quietwire.plans import detection, training  # noqa: E402
from quietwire.scratch import pin  # noqa: E402
from checks.event_packets import packets_from_events  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    packets = pin(packets_from_events(spark, folder).repartition(int(cpus)), "bench-packets")
    running = pin(feat.running_features(R.analysed_packets(packets), 1000), "bench-running")
    trained = training.train(running, key="packet_id")
    alerts = pin(q._alerts(spark, folder, False), "bench-alerts")
    candidates = pin(R.rule_candidates(R.packet_signals(packets)), "bench-candidates")

    jobs = {
        "snapshot_features": lambda: feat.snapshot_features(packets, 1000),
        "running_features": lambda: feat.running_features(R.analysed_packets(packets), 1000),
        "malicious_scan": lambda: R.malicious_payload_alerts(R.payload_signals(packets)),
        "rule_candidates": lambda: R.rule_candidates(R.packet_signals(packets)),
        "limiter": lambda: lim.limit_alerts(candidates),
        "detection_rules": lambda: detection.detect(packets),
        "detection_with_model": lambda: detection.detect(packets, trained.forest),
        "forest_training": lambda: fo.fit_forest(running, ForestConfig(), "packet_id").trees,
        "forest_scoring": lambda: fo.predict(trained.forest, running),
        "heatmap": lambda: an.hour_heatmap(alerts),
        "alert_rate": lambda: an.alert_rate(alerts, "1H"),
        "alert_stats": lambda: an.alert_stats(alerts),
        "entropy_documents": lambda: q.registered()["byte_entropy_documents"](spark, folder),
        "running_count_unlimited": lambda: q.registered()["running_count"](spark, folder),
    }
    seconds: dict[str, float] = {}
    for name, job in jobs.items():
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
    n = packets.agg(F.count(F.lit(1))).first()[0]
    print(
        json.dumps(
            {
                "metric": "total median seconds of the headline jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "packets": n,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
