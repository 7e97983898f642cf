"""Streaming detection over packet streams, with the rule and model code of the batch jobs.

Event time replaces the clock. Packets of a source must arrive in time order across micro-batches
for counts, rates, features and the limiter to equal a batch run; within a micro-batch they are
sorted. With a watermark, idle state expires after ``ttl``; without one it is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from quietwire.config import FEATURE_COMMON_PORTS, FEATURE_NAMES, DetectorConfig
from quietwire.functions.payload import describe_payload
from quietwire.operators import rules as R
from quietwire.operators.filters import valid_sources
from quietwire.operators.forest import Forest, predict
from quietwire.streaming import state as S

SIGNAL_SCHEMA = (
    "packet_id bigint, t_us bigint, src_ip string, protocol string, dst_port int, "
    "payload_len int, pattern string, seq bigint, rate double, avg_rate double"
)
FEATURE_SCHEMA = "src_ip string, packet_id bigint, t_us bigint, seq bigint, " + ", ".join(
    f"{n} double" for n in FEATURE_NAMES
)


def names_of(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _timeout(ttl_s: int | None) -> tuple[str, int | None]:
    if ttl_s is None:
        return GroupStateTimeout.NoTimeout, None
    return GroupStateTimeout.EventTimeTimeout, ttl_s * 1000


def _narrow(packets: DataFrame, cfg: DetectorConfig) -> DataFrame:
    return describe_payload(valid_sources(packets, cfg.trusted_subnets))


def stateless_candidates(packets: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Port and payload rules, packet by packet."""
    return R.rule_candidates(R.payload_signals(packets, cfg), cfg)


def rate_signals(
    packets: DataFrame, start_us: int, cfg: DetectorConfig = DetectorConfig(), ttl_s: int | None = None
) -> DataFrame:
    """Rule inputs with running count and rates, keyed state per source."""
    timeout, ttl_ms = _timeout(ttl_s)
    update = S.rate_signals(start_us, cfg.rate_history, cfg.packets_per_source, ttl_ms, names_of(SIGNAL_SCHEMA))
    keep = ["packet_id", "t_us", "src_ip", "protocol", "dst_port", "payload_len", "pattern"]
    narrow = _narrow(packets, cfg)
    keep += ["ts"] if "ts" in narrow.columns else []
    return narrow.select(*keep).groupBy("src_ip").applyInPandasWithState(
        update, SIGNAL_SCHEMA, S.RATE_STATE, "append", timeout
    )


def detection_candidates(
    packets: DataFrame, start_us: int, cfg: DetectorConfig = DetectorConfig(), ttl_s: int | None = None
) -> DataFrame:
    """Candidates of all packet rules."""
    return R.rule_candidates(rate_signals(packets, start_us, cfg, ttl_s), cfg)


def running_features(
    packets: DataFrame, cfg: DetectorConfig = DetectorConfig(), ttl_s: int | None = None
) -> DataFrame:
    """Features of a source at each of its packets, keyed state per source."""
    timeout, ttl_ms = _timeout(ttl_s)
    update = S.feature_rows(
        cfg.history,
        cfg.packets_per_source,
        cfg.min_packets_ml,
        FEATURE_COMMON_PORTS,
        ttl_ms,
        names_of(FEATURE_SCHEMA),
    )
    keep = ["packet_id", "t_us", "src_ip", "protocol", "dst_port", "size", "payload_len", "entropy"]
    narrow = _narrow(packets, cfg)
    keep += ["ts"] if "ts" in narrow.columns else []
    return narrow.select(*keep).groupBy("src_ip").applyInPandasWithState(
        update, FEATURE_SCHEMA, S.FEATURE_STATE, "append", timeout
    )


def limited_alerts(
    candidates: DataFrame, cfg: DetectorConfig = DetectorConfig(), ttl_s: int | None = None
) -> DataFrame:
    """The alert limiter over a candidate stream."""
    timeout, ttl_ms = _timeout(ttl_s)
    columns = list(R.CANDIDATE)
    schema = candidates.select(*columns).schema
    update = S.kept_alerts(cfg.cooldown_s * 1_000_000, cfg.max_alerts, ttl_ms, columns)
    keep = columns + (["ts"] if "ts" in candidates.columns else [])
    return candidates.select(*keep).groupBy("src_ip", "alert_type").applyInPandasWithState(
        update, schema, S.LIMITER_STATE, "append", timeout
    )


def traffic_rounds(packets: DataFrame, length: str = "60 seconds") -> DataFrame:
    """Packets per source and tumbling window; closed windows are final once the watermark passes."""
    return (
        packets.groupBy(F.window("ts", length), "src_ip")
        .agg(F.count(F.lit(1)).alias("packets"))
        .select(F.col("window.start").alias("round"), "src_ip", "packets")
    )


def traffic_totals(packets: DataFrame) -> DataFrame:
    """Packets per source since the start, as updates."""
    return packets.groupBy("src_ip").agg(F.count(F.lit(1)).alias("packets"))


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once by the file sink's log."""
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_ml_candidates(
    features: DataFrame, forest: Forest, path: str, checkpoint: str, score_threshold: float | None = 0.0
) -> StreamingQuery:
    """Score a feature stream micro-batch by micro-batch; the forest travels with the scoring function."""

    def score(batch: DataFrame, batch_id: int) -> None:
        found = R.ml_candidates(predict(forest, batch), score_threshold)
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        features.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_updates(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store the changed rows of every micro-batch in a folder of its own; a repeated batch overwrites it."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The newest stored row of every key."""
    newest = F.max_by(F.struct(*values), F.col("batch")).alias("v")
    return spark.read.parquet(path).groupBy(*keys).agg(newest).select(*keys, *[f"v.{c}" for c in values])
