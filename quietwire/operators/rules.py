"""Packet rules: from described packets to candidate alerts.

The wording of the alerts is fixed: what reads the alert log depends on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quietwire.config import DetectorConfig
from quietwire.functions.ip import safe_ip
from quietwire.functions.payload import describe_payload
from quietwire.functions.text import features_json
from quietwire.operators.filters import ml_score_valid, per_source_budget, valid_port, valid_sources
from quietwire.operators.ordering import running_count, split_with_halo

CANDIDATE = (
    "packet_id",
    "t_us",
    "src_ip",
    "rule",
    "rule_seq",
    "alert_type",
    "seq",
    "dst_port",
    "rate",
    "avg_rate",
    "payload_len",
    "pattern",
    "score",
    "raw_data",
)


@dataclass(frozen=True)
class Rule:
    """A rule is a predicate plus the text of its alert; all are plain columns."""

    name: str
    order: int
    alert_type: str
    fires: Column
    subject: Column
    body: Column


def packet_rules(cfg: DetectorConfig = DetectorConfig()) -> list[Rule]:
    """The rules in the order they are evaluated for one packet (0 is the model)."""
    source, port = safe_ip(F.col("src_ip")), F.col("dst_port").cast("string")
    usable = valid_port(F.col("protocol"), F.col("dst_port"))
    return [
        Rule(
            "spike",
            1,
            "RULE",
            (F.col("avg_rate") > 0) & (F.col("rate") > F.col("avg_rate") * cfg.spike_multiplier),
            F.concat(F.lit("ALERT: Traffic spike from "), source),
            F.format_string(
                "IP %s has a traffic rate of %.2f packets/sec, which is significantly higher than "
                "the average of %.2f packets/sec.",
                source,
                F.col("rate"),
                F.col("avg_rate"),
            ),
        ),
        Rule(
            "icmp_flood",
            2,
            "ICMP_FLOOD",
            (F.col("protocol") == "ICMP") & (F.col("seq") > cfg.icmp_threshold),
            F.concat(F.lit("ALERT: Possible ICMP attack (ping flood) from "), source),
            F.concat(
                F.lit("IP "), source, F.lit(f" has sent more than {cfg.icmp_threshold} ICMP packets.")
            ),
        ),
        Rule(
            "uncommon_port",
            3,
            "RULE",
            usable & ~F.col("dst_port").isin(*cfg.allowed_ports),
            F.concat(F.lit("ALERT: Traffic on uncommon port "), port, F.lit(" from "), source),
            F.concat(
                F.lit("Traffic detected from IP "),
                source,
                F.lit(" to port "),
                port,
                F.lit(", which is unusual."),
            ),
        ),
        Rule(
            "large_payload",
            4,
            "RULE",
            usable & (F.col("payload_len") > cfg.payload_threshold),
            F.concat(F.lit("ALERT: Unusually large payload from "), source),
            F.concat(
                F.lit("A payload of "),
                F.col("payload_len").cast("string"),
                F.lit(" bytes was detected from "),
                source,
                F.lit(" to port "),
                port,
                F.lit("."),
            ),
        ),
        Rule(
            "malicious_payload",
            5,
            "RULE",
            usable & F.col("pattern").isNotNull(),
            F.concat(F.lit("ALERT: Malicious payload detected from "), source),
            F.concat(
                F.lit("The pattern '"),
                F.col("pattern"),
                F.lit("' was detected in traffic from "),
                source,
                F.lit(" to port "),
                port,
                F.lit("."),
            ),
        ),
    ]


def ml_rule() -> Rule:
    source = safe_ip(F.col("src_ip"))
    return Rule(
        "ml",
        0,
        "ML",
        F.lit(True),
        F.concat(F.lit("ML ANOMALY DETECTED: "), source),
        F.format_string(
            "IP %s flagged as anomalous by ML model. Anomaly score: %.4f (lower = more anomalous). "
            "Total packets: %d",
            source,
            F.col("score"),
            F.col("seq").cast("bigint"),
        ),
    )


def analysed_packets(packets: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """What detection looks at: narrow rows of usable sources, with their running count ``seq``.

    All packets of a source, unless the configuration gives a budget.
    """
    usable = describe_payload(valid_sources(packets, cfg.trusted_subnets))
    if cfg.packets_per_source is not None:
        return per_source_budget(usable, cfg.packets_per_source)
    return running_count(usable)


def payload_signals(packets: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """What the port and payload rules read, packet by packet: no order, no shuffle. For tables and streams.

    Count and rates are null, so rules that need them don't fire. A budget per source (of a table) needs the order and
    gives ``seq``.
    """
    null = lambda kind: F.lit(None).cast(kind)
    rates = {"rate": null("double"), "avg_rate": null("double")}
    if cfg.packets_per_source is not None and not packets.isStreaming:
        return analysed_packets(packets, cfg).withColumns(rates)
    usable = describe_payload(valid_sources(packets, cfg.trusted_subnets))
    return usable.withColumns({"seq": null("bigint"), **rates})


def packet_rates(
    analysed: DataFrame, start_us: Column, history: int = 10, part_rows: int | None = 100_000
) -> DataFrame:
    """Add ``rate`` (packets of the source per second since start) and its rolling mean.

    Packets not after the start have no rate and do not enter the mean. Time grows with ``seq``,
    so these are a prefix of each source and a frame of rows is safe on the rest.
    """
    elapsed = (F.col("t_us") - start_us).cast("double") / 1e6
    rated = split_with_halo(analysed, part_rows, history - 1).withColumn(
        "rate", F.when(elapsed > 0, F.col("seq").cast("double") / elapsed)
    )
    last = (
        Window.partitionBy("src_ip", "part")
        .orderBy("t_us", "packet_id")
        .rowsBetween(-(history - 1), Window.currentRow)
    )
    return (
        rated.withColumn("avg_rate", F.when(F.col("rate").isNotNull(), F.avg("rate").over(last)))
        .where("core")
        .drop("part", "core")
    )


def first_packet_time(packets: DataFrame) -> Column:
    """Start of monitoring where none is given: the time of the first packet."""
    return packets.agg(F.min("t_us")).scalar()


def packet_signals(
    packets: DataFrame, start_us: Column | None = None, cfg: DetectorConfig = DetectorConfig()
) -> DataFrame:
    """All columns the rules read, for every analysed packet."""
    start = first_packet_time(packets) if start_us is None else start_us
    return packet_rates(analysed_packets(packets, cfg), start, cfg.rate_history, cfg.part_rows)


def _candidate_columns(name: Column, order: Column, alert_type: Column) -> list[Column]:
    return [
        F.col("packet_id"),
        F.col("t_us"),
        F.col("src_ip"),
        name.alias("rule"),
        order.cast("int").alias("rule_seq"),
        alert_type.alias("alert_type"),
        F.col("seq").cast("bigint").alias("seq"),
        F.col("dst_port").cast("int").alias("dst_port"),
        F.col("rate"),
        F.col("avg_rate"),
        F.col("payload_len").cast("int").alias("payload_len"),
        F.col("pattern"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("string").alias("raw_data"),
    ]


def rule_candidates(signals: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Candidates of all packet rules in one pass: each packet yields one row per firing rule."""
    fired = F.array_compact(
        F.array(
            *[
                F.when(
                    r.fires,
                    F.struct(
                        F.lit(r.name).alias("rule"),
                        F.lit(r.order).alias("rule_seq"),
                        F.lit(r.alert_type).alias("alert_type"),
                    ),
                )
                for r in packet_rules(cfg)
            ]
        )
    )
    return (
        signals.withColumn("_hit", F.explode(fired))
        .select("*", "_hit.rule", "_hit.rule_seq", "_hit.alert_type")
        .select(*_candidate_columns(F.col("rule"), F.col("rule_seq"), F.col("alert_type")))
    )


def one_rule(signals: DataFrame, name: str, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Candidates of a single rule."""
    rule = next(r for r in packet_rules(cfg) if r.name == name)
    return signals.where(rule.fires).select(
        *_candidate_columns(F.lit(rule.name), F.lit(rule.order), F.lit(rule.alert_type))
    )


def rate_spikes(signals: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    return one_rule(signals, "spike", cfg)


def icmp_floods(signals: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    return one_rule(signals, "icmp_flood", cfg)


def uncommon_port_alerts(signals: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    return one_rule(signals, "uncommon_port", cfg)


def large_payload_alerts(signals: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    return one_rule(signals, "large_payload", cfg)


def malicious_payload_alerts(signals: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    return one_rule(signals, "malicious_payload", cfg)


def ml_candidates(scored: DataFrame, score_threshold: float | None = 0.0) -> DataFrame:
    """Candidates of the model, from running features with prediction and anomaly_score.

    With the default threshold every scored packet qualifies, because forest scores are negative;
    None keeps only what the model labels as anomalous.
    """
    flagged = F.col("prediction") == -1
    if score_threshold is not None:
        flagged = flagged | (F.col("anomaly_score") < score_threshold)
    null = lambda kind: F.lit(None).cast(kind)
    return scored.where(flagged & ml_score_valid(F.col("anomaly_score"))).select(
        F.col("packet_id"),
        F.col("t_us"),
        F.col("src_ip"),
        F.lit("ml").alias("rule"),
        F.lit(0).alias("rule_seq"),
        F.lit("ML").alias("alert_type"),
        F.col("seq").cast("bigint").alias("seq"),
        null("int").alias("dst_port"),
        null("double").alias("rate"),
        null("double").alias("avg_rate"),
        null("int").alias("payload_len"),
        null("string").alias("pattern"),
        F.col("anomaly_score").alias("score"),
        features_json().alias("raw_data"),
    )


def all_candidates(rules: DataFrame, ml: DataFrame | None = None) -> DataFrame:
    return rules if ml is None else ml.unionByName(rules)


def alert_text(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Subject and body chosen by the ``rule`` column."""
    subject = F.coalesce(*[F.when(F.col("rule") == r.name, r.subject) for r in rules])
    body = F.coalesce(*[F.when(F.col("rule") == r.name, r.body) for r in rules])
    return subject, body


def stored_type(alert_type: Column) -> Column:
    """Only RULE and ML are stored as such."""
    return F.when(alert_type.isin("RULE", "ML"), alert_type).otherwise(F.lit("UNKNOWN"))


def _alert_row(description: Column, score: Column, raw_data: Column) -> list[Column]:
    return [
        F.timestamp_seconds(F.floor(F.col("t_us") / 1_000_000)).alias("ts"),
        F.col("packet_id"),
        F.col("src_ip").alias("ip_address"),
        F.col("rule"),
        F.col("alert_type"),
        stored_type(F.col("alert_type")).alias("stored_type"),
        description.alias("description"),
        score.alias("anomaly_score"),
        raw_data.alias("raw_data"),
        F.col("dst_port").alias("target_port"),
    ]


def alert_rows(kept: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Alert table rows of limited candidates: text is only built for what is stored."""
    subject, body = alert_text([ml_rule(), *packet_rules(cfg)])
    description = F.concat(subject, F.lit(" - "), body)
    return kept.select(*_alert_row(description, F.lit(0.0), F.lit(None).cast("string")))


def ml_direct_rows(ml: DataFrame) -> DataFrame:
    """The second, unlimited copy of every model alert: real score, body only, features as JSON."""
    return ml.select(*_alert_row(ml_rule().body, F.col("score"), F.col("raw_data")))
