"""Batch detection: packets in, alert rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from quietwire.config import DetectorConfig
from quietwire.operators import rules as R
from quietwire.operators.features import running_features
from quietwire.operators.filters import ml_ready
from quietwire.operators.forest import Forest, predict
from quietwire.operators.limiter import limit_alerts
from quietwire.scratch import pin


def detect(
    packets: DataFrame,
    forest: Forest | None = None,
    start_us: Column | None = None,
    cfg: DetectorConfig = DetectorConfig(),
) -> DataFrame:
    """Alert rows of the packet rules and, with a forest, of the model.

    Every packet of a usable source is looked at (a budget is an option of the configuration).
    Sources are counted by ranges and framed in parts, so that no source is one task. With a
    forest, what two branches read (the analysed packets, the scored candidates) is written once.
    """
    start = R.first_packet_time(packets) if start_us is None else start_us
    analysed = R.analysed_packets(packets, cfg)
    if forest is not None:
        analysed = pin(analysed, "analysed")
    rules = R.rule_candidates(R.packet_rates(analysed, start, cfg.rate_history, cfg.part_rows), cfg)
    if forest is None:
        return R.alert_rows(limit_alerts(rules, cfg.cooldown_s, cfg.max_alerts), cfg)
    running = running_features(analysed, cfg.history, cfg.min_packets_ml, cfg.part_rows)
    scored = predict(forest, ml_ready(running, cfg.min_packets_ml))
    ml = pin(R.ml_candidates(scored, cfg.score_threshold), "ml-candidates")
    limited = limit_alerts(R.all_candidates(rules, ml), cfg.cooldown_s, cfg.max_alerts)
    return R.alert_rows(limited, cfg).unionByName(R.ml_direct_rows(ml))
