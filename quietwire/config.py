"""Defaults of the detector. Everything a job needs is passed in explicitly."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------------------------
# Results depend on these lists and numbers.
# ---------------------------------------------------------------------------------------------

FEATURE_NAMES = (
    "packets_per_second",
    "bytes_per_second",
    "avg_packet_size",
    "packet_size_variance",
    "total_packets",
    "total_bytes",
    "inter_arrival_mean",
    "inter_arrival_std",
    "burst_rate",
    "session_duration",
    "tcp_ratio",
    "udp_ratio",
    "icmp_ratio",
    "unique_ports",
    "uncommon_port_ratio",
    "payload_entropy",
    "avg_payload_size",
    "payload_size_variance",
)

# Ports the port rule accepts.
HIGH_TRAFFIC_PORTS = (22, 53, 80, 443, 993, 995, 587, 465)

# Ports the uncommon_port_ratio feature accepts (a different list on purpose).
FEATURE_COMMON_PORTS = (20, 21, 22, 23, 25, 53, 80, 110, 143, 443, 3306, 5432, 8080, 8443)

TRUSTED_SUBNETS = ("192.168.65.0/24",)

MALICIOUS_PATTERNS = (
    "UNION SELECT",
    "' OR '1'='1'",
    "' OR 1=1--",
    "' OR 'x'='x'",
    "admin'--",
    "' UNION SELECT",
    "'; DROP TABLE",
    "'; DELETE FROM",
    "xp_cmdshell",
    "sp_executesql",
    "; wget http",
    "; curl http",
    "&& wget",
    "| wget",
    "; chmod 777",
    "&& chmod",
    "/bin/bash -c",
    "/bin/sh -c",
    "nc -l -p",
    "ncat -l",
    "<?php system(",
    "<?php exec(",
    "<?php shell_exec(",
    "eval(base64_decode(",
    "system($_GET[",
    "exec($_POST[",
    "<script>alert(",
    "javascript:alert(",
    "<img src=x onerror=",
    "<svg onload=",
    "<iframe src=",
    "../../../etc/passwd",
    "..\\..\\..\\windows",
    "../../../../etc/shadow",
    "..\\..\\..\\boot.ini",
    "php://filter",
    "php://input",
    "data://text/plain",
    "file:///etc/passwd",
    "file:///c:/windows",
)

KNOWN_IPS = (
    ("8.8.8.8", "Google DNS (Primary)"),
    ("8.8.4.4", "Google DNS (Secondary)"),
    ("1.1.1.1", "Cloudflare DNS"),
    ("1.0.0.1", "Cloudflare DNS"),
    ("9.9.9.9", "Quad9 DNS"),
    ("149.112.112.112", "Quad9 DNS"),
    ("208.67.222.222", "OpenDNS Home"),
    ("208.67.220.220", "OpenDNS Home"),
    ("4.2.2.1", "Level3 DNS"),
    ("4.2.2.2", "Level3 DNS"),
    ("192.168.1.1", "Local Gateway"),
    ("192.168.0.1", "Local Gateway"),
)

GENERIC_CATEGORIES = (
    "Public Internet",
    "Local Network (Private)",
    "Localhost (Loopback)",
    "Multicast",
    "Reserved",
    "Unknown/Invalid",
)

SENSITIVE_WORDS = ("password", "token", "key", "secret", "auth")

DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

LOG_TIMESTAMP = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
LOG_ML_ALERT = r"\[ML\] ML ANOMALY DETECTED: ([\d\.]+) - .*Anomaly score: ([-\d\.]+)"
LOG_RULE_ALERT = r"\[RULE\] ALERT: (.+)"
LOG_SOURCE = r"from ([\d\.]+)"
LOG_ANY_IP = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"

SCORE_TIMELINE_THRESHOLD = -0.1
ALERT_INTERVALS_US = {
    "5min": 300_000_000,
    "15min": 900_000_000,
    "1H": 3_600_000_000,
    "4H": 14_400_000_000,
    "1D": 86_400_000_000,
}


@dataclass(frozen=True)
class DetectorConfig:
    """Thresholds of the packet rules and of the alert limiter.

    ``packets_per_source`` is an explicit budget (the first so many packets of each source); None, the
    default, looks at every packet. ``history`` is the length of the feature frame, ``part_rows`` the
    packets of a source that are framed in one task.
    """

    trusted_subnets: tuple[str, ...] = TRUSTED_SUBNETS
    allowed_ports: tuple[int, ...] = HIGH_TRAFFIC_PORTS
    spike_multiplier: float = 2.0
    icmp_threshold: int = 50
    payload_threshold: int = 100
    packets_per_source: int | None = None
    rate_history: int = 10
    history: int = 1_000
    part_rows: int = 100_000
    min_packets_ml: int = 10
    score_threshold: float | None = 0.0
    cooldown_s: int = 60
    max_alerts: int = 3

    def __post_init__(self) -> None:
        if not self.spike_multiplier > 1.0:
            raise ValueError(f"a spike is more than the mean rate: multiplier {self.spike_multiplier}")
        counts = {"icmp_threshold": 1, "payload_threshold": 1, "history": 1, "part_rows": self.history}
        for name, least in counts.items():
            if getattr(self, name) < least:
                raise ValueError(f"{name} is below {least}")
        if self.packets_per_source is not None and self.packets_per_source < 1:
            raise ValueError("packets_per_source is below 1; None is no budget")


@dataclass(frozen=True)
class ForestConfig:
    """Isolation forest settings."""

    contamination: float = 0.01
    n_trees: int = 100
    max_samples: int = 256
    seed: int = 42
    min_rows: int = 2

    def __post_init__(self) -> None:
        if not 0.001 <= self.contamination <= 0.5:
            raise ValueError(f"contamination {self.contamination} is not in [0.001, 0.5]")
