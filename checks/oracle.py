"""The registered queries as SQL over the raw tables, for an independent engine."""

from __future__ import annotations

from checks.event_packets import packet_sql
from checks.forest_sql import forest_ctes, offset_cte, score_ctes, stats_select
from quietwire import config as C

# Written anew here, so that an error in the library's patterns shows.
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NOT_PRINTABLE = (
    "[\\p{C}\\p{Zl}\\p{Zp}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]"
)
LOG_TIMESTAMP = "([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})"
LOG_ML_ALERT = "\\[ML\\] ML ANOMALY DETECTED: ([0-9.]+) - .*Anomaly score: ([-0-9.]+)"
LOG_RULE_ALERT = "\\[RULE\\] ALERT: (.+)"
LOG_SOURCE = "from ([0-9.]+)"
LOG_ANY_IP = "([0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3})"

QUAD = rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ip_number(ip: str) -> str:
    parts = " + ".join(f"CAST(split_part({ip}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5))
    return f"CASE WHEN regexp_full_match({ip}, {quote(QUAD)}) THEN {parts} END"


def first_pattern(text: str) -> str:
    ordered = sorted(C.MALICIOUS_PATTERNS, key=len, reverse=True)
    whens = " ".join(
        f"WHEN contains(lower({text}), {quote(p.lower())}) THEN {quote(p)}" for p in ordered
    )
    return f"CASE {whens} END"


def char_entropy(table: str, key: str, text: str) -> str:
    return f"""
SELECT {key}, -sum(p * log2(p)) AS entropy FROM (
  SELECT {key}, ch, CAST(count(*) AS DOUBLE) / any_value(len) AS p FROM (
    SELECT {key}, strlen({text}) / 1 AS len, unnest(string_split({text}, '')) AS ch
    FROM {table} WHERE {text} <> '') GROUP BY {key}, ch) GROUP BY {key}"""


def byte_entropy(table: str, key: str, text: str) -> str:
    return f"""
SELECT {key}, -sum(p * log2(p)) AS entropy FROM (
  SELECT {key}, b, CAST(count(*) AS DOUBLE) / any_value(len) AS p FROM (
    SELECT {key}, strlen({text}) AS len, unnest(regexp_extract_all(hex(encode({text})), '..')) AS b
    FROM {table} WHERE {text} <> '') GROUP BY {key}, b) GROUP BY {key}"""


def not_in_detection(number: str) -> str:
    return (
        f"({number} BETWEEN 2130706432 AND 2147483647 OR {number} BETWEEN 2851995648 AND 2852061183"
        f" OR {number} BETWEEN 3232252160 AND 3232252415)"
    )


CATEGORY = """CASE {known} WHEN n IS NULL THEN 'Unknown/Invalid'
  WHEN n BETWEEN 2130706432 AND 2147483647 THEN 'Localhost (Loopback)'
  WHEN (n < 16777216 OR n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2851995648 AND 2852061183
    OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3221225472 AND 3221225727
    OR n BETWEEN 3221225984 AND 3221226239 OR n BETWEEN 3232235520 AND 3232301055
    OR n BETWEEN 3323068416 AND 3323199487 OR n BETWEEN 3325256704 AND 3325256959
    OR n BETWEEN 3405803776 AND 3405804031 OR n >= 4026531840)
    AND n NOT IN (3221225481, 3221225482) THEN 'Local Network (Private)'
  WHEN n BETWEEN 3758096384 AND 4026531839 THEN 'Multicast' ELSE 'Public Internet' END"""


def category(ip: str) -> str:
    known = " ".join(f"WHEN {ip} = {quote(a)} THEN {quote(b)}" for a, b in C.KNOWN_IPS)
    return CATEGORY.format(known=known)


IN_PORTS = "(" + ", ".join(map(str, C.HIGH_TRAFFIC_PORTS)) + ")"
COMMON = "(" + ", ".join(map(str, C.FEATURE_COMMON_PORTS)) + ")"
USABLE = "protocol IN ('TCP', 'UDP') AND dst_port BETWEEN 0 AND 65535"


def packet_ctes(suffix: str, compress: bool) -> str:
    s = suffix
    return f"""
pk{s} AS ({packet_sql("events", "epoch_us(ts)", "//", "VARCHAR", compress)}),
pl{s} AS (SELECT *, {ip_number("src_ip")} AS ip_long FROM pk{s}),
val{s} AS (SELECT * FROM pl{s} WHERE ip_long IS NOT NULL AND NOT {not_in_detection("ip_long")}),
ent{s} AS ({char_entropy("pk" + s, "packet_id", "payload")}),
des{s} AS (SELECT pl{s}.*, coalesce(strlen(payload), 0) AS payload_len, coalesce(entropy, 0) AS entropy,
  {first_pattern("payload")} AS pattern
  FROM pl{s} LEFT JOIN ent{s} USING (packet_id)),
bud{s} AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY t_us, packet_id) AS seq
  FROM des{s} WHERE packet_id IN (SELECT packet_id FROM val{s})),
rat{s} AS (SELECT *, CASE WHEN t_us > t0 THEN CAST(seq AS DOUBLE) / (CAST(t_us - t0 AS DOUBLE) / 1e6) END AS rate
  FROM bud{s}, (SELECT min(t_us) AS t0 FROM pk{s})),
sig{s} AS (SELECT *, CASE WHEN rate IS NOT NULL THEN avg(rate) OVER (PARTITION BY src_ip ORDER BY t_us, packet_id
  ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS avg_rate FROM rat{s}),
cand{s} AS (
  SELECT packet_id, t_us, src_ip, 'spike' AS rule, 1 AS rule_seq, 'RULE' AS alert_type, dst_port, '' AS description
    FROM sig{s} WHERE avg_rate > 0 AND rate > avg_rate * 2.0
  UNION ALL SELECT packet_id, t_us, src_ip, 'icmp_flood', 2, 'ICMP_FLOOD', dst_port,
    'ALERT: Possible ICMP attack (ping flood) from ' || src_ip || ' - IP ' || src_ip || ' has sent more than 50 ICMP packets.'
    FROM sig{s} WHERE protocol = 'ICMP' AND seq > 50
  UNION ALL SELECT packet_id, t_us, src_ip, 'uncommon_port', 3, 'RULE', dst_port,
    'ALERT: Traffic on uncommon port ' || dst_port || ' from ' || src_ip || ' - Traffic detected from IP ' || src_ip
    || ' to port ' || dst_port || ', which is unusual.'
    FROM sig{s} WHERE {USABLE} AND dst_port NOT IN {IN_PORTS}
  UNION ALL SELECT packet_id, t_us, src_ip, 'large_payload', 4, 'RULE', dst_port,
    'ALERT: Unusually large payload from ' || src_ip || ' - A payload of ' || payload_len || ' bytes was detected from '
    || src_ip || ' to port ' || dst_port || '.'
    FROM sig{s} WHERE {USABLE} AND payload_len > 100
  UNION ALL SELECT packet_id, t_us, src_ip, 'malicious_payload', 5, 'RULE', dst_port,
    'ALERT: Malicious payload detected from ' || src_ip || ' - The pattern ''' || pattern || ''' was detected in traffic from '
    || src_ip || ' to port ' || dst_port || '.'
    FROM sig{s} WHERE {USABLE} AND pattern IS NOT NULL),
mlc{s} AS (SELECT packet_id, t_us, src_ip, seq,
  -round(CAST(size AS DOUBLE) / CAST(size + 300 AS DOUBLE), 3) AS score FROM bud{s} WHERE seq >= 10),
mlb{s} AS (SELECT *, printf('IP %s flagged as anomalous by ML model. Anomaly score: %.4f (lower = more anomalous). Total packets: %d',
  src_ip, score, seq) AS body FROM mlc{s}),
al{s} AS (
  SELECT t_us // 1000000 AS ts_s, packet_id, src_ip AS ip_address, rule, alert_type,
    CASE WHEN alert_type IN ('RULE', 'ML') THEN alert_type ELSE 'UNKNOWN' END AS stored_type, description,
    0.0::DOUBLE AS anomaly_score, dst_port AS target_port FROM cand{s}
  UNION ALL SELECT t_us // 1000000, packet_id, src_ip, 'ml', 'ML', 'ML', body, score, NULL FROM mlb{s})"""


def limiter_ctes(source: str, name: str) -> str:
    """The limiter as a recursion over the candidates of a key; a, b, c are its last kept times."""
    return f"""
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY src_ip, alert_type ORDER BY t_us, packet_id, rule_seq) AS n
  FROM {source}),
{name}_f AS (
  SELECT n, src_ip, alert_type, packet_id, rule_seq, t_us, TRUE AS kept,
    CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(t_us AS BIGINT) AS c FROM {name}_n WHERE n = 1
  UNION ALL
  SELECT x.n, x.src_ip, x.alert_type, x.packet_id, x.rule_seq, x.t_us,
    f.a IS NULL OR x.t_us - f.a > 60000000,
    CASE WHEN f.a IS NULL OR x.t_us - f.a > 60000000 THEN f.b ELSE f.a END,
    CASE WHEN f.a IS NULL OR x.t_us - f.a > 60000000 THEN f.c ELSE f.b END,
    CASE WHEN f.a IS NULL OR x.t_us - f.a > 60000000 THEN x.t_us ELSE f.c END
  FROM {name}_f f JOIN {name}_n x ON x.src_ip = f.src_ip AND x.alert_type = f.alert_type AND x.n = f.n + 1),
{name} AS (SELECT x.* FROM {name}_n x JOIN {name}_f f USING (src_ip, alert_type, n) WHERE f.kept)"""


PRELUDE = "WITH RECURSIVE" + ",".join([packet_ctes("", True), packet_ctes("_real", False)])


def q(select: str, *extra: str) -> str:
    return PRELUDE + "".join("," + e for e in extra) + "\n" + select


def snapshot_sql(history: int, source: str = "pl") -> str:
    return f"""
snap_in AS (SELECT d.* FROM des d JOIN {source} v USING (packet_id) WHERE d.ip_long IS NOT NULL),
now AS (SELECT max(t_us) AS now FROM snap_in),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY t_us DESC, packet_id DESC) AS age FROM snap_in),
hist0 AS (SELECT * FROM ranked WHERE age <= {history}),
hist1 AS (SELECT *, t_us - lead(t_us) OVER (PARTITION BY src_ip ORDER BY age) AS gap FROM hist0),
life AS (SELECT src_ip, count(*) AS n, sum(size) AS bytes, min(t_us) AS t0,
  count(*) FILTER (WHERE protocol = 'TCP') AS tcp, count(*) FILTER (WHERE protocol = 'UDP') AS udp,
  count(*) FILTER (WHERE protocol = 'ICMP') AS icmp FROM snap_in GROUP BY src_ip HAVING count(*) >= 3),
hist AS (SELECT src_ip, avg(size) AS m, var_pop(size) AS v, avg(gap) AS gm, stddev_pop(gap) AS gs,
  count(*) FILTER (WHERE t_us > now - 5000000) AS burst, count(DISTINCT dst_port) AS ports, count(dst_port) AS np,
  count(*) FILTER (WHERE dst_port NOT IN {COMMON}) AS unc, avg(entropy) FILTER (WHERE entropy > 0) AS e,
  avg(payload_len) FILTER (WHERE payload_len > 0) AS pm, var_pop(payload_len) FILTER (WHERE payload_len > 0) AS pv
  FROM hist1, now GROUP BY src_ip),
feat AS (SELECT src_ip,
  n / greatest((now - t0) / 1e6, 0.001) AS packets_per_second,
  CAST(bytes AS DOUBLE) / greatest((now - t0) / 1e6, 0.001) AS bytes_per_second,
  m AS avg_packet_size, v AS packet_size_variance, CAST(n AS DOUBLE) AS total_packets, CAST(bytes AS DOUBLE) AS total_bytes,
  coalesce(gm, 0) / 1e6 AS inter_arrival_mean, coalesce(gs, 0) / 1e6 AS inter_arrival_std, burst / 5.0::DOUBLE AS burst_rate,
  (now - t0) / 1e6 AS session_duration, CAST(tcp AS DOUBLE) / n AS tcp_ratio, CAST(udp AS DOUBLE) / n AS udp_ratio,
  CAST(icmp AS DOUBLE) / n AS icmp_ratio, CAST(ports AS DOUBLE) AS unique_ports,
  CASE WHEN np > 0 THEN CAST(unc AS DOUBLE) / np ELSE 0 END AS uncommon_port_ratio, coalesce(e, 0) AS payload_entropy,
  coalesce(pm, 0) AS avg_payload_size, coalesce(pv, 0) AS payload_size_variance
  FROM life JOIN hist USING (src_ip), now)"""


def running_sql(history: int) -> str:
    h = history - 1
    return f"""
run0 AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY src_ip ORDER BY t_us, packet_id) AS gap,
  min(t_us) OVER (PARTITION BY src_ip) AS t0 FROM bud),
run1 AS (SELECT *, sum(size) OVER life AS bytes, count(*) FILTER (WHERE protocol = 'TCP') OVER life AS tcp,
  count(*) FILTER (WHERE protocol = 'UDP') OVER life AS udp, count(*) FILTER (WHERE protocol = 'ICMP') OVER life AS icmp,
  avg(size) OVER hist AS m, var_pop(size) OVER hist AS v, list(t_us) OVER hist AS times,
  avg(gap) OVER gaps AS gm, stddev_pop(gap) OVER gaps AS gs, count(DISTINCT dst_port) OVER hist AS ports,
  count(dst_port) OVER hist AS np, count(*) FILTER (WHERE dst_port NOT IN {COMMON}) OVER hist AS unc,
  avg(entropy) FILTER (WHERE entropy > 0) OVER hist AS e, avg(payload_len) FILTER (WHERE payload_len > 0) OVER hist AS pm,
  var_pop(payload_len) FILTER (WHERE payload_len > 0) OVER hist AS pv FROM run0
  WINDOW life AS (PARTITION BY src_ip ORDER BY t_us, packet_id ROWS UNBOUNDED PRECEDING),
    hist AS (PARTITION BY src_ip ORDER BY t_us, packet_id ROWS BETWEEN {h} PRECEDING AND CURRENT ROW),
    gaps AS (PARTITION BY src_ip ORDER BY t_us, packet_id ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)),
runf AS (SELECT src_ip, packet_id, t_us, seq,
  seq / greatest((t_us - t0) / 1e6, 0.001) AS packets_per_second,
  CAST(bytes AS DOUBLE) / greatest((t_us - t0) / 1e6, 0.001) AS bytes_per_second,
  m AS avg_packet_size, v AS packet_size_variance, CAST(seq AS DOUBLE) AS total_packets, CAST(bytes AS DOUBLE) AS total_bytes,
  gm / 1e6 AS inter_arrival_mean, gs / 1e6 AS inter_arrival_std,
  len(list_filter(times, lambda x: x > t_us - 5000000)) / 5.0::DOUBLE AS burst_rate,
  (t_us - t0) / 1e6 AS session_duration, CAST(tcp AS DOUBLE) / seq AS tcp_ratio, CAST(udp AS DOUBLE) / seq AS udp_ratio,
  CAST(icmp AS DOUBLE) / seq AS icmp_ratio, CAST(ports AS DOUBLE) AS unique_ports,
  CASE WHEN np > 0 THEN CAST(unc AS DOUBLE) / np ELSE 0 END AS uncommon_port_ratio, coalesce(e, 0) AS payload_entropy,
  coalesce(pm, 0) AS avg_payload_size, coalesce(pv, 0) AS payload_size_variance FROM run1 WHERE seq >= 10)"""


ROUNDED = ", ".join(f"floor(CAST({c} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS {c}" for c in C.FEATURE_NAMES)
CAND_OUT = "packet_id, t_us, src_ip, rule, CAST(rule_seq AS INT) AS rule_seq, alert_type, CAST(dst_port AS INT) AS dst_port, description"
LINES = """
logl AS (SELECT packet_id, strftime(make_timestamp(ts_s * 1000000), '%Y-%m-%d %H:%M:%S') || ' - quietwire - INFO - ['
  || stored_type || '] ' || CASE WHEN rule = 'ml' THEN 'ML ANOMALY DETECTED: ' || ip_address || ' - ' || description
  ELSE description END AS line FROM al)"""
LOG_PARSED = f"""
SELECT CAST(epoch(CAST(regexp_extract(line, {quote(LOG_TIMESTAMP)}, 1) AS TIMESTAMP)) AS BIGINT) AS ts_s,
  CASE WHEN ml THEN regexp_extract(line, {quote(LOG_ML_ALERT)}, 1)
    WHEN regexp_matches(body, {quote(LOG_SOURCE)}) THEN regexp_extract(body, {quote(LOG_SOURCE)}, 1)
    WHEN regexp_matches(body, {quote(LOG_ANY_IP)}) THEN regexp_extract(body, {quote(LOG_ANY_IP)}, 1)
    ELSE 'unknown' END AS ip_address,
  CASE WHEN ml THEN CAST(regexp_extract(line, {quote(LOG_ML_ALERT)}, 2) AS DOUBLE) ELSE 0.0::DOUBLE END AS anomaly_score,
  CASE WHEN ml THEN 'ML' ELSE 'RULE' END AS alert_type,
  CASE WHEN ml THEN printf('ML-detected anomaly (score: %.3f)', CAST(regexp_extract(line, {quote(LOG_ML_ALERT)}, 2) AS DOUBLE))
    ELSE body END AS description
FROM (SELECT *, regexp_matches(line, {quote(LOG_ML_ALERT)}) AS ml, regexp_extract(line, {quote(LOG_RULE_ALERT)}, 1) AS body
  FROM logl WHERE regexp_matches(line, {quote(LOG_TIMESTAMP)})
  AND (regexp_matches(line, {quote(LOG_ML_ALERT)}) OR regexp_matches(line, {quote(LOG_RULE_ALERT)})))"""


def redact(text: str) -> str:
    out = text
    for word in C.SENSITIVE_WORDS:
        out = rf"regexp_replace({out}, '(?i){word}[=:]\s*\S+', '[REDACTED]', 'g')"
    return f"regexp_replace({out}, {quote(NOT_PRINTABLE)}, '?', 'g')"


WIDE_IPS = """
wip AS (SELECT l_orderkey, l_linenumber, concat(CAST(l_orderkey % 300 AS VARCHAR), '.', CAST(l_partkey % 256 AS VARCHAR), '.',
  CAST(l_suppkey % 256 AS VARCHAR), '.', CAST(l_linenumber AS VARCHAR)) AS ip FROM lineitem)"""


def rate_sql(interval: str) -> str:
    step = C.ALERT_INTERVALS_US[interval] // 1_000_000
    return q(
        f"""SELECT g AS bucket_s, CAST(coalesce(n, 0) AS BIGINT) AS alerts
FROM (SELECT unnest(range(lo, hi + {step}, {step})) AS g FROM (SELECT min(ts_s) // {step} * {step} AS lo,
  max(ts_s) // {step} * {step} AS hi FROM al_real)) LEFT JOIN
  (SELECT ts_s // {step} * {step} AS b, count(*) AS n FROM al_real GROUP BY 1) ON g = b"""
    )


def stats_sql(source: str, rule: str) -> str:
    return f"""SELECT count(*) AS total_alerts, count(*) FILTER (WHERE stored_type = 'ML') AS ml_alerts,
  count(*) FILTER (WHERE {rule}) AS rule_alerts, count(DISTINCT ip_address) AS unique_ips FROM {source}"""


HEAT = """
cells AS (SELECT isodow(make_timestamp(ts_s * 1000000)) - 1 AS d, hour(make_timestamp(ts_s * 1000000)) AS h, count(*) AS n
  FROM al_real GROUP BY 1, 2)"""
DAY_CASE = "CASE d " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(C.DAY_NAMES)) + " END"


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["packet_table"] = q("SELECT packet_id, t_us, src_ip, protocol, dst_port, size, CAST(coalesce(strlen(payload), 0) AS INT) AS payload_len FROM pk")
    out["valid_sources"] = q("SELECT packet_id, src_ip FROM val")
    out["valid_sources_training"] = q("SELECT packet_id, src_ip FROM pl WHERE ip_long IS NOT NULL")
    out["label_training_ips"] = q(
        f"""SELECT packet_id, CASE WHEN ok THEN src_ip ELSE 'invalid_ip_' || CAST(k - 1 AS VARCHAR) END AS label FROM (
  SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (ORDER BY packet_id ROWS UNBOUNDED PRECEDING)::BIGINT AS k FROM (
  SELECT *, ip_long IS NOT NULL AND NOT (ip_long BETWEEN 2130706432 AND 2147483647 OR ip_long BETWEEN 2851995648 AND 2852061183) AS ok FROM pl))"""
    )
    out["clean_features"] = """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 0.0 WHEN 2 THEN 1e6 WHEN 3 THEN -1e6
  WHEN 4 THEN 0.0 ELSE CAST(l_extendedprice AS DOUBLE) END AS value FROM lineitem"""
    for cap in (100, 10_000):
        name = "per_source_budget" if cap == 10_000 else f"per_source_budget_{cap}"
        out[name] = q(
            f"""SELECT packet_id, src_ip, CAST(row_number() OVER (PARTITION BY src_ip ORDER BY t_us, packet_id) AS BIGINT) AS seq
  FROM val QUALIFY seq <= {cap}"""
        )
    out["running_count"] = q(
        "SELECT packet_id, src_ip, CAST(row_number() OVER (PARTITION BY src_ip ORDER BY t_us, packet_id) AS BIGINT) AS seq FROM pk"
    )
    out["valid_port"] = q(f"SELECT packet_id, protocol, dst_port FROM pk WHERE {USABLE}")
    out["ml_ready"] = q("SELECT packet_id, src_ip, CAST(seq AS BIGINT) AS seq FROM bud WHERE seq >= 10")
    out["rolling_rate"] = q(
        "SELECT packet_id, src_ip, round(rate, 6) AS rate, round(avg_rate, 6) AS avg_rate FROM sig"
    )
    out["rate_spikes"] = q(
        "SELECT packet_id, src_ip, round(rate, 6) AS rate, round(avg_rate, 6) AS avg_rate FROM sig WHERE avg_rate > 0 AND rate > avg_rate * 1.5"
    )
    for rule in ("icmp_flood", "uncommon_port", "large_payload", "malicious_payload"):
        out[f"rule_{rule}"] = q(f"SELECT {CAND_OUT} FROM cand WHERE rule = '{rule}'")
    out["all_candidates"] = q(f"SELECT {CAND_OUT} FROM cand")
    out["stored_types"] = q(
        "SELECT alert_type, stored_type, count(*) AS alerts FROM al GROUP BY ALL"
    )
    out["limit_alerts"] = q(f"SELECT {CAND_OUT} FROM lim", limiter_ctes("cand", "lim"))
    out["limit_alerts_quiet_split"] = q(
        "SELECT packet_id, t_us, src_ip, rule FROM lim", limiter_ctes("gapped", "lim")
    ).replace(
        "\nlim_n AS",
        "\ngapped AS (SELECT * REPLACE (t_us + t_us // 120000000 * 600000000 AS t_us) FROM cand),\nlim_n AS",
        1,
    )
    out["detection_rules_only"] = q(
        """SELECT t_us // 1000000 AS ts_s, packet_id, src_ip AS ip_address, rule,
  CASE WHEN alert_type = 'RULE' THEN 'RULE' ELSE 'UNKNOWN' END AS stored_type, description, 0.0::DOUBLE AS anomaly_score FROM lim""",
        limiter_ctes("cand", "lim"),
    )
    ml_all = """
all_c AS (SELECT packet_id, t_us, src_ip, rule, rule_seq, alert_type, description, 0.0::DOUBLE AS score FROM cand
  UNION ALL SELECT packet_id, t_us, src_ip, 'ml', 0, 'ML', 'ML ANOMALY DETECTED: ' || src_ip || ' - ' || body, score FROM mlb)"""
    out["ml_alert_rows"] = q(
        """SELECT packet_id, t_us // 1000000 AS ts_s, src_ip AS ip_address, description, 0.0::DOUBLE AS anomaly_score
  FROM lim WHERE alert_type = 'ML'
UNION ALL SELECT packet_id, t_us // 1000000, src_ip, body, score FROM mlb""",
        ml_all,
        limiter_ctes("all_c", "lim"),
    )
    for name, history in (("snapshot_features", 1000), ("snapshot_features_h100", 100)):
        out[name] = q(f"SELECT src_ip, {ROUNDED} FROM feat", snapshot_sql(history, "val"))
    out["training_features"] = q(f"SELECT src_ip, {ROUNDED} FROM feat", snapshot_sql(1000, "pl"))
    out["flagship"] = out["training_features"]
    for name, history in (("running_features", 1000), ("running_features_h100", 100), ("running_features_parts", 50)):
        out[name] = q(f"SELECT src_ip, packet_id, CAST(seq AS BIGINT) AS seq, {ROUNDED} FROM runf", running_sql(history))
    out["traffic_summary"] = q("SELECT src_ip, count(*) AS packets FROM pk GROUP BY 1")
    out["tracked_sources"] = q("SELECT DISTINCT src_ip FROM pk")
    out["alert_stats"] = q(stats_sql("al", "stored_type <> 'ML'"))
    out["period_stats"] = q(
        stats_sql("al", "stored_type = 'RULE'").replace(
            " FROM al", ", round(avg(anomaly_score) FILTER (WHERE stored_type = 'ML'), 6) AS avg_score FROM al"
        )
    )
    out["load_alerts"] = q(
        f"""SELECT ts_s, packet_id, ip_address, rule FROM al WHERE ts_s >= (SELECT min(ts_s) + 120 FROM al)
  AND ts_s <= (SELECT min(ts_s) + 600 FROM al)"""
    )
    out["alerts_of_address"] = q(
        """SELECT ts_s, packet_id, rule, stored_type, CAST(anomaly_score AS DOUBLE) AS anomaly_score FROM al_real
  WHERE ip_address = '10.0.1.12'"""
    )
    out["recent_alerts"] = q(
        "SELECT ts_s, packet_id, ip_address, rule FROM al WHERE ts_s >= (SELECT max(ts_s) FROM al) - 300"
    )
    out["alerts_last_days"] = q(
        "SELECT ts_s, packet_id, ip_address, rule FROM al_real WHERE ts_s >= (SELECT max(ts_s) FROM al_real) - 7 * 86400"
    )
    out["search_alerts_all"] = q(
        """SELECT ts_s, packet_id, ip_address, stored_type, anomaly_score::DOUBLE AS anomaly_score FROM al
  WHERE regexp_matches(ip_address, '(?i)0.1.2') AND (stored_type = 'RULE' OR anomaly_score <= -0.2)"""
    )
    out["search_alerts_ml"] = q(
        "SELECT ts_s, packet_id, ip_address, stored_type, anomaly_score::DOUBLE AS anomaly_score FROM al WHERE stored_type = 'ML' AND anomaly_score <= -0.3"
    )
    out["search_alerts_rule"] = q(
        "SELECT ts_s, packet_id, ip_address, stored_type, anomaly_score::DOUBLE AS anomaly_score FROM al WHERE stored_type = 'RULE'"
    )
    out["ml_score_valid"] = "SELECT event_id, value AS score FROM events WHERE abs(value) <= 10"
    out["alert_view"] = q(
        f"""SELECT ts_s, ip_address, stored_type AS alert_type, CAST(anomaly_score AS DOUBLE) AS anomaly_score, description
  FROM al"""
    )
    out["score_timeline"] = q(
        """SELECT ts_s, CAST(anomaly_score AS DOUBLE) AS anomaly_score, ip_address, anomaly_score < -0.1 AS below_threshold
  FROM al WHERE stored_type = 'ML'"""
    )
    out["ml_score_stats"] = q(
        f"""SELECT round(coalesce(avg(anomaly_score), 0), 6) AS avg_score, CAST(coalesce(min(anomaly_score), 0) AS DOUBLE) AS min_score,
  CAST(coalesce(max(anomaly_score), 0) AS DOUBLE) AS max_score FROM al WHERE stored_type = 'ML'"""
    )
    for interval in C.ALERT_INTERVALS_US:
        out[f"alert_rate_{interval.lower()}"] = rate_sql(interval)
    out["score_histogram"] = q(
        """SELECT CAST(b AS INT) AS bin, count(anomaly_score) AS alerts, round(lo + b * ((hi - lo) / 30), 6) AS bin_start
  FROM (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM mls), range(30) t(b)
  LEFT JOIN mls ON least(floor((anomaly_score - lo) / ((hi - lo) / 30)), 29) = b GROUP BY b, lo, hi""",
        "mls AS (SELECT CAST(anomaly_score AS DOUBLE) AS anomaly_score FROM al WHERE stored_type = 'ML')",
    )
    for n in (5, 10, 15):
        out[f"top_ips_{n}"] = q(
            f"SELECT ip_address, count(*) AS alerts FROM al GROUP BY 1 ORDER BY alerts DESC, ip_address LIMIT {n}"
        )
    out["alert_type_distribution"] = q("SELECT stored_type AS alert_type, count(*) AS alerts FROM al GROUP BY 1")
    ports = r"CAST(nullif(regexp_extract(description, '(?i)port\s+(\d+)', 1), '') AS INT)"
    out["target_port"] = q(f"SELECT packet_id, rule, {ports} AS port FROM al")
    out["port_distribution"] = q(
        f"""SELECT port, count(*) AS alerts FROM (SELECT {ports} AS port FROM al) WHERE port IS NOT NULL
  GROUP BY 1 ORDER BY alerts DESC, port LIMIT 15"""
    )
    out["hour_counts"] = q(
        """SELECT CAST(g // 24 AS INT) AS day_no, CAST(g % 24 AS INT) AS hour, CAST(coalesce(n, 0) AS BIGINT) AS alerts
  FROM range(168) t(g) LEFT JOIN cells ON d = g // 24 AND h = g % 24""",
        HEAT,
    )
    out["hour_heatmap"] = q(
        f"SELECT {DAY_CASE} AS day_name, "
        + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE h = {h}), 0) AS BIGINT) AS h{h}" for h in range(24))
        + " FROM (SELECT unnest(range(7)) AS d) LEFT JOIN cells USING (d) GROUP BY d",
        HEAT,
    )
    out["calendar"] = q(
        "SELECT packet_id, CAST(hour(make_timestamp(t_us)) AS INT) AS hour, dayname(make_timestamp(t_us)) AS day_name FROM pk_real"
    )
    cat = f"(SELECT *, {category('ip_address')} AS category FROM (SELECT *, {ip_number('ip_address')} AS n FROM al))"
    out["ip_category_distribution"] = q(f"SELECT category, count(*) AS alerts FROM {cat} GROUP BY 1")
    out["enrich_known_ips"] = q(
        f"SELECT packet_id, rule, ip_address, CASE ip_address WHEN '8.8.8.8' THEN 'Google DNS (Primary)' END AS entity, category FROM {cat}"
    )
    out["known_only"] = q("SELECT packet_id, rule, ip_address FROM al WHERE ip_address = '8.8.8.8'")
    out["known_ips_table"] = q(
        f"""SELECT ip_address, category AS entity, count(*) AS alerts FROM {cat}
  WHERE category NOT IN ({", ".join(map(quote, C.GENERIC_CATEGORIES))}) GROUP BY 1, 2"""
    )
    out["outside_networks"] = (
        "WITH"
        + WIDE_IPS
        + f""", nets(lo, hi) AS (VALUES (167772160, 184549375), (3232235520, 3232301055), (134744064, 134744319), (0, 16777215))
SELECT l_orderkey, l_linenumber, ip FROM (SELECT *, {ip_number('ip')} AS n FROM wip) w
WHERE n IS NULL OR NOT EXISTS (SELECT 1 FROM nets WHERE w.n BETWEEN lo AND hi)"""
    )
    out["longest_networks"] = """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 4 AS kind, l_partkey % 512 AS g3,
  '2001:DB8:' || hex(l_partkey % 512) || '::' || hex(l_suppkey) || ':' || hex(l_orderkey % 65536) AS six FROM lineitem),
n AS (SELECT l_orderkey, l_linenumber, CASE kind WHEN 0 THEN concat('10.', l_partkey % 256, '.', l_suppkey % 256, '.', l_linenumber)
    WHEN 1 THEN six || ':::' ELSE six END AS ip,
  CASE WHEN kind = 1 THEN NULL WHEN kind = 0 THEN CASE WHEN l_partkey % 256 = 17 THEN '10.17.0.0/16'
      WHEN l_partkey % 256 BETWEEN 16 AND 31 THEN '10.16.0.0/12' END
    WHEN g3 = 511 AND l_suppkey = 1 THEN '2001:db8:1ff::1:0/112' WHEN g3 BETWEEN 272 AND 287 THEN '2001:db8:110::/44'
    WHEN g3 BETWEEN 256 AND 511 THEN '2001:db8:100::/40' WHEN g3 BETWEEN 16 AND 31 THEN '2001:db8:10::/44'
    WHEN g3 = 0 AND l_suppkey BETWEEN 64 AND 127 THEN '2001:db8::40:0/106' END AS network FROM t)
SELECT *, network IS NULL AS outside FROM n"""
    out["ip_functions"] = (
        "WITH"
        + WIDE_IPS
        + f"""SELECT l_orderkey, l_linenumber, ip, n AS ip_long, n IS NOT NULL AS is_ipv4,
  CASE WHEN n IS NULL THEN '<invalid_ip>' ELSE ip END AS safe, {category('ip')} AS category
  FROM (SELECT *, {ip_number('ip')} AS n FROM wip)"""
    )
    out["ipv6_functions"] = """
WITH t AS (SELECT l_orderkey, l_linenumber, l_orderkey % 10 <> 0 AS ok, CASE l_linenumber WHEN 1 THEN '::1'
  WHEN 2 THEN 'fe80::' || hex(l_partkey) WHEN 3 THEN '2001:db8::' || hex(l_partkey) || ':1' WHEN 4 THEN 'FF02::' || hex(l_partkey)
  WHEN 5 THEN '2606:4700:0:0:0:0:0:' || hex(l_partkey) WHEN 6 THEN '::ffff:10.0.0.' || CAST(l_partkey % 256 AS VARCHAR)
  ELSE '4000::' || hex(l_partkey) END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN x ELSE x || ':::' END AS ip, ok AS is_ipv6,
  CASE WHEN ok THEN x ELSE '<invalid_ip>' END AS safe,
  CASE WHEN NOT ok THEN 'Unknown/Invalid' WHEN l_linenumber = 1 THEN 'Localhost (Loopback)' WHEN l_linenumber IN (2, 3, 6) THEN 'Local Network (Private)'
    WHEN l_linenumber = 4 THEN 'Multicast' WHEN l_linenumber = 5 THEN 'Public Internet' ELSE 'Reserved' END AS category,
  ok AND l_linenumber NOT IN (1, 2) AS usable FROM t"""
    out["byte_entropy_packets"] = q("SELECT packet_id, round(entropy, 6) AS entropy FROM des")
    out["byte_entropy_documents"] = (
        f"WITH e AS ({byte_entropy('documents', 'doc_id', 'text')}) "
        "SELECT doc_id, round(coalesce(entropy, 0), 6) AS entropy FROM documents LEFT JOIN e USING (doc_id)"
    )
    out["payload_stats"] = (
        f"WITH small AS (SELECT * FROM documents WHERE strlen(text) > 0), e AS ({byte_entropy('small', 'doc_id', 'text')}) "
        """SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, CAST(length(regexp_replace(text, '[^ -~]', '', 'g')) AS BIGINT) AS printable_chars,
  CAST(0 AS BIGINT) AS null_bytes, round(entropy, 6) AS entropy,
  round(CAST(length(regexp_replace(text, '[^ -~]', '', 'g')) AS DOUBLE) / strlen(text), 6) AS printable_ratio
  FROM small JOIN e USING (doc_id)"""
    )
    out["malicious_pattern_packets"] = q("SELECT packet_id, pattern FROM des")
    texts = """SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'p', page_id, html FROM pages
  UNION ALL SELECT 'b', item_id, text FROM benchmark UNION ALL SELECT 'c', conv_id * 1000 + turn, text FROM conversations"""
    out["malicious_pattern_texts"] = (
        f"SELECT kind, id, {first_pattern('text')} AS pattern FROM ({texts})"
    )
    out["printable_only"] = (
        f"SELECT kind, id, regexp_replace(text, {quote(NOT_PRINTABLE)}, '?', 'g') AS shown FROM ({texts})"
    )
    out["redact"] = f"SELECT kind, id, {redact('text')} AS safe FROM ({texts})"
    out["redact_alerts"] = q(f"SELECT packet_id, rule, {redact('description')} AS safe FROM al")
    out["alert_log"] = q(LOG_PARSED, LINES)
    out["export_alerts_csv"] = q(
        "SELECT ts_s, packet_id, ip_address, stored_type, description, CAST(anomaly_score AS DOUBLE) AS anomaly_score FROM al"
    )
    out["feature_scaler"] = q(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END, 6) AS scale FROM feat"
            for c in C.FEATURE_NAMES
        ),
        snapshot_sql(1000, "val"),
    )
    out["feature_correlation"] = q(
        " UNION ALL ".join(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) END AS r FROM feat"
            for a in C.FEATURE_NAMES
            for b in C.FEATURE_NAMES
        ),
        snapshot_sql(1000, "val"),
    )
    # Daily partials add up to what the whole table gives.
    out["daily_stats"] = q(stats_sql("al_real", "stored_type <> 'ML'"))
    out["daily_top_ips"] = q(
        "SELECT ip_address, count(*) AS alerts FROM al_real GROUP BY 1 ORDER BY alerts DESC, ip_address LIMIT 10"
    )
    out["daily_types"] = q("SELECT stored_type AS alert_type, count(*) AS alerts FROM al_real GROUP BY 1")
    out["daily_ports"] = out["port_distribution"].replace("FROM al)", "FROM al_real)")
    out["daily_hours"] = out["hour_counts"]
    out["report_summary"] = q(
        stats_sql("al_real", "stored_type = 'RULE'") + " WHERE ts_s >= (SELECT max(ts_s) FROM al_real) - 86400 * 7"
    )
    out["report_top_ips"] = q(
        """SELECT ip_address, count(*) AS alerts FROM al_real WHERE ts_s >= (SELECT max(ts_s) FROM al_real) - 86400 * 7
  GROUP BY 1 ORDER BY alerts DESC, ip_address LIMIT 5"""
    )
    out["features_json"] = out["training_features"]
    out["training_csv"] = q(
        f"""SELECT row_number() OVER (ORDER BY src_ip) - 1 AS row, CASE WHEN ok THEN src_ip ELSE
  'invalid_ip_' || CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (ORDER BY src_ip ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) END AS label,
  {ROUNDED} FROM (SELECT *, src_ip NOT IN ('127.0.0.1', '169.254.3.3') AS ok FROM feat)""",
        snapshot_sql(1000, "pl"),
    )
    for name in ("contamination_offset", "contamination_offset_narrowed"):
        out[name] = q("SELECT round(quantile_cont(CAST(score AS DOUBLE), 0.01), 6) AS score_offset FROM mlc")
    out["score_summary"] = q(
        """SELECT count(*) AS n_samples, CAST(18 AS INT) AS n_features, count(*) FILTER (WHERE score < -0.3) AS n_anomalies,
  round(CAST(count(*) FILTER (WHERE score < -0.3) AS DOUBLE) / count(*), 6) AS anomaly_rate, round(avg(score), 6) AS score_mean,
  round(stddev_pop(score), 6) AS score_std, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max FROM mlc"""
    )
    matrix = (running_sql(100), forest_ctes("runf", "packet_id"))
    out["forest_sample"] = q("SELECT tree, k AS packet_id FROM fs", *matrix)
    out["forest_trees"] = q("SELECT * REPLACE (round(threshold, 6) AS threshold) FROM ft", *matrix)
    out["forest_scores"] = q(
        """SELECT src_ip, packet_id, round(score, 6) AS anomaly_score, CAST(CASE WHEN score < cut THEN -1 ELSE 1 END AS INT) AS prediction
  FROM fv JOIN runf ON packet_id = k, fo""",
        *matrix,
        score_ctes("runf", "packet_id"),
        offset_cte(),
    )
    sources = (snapshot_sql(1000, "pl"), forest_ctes("feat", "src_ip"))
    own = (*sources, score_ctes("feat", "src_ip"))
    out["training_stats"] = q(stats_select(), *own, offset_cte(contamination=0.1))
    out["stored_model"] = q(stats_select(features=False), *own, offset_cte())
    out["csv_training"] = q(
        stats_select(),
        snapshot_sql(1000, "pl"),
        "\ncsvf AS (SELECT *, row_number() OVER (ORDER BY src_ip) - 1 AS line FROM feat)",
        forest_ctes("csvf", "line"),
        score_ctes("csvf", "line"),
        offset_cte(contamination=0.1),
    )
    names = ",".join(C.FEATURE_NAMES)
    out["model_info"] = q(
        f"""SELECT CAST(v AS INT) AS version, v = 10 AS latest, CAST(18 AS INT) AS n_features, 0.1::DOUBLE AS contamination,
  CAST(100 AS INT) AS n_estimators, CAST(42 AS BIGINT) AS random_state, CAST(size AS INT) AS max_samples, round(cut, 6) AS score_offset,
  '{names}' AS feature_names FROM (VALUES (1), (9), (10)) t(v), fdim, fo""",
        *own,
        offset_cte(contamination=0.1),
    )
    scored = (*sources, running_sql(1000), score_ctes("runf", "packet_id"))
    out["detection_with_model"] = q(
        """SELECT t_us // 1000000 AS ts_s, packet_id, src_ip AS ip_address, rule,
  CASE WHEN alert_type IN ('RULE', 'ML') THEN alert_type ELSE 'UNKNOWN' END AS stored_type, 0.0::DOUBLE AS anomaly_score FROM lim
UNION ALL SELECT t_us // 1000000, packet_id, src_ip, 'ml', 'ML', round(score, 6) FROM fv JOIN runf ON packet_id = k""",
        *scored,
        """
all_m AS (SELECT packet_id, t_us, src_ip, rule, rule_seq, alert_type FROM cand
  UNION ALL SELECT packet_id, t_us, src_ip, 'ml', 0, 'ML' FROM runf)""",
        limiter_ctes("all_m", "lim"),
    )
    # Streams must give what the batch gives.
    out["stream_detection"] = out["detection_with_model"]
    out["stream_sessions"] = q(
        """SELECT packet_id, src_ip, CAST(n AS BIGINT) AS seq, round(rate, 6) AS rate, round(CASE WHEN rate IS NOT NULL THEN
  avg(rate) OVER (PARTITION BY src_ip, session ORDER BY t_us, packet_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END, 6) AS avg_rate,
  round(n / greatest((t_us - began) / 1e6, 0.001), 6) AS packets_per_second FROM ses2""",
        """
ses0 AS (SELECT *, sum(CASE WHEN gap > 3000000 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY t_us, packet_id) AS session
  FROM (SELECT packet_id, src_ip, t_us, t_us - lag(t_us) OVER (PARTITION BY src_ip ORDER BY t_us, packet_id) AS gap FROM bud)),
ses1 AS (SELECT *, row_number() OVER (PARTITION BY src_ip, session ORDER BY t_us, packet_id) AS n,
  min(t_us) OVER (PARTITION BY src_ip, session) AS began FROM ses0),
ses2 AS (SELECT *, CASE WHEN t_us > t0 THEN CAST(n AS DOUBLE) / (CAST(t_us - t0 AS DOUBLE) / 1e6) END AS rate
  FROM ses1, (SELECT min(t_us) AS t0 FROM pk))""",
    )
    out["stream_ml_alerts"] = q(
        "SELECT packet_id, src_ip, CAST(seq AS BIGINT) AS seq, round(score, 6) AS score FROM fv JOIN runf ON packet_id = k", *scored
    )
    out["stream_rules"] = q(f"SELECT {CAND_OUT} FROM cand WHERE rule IN ('uncommon_port', 'large_payload', 'malicious_payload')")
    out["stream_alert_sink"] = q(
        """SELECT t_us // 1000000 AS ts_s, packet_id, src_ip AS ip_address, rule, 'RULE' AS stored_type FROM cand
  WHERE rule IN ('uncommon_port', 'large_payload', 'malicious_payload')"""
    )
    out["stream_rates"] = q(
        """SELECT packet_id, src_ip, 'icmp_flood' AS rule FROM sig WHERE protocol = 'ICMP' AND seq > 50
  UNION ALL SELECT packet_id, src_ip, 'spike' FROM sig WHERE avg_rate > 0 AND rate > avg_rate * 1.5"""
    )
    out["stream_limiter"] = q("SELECT packet_id, t_us, src_ip, rule FROM lim", limiter_ctes("lim_in", "lim")).replace(
        "\nlim_n AS", "\nlim_in AS (SELECT * FROM cand WHERE rule IN ('uncommon_port', 'large_payload', 'malicious_payload')),\nlim_n AS", 1
    )
    out["stream_traffic_rounds"] = q(
        "SELECT t_us // 60000000 * 60 AS round_s, src_ip, count(*) AS packets FROM pk GROUP BY 1, 2"
    )
    out["stream_traffic_totals"] = q("SELECT src_ip, count(*) AS packets FROM pk GROUP BY 1")
    out["stream_features"] = q(
        f"SELECT src_ip, packet_id, CAST(seq AS BIGINT) AS seq, {ROUNDED} FROM runf", running_sql(1000)
    )
    return out
