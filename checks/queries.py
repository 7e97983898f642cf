"""The registered queries: every operator over the given tables, flat columns out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quietwire import config as C
from quietwire.config import DetectorConfig, ForestConfig
from quietwire.functions import ip as ipf, payload as pay, text as txt
from quietwire.operators import analytics as an, features as feat, filters as flt, forest as fo
from quietwire.operators import limiter as lim, lookups as look, ordering as order, rules as R
from quietwire.plans import detection, report, training
from quietwire.scratch import new_folder, pin
from quietwire.sources import alert_days, alert_log, alerts as store, models, packets as psrc, training_csv
from checks.event_packets import as_packets, packets_from_events
from quietwire.streaming import detection as st, job

Query = Callable[[SparkSession, str], DataFrame]
LOOSE = DetectorConfig(spike_multiplier=1.5)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _rounded(df: DataFrame, *first: str) -> DataFrame:
    """Six decimals by plain arithmetic: engines differ in how round() treats decimal ties."""
    six = lambda c: (F.floor(F.col(c) * 1e6 + 0.5).cast("double") / 1e6).alias(c)
    return df.select(*first, *[six(c) for c in C.FEATURE_NAMES])


def _signals(spark: SparkSession, folder: str, compress: bool = True) -> DataFrame:
    return R.packet_signals(packets_from_events(spark, folder, compress))


def _candidates(spark: SparkSession, folder: str, compress: bool = True) -> DataFrame:
    return R.rule_candidates(_signals(spark, folder, compress))


def _gapped(candidates: DataFrame) -> DataFrame:
    """Two busy minutes, ten quiet ones, and so on."""
    quiet = F.floor(F.col("t_us") / 120_000_000) * 600_000_000
    return candidates.withColumn("t_us", (F.col("t_us") + quiet).cast("bigint"))


def _show_candidates(candidates: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    subject, body = R.alert_text(R.packet_rules(cfg))
    return candidates.select(
        "packet_id",
        "t_us",
        "src_ip",
        "rule",
        "rule_seq",
        "alert_type",
        "dst_port",
        F.concat(subject, F.lit(" - "), body).alias("description"),
    )


def _stand_in_scores(packets: DataFrame) -> DataFrame:
    """Model alerts with a score computed from the packet size, so that SQL can repeat them."""
    size = F.col("size").cast("double")
    null = lambda kind: F.lit(None).cast(kind)
    return flt.ml_ready(R.analysed_packets(packets)).select(
        "packet_id",
        "t_us",
        "src_ip",
        F.lit("ml").alias("rule"),
        F.lit(0).alias("rule_seq"),
        F.lit("ML").alias("alert_type"),
        F.col("seq").cast("bigint").alias("seq"),
        null("int").alias("dst_port"),
        null("double").alias("rate"),
        null("double").alias("avg_rate"),
        null("int").alias("payload_len"),
        null("string").alias("pattern"),
        (-F.round(size / (size + 300), 3)).alias("score"),
        null("string").alias("raw_data"),
    )


def _alerts(spark: SparkSession, folder: str, compress: bool = True) -> DataFrame:
    packets = packets_from_events(spark, folder, compress)
    rules = R.alert_rows(R.rule_candidates(R.packet_signals(packets)))
    return rules.unionByName(R.ml_direct_rows(_stand_in_scores(packets)))


def _seconds(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn("ts_s", F.unix_seconds(column)).drop(column)


def _wide_ips(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda c, n: (F.col(c) % n).cast("string")
    return _table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.concat_ws(
            ".",
            part("l_orderkey", 300),
            part("l_partkey", 256),
            part("l_suppkey", 256),
            F.col("l_linenumber").cast("string"),
        ).alias("ip"),
    )


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    pick = lambda name, kind, key, text: _table(spark, folder, name).select(
        F.lit(kind).alias("kind"), key.alias("id"), F.col(text).alias("text")
    )
    return reduce(
        DataFrame.unionByName,
        [
            pick("documents", "d", F.col("doc_id"), "text"),
            pick("pages", "p", F.col("page_id"), "html"),
            pick("benchmark", "b", F.col("item_id"), "text"),
            pick("conversations", "c", F.col("conv_id") * 1000 + F.col("turn"), "text"),
        ],
    )


def _training(spark: SparkSession, folder: str) -> DataFrame:
    return training.training_features(packets_from_events(spark, folder))


def _detect_features(spark: SparkSession, folder: str, history: int = 1000) -> DataFrame:
    return feat.snapshot_features(flt.valid_sources(packets_from_events(spark, folder)), history=history)


# -- sources -----------------------------------------------------------------------------------


def packet_table(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "packets")
    packets_from_events(spark, folder).write.parquet(path)
    return psrc.read_packets(spark, path).select(
        "packet_id",
        "t_us",
        "src_ip",
        "protocol",
        "dst_port",
        "size",
        pay.payload_length(F.col("payload")).alias("payload_len"),
    )


def alert_store(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "alerts")
    store.append_alerts(_alerts(spark, folder), path)
    alerts = store.alert_table(spark, path)
    start = alerts.agg(F.min("ts") + F.expr("INTERVAL 120 SECOND")).first()[0]
    end = alerts.agg(F.min("ts") + F.expr("INTERVAL 600 SECOND")).first()[0]
    newest = store.load_alerts(spark, path, start, end)
    return _seconds(newest.select("ts", "packet_id", "ip_address", "rule"))


def alerts_of_address(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "alerts")
    store.append_alerts(_alerts(spark, folder, False), path)
    found = store.alerts_of(spark, path, "10.0.1.12")
    return _seconds(found.select("ts", "packet_id", "rule", "stored_type", "anomaly_score"))


def of_days(table: str, summary: Callable[[DataFrame], DataFrame]) -> Query:
    """A summary over daily partials that were made in two goes: the older half of the alerts, then all."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        path, days = new_folder(spark, "alerts"), new_folder(spark, "days")
        alerts = pin(_alerts(spark, folder, False), "alerts")
        middle = alerts.agg(F.percentile_approx(F.unix_seconds("ts"), 0.5)).first()[0]
        for half in (F.unix_seconds("ts") <= middle, F.unix_seconds("ts") > middle):
            store.append_alerts(alerts.where(half), path)
            alert_days.refresh_days(spark, path, days)
        return summary(getattr(alert_days, table)(spark, days))

    return run


def alert_log_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "log")
    subject = F.when(
        F.col("rule") == "ml", F.concat(F.lit("ML ANOMALY DETECTED: "), F.col("ip_address"), F.lit(" - "))
    ).otherwise(F.lit(""))
    alert_log.write_alert_log(
        _alerts(spark, folder).withColumn("description", F.concat(subject, F.col("description"))), path
    )
    parsed = alert_log.read_alert_log(spark, path, last=None)
    return _seconds(parsed.withColumnRenamed("stored_type", "alert_type"))


def export_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "export")
    columns = ["ts", "packet_id", "ip_address", "stored_type", "description", "anomaly_score"]
    store.export_alerts_csv(_alerts(spark, folder).select(*columns), path)
    schema = "ts timestamp, packet_id bigint, ip_address string, stored_type string, description string, anomaly_score double"
    return _seconds(spark.read.schema(schema).option("header", True).option("escape", '"').csv(path))


def training_csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "training") + ".csv"
    # One file in address order, so that the numbers of unusable addresses are known.
    training_csv.write_training_csv(_training(spark, folder).orderBy("src_ip").coalesce(1), path)
    return _rounded(training_csv.read_training_csv(spark, path), "row", "label")


# -- filters -----------------------------------------------------------------------------------


def clean_features(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("l_linenumber")
    rows = _table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(number == 1, F.lit(float("nan")))
        .when(number == 2, F.lit(float("inf")))
        .when(number == 3, F.lit(float("-inf")))
        .when(number != 4, F.col("l_extendedprice").cast("double"))
        .alias("value"),
    )
    return flt.clean_features(rows, ["value"])


def search(ip: str, kind: str, score: float) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = flt.search_alerts(_alerts(spark, folder), ip, kind, score)
        return _seconds(found.select("ts", "packet_id", "ip_address", "stored_type", "anomaly_score"))

    return run


def budget(cap: int) -> Query:
    return lambda spark, folder: flt.per_source_budget(
        flt.valid_sources(packets_from_events(spark, folder)), cap
    ).select("packet_id", "src_ip", F.col("seq").cast("bigint").alias("seq"))


# -- rules and detection -------------------------------------------------------------------------


def payload_rule(name: str) -> Query:
    return lambda spark, folder: _show_candidates(
        R.one_rule(R.payload_signals(packets_from_events(spark, folder)), name)
    )


def rule(name: str) -> Query:
    return lambda spark, folder: _show_candidates(R.one_rule(_signals(spark, folder), name))


def rate_spikes(spark: SparkSession, folder: str) -> DataFrame:
    spikes = R.rate_spikes(_signals(spark, folder), LOOSE)
    return spikes.select(
        "packet_id", "src_ip", F.round("rate", 6).alias("rate"), F.round("avg_rate", 6).alias("avg_rate")
    )


def rolling_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _signals(spark, folder).select(
        "packet_id", "src_ip", F.round("rate", 6).alias("rate"), F.round("avg_rate", 6).alias("avg_rate")
    )


def ml_alert_rows(spark: SparkSession, folder: str) -> DataFrame:
    packets = packets_from_events(spark, folder)
    ml = _stand_in_scores(packets)
    both = R.all_candidates(R.rule_candidates(R.packet_signals(packets)), ml)
    limited = R.alert_rows(lim.limit_alerts(both)).where("rule = 'ml'")
    rows = limited.unionByName(R.ml_direct_rows(ml))
    return _seconds(rows.select("packet_id", "ts", "ip_address", "description", "anomaly_score"))


def detection_rules_only(spark: SparkSession, folder: str) -> DataFrame:
    alerts = detection.detect(packets_from_events(spark, folder))
    return _seconds(
        alerts.select("ts", "packet_id", "ip_address", "rule", "stored_type", "description", "anomaly_score")
    )


def detection_with_model(spark: SparkSession, folder: str) -> DataFrame:
    packets = packets_from_events(spark, folder)
    forest = training.train(training.training_features(packets)).forest
    alerts = detection.detect(packets, forest)
    score = F.round("anomaly_score", 6).alias("anomaly_score")
    return _seconds(alerts.select("ts", "packet_id", "ip_address", "rule", "stored_type", score))


# -- features ------------------------------------------------------------------------------------


def running(history: int, part_rows: int | None = 100_000) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        packets = packets_from_events(spark, folder)
        out = feat.running_features(R.analysed_packets(packets), history, part_rows=part_rows)
        return _rounded(out, "src_ip", "packet_id", "seq")

    return run


def features_json(spark: SparkSession, folder: str) -> DataFrame:
    features = _training(spark, folder)
    back = features.select("src_ip", txt.features_json().alias("raw")).select(
        "src_ip", txt.features_from_json(F.col("raw")).alias("f")
    )
    named = back.select("src_ip", *[F.col("f")[i].alias(n) for i, n in enumerate(C.FEATURE_NAMES)])
    return _rounded(named, "src_ip")


# -- model -----------------------------------------------------------------------------------------


def feature_scaler(spark: SparkSession, folder: str) -> DataFrame:
    return fo.scaler_table(_detect_features(spark, folder)).select(
        "feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale")
    )


def feature_correlation(spark: SparkSession, folder: str) -> DataFrame:
    features = pin(_detect_features(spark, folder), "features")
    return fo.feature_correlation(features).withColumn("r", F.round("r", 6))


def _score_table(spark: SparkSession, folder: str) -> DataFrame:
    score = F.col("score").alias("anomaly_score")
    return _stand_in_scores(packets_from_events(spark, folder)).select("packet_id", score)


def contamination_offset(spark: SparkSession, folder: str) -> DataFrame:
    offset = fo.exact_quantile(_score_table(spark, folder), "anomaly_score", 0.01)
    return spark.createDataFrame([(round(offset, 6),)], "score_offset double")


def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("anomaly_score") < -0.3, -1).otherwise(1)
    stats = fo.training_stats(_score_table(spark, folder).withColumn("prediction", label))
    six = lambda c: F.round(c, 6).alias(c)
    return stats.select(
        "n_samples",
        "n_features",
        "n_anomalies",
        *[six(c) for c in ("anomaly_rate", "score_mean", "score_std", "score_min", "score_max")],
    )


def _event_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The features of every packet as the training matrix: one row per packet, key packet_id."""
    return feat.running_features(R.analysed_packets(packets_from_events(spark, folder)), 100)


def forest_sample(spark: SparkSession, folder: str) -> DataFrame:
    features = _event_matrix(spark, folder)
    return fo.sample_for_trees(features, features.count(), key="packet_id").select("tree", "packet_id")


def forest_trees(spark: SparkSession, folder: str) -> DataFrame:
    features = _event_matrix(spark, folder)
    scaler = fo.fit_scaler(features)
    trees = fo.fit_trees(fo.scale(features, scaler), scaler.n_rows, key="packet_id")
    return trees.withColumn("threshold", F.round("threshold", 6))


def forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    trained = training.train(_event_matrix(spark, folder), key="packet_id")
    return trained.scored.select("src_ip", "packet_id", F.round("anomaly_score", 6).alias("anomaly_score"), "prediction")


def _six(stats: DataFrame) -> DataFrame:
    return stats.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in stats.dtypes])


def training_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _six(training.train(_training(spark, folder), ForestConfig(contamination=0.1)).stats)


def stored_model(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "models")
    trained = training.train_and_save(packets_from_events(spark, folder), path, 1)
    models.save_forest(trained.forest, path, 2)
    loaded = models.load_forest(spark, path)
    return _six(fo.validate_model(loaded, _training(spark, folder)))


def csv_training(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "training") + ".csv"
    training_csv.write_training_csv(_training(spark, folder).orderBy("src_ip").coalesce(1), path)
    return _six(training.train_from_csv(spark, path, new_folder(spark, "models"), 1, ForestConfig(contamination=0.1)).stats)


def model_info(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "models")
    forest = training.train(_training(spark, folder), ForestConfig(contamination=0.1)).forest
    for version in (1, 10, 9):
        models.save_forest(forest, path, version)
    return models.model_info(spark, path).select(
        "version",
        (F.col("version") == models.latest_version(spark, path)).alias("latest"),
        "n_features",
        "contamination",
        "n_estimators",
        "random_state",
        "max_samples",
        F.round("score_offset", 6).alias("score_offset"),
        F.array_join("feature_names", ",").alias("feature_names"),
    )


def pca_2d(spark: SparkSession, folder: str) -> DataFrame:
    return fo.pca_2d(training.train(_training(spark, folder), ForestConfig(contamination=0.1)).scored)


# -- functions -----------------------------------------------------------------------------------


def ip_functions(spark: SparkSession, folder: str) -> DataFrame:
    ip = F.col("ip")
    return _wide_ips(spark, folder).select(
        "l_orderkey",
        "l_linenumber",
        "ip",
        ipf.ip_to_long(ip).alias("ip_long"),
        ipf.is_ipv4(ip).alias("is_ipv4"),
        ipf.safe_ip(ip).alias("safe"),
        ipf.ip_category(ip).alias("category"),
    )


def ipv6_functions(spark: SparkSession, folder: str) -> DataFrame:
    """IPv6 texts of every kind, made from the line items; each tenth order has broken ones."""
    h, n = F.hex("l_partkey"), F.col("l_linenumber")
    text = (
        F.when(n == 1, F.lit("::1"))
        .when(n == 2, F.concat(F.lit("fe80::"), h))
        .when(n == 3, F.concat(F.lit("2001:db8::"), h, F.lit(":1")))
        .when(n == 4, F.concat(F.lit("FF02::"), h))
        .when(n == 5, F.concat(F.lit("2606:4700:0:0:0:0:0:"), h))
        .when(n == 6, F.concat(F.lit("::ffff:10.0.0."), (F.col("l_partkey") % 256).cast("string")))
        .otherwise(F.concat(F.lit("4000::"), h))
    )
    ip = F.when(F.col("l_orderkey") % 10 == 0, F.concat(text, F.lit(":::"))).otherwise(text)
    rows = _table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", ip.alias("ip"))
    return rows.select(
        "*",
        ipf.is_ipv6(F.col("ip")).alias("is_ipv6"),
        ipf.safe_ip(F.col("ip")).alias("safe"),
        ipf.ip_category(F.col("ip")).alias("category"),
        flt.usable_label(F.col("ip")).alias("usable"),
    )


def outside_networks(spark: SparkSession, folder: str) -> DataFrame:
    nets = ["10.0.0.0/8", "192.168.0.0/16", "8.8.8.0/24", "0.0.0.0/8", "10.0.0.1/8", "no network"]
    subnets = spark.createDataFrame([(n,) for n in nets], "cidr string")
    return look.outside_networks(_wide_ips(spark, folder), subnets, "ip")


NETWORKS = (
    "2001:db8:10::/44",
    "2001:db8:100::/40",
    "2001:db8:110::/44",
    "2001:db8:1ff::1:0/112",
    "2001:db8::40:0/106",
    "2001:db8::1/32",  # host bits
    "10.16.0.0/12",
    "10.17.0.0/16",
    "no network",
)


def longest_networks(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of both families, made from the line items, in a table of networks."""
    third, seventh = F.hex(F.col("l_partkey") % 512), F.hex("l_suppkey")
    six = F.concat(F.lit("2001:DB8:"), third, F.lit("::"), seventh, F.lit(":"), F.hex(F.col("l_orderkey") % 65536))
    four = F.concat_ws(
        ".", F.lit("10"), *[(F.col(c) % 256).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")]
    )
    kind = F.col("l_linenumber") % 4
    ip = F.when(kind == 0, four).when(kind == 1, F.concat(six, F.lit(":::"))).otherwise(six)
    rows = _table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", ip.alias("ip"))
    networks = spark.createDataFrame([(n,) for n in NETWORKS], "cidr string")
    outside = look.outside_networks(rows, networks, "ip").select("ip", F.lit(True).alias("outside")).distinct()
    return look.longest_networks(rows, networks, "ip").join(outside, "ip", "left").select(
        "l_orderkey", "l_linenumber", "ip", "network", F.coalesce("outside", F.lit(False)).alias("outside")
    )


def payload_stats(spark: SparkSession, folder: str) -> DataFrame:
    body = F.encode("text", "UTF-8")
    return (
        _table(spark, folder, "documents")
        .select("doc_id", pay.payload_stats(body).alias("s"))
        .where("s IS NOT NULL")
        .select(
            "doc_id",
            "s.size",
            "s.printable_chars",
            "s.null_bytes",
            F.round("s.entropy", 6).alias("entropy"),
            F.round("s.printable_ratio", 6).alias("printable_ratio"),
        )
    )


# -- streams ---------------------------------------------------------------------------------------


def _packet_stream(spark: SparkSession, folder: str) -> DataFrame:
    events = _table(spark, folder, "events")
    stream = (
        spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    )
    return as_packets(stream).withColumn("ts", F.timestamp_micros("t_us"))


def _drain(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = new_folder(spark, name)
    st.write_stream(rows, path, new_folder(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def _drain_updates(
    spark: SparkSession, rows: DataFrame, name: str, keys: list[str], values: list[str]
) -> DataFrame:
    path = new_folder(spark, name)
    st.write_updates(rows, path, new_folder(spark, f"{name}-checkpoint")).awaitTermination()
    return st.latest_updates(spark, path, keys, values)


def _start_us(spark: SparkSession, folder: str) -> int:
    return packets_from_events(spark, folder).agg(F.min("t_us")).first()[0]


def stream_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _show_candidates(_drain(spark, st.stateless_candidates(_packet_stream(spark, folder)), "rules"))


def stream_rates(spark: SparkSession, folder: str) -> DataFrame:
    found = st.detection_candidates(_packet_stream(spark, folder), _start_us(spark, folder), LOOSE)
    rows = _drain(spark, found, "rates")
    return rows.where("rule IN ('icmp_flood', 'spike')").select("packet_id", "src_ip", "rule")


def stream_limiter(spark: SparkSession, folder: str) -> DataFrame:
    candidates = _drain(spark, st.stateless_candidates(_packet_stream(spark, folder)), "candidates")
    path = candidates.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(candidates.schema).parquet(path)
    return _drain(spark, st.limited_alerts(stream), "limited").select("packet_id", "t_us", "src_ip", "rule")


def stream_features(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(
        _drain(spark, st.running_features(_packet_stream(spark, folder)), "features"),
        "src_ip",
        "packet_id",
        "seq",
    )


def stream_ml_alerts(spark: SparkSession, folder: str) -> DataFrame:
    forest = training.train(_training(spark, folder)).forest
    path = new_folder(spark, "ml")
    features = st.running_features(_packet_stream(spark, folder))
    st.write_ml_candidates(features, forest, path, new_folder(spark, "ml-checkpoint")).awaitTermination()
    found = spark.read.parquet(path)
    return found.select("packet_id", "src_ip", "seq", F.round("score", 6).alias("score"))


def _arriving(spark: SparkSession, folder: str, files: int = 5) -> tuple[DataFrame, int]:
    """Packets as a stream of files by time, some up to 20 seconds late, and the time of the first packet.

    A packet long after all others, of a source of its own, moves the watermark to the end.
    """
    packets = pin(packets_from_events(spark, folder), "arriving")
    first, last = packets.agg(F.min("t_us"), F.max("t_us")).first()
    arrival = F.col("t_us") + F.pmod(F.col("packet_id") * 7919, F.lit(20)) * 1_000_000
    at = F.least(F.floor((arrival - first) / ((last - first) / files + 1)), F.lit(files - 1))
    path = new_folder(spark, "arriving")
    for number in range(files):
        # The table is read by many tasks, one writes; small row groups let many read the file again.
        arriving = packets.where(at == number).repartition(1)
        arriving.write.mode("append").option("parquet.block.size", 4 << 20).parquet(path)
    end = spark.createDataFrame([(-1, last + 10**10, "8.8.4.4", "TCP", 443, 0, None)], packets.schema)
    end.coalesce(1).write.mode("append").parquet(path)
    return psrc.packet_stream(spark, path, max_files=1, delay="30 seconds"), first


def stream_detection(spark: SparkSession, folder: str) -> DataFrame:
    forest = training.train(_training(spark, folder)).forest
    stream, first = _arriving(spark, folder)
    path = new_folder(spark, "job")
    job.run(stream, first, path, new_folder(spark, "job-checkpoint"), forest).awaitTermination()
    score = F.round("anomaly_score", 6).alias("anomaly_score")
    alerts = store.alert_table(spark, path).select("ts", "packet_id", "ip_address", "rule", "stored_type", score)
    return _seconds(alerts)


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and rates of sources that start anew after three seconds of silence."""
    stream, first = _arriving(spark, folder)
    job.use_rocksdb(spark)
    found = _drain(spark, job.signals(stream, first, ttl_s=3), "sessions")
    return found.select(
        "packet_id", "src_ip", "seq", *[F.round(c, 6).alias(c) for c in ("rate", "avg_rate", "packets_per_second")]
    )


def stream_alert_sink(spark: SparkSession, folder: str) -> DataFrame:
    alerts = R.alert_rows(st.stateless_candidates(_packet_stream(spark, folder)))
    path = new_folder(spark, "alert-stream")
    store.append_alert_stream(alerts, path, new_folder(spark, "alert-stream-checkpoint")).awaitTermination()
    return _seconds(store.alert_table(spark, path).select("ts", "packet_id", "ip_address", "rule", "stored_type"))


def stream_traffic_rounds(spark: SparkSession, folder: str) -> DataFrame:
    stream = _packet_stream(spark, folder).withWatermark("ts", "1 minute")
    rows = _drain_updates(spark, st.traffic_rounds(stream), "rounds", ["round", "src_ip"], ["packets"])
    return rows.select(F.unix_seconds("round").alias("round_s"), "src_ip", "packets")


def stream_traffic_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _drain_updates(
        spark, st.traffic_totals(_packet_stream(spark, folder)), "totals", ["src_ip"], ["packets"]
    )


def registered() -> dict[str, Query]:
    packets = packets_from_events
    show = lambda *columns: (lambda df: df.select(*columns))
    cols = lambda df: _seconds(df.select("ts", "packet_id", "ip_address", "rule"))
    out: dict[str, Query] = {
        "flagship": lambda s, d: _rounded(_training(s, d), "src_ip"),
        "packet_table": packet_table,
        "valid_sources": lambda s, d: flt.valid_sources(packets(s, d)).select("packet_id", "src_ip"),
        "valid_sources_training": lambda s, d: flt.valid_sources(packets(s, d), parse_only=True).select(
            "packet_id", "src_ip"
        ),
        "label_training_ips": lambda s, d: flt.label_training_ips(packets(s, d)).select("packet_id", "label"),
        "clean_features": clean_features,
        "per_source_budget": budget(10_000),
        "per_source_budget_100": budget(100),
        "running_count": lambda s, d: order.running_count(packets(s, d)).select("packet_id", "src_ip", "seq"),
        "valid_port": lambda s, d: packets(s, d)
        .where(flt.valid_port(F.col("protocol"), F.col("dst_port")))
        .select("packet_id", "protocol", "dst_port"),
        "ml_ready": lambda s, d: flt.ml_ready(R.analysed_packets(packets(s, d))).select(
            "packet_id", "src_ip", F.col("seq").cast("bigint").alias("seq")
        ),
        "rolling_rate": rolling_rate,
        "rate_spikes": rate_spikes,
        "rule_icmp_flood": rule("icmp_flood"),
        "rule_uncommon_port": payload_rule("uncommon_port"),
        "rule_large_payload": payload_rule("large_payload"),
        "rule_malicious_payload": payload_rule("malicious_payload"),
        "all_candidates": lambda s, d: _show_candidates(_candidates(s, d)),
        "stored_types": lambda s, d: _alerts(s, d)
        .groupBy("alert_type", "stored_type")
        .agg(F.count(F.lit(1)).alias("alerts")),
        "limit_alerts": lambda s, d: _show_candidates(lim.limit_alerts(_candidates(s, d), chunk_s=60)),
        "limit_alerts_quiet_split": lambda s, d: lim.limit_alerts(_gapped(_candidates(s, d)), chunk_s=300).select(
            "packet_id", "t_us", "src_ip", "rule"
        ),
        "detection_rules_only": detection_rules_only,
        "ml_alert_rows": ml_alert_rows,
        "detection_with_model": detection_with_model,
        "snapshot_features": lambda s, d: _rounded(_detect_features(s, d), "src_ip"),
        "snapshot_features_h100": lambda s, d: _rounded(_detect_features(s, d, 100), "src_ip"),
        "training_features": lambda s, d: _rounded(_training(s, d), "src_ip"),
        "running_features": running(1000),
        "running_features_h100": running(100),
        "running_features_parts": running(50, 70),
        "traffic_summary": lambda s, d: an.traffic_summary(packets(s, d)),
        "tracked_sources": lambda s, d: an.tracked_sources(packets(s, d)),
        "alert_stats": lambda s, d: an.alert_stats(_alerts(s, d)),
        "period_stats": lambda s, d: an.period_stats(_alerts(s, d)).withColumn(
            "avg_score", F.round("avg_score", 6)
        ),
        "load_alerts": alert_store,
        "alerts_of_address": alerts_of_address,
        "daily_stats": of_days("day_sources", alert_days.stats_of_days),
        "daily_top_ips": of_days("day_sources", alert_days.top_ips_of_days),
        "daily_types": of_days("day_counts", alert_days.types_of_days),
        "daily_ports": of_days("day_counts", alert_days.ports_of_days),
        "daily_hours": of_days("day_counts", alert_days.hours_of_days),
        "recent_alerts": lambda s, d: cols(
            flt.recent_alerts(_alerts(s, d), 5, flt.latest_time(_alerts(s, d)))
        ),
        "alerts_last_days": lambda s, d: cols(
            flt.alerts_last_days(_alerts(s, d, False), 7, flt.latest_time(_alerts(s, d, False)))
        ),
        "search_alerts_all": search("0.1.2", "All", -0.2),
        "search_alerts_ml": search("", "ML", -0.3),
        "search_alerts_rule": search("", "RULE", 0.0),
        "ml_score_valid": lambda s, d: _table(s, d, "events")
        .select("event_id", F.col("value").alias("score"))
        .where(flt.ml_score_valid(F.col("score"))),
        "alert_view": lambda s, d: _seconds(an.alert_view(_alerts(s, d)), "timestamp"),
        "score_timeline": lambda s, d: _seconds(an.score_timeline(_alerts(s, d)), "timestamp"),
        "ml_score_stats": lambda s, d: an.ml_score_stats(_alerts(s, d)).withColumn(
            "avg_score", F.round("avg_score", 6)
        ),
        "score_histogram": lambda s, d: an.score_histogram(_alerts(s, d)).withColumn(
            "bin_start", F.round("bin_start", 6)
        ),
        "alert_type_distribution": lambda s, d: an.alert_type_distribution(_alerts(s, d)),
        "target_port": lambda s, d: _alerts(s, d).select(
            "packet_id", "rule", txt.target_port(F.col("description")).alias("port")
        ),
        "port_distribution": lambda s, d: an.port_distribution(_alerts(s, d)),
        "hour_counts": lambda s, d: an.hour_counts(_alerts(s, d, False)),
        "hour_heatmap": lambda s, d: an.hour_heatmap(_alerts(s, d, False)),
        "calendar": lambda s, d: packets(s, d, False)
        .withColumn("ts", F.timestamp_micros("t_us"))
        .select("packet_id", F.hour("ts").alias("hour"), F.date_format("ts", "EEEE").alias("day_name")),
        "ip_category_distribution": lambda s, d: an.ip_category_distribution(_alerts(s, d)),
        "enrich_known_ips": lambda s, d: look.enrich_known_ips(_alerts(s, d)).select(
            "packet_id", "rule", "ip_address", "entity", "category"
        ),
        "known_only": lambda s, d: look.known_only(_alerts(s, d)).select("packet_id", "rule", "ip_address"),
        "known_ips_table": lambda s, d: an.known_ips_table(_alerts(s, d)),
        "outside_networks": outside_networks,
        "longest_networks": longest_networks,
        "ip_functions": ip_functions,
        "ipv6_functions": ipv6_functions,
        "byte_entropy_packets": lambda s, d: packets(s, d).select(
            "packet_id", F.round(pay.byte_entropy(F.col("payload")), 6).alias("entropy")
        ),
        "byte_entropy_documents": lambda s, d: _table(s, d, "documents").select(
            "doc_id", F.round(pay.byte_entropy(F.encode("text", "UTF-8")), 6).alias("entropy")
        ),
        "payload_stats": payload_stats,
        "malicious_pattern_packets": lambda s, d: packets(s, d).select(
            "packet_id", pay.malicious_pattern(F.col("payload")).alias("pattern")
        ),
        "malicious_pattern_texts": lambda s, d: _texts(s, d).select(
            "kind", "id", pay.malicious_pattern(F.encode("text", "UTF-8")).alias("pattern")
        ),
        "printable_only": lambda s, d: _texts(s, d).select(
            "kind", "id", txt.printable_only(F.col("text")).alias("shown")
        ),
        "redact": lambda s, d: _texts(s, d).select("kind", "id", txt.redact(F.col("text")).alias("safe")),
        "redact_alerts": lambda s, d: _alerts(s, d).select(
            "packet_id", "rule", txt.redact(F.col("description")).alias("safe")
        ),
        "alert_log": alert_log_round_trip,
        "export_alerts_csv": export_csv,
        "training_csv": training_csv_round_trip,
        "features_json": features_json,
        "feature_scaler": feature_scaler,
        "feature_correlation": feature_correlation,
        "contamination_offset": contamination_offset,
        "contamination_offset_narrowed": contamination_offset,
        "score_summary": score_summary,
        "forest_sample": forest_sample,
        "forest_trees": forest_trees,
        "forest_scores": forest_scores,
        "training_stats": training_stats,
        "stored_model": stored_model,
        "pca_2d": pca_2d,
        "csv_training": csv_training,
        "model_info": model_info,
        "report_summary": lambda s, d: report.report_tables(_alerts(s, d, False), 7)["summary"],
        "report_top_ips": lambda s, d: report.report_tables(_alerts(s, d, False), 7)["top_ips"],
        "stream_rules": stream_rules,
        "stream_rates": stream_rates,
        "stream_limiter": stream_limiter,
        "stream_features": stream_features,
        "stream_ml_alerts": stream_ml_alerts,
        "stream_alert_sink": stream_alert_sink,
        "stream_detection": stream_detection,
        "stream_sessions": stream_sessions,
        "stream_traffic_rounds": stream_traffic_rounds,
        "stream_traffic_totals": stream_traffic_totals,
    }
    for interval in C.ALERT_INTERVALS_US:
        out[f"alert_rate_{interval.lower()}"] = lambda s, d, i=interval: _seconds(
            an.alert_rate(_alerts(s, d, False), i), "bucket"
        ).withColumnRenamed("ts_s", "bucket_s")
    for n in (5, 10, 15):
        out[f"top_ips_{n}"] = lambda s, d, n=n: an.top_ips(_alerts(s, d), n)
    return {name: _in_utc(query) for name, query in out.items()}


def _in_utc(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, folder)

    return run
