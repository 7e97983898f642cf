"""Explicit schemas of the tables that cross a storage boundary."""

from pyspark.sql import types as T

from quietwire.config import FEATURE_NAMES

PACKET = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("t_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

FEATURES = T.StructType(
    [T.StructField("src_ip", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in FEATURE_NAMES]
)

ALERTS = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("packet_id", T.LongType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("stored_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("raw_data", T.StringType()),
        T.StructField("target_port", T.IntegerType()),
    ]
)

TREES = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
    ]
)

SCALER = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("scale", T.DoubleType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("model_type", T.StringType()),
        T.StructField("training_date", T.TimestampType()),
        T.StructField("library_version", T.StringType()),
        T.StructField("n_features", T.IntegerType()),
        T.StructField("contamination", T.DoubleType()),
        T.StructField("n_estimators", T.IntegerType()),
        T.StructField("random_state", T.LongType()),
        T.StructField("max_samples", T.IntegerType()),
        T.StructField("score_offset", T.DoubleType()),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
    ]
)
