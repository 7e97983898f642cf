"""Feature tables as CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quietwire.config import FEATURE_NAMES
from quietwire.operators.filters import clean_features, usable_label
from quietwire.operators.ordering import running_totals

ROW_ORDER = ("_file", "_block", "_row")


def read_training_csv(
    spark: SparkSession, path: str, max_rows: int | None = None, max_cols: int | None = None
) -> DataFrame:
    """A feature CSV, or its first ``max_rows`` rows: ``row``, ``label``, cleaned feature columns.

    Column ``ip`` is optional; unusable addresses become ``invalid_ip_{k}`` and rows without the
    column ``ip_{row}``.
    """
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError(f"not a CSV file: {path}")
    try:
        names = spark.read.option("header", True).csv(path).columns
    except AnalysisException as error:
        raise FileNotFoundError(path) from error
    if max_cols is not None and len(names) > max_cols:
        raise ValueError(f"too many columns: {len(names)} (at most {max_cols})")
    schema = T.StructType(
        [T.StructField(n, T.StringType() if n == "ip" else T.DoubleType()) for n in names]
    )
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .csv(path)
        .select(
            *names,
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    if max_rows is not None:
        rows = rows.orderBy(*ROW_ORDER).limit(max_rows)
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    # Row numbers by ranges of rows: no task sees all of them.
    bad = F.lit(0) if "ip" not in names else F.when(usable_label(F.col("ip")), 0).otherwise(1)
    one = F.lit(1).cast("bigint")
    counted = running_totals(rows, {"_n": one, "_bad": bad.cast("bigint")}, keys=(), order=ROW_ORDER)
    row = F.col("_n") - 1
    label = F.concat(F.lit("ip_"), row.cast("string"))
    if "ip" in names:
        numbered = F.concat(F.lit("invalid_ip_"), (F.col("_bad") - 1).cast("string"))
        label = F.when(usable_label(F.col("ip")), F.col("ip")).otherwise(numbered)
    features = [n for n in names if n != "ip"]
    return clean_features(counted.select(row.alias("row"), label.alias("label"), *features), features)


def write_training_csv(features: DataFrame, path: str, ip: str = "src_ip") -> None:
    features.select(F.col(ip).alias("ip"), *FEATURE_NAMES).write.mode("overwrite").option("header", True).csv(
        path
    )
