"""Stored forests: tables trees, scaler and metadata, each with one folder per version."""

from __future__ import annotations

import warnings
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quietwire.config import FEATURE_NAMES, ForestConfig
from quietwire.operators.forest import Forest, Scaler
from quietwire.schemas import METADATA, SCALER, TREES


def save_forest(forest: Forest, path: str, version: int, trained_at: datetime | None = None) -> None:
    if version < 1:
        raise ValueError("versions count from 1")
    spark = forest.trees.sparkSession
    scaler = forest.scaler
    metadata = (
        "IsolationForest",
        trained_at or datetime.now(),
        spark.version,
        len(scaler.names),
        forest.config.contamination,
        forest.config.n_trees,
        forest.config.seed,
        forest.max_samples,
        forest.score_offset,
        list(scaler.names),
    )
    tables = {
        "trees": forest.trees.coalesce(1),
        "scaler": spark.createDataFrame(list(zip(scaler.names, scaler.mean, scaler.scale)), SCALER).coalesce(1),
        "metadata": spark.createDataFrame([metadata], METADATA).coalesce(1),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/version={version}")


def model_info(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of all stored versions."""
    schema = T.StructType([*METADATA.fields, T.StructField("version", T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(f"{path}/metadata")
    except AnalysisException as error:
        raise FileNotFoundError(f"no model in {path}") from error


def latest_version(spark: SparkSession, path: str) -> int:
    found = model_info(spark, path).agg(F.max("version")).first()[0]
    if found is None:
        raise FileNotFoundError(f"no model in {path}")
    return int(found)


def load_forest(spark: SparkSession, path: str, version: int | None = None) -> Forest:
    """A stored version, by default the highest one."""
    chosen = latest_version(spark, path) if version is None else version
    meta = model_info(spark, path).where(F.col("version") == chosen).first()
    if meta is None:
        raise FileNotFoundError(f"no version {chosen} in {path}")
    if meta.n_features != len(FEATURE_NAMES):
        raise ValueError(f"model has {meta.n_features} features, expected {len(FEATURE_NAMES)}")
    if datetime.now() - meta.training_date > timedelta(days=30):
        warnings.warn(f"model version {chosen} is older than 30 days; consider training again")
    if meta.library_version.split(".")[0] != spark.version.split(".")[0]:
        warnings.warn(f"model version {chosen} was trained with Spark {meta.library_version}")
    rows = {r.feature: r for r in spark.read.schema(SCALER).parquet(f"{path}/scaler/version={chosen}").collect()}
    names = tuple(meta.feature_names)
    scaler = Scaler(names, tuple(rows[n].mean for n in names), tuple(rows[n].scale for n in names), 0)
    trees = spark.read.schema(TREES).parquet(f"{path}/trees/version={chosen}")
    cfg = ForestConfig(
        contamination=meta.contamination, n_trees=meta.n_estimators, seed=meta.random_state
    )
    return Forest(trees, scaler, meta.max_samples, meta.score_offset, cfg)
