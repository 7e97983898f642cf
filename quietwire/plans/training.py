"""Training: packets or a CSV in, a stored forest and its statistics out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quietwire.config import ForestConfig
from quietwire.operators.features import snapshot_features
from quietwire.operators.filters import clean_features, valid_sources
from quietwire.operators.forest import Forest, fit_and_score, training_stats
from quietwire.scratch import pin
from quietwire.sources.models import save_forest
from quietwire.sources.training_csv import read_training_csv


@dataclass(frozen=True)
class Trained:
    forest: Forest
    scored: DataFrame
    stats: DataFrame


def training_features(packets: DataFrame, as_of_us: int | None = None, history: int = 1000) -> DataFrame:
    """Features of every source whose address parses; training uses no other filter and no budget."""
    return snapshot_features(valid_sources(packets, parse_only=True), history, as_of_us)


def train(features: DataFrame, cfg: ForestConfig = ForestConfig(), key: str = "src_ip") -> Trained:
    """Fit on the features. They are read several times, so they are written once first."""
    ready = pin(clean_features(features), "features")
    forest, scored = fit_and_score(ready, cfg, key)
    return Trained(forest, scored, training_stats(scored))


def train_and_save(packets: DataFrame, path: str, version: int, cfg: ForestConfig = ForestConfig()) -> Trained:
    trained = train(training_features(packets), cfg)
    save_forest(trained.forest, path, version)
    return trained


def train_from_csv(
    spark: SparkSession, csv: str, path: str, version: int, cfg: ForestConfig = ForestConfig()
) -> Trained:
    trained = train(read_training_csv(spark, csv), cfg, key="row")
    save_forest(trained.forest, path, version)
    return trained
