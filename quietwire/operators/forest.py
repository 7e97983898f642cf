"""Isolation forest on Spark (Liu, Ting, Zhou 2008): sampling, trees, scores.

Every random number is the MD5 of the seed and of what it is drawn for (a row, or a node of a tree), and values are
compared in steps of 1e-9 deviations. The same rows and seed give the same forest whatever the
partitioning, the order of the rows and the rounding of sums, and another engine can repeat it.

Each tree sees at most ``max_samples`` rows, so sampling is a filter on a hash of the row and only
the sampled rows are shuffled. A forest is a table of at most ``n_trees * (2 * max_samples - 1)``
nodes, small enough to travel with the scoring function.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from quietwire.config import FEATURE_NAMES, ForestConfig
from quietwire.scratch import pin
from quietwire.schemas import TREES

EULER = 0.5772156649
EPSILON = 2.220446049250313e-16
DRAWS = (1 << 52) - 47
"""A prime: numbers drawn by a row for its trees are pairwise independent modulo it."""

STEPS = 1e9
SCORE_STEPS = 1e12
_ROWS_AT_ONCE = 1024


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature; constant features keep deviation 1."""

    names: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    n_rows: int
    varies: tuple[bool, ...] = ()


@dataclass(frozen=True)
class Forest:
    trees: DataFrame
    scaler: Scaler
    max_samples: int
    score_offset: float
    config: ForestConfig


def check_features(features: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> None:
    missing = [n for n in names if n not in features.columns]
    if missing:
        raise ValueError(f"expected {len(names)} feature columns, missing {missing}")


def scaler_table(features: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """One row per feature: feature, mean, scale, varies, n_rows. A single pass over the features.

    Like scikit-learn's scaler, a feature counts as constant where its variance is within the
    rounding error of its mean.
    """
    wide = features.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(n).alias(f"m_{i}") for i, n in enumerate(names)],
        *[F.stddev_pop(n).alias(f"s_{i}") for i, n in enumerate(names)],
    )

    def cell(i: int, name: str) -> Column:
        mean, deviation = F.col(f"m_{i}"), F.col(f"s_{i}")
        noise = F.col("n_rows") * EPSILON
        varies = deviation * deviation > noise * deviation * deviation + (noise * mean) * (noise * mean)
        return F.struct(
            F.lit(name).alias("feature"),
            mean.alias("mean"),
            F.when(varies, deviation).otherwise(F.lit(1.0)).alias("scale"),
            F.coalesce(varies, F.lit(False)).alias("varies"),
        )

    cells = F.array(*[cell(i, n) for i, n in enumerate(names)])
    return wide.select(F.explode(cells).alias("c"), "n_rows").select("c.*", "n_rows")


def fit_scaler(features: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> Scaler:
    rows = {r.feature: r for r in scaler_table(features, names).collect()}
    n_rows = int(rows[names[0]].n_rows)
    pick = lambda field: tuple(0.0 if rows[n][field] is None else float(rows[n][field]) for n in names)
    varies = tuple(bool(rows[n].varies) for n in names)
    return Scaler(tuple(names), pick("mean"), pick("scale"), n_rows, varies)


def scale(features: DataFrame, scaler: Scaler) -> DataFrame:
    """Features in deviations from their mean, in steps of ``1 / STEPS``."""
    steps = lambda n, m, s: F.floor((F.col(n) - F.lit(m)) / F.lit(s) * STEPS + 0.5).cast("double") / STEPS
    return features.withColumns(
        {n: steps(n, m, s) for n, m, s in zip(scaler.names, scaler.mean, scaler.scale)}
    )


def sample_for_trees(
    features: DataFrame, n_rows: int, cfg: ForestConfig = ForestConfig(), key: str = "src_ip"
) -> DataFrame:
    """``min(max_samples, n_rows)`` distinct rows per tree, the same for the same seed.

    A row's MD5 with the seed gives two numbers a and b; its draw for tree t is ``a + b * (t + 1)`` modulo a prime. Only
    draws under a threshold that lets half as many again through are kept and ranked. ``key`` must identify a row.
    """
    size = min(cfg.max_samples, n_rows)
    threshold = min(DRAWS, math.ceil(1.5 * size / max(n_rows, 1) * DRAWS))
    digest = F.md5(F.concat(F.lit(f"{cfg.seed}:"), F.col(key).cast("string")))
    number = lambda at: F.conv(F.substring("_md5", at, 13), 16, 10).cast("bigint")
    drawn = features.withColumn("_md5", digest).withColumns({"_a": number(1), "_b": number(14)})
    draw = lambda tree: F.pmod(F.col("_a") + F.col("_b") * (tree + 1), F.lit(DRAWS))
    trees = F.filter(F.sequence(F.lit(0), F.lit(cfg.n_trees - 1)), lambda t: draw(t) < threshold)
    ranked = Window.partitionBy("tree").orderBy("_draw", key)
    return (
        drawn.withColumn("tree", F.explode(trees))
        .withColumn("_draw", draw(F.col("tree")))
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= size)
        .drop("_draw", "_rank", "_md5", "_a", "_b")
    )


def average_path(n: np.ndarray) -> np.ndarray:
    """Expected depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + EULER) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, value))


def node_draws(seed: int, tree: int, node: int) -> tuple[float, float]:
    """Two numbers in [0, 1) for a node: which feature it splits, and where."""
    digest = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
    return int(digest[:13], 16) / 2.0**52, int(digest[13:26], 16) / 2.0**52


def grow_tree(x: np.ndarray, max_depth: int, seed: int, tree: int) -> list[tuple]:
    """Nodes (node, left, right, feature, threshold, n, depth) of one random tree; -1 marks leaves.

    The children of node i are 2i + 1 and 2i + 2.
    """
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, 0)]
    while todo:
        rows, node, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if len(rows) <= 1 or depth >= max_depth or len(varying) == 0:
            nodes.append((node, -1, -1, -1, 0.0, len(rows), depth))
            continue
        which, where = node_draws(seed, tree, node)
        feature = int(varying[int(which * len(varying))])
        threshold = float(low[feature] + where * (high[feature] - low[feature]))
        if threshold >= high[feature]:
            threshold = float(low[feature])
        goes_left = part[:, feature] <= threshold
        nodes.append((node, 2 * node + 1, 2 * node + 2, feature, threshold, len(rows), depth))
        todo.append((rows[~goes_left], 2 * node + 2, depth + 1))
        todo.append((rows[goes_left], 2 * node + 1, depth + 1))
    return nodes


def fit_trees(
    scaled: DataFrame, n_rows: int, cfg: ForestConfig = ForestConfig(), key: str = "src_ip"
) -> DataFrame:
    """The node table of the forest, one task group of at most ``max_samples`` rows per tree."""
    names = list(FEATURE_NAMES)
    size = min(cfg.max_samples, n_rows)
    max_depth = math.ceil(math.log2(max(size, 2)))
    seed = cfg.seed

    def grow(tree: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        number = int(tree[0])
        nodes = grow_tree(rows[names].to_numpy(dtype=float), max_depth, seed, number)
        out = pd.DataFrame(nodes, columns=["node", "left", "right", "feature", "threshold", "n", "depth"])
        out.insert(0, "tree", number)
        return out

    sampled = sample_for_trees(scaled, n_rows, cfg, key).select("tree", key, *names)
    return sampled.groupBy("tree").applyInPandas(grow, TREES)


@dataclass(frozen=True)
class _Walk:
    """A forest as flat arrays: leaves lead to themselves, so every row takes ``depth`` steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray  # left child of node i at 2i, right child at 2i + 1
    path: np.ndarray
    depth: int
    norm: float

    @staticmethod
    def of(nodes: pd.DataFrame, max_samples: int) -> "_Walk":
        nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        roots = np.flatnonzero(nodes["node"].to_numpy() == 0)
        leaf = nodes["left"].to_numpy() < 0
        here = np.arange(len(nodes))
        # Nodes are numbered by their place in a full tree: look up where each stands.
        tree = np.repeat(np.arange(len(roots)), np.diff([*roots, len(nodes)]))
        span = int(nodes["node"].max()) + 1
        place = np.zeros(len(roots) * span, dtype=np.int64)
        place[tree * span + nodes["node"].to_numpy()] = here
        child = lambda c: np.where(leaf, here, place[tree * span + np.where(leaf, 0, nodes[c].to_numpy())])
        left, right = child("left"), child("right")
        return _Walk(
            roots=roots.astype(np.int32),
            feature=np.where(leaf, 0, nodes["feature"].to_numpy()).astype(np.int32),
            threshold=np.where(leaf, np.inf, nodes["threshold"].to_numpy()),
            children=np.column_stack([left, right]).ravel().astype(np.int32),
            path=nodes["depth"].to_numpy() + average_path(nodes["n"].to_numpy()),
            depth=int(nodes["depth"].max()),
            norm=float(average_path(np.array([max_samples]))[0]),
        )

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.norm <= 0:
            return np.full(len(x), -1.0)
        out = np.empty(len(x))
        for begin in range(0, len(x), _ROWS_AT_ONCE):
            part = np.ascontiguousarray(x[begin : begin + _ROWS_AT_ONCE])
            values, first = part.ravel(), (np.arange(len(part), dtype=np.int32) * x.shape[1])[:, None]
            at = np.tile(self.roots, (len(part), 1))
            for _ in range(self.depth):
                goes_right = values.take(first + self.feature.take(at)) > self.threshold.take(at)
                at = self.children.take(2 * at + goes_right)
            mean_path = self.path.take(at).mean(axis=1)
            score = -np.exp2(-mean_path / self.norm)
            out[begin : begin + len(part)] = np.floor(score * SCORE_STEPS + 0.5) / SCORE_STEPS
        return out


def anomaly_score(forest: Forest) -> Column:
    """Score of the feature columns of a row: in [-1, 0), lower is more anomalous."""
    walk = _Walk.of(forest.trees.toPandas(), forest.max_samples)
    mean, spread = np.array(forest.scaler.mean), np.array(forest.scaler.scale)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.Series(walk.scores(np.floor((x - mean) / spread * STEPS + 0.5) / STEPS))

    return score(*[F.col(n) for n in forest.scaler.names])


def predict(forest: Forest, features: DataFrame) -> DataFrame:
    """Add ``anomaly_score`` and ``prediction`` (-1 anomalous, 1 normal)."""
    check_features(features, forest.scaler.names)
    return with_prediction(features.withColumn("anomaly_score", anomaly_score(forest)), forest.score_offset)


def order_statistics(
    values: DataFrame, column: str, ranks: Sequence[int], n: int, accuracy: int = 10_000, most: int = 100_000
) -> list[float]:
    """The values at neighbouring ``ranks`` (from 0, ascending) of ``n`` sorted values without nulls.

    A mergeable quantile sketch brackets the ranks in one pass; a second one counts what lies below and at the ends of
    the bracket and picks inside it. At most ``most`` values come to the driver: a bracket that may hold more
    is bracketed again first.
    """
    v, below, slack = F.col(column), 0, 2.0 / accuracy
    inside, size = values, n
    while True:
        low_rank, high_rank = ranks[0] - below, ranks[-1] - below
        at = [max(0.0, low_rank / size - slack), min(1.0, (high_rank + 1) / size + slack)]
        low, high = inside.agg(F.percentile_approx(v, at, accuracy)).first()[0]
        within = (v > F.lit(low)) & (v < F.lit(high))
        few = size * min(1.0, 4 * slack) + high_rank - low_rank < most
        picked = F.sort_array(F.collect_list(F.when(within, v))) if few else F.array().cast("array<double>")
        found = inside.agg(
            F.count_if(v < low).alias("below"),
            F.count_if(v == low).alias("low"),
            F.count_if(within).alias("within"),
            F.count_if(v == high).alias("high"),
            picked.alias("picked"),
        ).first()
        steps = np.cumsum([found.below, found.low, found.within, found.high if high > low else 0]).tolist()

        def value(rank: int) -> float | None:
            if rank < steps[1]:
                return float(low)
            if rank < steps[2]:
                return float(found.picked[rank - steps[1]]) if few else None
            return float(high)

        if not steps[0] <= low_rank <= high_rank < steps[3]:
            slack *= 4  # the sketch was off by more than its accuracy
            continue
        out = [value(r - below) for r in ranks]
        if None not in out:
            return out
        if all(steps[1] <= r - below < steps[2] for r in ranks):
            inside, size, below = inside.where(within), found.within, below + steps[1]
        else:
            # The ranks lie on both sides of an end: one by one.
            return [order_statistics(values, column, [r], n, accuracy, most)[0] for r in ranks]


def exact_quantile(values: DataFrame, column: str, q: float, n: int | None = None) -> float:
    """Linearly interpolated quantile of any number of rows, in two passes.

    Spark's exact percentile keeps all values of a column in one task; this way keeps a bracket around the rank. With
    ``n`` given, ``values`` are taken to be a written table.
    """
    values = values.select(column)
    if n is None:
        values = pin(values, "quantile")
        n = values.count()
    at = (n - 1) * q
    k = math.floor(at)
    found = order_statistics(values, column, [k, k + 1] if k + 1 < n else [k], n)
    return found[0] + (at - k) * (found[-1] - found[0])


def with_prediction(scored: DataFrame, offset: float) -> DataFrame:
    return scored.withColumn("prediction", F.when(F.col("anomaly_score") < offset, -1).otherwise(1))


def fit_and_score(
    features: DataFrame, cfg: ForestConfig = ForestConfig(), key: str = "src_ip"
) -> tuple[Forest, DataFrame]:
    """Scale, sample, grow, and set the score offset so that ``contamination`` of the rows lie below.

    The rows with score and prediction come along: scores are computed once and written.
    """
    check_features(features)
    scaler = fit_scaler(features)
    if scaler.n_rows < cfg.min_rows:
        raise ValueError(f"need at least {cfg.min_rows} rows for training, got {scaler.n_rows}")
    trees = pin(fit_trees(scale(features, scaler), scaler.n_rows, cfg, key), "trees")
    size = min(cfg.max_samples, scaler.n_rows)
    unset = Forest(trees, scaler, size, float("-inf"), cfg)
    scored = pin(features.withColumn("anomaly_score", anomaly_score(unset)), "scores")
    offset = exact_quantile(scored, "anomaly_score", cfg.contamination, scaler.n_rows)
    return Forest(trees, scaler, size, offset, cfg), with_prediction(scored, offset)


def fit_forest(features: DataFrame, cfg: ForestConfig = ForestConfig(), key: str = "src_ip") -> Forest:
    """The forest alone."""
    return fit_and_score(features, cfg, key)[0]


def training_stats(scored: DataFrame) -> DataFrame:
    anomalies = F.count_if(F.col("prediction") == -1)
    n = F.count(F.lit(1))
    return scored.agg(
        n.alias("n_samples"),
        F.lit(len(FEATURE_NAMES)).alias("n_features"),
        anomalies.alias("n_anomalies"),
        F.try_divide(anomalies.cast("double"), n.cast("double")).alias("anomaly_rate"),
        F.avg("anomaly_score").alias("score_mean"),
        F.stddev_pop("anomaly_score").alias("score_std"),
        F.min("anomaly_score").alias("score_min"),
        F.max("anomaly_score").alias("score_max"),
    )


def validate_model(forest: Forest, features: DataFrame) -> DataFrame:
    return training_stats(predict(forest, features)).drop("n_features")


def assembled(features: DataFrame, names: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="_v").transform(features)


def feature_correlation(features: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Pearson correlation of every pair of features as rows (feature_a, feature_b, r).

    Features are standardised first, so that large means cost no precision and a constant feature
    is exactly zero; ``r`` is null for it. Only the matrix itself comes to the driver.
    """
    spark = features.sparkSession
    scaler = fit_scaler(features, names)
    varies = dict(zip(scaler.names, scaler.varies))
    flat = scale(features, scaler).select(
        *[F.col(n) if varies[n] else F.lit(0.0).alias(n) for n in names]
    )
    matrix = Correlation.corr(assembled(flat, names), "_v").first()[0].toArray()
    cells = [
        (a, b, float(matrix[i, j]) if varies[a] and varies[b] else None)
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    return spark.createDataFrame(cells, "feature_a string, feature_b string, r double")


def pca_2d(scored: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Two principal components of the centred features, with label Normal or Anomaly."""
    means = scored.agg(*[F.avg(n).alias(n) for n in names]).first()
    vectors = assembled(scored.withColumns({n: F.col(n) - F.lit(float(means[n])) for n in names}), names)
    projected = PCA(k=2, inputCol="_v", outputCol="_p").fit(vectors).transform(vectors)
    xy = vector_to_array("_p")
    return projected.select(
        *[c for c in scored.columns if c not in names and c not in ("prediction", "anomaly_score")],
        xy[0].alias("x"),
        xy[1].alias("y"),
        F.when(F.col("prediction") == -1, "Anomaly").otherwise("Normal").alias("label"),
    )
