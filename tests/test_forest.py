from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietwire.config import FEATURE_NAMES, ForestConfig
from quietwire.operators import forest as fo
from quietwire.plans import training
from quietwire.sources import models, training_csv

SCHEMA = "src_ip string, " + ", ".join(f"{n} double" for n in FEATURE_NAMES)


def matrix(spark, x, prefix="10.0.0"):
    rows = [(f"{prefix}.{i}", *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def normal():
    return np.random.default_rng(42).normal(0, 0.5, (400, 18))


@pytest.fixture(scope="module")
def trained(spark, normal):
    return training.train(matrix(spark, normal), ForestConfig(contamination=0.05))


def test_scaler(spark, normal):
    x = normal.copy()
    x[:, 3] = 7.0
    scaler = fo.fit_scaler(matrix(spark, x))
    assert np.allclose(scaler.mean, x.mean(axis=0))
    want = x.std(axis=0)
    want[3] = 1.0
    assert np.allclose(scaler.scale, want) and scaler.n_rows == 400


def test_sample(spark, normal):
    df = matrix(spark, normal)
    take = lambda seed: {(r.tree, r.src_ip) for r in fo.sample_for_trees(df, 400, ForestConfig(seed=seed)).select("tree", "src_ip").collect()}
    a = take(42)
    assert len(a) == 100 * 256 and {t for t, _ in a} == set(range(100))
    assert a == take(42) and a != take(7)


def test_trees(trained):
    nodes = trained.forest.trees.toPandas()
    roots = nodes[nodes.node == 0]
    assert len(roots) == 100 and (roots.n == 256).all()
    assert nodes.depth.max() <= 8
    inner = nodes[nodes.left >= 0]
    n = nodes.set_index(["tree", "node"]).n
    for row in inner.head(500).itertuples():
        assert n[(row.tree, row.left)] + n[(row.tree, row.right)] == row.n
        assert min(n[(row.tree, row.left)], n[(row.tree, row.right)]) > 0


def walk(nodes, x):
    """Path length of one point in one tree, node by node."""
    nodes = {n["node"]: n for n in nodes}
    node = nodes[0]
    while node["left"] >= 0:
        node = nodes[node["left"] if x[node["feature"]] <= node["threshold"] else node["right"]]
    return node["depth"] + float(fo.average_path(np.array([node["n"]]))[0])


def test_scores_equal_a_plain_walk(trained, normal):
    forest = trained.forest
    trees = [t.sort_values("node").to_dict("records") for _, t in forest.trees.toPandas().groupby("tree")]
    scores = {r.src_ip: r.anomaly_score for r in trained.scored.collect()}
    scaled = (normal - np.array(forest.scaler.mean)) / np.array(forest.scaler.scale)
    norm = float(fo.average_path(np.array([256]))[0])
    for i in range(0, 400, 37):
        mean = np.mean([walk(t, scaled[i]) for t in trees])
        assert scores[f"10.0.0.{i}"] == pytest.approx(-(2.0 ** (-mean / norm)))
    assert all(-1 <= s < 0 for s in scores.values())


def test_the_forest_does_not_depend_on_rows_order_or_partitions(spark, normal, trained):
    shuffled = matrix(spark, normal).orderBy(F.rand(3)).repartition(7)
    again = training.train(shuffled, ForestConfig(contamination=0.05))
    nodes = lambda t: sorted(map(tuple, t.forest.trees.collect()))
    assert nodes(again) == nodes(trained) and again.forest.score_offset == trained.forest.score_offset


def test_contamination_and_outliers(spark, trained):
    stats = trained.stats.first()
    assert stats.n_samples == 400 and stats.n_features == 18
    assert stats.n_anomalies == 20 and stats.anomaly_rate == 0.05
    far = matrix(spark, np.random.default_rng(1).normal(10, 5, (10, 18)), "11.0.0")
    scored = fo.predict(trained.forest, far).collect()
    assert all(r.prediction == -1 for r in scored)
    assert max(r.anomaly_score for r in scored) < stats.score_mean


def test_batch_equals_single(spark, trained, normal):
    one = fo.predict(trained.forest, matrix(spark, normal[:1])).first()
    many = trained.scored.where("src_ip = '10.0.0.0'").first()
    assert one.anomaly_score == many.anomaly_score and one.prediction == many.prediction


def test_quantile(spark):
    x = np.random.default_rng(0).normal(size=5000).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    assert fo.exact_quantile(df, "v", 0.013) == pytest.approx(np.percentile(x, 1.3))
    for k in (0, 1, 77, 2500, 4999):
        assert fo.order_statistics(df, "v", [k], 5000) == [np.sort(x)[k]]
    # Coarse sketches and few values at the driver: brackets within brackets, ranks on both sides of an end.
    for k in (0, 1249, 2500, 4998):
        got = fo.order_statistics(df, "v", [k, k + 1], 5000, accuracy=8, most=60)
        assert got == np.sort(x)[[k, k + 1]].tolist()
    same = df.selectExpr("1.5 AS v")
    assert fo.order_statistics(same, "v", [7, 8], 5000, accuracy=8, most=60) == [1.5, 1.5]


def test_errors(spark, normal):
    with pytest.raises(ValueError):
        fo.fit_forest(matrix(spark, normal).drop("tcp_ratio"))
    with pytest.raises(ValueError):
        fo.fit_forest(matrix(spark, normal[:1]))
    with pytest.raises(ValueError):
        ForestConfig(contamination=0.7)


def test_save_and_load(spark, trained, tmp_path):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        models.load_forest(spark, path)
    models.save_forest(trained.forest, path, 1)
    models.save_forest(trained.forest, path, 10)
    models.save_forest(trained.forest, path, 9)
    assert models.latest_version(spark, path) == 10
    loaded = models.load_forest(spark, path)
    assert loaded.score_offset == trained.forest.score_offset and loaded.config == trained.forest.config
    again = {r.src_ip: (r.anomaly_score, r.prediction) for r in fo.predict(loaded, trained.scored.drop("anomaly_score", "prediction")).collect()}
    assert again == {r.src_ip: (r.anomaly_score, r.prediction) for r in trained.scored.collect()}
    check = fo.validate_model(loaded, trained.scored.drop("anomaly_score", "prediction")).first()
    assert check.n_anomalies == 20
    with pytest.raises(FileNotFoundError):
        models.load_forest(spark, path, 3)


def test_old_model_warns(spark, trained, tmp_path):
    from datetime import datetime

    models.save_forest(trained.forest, str(tmp_path), 1, datetime(2020, 1, 1))
    with pytest.warns(UserWarning, match="older than 30 days"):
        models.load_forest(spark, str(tmp_path))


def test_csv(spark, normal, tmp_path):
    path = f"{tmp_path}/features.csv"
    training_csv.write_training_csv(matrix(spark, normal[:20]).coalesce(1), path)
    back = training_csv.read_training_csv(spark, path).orderBy("row").collect()
    assert [r.label for r in back] == [f"10.0.0.{i}" for i in range(20)]
    assert np.allclose([[r[n] for n in FEATURE_NAMES] for r in back], normal[:20], atol=0)
    trained = training.train_from_csv(spark, path, f"{tmp_path}/models", 1)
    assert trained.stats.first().n_samples == 20


def test_csv_rules(spark, tmp_path):
    with pytest.raises(ValueError):
        training_csv.read_training_csv(spark, f"{tmp_path}/x.txt")
    with pytest.raises(FileNotFoundError):
        training_csv.read_training_csv(spark, f"{tmp_path}/none.csv")
    (tmp_path / "wide.csv").write_text(",".join(f"c{i}" for i in range(51)) + "\n" + ",".join(["1"] * 51) + "\n")
    with pytest.raises(ValueError, match="too many columns"):
        training_csv.read_training_csv(spark, f"{tmp_path}/wide.csv", max_cols=50)
    assert training_csv.read_training_csv(spark, f"{tmp_path}/wide.csv").count() == 1
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        training_csv.read_training_csv(spark, f"{tmp_path}/empty.csv")
    (tmp_path / "plain.csv").write_text("a,b\n1,nan\n2,inf\n3,4\n")
    got = training_csv.read_training_csv(spark, f"{tmp_path}/plain.csv", max_rows=2).orderBy("row").collect()
    assert [(r.label, r.a, r.b) for r in got] == [("ip_0", 1.0, 0.0), ("ip_1", 2.0, 0.0)]
    (tmp_path / "bad.csv").write_text("ip,a\n127.0.0.1,1\n8.8.8.8,2\nnope,3\n")
    got = training_csv.read_training_csv(spark, f"{tmp_path}/bad.csv").orderBy("row").collect()
    assert [r.label for r in got] == ["invalid_ip_0", "8.8.8.8", "invalid_ip_1"]


def test_correlation_and_pca(spark, trained, normal):
    x = normal.copy()
    x[:, 5] = 3.0
    got = {(r.feature_a, r.feature_b): r.r for r in fo.feature_correlation(matrix(spark, x)).collect()}
    assert len(got) == 324 and got[FEATURE_NAMES[5], FEATURE_NAMES[0]] is None
    want = np.corrcoef(x[:, [0, 1]].T)[0, 1]
    assert got[FEATURE_NAMES[0], FEATURE_NAMES[1]] == pytest.approx(want)
    flat = fo.pca_2d(trained.scored).collect()
    assert sum(r.label == "Anomaly" for r in flat) == 20
    centred = normal - normal.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    rows = {r.src_ip: r for r in flat}
    for axis, field in zip(axes, ("x", "y")):
        mine = np.array([rows[f"10.0.0.{i}"][field] for i in range(400)])
        assert np.allclose(np.abs(mine), np.abs(centred @ axis), atol=1e-6)
