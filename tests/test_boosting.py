import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwise.operators import balance, boosting, training

FEATURES = ["a", "b", "c", "d"]


def _rows(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 12, n), rng.integers(0, 200, n), rng.integers(-40, 40, n) / 8
    d = rng.normal(size=n).round(2)
    y = (a * 7 + b + 20 * c + 30 * rng.normal(size=n)) > 150
    rows = [(float(p), float(q), float(r), float(s), int(t)) for p, q, r, s, t in zip(a, b, c, d, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, label int")


def _trees(model):
    return [line.split("Predict")[0] for line in model.toDebugString.split("\n")[1:]]


def test_trees_are_those_of_the_trainer_where_it_counts_all_rows(spark):
    from pyspark.ml.classification import GBTClassifier

    df = _rows(spark, 6000)
    params = {"maxIter": 5, "maxDepth": 4, "stepSize": 0.1}
    theirs = GBTClassifier(featuresCol="features", labelCol="label", seed=42, **params).fit(training.assemble(df, FEATURES))
    ours = training.train_gbt(df, FEATURES, **params)
    assert _trees(ours) == _trees(theirs)
    both = [sorted((r.a, r.b, r.c, r.d, r.score) for r in training.predict(m, df, FEATURES).collect()) for m in (ours, theirs)]
    assert np.allclose(both[0], both[1], rtol=0, atol=1e-6)
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), rtol=0, atol=1e-6)
    a, b = (m._call_java("trees")[0].rootNode() for m in (ours, theirs))
    assert math.isclose(a.impurity(), b.impurity()) and math.isclose(a.leftChild().impurity(), b.leftChild().impurity())
    wide = training.train_gbt(df, FEATURES, maxIter=2, maxDepth=3, maxBins=64)  # one feature a code
    theirs = GBTClassifier(featuresCol="features", labelCol="label", maxIter=2, maxDepth=3, maxBins=64).fit(training.assemble(df, FEATURES))
    assert _trees(wide) == _trees(theirs)


def test_trees_hang_on_neither_order_nor_partitions(spark, monkeypatch):
    df = _rows(spark, 25_000).withColumn("d", F.col("d") + F.col("b") / 977).cache()
    one = training.train_gbt(df.orderBy(F.desc("d")).coalesce(1), FEATURES, maxIter=3, maxDepth=3)
    monkeypatch.setattr(boosting, "AT_DRIVER", 0)  # the same splits where histograms are merged in a shuffle
    monkeypatch.setattr(boosting, "BLOCK", 999)
    monkeypatch.setattr(boosting, "COUNTED", 5000)
    other = training.train_gbt(df.repartition(7), FEATURES, maxIter=3, maxDepth=3)
    assert one.toDebugString.split("\n")[1:] == other.toDebugString.split("\n")[1:]
    df.unpersist()


def test_split_points_part_all_rows_evenly(spark):
    # a heavy value between others of its cell, values far apart in size, one value alone, few values, none on both sides of 0
    df = spark.range(64_000).selectExpr("IF(id % 3 = 0, 901.37, 900.5 + id / 64000.0) AS heavy", "exp(id / 3200.0) AS wide",
                                        "CAST(7 AS DOUBLE) AS one", "CAST(id % 5 AS DOUBLE) AS few", "id - 32000.5D AS signs")
    n, points = boosting.split_points(df, 32)
    assert n == 64_000 and len(points[2]) == 0 and points[3].tolist() == [0.5, 1.5, 2.5, 3.5]
    for c, at in (("wide", 1), ("signs", 4)):
        x = np.sort(np.array([r[0] for r in df.select(c).collect()]))
        assert len(points[at]) == 31
        assert abs(np.diff(np.searchsorted(x, points[at])) - 2000).max() <= 2 * 64_000 / boosting.FINE
    x = np.sort(np.array([r[0] for r in df.select("heavy").collect()], dtype=float))
    inside = points[0][np.abs(points[0] - 901.37) < 1e-3]
    assert len(inside) >= 1 and np.diff(np.searchsorted(x, points[0]))[np.diff(np.searchsorted(x, points[0])) < 20_000].max() <= 2300


def test_fit_of_one_class_and_of_no_rows(spark):
    df = _rows(spark, 300)
    model = training.train_gbt(df.withColumn("label", F.lit(0)), FEATURES, maxIter=2, maxDepth=3)
    assert {r.prediction for r in training.predict(model, df, FEATURES).collect()} == {0}
    with pytest.raises(ValueError):
        training.train_gbt(df.limit(0), FEATURES, maxIter=2, maxDepth=3)


def test_synthetic_rows_are_made_where_their_part_is(spark):
    df = spark.range(9000).selectExpr("id AS row_id", "CAST(id AS DOUBLE) AS f", "IF(id < 2, 1, 0) AS label")
    out = balance.smote(df, ["f"], id_cols=("row_id",))
    plan = out.where("is_synthetic")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    syn = out.where("is_synthetic").collect()
    assert sorted(r.synthetic_no for r in syn) == list(range(8996))  # 8998 of one class, 2 of the other
    assert all(0.0 <= r.f <= 1.0 for r in syn)
