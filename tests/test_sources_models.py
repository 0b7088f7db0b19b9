import math
import tempfile

from pyspark.sql import functions as F

from cartwise.operators import sampling, training
from cartwise.sources import files, schemas, testdata

SF = "/root/testdata/sf0.001"


def test_csv_round_trip_with_explicit_schemas(spark):
    d = tempfile.mkdtemp(prefix="cartwise-csv-")
    t = testdata.load_retail(spark, SF)
    for name, (fname, schema) in schemas.CSV_TABLES.items():
        t[name].select(*schema.fieldNames()).write.option("header", True).csv(f"{d}/{fname}")
    back = files.load_datasets(spark, d)
    for name in schemas.CSV_TABLES:
        assert back[name].count() == t[name].count()
        assert back[name].schema.fieldNames() == schemas.CSV_TABLES[name][1].fieldNames()
    assert files.load_prices(spark, f"{d}/missing.csv") is None


def test_hash_sample_stable_and_exact_size(spark):
    df = spark.range(5000).select(F.col("id").alias("order_id"), (F.col("id") % 7).alias("product_id"))
    a = {tuple(r) for r in sampling.hash_sample(df, 0.1, ["order_id", "product_id"]).collect()}
    b = {tuple(r) for r in sampling.hash_sample(df.repartition(11), 0.1, ["order_id", "product_id"]).collect()}
    assert a == b and 300 < len(a) < 700
    ex = sampling.hash_sample_exact(df, ["order_id", "product_id"], fraction=0.02)
    assert ex.count() == 100


def test_grid_choice_is_seeded_and_distinct():
    a, b = training.choose_param_maps(10), training.choose_param_maps(10)
    assert a == b and len({tuple(sorted(p.items())) for p in a}) == 10


def test_gbt_separable_auc_and_save_load(spark):
    from pyspark.ml.classification import GBTClassificationModel

    from cartwise.operators.evaluation import roc_auc

    rows = [(float(i), float(i % 3), 1 if i >= 50 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    model = training.train_gbt(df, ["a", "b"], maxIter=5, maxDepth=2)
    pred = training.predict(model, df, ["a", "b"])
    assert roc_auc(pred).collect()[0].auc > 0.9
    probs = [r.score for r in pred.collect()]
    assert all(0.0 <= p <= 1.0 for p in probs)
    d = tempfile.mkdtemp(prefix="cartwise-model-")
    training.save_model(model, d)
    again = training.predict(GBTClassificationModel.load(f"{d}/model"), df, ["a", "b"])
    assert [r.score for r in again.collect()] == probs
    imp = training.feature_importance(model, ["a", "b"]).collect()
    assert math.isclose(sum(r.importance for r in imp), 1.0)


def test_base_model_reads_lines_without_the_graph(spark, monkeypatch):
    from cartwise.operators import training
    from cartwise.plans import q_models

    rows = spark.range(6).selectExpr("id AS order_id", "id AS product_id", "CAST(id % 2 AS INT) AS reordered",
                                     *[f"CAST(id AS DOUBLE) AS {c}" for c in training.BASE_FEATURES])
    monkeypatch.setattr(q_models, "_MEMO", {})
    monkeypatch.setattr(q_models, "_key", lambda name, *_: name)
    monkeypatch.setattr(q_models, "features", lambda *_: rows)
    monkeypatch.setattr(q_models, "enhanced", lambda *_: 1 / 0)
    # a product with two categories has its line twice, as in the enhanced lines
    monkeypatch.setattr(q_models, "categories", lambda *_: spark.createDataFrame([(1,), (1,), (9,)], "product_id long"))
    assert q_models.matrix(spark, "", training.BASE_FEATURES).count() == 7
    done = rows.limit(4)
    monkeypatch.setattr(q_models, "_MEMO", {"enhanced": done})
    assert q_models.model_lines(spark, "", training.BASE_FEATURES) is done


def test_centrality_measures_run_at_once(spark, monkeypatch):
    import threading

    from cartwise.operators import graph

    both = threading.Barrier(2, timeout=30)
    edges = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "src bigint, dst bigint, weight bigint")
    for name in ("betweenness", "pagerank"):
        plain = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda *a, plain=plain, **k: (both.wait(), plain(*a, **k))[1])
    assert {r.product_id: r.pagerank for r in graph.centrality_table(edges).collect()} == {1: 0.5, 2: 0.5}


def test_models_are_fitted_on_every_labelled_line(spark, monkeypatch):
    from cartwise.plans import q_models

    few = training.LABELLED_ROWS + 500
    lines = spark.range(3 * few).selectExpr(
        "id AS order_id", "id % 50 AS product_id", f"IF(id % 100 = 7 AND id > {2 * few}, NULL, IF(id < {few}, 1, 0)) AS reordered",
        *[f"CAST(id % {7 + i} AS DOUBLE) AS {c}" for i, c in enumerate(training.BASE_FEATURES)])
    monkeypatch.setattr(q_models, "_MEMO", {})
    monkeypatch.setattr(q_models, "_key", lambda name, *_: name)
    monkeypatch.setattr(q_models, "model_lines", lambda *_: lines)
    got = q_models.balanced(spark, "", training.BASE_FEATURES)
    n = {(r.label, r.is_synthetic): r["count"] for r in got.groupBy("label", "is_synthetic").count().collect()}
    many = lines.where("reordered = 0").count()
    # rows without a label are none of a fit; all others are there, however many a class has
    assert many < 2 * few and n == {(1, False): few, (0, False): many, (1, True): many - few}
    assert got.where("NOT is_synthetic").select("order_id").distinct().count() == few + many
