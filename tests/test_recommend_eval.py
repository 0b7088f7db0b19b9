import math

from cartwise.operators import evaluation, recommend, similarity


def test_cross_sell_example(spark):
    baskets = spark.createDataFrame([(1, 1), (1, 2)], "basket_id bigint, product_id bigint")
    rows = []
    for u, v, w in [(1, 3, 5), (2, 3, 6), (1, 2, 9), (2, 4, 5)]:
        rows += [(u, v, w), (v, u, w)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, weight bigint")
    feats = spark.createDataFrame(
        [(1, "a", 10.0, 0.0, 0.0), (2, "b", 20.0, 0.0, 0.0), (3, "c", 5.0, 0.5, 2.0)],
        "product_id bigint, product_name string, price double, basket_expansion_score double, "
        "cross_sell_strength double")
    recs = recommend.cross_sell(baskets, edges, feats, 5).collect()
    assert [r.product_id for r in recs] == [3]
    r = recs[0]
    assert r.network_strength == 11.0
    assert math.isclose(r.recommendation_score, 0.4 * 11 + 0.3 * 0.5 + 0.2 * 5 / 20 + 0.1 * 2.0)


def test_revenue_topk_divides_by_requested_k(spark):
    rows = spark.createDataFrame([(i, i % 2, 0.1 * i, 10.0, 1.0) for i in range(10)],
                                 "row_id long, label int, ml_probability double, price double, "
                                 "basket_expansion_score double")
    r = recommend.revenue_topk(rows, "ml_probability", 1000).collect()[0]
    assert r.total_revenue == 50.0 and r.avg_revenue_per_rec == 0.05 and r.precision == 0.5


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")
    assert evaluation.roc_auc(df).collect()[0].auc == 0.5
    df2 = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "score double, label int")
    assert math.isclose(evaluation.roc_auc(df2).collect()[0].auc, 0.75)


def test_similarity_statistics(spark):
    sims = spark.createDataFrame([(1, 2, 1, 0.2), (1, 3, 3, 0.8)], "p1 bigint, p2 bigint, cnt bigint, similarity double")
    r = {x.product_id: x for x in similarity.similarity_features(sims).collect()}[1]
    assert math.isclose(r.avg_semantic_similarity, 0.65) and r.max_semantic_similarity == 0.8
    assert math.isclose(r.semantic_diversity, math.sqrt(0.0675))


def test_classification_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    rep = {r["class"]: r for r in evaluation.classification_report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["0"].recall == 1.0


def test_auc_of_scores_in_a_narrow_band_with_an_outlier(spark):
    rows = [(i % 2, 0.5 + i * 1e-12) for i in range(400)] + [(1, 1e9)]
    df = spark.createDataFrame(rows, "label int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    expect = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    from cartwise.operators.evaluation import roc_auc

    assert abs(roc_auc(df).first()["auc"] - expect) < 1e-12


def test_rows_are_numbered_with_an_outlier_id(spark):
    from cartwise.operators.enrich import number_rows

    df = spark.range(0, 2000).unionByName(spark.createDataFrame([(2**55,)], "id long")).withColumnRenamed("id", "product_id")
    got = {r.product_id: r.rn for r in number_rows(df).collect()}
    assert got == {**{i: i + 1 for i in range(2000)}, 2**55: 2001}
