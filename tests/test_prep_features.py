import math

from cartwise.operators import expansion, features, prep


def test_median_fill(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0), (3, 4.0, None), (4, None, 1.0)],
                               "id int, price double, days_since_prior_order double")
    got = {r["id"]: (r["price"], r["days_since_prior_order"]) for r in prep.impute_missing(df).collect()}
    assert got[4] == (2.0, 1.0) and got[1] == (1.0, 0.0)


def test_rank_pct_ties_and_null(spark):
    products = spark.createDataFrame([(i, f"p{i}", 1, 1) for i in range(1, 6)],
                                     "product_id bigint, product_name string, aisle_id int, department_id int")
    attrs = spark.createDataFrame(
        [(1, 1.0, 1.0, 1.0, 1.0, 1, 1.0), (2, 1.0, 1.0, 1.0, 1.0, 1, 2.0), (3, 1.0, 1.0, 1.0, 1.0, 1, 2.0),
         (4, 1.0, 1.0, 1.0, 1.0, 1, None), (5, 1.0, 1.0, 1.0, 1.0, 1, 5.0)],
        "product_id bigint, premium_score double, necessity_score double, impulse_score double, "
        "cross_sell_score double, is_food int, price double")
    out = {r["product_id"]: r for r in features.price_rank_features(products, attrs).collect()}
    assert [out[i]["price_percentile"] for i in range(1, 6)] == [0.25, 0.62, 0.62, None, 1.0]
    assert out[4]["is_premium_priced"] == 0 and out[5]["is_premium_priced"] == 1


def test_normalize_constant_column_is_zero(spark):
    m = spark.createDataFrame([(1, 7.0), (2, 7.0)], "product_id bigint, avg_price double")
    got = [r["avg_price_norm"] for r in expansion.normalize(m, ["avg_price"]).collect()]
    assert got == [0.0, 0.0]


def test_user_stats_exact_money(spark):
    df = spark.createDataFrame([(1, 10, 1, 0.1), (1, 11, 2, 0.2)],
                               "user_id bigint, product_id bigint, order_number int, price double")
    r = prep.user_stats(df).collect()[0]
    assert r["user_total_spent"] == 0.3 and math.isclose(r["user_avg_order_value"], 0.15)


def test_activity_counts_distinct_values_of_odd_lines(spark):
    rows = [(1, 10, 5, 1.25, 1), (1, 10, 5, 1.25, 1), (1, 10, 6, None, None), (1, 11, None, 2.0, 0), (2, 10, 5, None, None),
            (None, 10, 5, 3.0, 1), (1, None, 7, 0.5, 1)]
    lines = spark.createDataFrame(rows, "product_id long, order_id long, user_id long, price double, reordered int")
    got = {r[0]: tuple(r)[1:] for r in expansion.product_activity(lines).collect()}
    assert got == {1: (2, 3, 1.25, 0.75), 2: (1, 1, None, None), None: (1, 1, 3.0, 1.0)}
    plan = expansion.product_activity(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_text_free_lines_are_merged_alike_and_dealt_by_order(spark):
    t = {"products": spark.createDataFrame([(1, "a", 1, 1), (1, "a", 1, 1), (2, "b", 1, 2)], "product_id long, product_name string, aisle_id int, department_id int"),
         "aisles": spark.createDataFrame([(1, "x")], "aisle_id int, aisle string"),
         "departments": spark.createDataFrame([(1, "d"), (2, "e")], "department_id int, department string"),
         "orders": spark.createDataFrame([(i, i % 2) for i in range(5)] + [(4, 0)], "order_id long, user_id long"),
         "order_products_prior": spark.createDataFrame([(i, 1 + i % 3, 0) for i in range(6)], "order_id long, product_id long, reordered int"),
         "order_products_train": spark.createDataFrame([(4, 1, 1), (None, 1, 1)], "order_id long, product_id long, reordered int"),
         "product_prices": spark.createDataFrame([(1, 2.5)], "product_id long, price double")}
    whole = prep.merge_all(t)[0].drop("product_name", "aisle", "department")
    thin = prep.merge_all(prep.without_texts(t))[0]
    assert thin.schema == whole.schema
    rows = [sorted(map(tuple, df.collect()), key=repr) for df in (whole, thin)]
    assert rows[0] == rows[1] and len(rows[0]) > 5
