import __spark_entry__ as E


def test_entry_runs_on_smallest_data(spark):
    df = E.entry(spark)
    assert set(["basket_id", "product_id", "recommendation_score"]) <= set(df.columns)
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_flagship_plan_has_no_cross_join_or_python_udf(spark):
    df = E.queries()["cross_sell_topn"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def _executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_user_features_use_aggregates_not_windows(spark):
    plan = _executed(E.queries()["base_features"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and "HashAggregate" in plan


def test_scans_prune_columns(spark):
    df = E.queries()["frequent_pairs"](spark, "/root/testdata/sf0.001")
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and all("product_name" not in s and "price" not in s for s in schemas)
