from cartwise.plans.pipeline import run_pipeline
from cartwise.sources import testdata


def test_pipeline_end_to_end_smallest(spark, tmp_path):
    t = testdata.load_retail(spark, "/root/testdata/sf0.001")
    res = run_pipeline(spark, t, out_dir=str(tmp_path / "out"), min_support=2, betweenness_k=50,
                       pagerank_iter=10, gbt_params={"maxIter": 3, "maxDepth": 3})
    assert res["recommendations"].count() > 0
    assert {r.metric for r in res["model_comparison"].collect()} == {"accuracy", "auc"}
    assert spark.read.json(str(tmp_path / "out" / "results")).count() == 1
    assert set(res["timings"]) >= {"merge", "pairs", "centrality", "cross_sell"}
