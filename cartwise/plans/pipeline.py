"""End-to-end pipeline (the reference's main flow, steps 1-7), stages materialised once.

preprocess (N1) -> enrichment tables (M2/M6 inputs) -> pairs, similarity (M6)
-> graph, centrality, basket expansion (N2) -> enhanced lines (D8) -> SMOTE,
split, boosted trees base/enhanced (L1-L9) -> hybrid revenue comparison
(N3, E12, E13) -> cross-sell recommendations for every order (N4) ->
reports (N7-N9) and artifacts (B3-B5).

Every stage that several consumers read is written once into the reliable
checkpoint folder (``materialize``); nothing is collected except scalars and
the bounded model metadata.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.operators import (
    balance,
    expansion,
    graph,
    pairs,
    prep,
    recommend,
    similarity,
    training,
)
from cartwise.operators.enrich import category_requests, parse_category_replies
from cartwise.session import materialize
from cartwise.sources import sinks

KEYS = ["order_id", "product_id"]


def run_pipeline(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    out_dir: str | None = None,
    labelled_rows: int = training.LABELLED_ROWS,
    min_support: int = 5,
    pair_mode: str = "directed",
    max_orders: int | None = None,
    betweenness_k: int | None = 1000,
    pagerank_iter: int = 50,
    gbt_params: dict | None = None,
    top_n: int = 5,
    top_k: int = 1000,
    category_replies: DataFrame | None = None,
) -> dict:
    """Run every step; returns the result DataFrames plus ``timings`` (seconds per step)."""
    timings: dict[str, float] = {}
    res: dict = {"timings": timings}

    def step(name, fn):
        t = time.time()
        out = fn()
        timings[name] = round(time.time() - t, 3)
        return out

    # 1 preprocessing
    merged = step("merge", lambda: materialize(prep.merge_all(tables)[0], "p-merged"))
    feats = step("features", lambda: materialize(prep.add_base_features(prep.impute_missing(merged)), "p-features"))

    # 2 enrichment side: category requests for all products (+ parsed replies if given)
    prods = prep.attach_prices(
        prep.product_dim(tables["products"], tables["aisles"], tables["departments"]), tables.get("product_prices"))
    members, requests = category_requests(prods)
    res["category_requests"] = requests
    cats = parse_category_replies(category_replies, members) if category_replies is not None else None

    # 3 pairs, similarity, graph
    fp = step("pairs", lambda: materialize(
        pairs.frequent_pairs(feats.select("order_id", "product_id", "add_to_cart_order"), min_support, pair_mode,
                             max_orders), "p-pairs"))
    sim = step("similarity", lambda: materialize(
        similarity.similarity_features(similarity.pair_similarity(fp, tables["product_embeddings"])), "p-sim"))
    edges = step("edges", lambda: materialize(graph.edges_from_pairs(fp), "p-edges"))
    res["network_summary"] = graph.network_summary(edges)
    cent = step("centrality", lambda: materialize(
        graph.centrality_table(edges, k=betweenness_k, pagerank_iter=pagerank_iter), "p-centrality"))
    scored = step("expansion", lambda: materialize(
        expansion.analyze_basket_expansion(feats.select("order_id", "product_id", "user_id", "price", "reordered"),
                                           edges), "p-expansion"))

    # 4 enhanced lines
    bm = scored.select("product_id", "basket_expansion_score", "cross_sell_strength", "avg_basket_size_with_product")
    enh = feats
    if cats is not None:
        enh = enh.join(cats, "product_id", "left")
    enh = enh.join(sim, "product_id", "left").join(cent, "product_id", "left").join(bm, "product_id", "left")
    enh = enh.fillna(0, subset=[c for c in training.ENHANCED_FEATURES if c in enh.columns])
    enh = step("enhanced", lambda: materialize(enh, "p-enhanced"))

    # 5 models
    gp = gbt_params or {}
    evals = {}
    preds = {}
    for which, fl in (("base", training.BASE_FEATURES), ("enhanced", training.BASE_FEATURES + training.ENHANCED_FEATURES)):
        def fit(fl=fl, which=which):
            m = training.training_matrix(training.labelled_share(enh, KEYS, n=labelled_rows), fl)
            data = materialize(training.split(balance.smote(m, fl, id_cols=tuple(KEYS))), f"p-balanced-{which}")
            model = training.train_gbt(data.where("is_train"), fl, **gp)
            held = training.split(training.training_matrix(enh, fl), keys=tuple(KEYS))
            test = held.where(~F.col("is_train"))
            pred = materialize(training.predict(model, test, fl), f"p-pred-{which}")
            return model, pred
        model, pred = step(f"model_{which}", fit)
        preds[which] = pred
        evals[which] = materialize(training.evaluate(pred, which), f"p-eval-{which}")
        res[f"model_{which}"] = model
    res["model_comparison"] = training.model_comparison(evals["base"], evals["enhanced"])
    imp = training.feature_importance(res["model_enhanced"], training.BASE_FEATURES + training.ENHANCED_FEATURES)
    res["feature_importance"] = imp
    res["importance_by_category"] = training.importance_by_category(imp)

    # 6 revenue comparison on every held-out line (features read from the row)
    rows = preds["enhanced"].select(
        *KEYS, "label", F.col("score").alias("ml_probability"), "price", "basket_expansion_score",
        "cross_sell_strength")
    hy = recommend.hybrid_scores(rows)
    rev = step("revenue", lambda: materialize(
        recommend.revenue_topk(hy, "ml_probability", top_k, KEYS).unionByName(
            recommend.revenue_topk(hy, "hybrid_score", top_k, KEYS)), "p-revenue"))
    res["revenue_impact"] = recommend.revenue_impact(rev)

    # 7 cross-sell for every order
    pf = materialize(recommend.product_features(feats, scored), "p-product-features")
    baskets = merged.select(F.col("order_id").alias("basket_id"), "product_id")
    recs = step("cross_sell", lambda: materialize(recommend.cross_sell(baskets, edges, pf, top_n), "p-cross-sell"))
    res.update({"features": feats, "frequent_pairs": fp, "similarity": sim, "edges": edges, "centrality": cent,
                "expansion": scored, "enhanced": enh, "recommendations": recs, "revenue": rev})

    if out_dir:
        def write():
            sinks.overwrite_table(recs, f"{out_dir}/recommendations")
            sinks.overwrite_table(scored, f"{out_dir}/basket_expansion")
            sinks.overwrite_table(cent, f"{out_dir}/centrality")
            sinks.write_metric_lines(evals["base"].unionByName(evals["enhanced"]), f"{out_dir}/model_performance")
            training.save_model(res["model_enhanced"], f"{out_dir}/enhanced_model",
                                meta=res["model_comparison"])
            doc = res["model_comparison"].agg(
                F.collect_list(F.struct("metric", "base", "enhanced", "improvement_pct")).alias("models")).select(
                "models",
                res["revenue_impact"].agg(F.collect_list(F.struct("metric", "ml_only", "hybrid", "improvement_pct")))
                .scalar().alias("revenue"),
                imp.agg(F.collect_list(F.struct("feature", "importance", "category"))).scalar().alias(
                    "feature_importance"),
            )
            sinks.write_results_json(doc, f"{out_dir}/results")
        step("write", write)
    return res
