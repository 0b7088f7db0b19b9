"""Registered queries: cross-sell, hybrid score, revenue comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise.functions.expr import unit_hash
from cartwise.operators import recommend, sampling
from cartwise.plans.oracle import h, round_cols, sql
from cartwise.plans.q_graph import EXP_CTES, edges, pair_lines, scored
from cartwise.plans.q_prep import imputed, score_imputed, thin_lines
from cartwise.plans.registry import register, stage
from cartwise.session import materialize

TOP_N = 5
TOP_K = 1000


def product_feats(spark, sf_dir):
    return stage("product-feats", spark, sf_dir,
                 lambda: recommend.product_features(imputed(spark, sf_dir), scored(spark, sf_dir)))


def order_baskets(spark, sf_dir):
    return pair_lines(spark, sf_dir).select(F.col("order_id").alias("basket_id"), "product_id")


REC_CTES = EXP_CTES + """,
r_pfeat AS (
  SELECT f.product_id, arg_min(f.product_name, f.order_id) AS product_name, arg_min(f.price, f.order_id) AS price,
         coalesce(max(s.basket_expansion_score), 0.0) AS basket_expansion_score,
         coalesce(max(s.cross_sell_strength), 0.0) AS cross_sell_strength
  FROM r_imputed f LEFT JOIN r_score s ON f.product_id = s.product_id GROUP BY f.product_id),
r_baskets AS (SELECT order_id AS basket_id, product_id FROM r_merged),
r_cand AS (
  SELECT b.basket_id, e.dst AS product_id, sum(CAST(e.weight AS DOUBLE)) AS network_strength
  FROM r_baskets b JOIN r_edges e ON b.product_id = e.src
  GROUP BY b.basket_id, e.dst),
r_cand2 AS (
  SELECT c.* FROM r_cand c ANTI JOIN r_baskets b ON c.basket_id = b.basket_id AND c.product_id = b.product_id),
r_rec AS (
  SELECT c.basket_id, c.product_id, p.product_name, p.price, c.network_strength,
         0.4 * c.network_strength + 0.3 * p.basket_expansion_score
         + 0.2 * (p.price / (SELECT max(price) FROM r_pfeat)) + 0.1 * p.cross_sell_strength AS recommendation_score
  FROM r_cand2 c JOIN r_pfeat p ON c.product_id = p.product_id)
"""


@register("product_features", sql(round_cols("SELECT * FROM r_pfeat",
                                             ["price", "basket_expansion_score", "cross_sell_strength"]), REC_CTES))
def q_product_features(spark, sf_dir):
    """First line per product plus expansion score and strength (0 when missing)."""
    return recommend.product_features(imputed(spark, sf_dir), scored(spark, sf_dir))


@register("cross_sell_candidates", sql(round_cols("SELECT * FROM r_cand2", ["network_strength"]), REC_CTES))
def q_cross_sell_candidates(spark, sf_dir):
    """D14, H2, D15, H3, E16 for every order as a basket."""
    return recommend.cross_sell_candidates(order_baskets(spark, sf_dir), edges(spark, sf_dir))


@register("cross_sell_topn", sql(round_cols("""
SELECT basket_id, CAST(row_number() OVER (PARTITION BY basket_id ORDER BY recommendation_score DESC, product_id)
       AS INTEGER) AS rank, product_id, product_name, price, recommendation_score, network_strength
FROM r_rec QUALIFY rank <= 5""", ["price", "recommendation_score", "network_strength"]), REC_CTES))
def q_cross_sell_topn(spark, sf_dir):
    """N4 (flagship): top-5 cross-sell products for every order."""
    products = product_feats(spark, sf_dir)
    return recommend.cross_sell(order_baskets(spark, sf_dir), edges(spark, sf_dir), products, TOP_N)


@register("cross_sell_user_topn", sql(round_cols("""
SELECT basket_id, CAST(row_number() OVER (PARTITION BY basket_id ORDER BY recommendation_score DESC, product_id)
       AS INTEGER) AS rank, product_id, product_name, price, recommendation_score, network_strength
FROM r_rec2 QUALIFY rank <= 5""", ["price", "recommendation_score", "network_strength"]),
    REC_CTES.replace("r_baskets AS (SELECT order_id AS basket_id, product_id FROM r_merged)", """r_baskets AS (
  SELECT user_id AS basket_id, product_id FROM r_merged
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY order_number, add_to_cart_order, product_id) <= 3)""")
    .replace("r_rec AS (", "r_rec2 AS (")))
def q_cross_sell_user_topn(spark, sf_dir):
    """N5 for every user: basket = the user's first three products, then N4."""
    first3 = recommend.first_items_per_user(thin_lines(spark, sf_dir), 3)
    baskets, products = first3.select(F.col("user_id").alias("basket_id"), "product_id"), product_feats(spark, sf_dir)
    return recommend.cross_sell(baskets, edges(spark, sf_dir), products, TOP_N)


def scored_rows(spark, sf_dir):
    """N3 inputs: test-split lines with label, a deterministic score stand-in, price and graph scores.

    ml_probability is a key hash (a model-free stand-in that SQL can replay);
    the model-backed version is ``model_scored_rows`` in q_models.
    """
    lines = score_imputed(spark, sf_dir).select("order_id", "product_id", "reordered", "price")
    lines = sampling.train_test_split(lines, ["order_id", "product_id"]).where(~F.col("is_train"))
    sp = scored(spark, sf_dir).select("product_id", "basket_expansion_score", "cross_sell_strength")
    return lines.join(sp, "product_id", "left").select(
        "order_id", "product_id", F.col("reordered").alias("label"),
        unit_hash(F.lit("score"), "order_id", "product_id").alias("ml_probability"),
        "price", "basket_expansion_score", "cross_sell_strength",
    )


HYB_CTES = REC_CTES + f""",
r_rows AS (
  SELECT i.order_id, i.product_id, i.reordered AS label,
         {h("'score'", 'i.order_id', 'i.product_id')} AS ml_probability,
         coalesce(i.price, 0.0) AS price, coalesce(s.basket_expansion_score, 0.0) AS basket_expansion_score,
         coalesce(s.cross_sell_strength, 0.0) AS cross_sell_strength
  FROM r_imputed i LEFT JOIN r_score s ON i.product_id = s.product_id
  WHERE NOT ({h("'split'", 'i.order_id', 'i.product_id')} < 0.8)),
r_pb AS (SELECT min(price) AS lo, max(price) AS hi FROM r_rows),
r_hyb AS (
  SELECT r.*, 0.4 * ml_probability + 0.3 * basket_expansion_score
         + 0.2 * (CASE WHEN hi > lo THEN (price - lo) / (hi - lo) ELSE 0.0 END) + 0.1 * cross_sell_strength
         AS hybrid_score
  FROM r_rows r, r_pb),
r_topml AS (SELECT * FROM r_hyb ORDER BY ml_probability DESC, order_id, product_id LIMIT {TOP_K}),
r_tophy AS (SELECT * FROM r_hyb ORDER BY hybrid_score DESC, order_id, product_id LIMIT {TOP_K}),
r_rev AS (
  SELECT 'ml_probability' AS strategy, avg(label) AS precision, sum(label * price) AS total_revenue,
         sum(label * price) / {float(TOP_K)} AS avg_revenue_per_rec, avg(basket_expansion_score) AS avg_basket_expansion
  FROM r_topml
  UNION ALL
  SELECT 'hybrid_score', avg(label), sum(label * price), sum(label * price) / {float(TOP_K)},
         avg(basket_expansion_score) FROM r_tophy)
"""
REV_COLS = ["precision", "total_revenue", "avg_revenue_per_rec", "avg_basket_expansion"]


def hybrid(spark, sf_dir):
    return stage("hybrid", spark, sf_dir, lambda: recommend.hybrid_scores(scored_rows(spark, sf_dir)))


@register("hybrid_scores", sql(round_cols("SELECT * FROM r_hyb",
                                          ["ml_probability", "price", "basket_expansion_score",
                                           "cross_sell_strength", "hybrid_score"]), HYB_CTES))
def q_hybrid_scores(spark, sf_dir):
    """J11 + N3 over the test split."""
    return hybrid(spark, sf_dir)


def revenue_rows(spark, sf_dir):
    hy = hybrid(spark, sf_dir)
    keys = ("order_id", "product_id")
    return recommend.revenue_topk(hy, "ml_probability", TOP_K, keys).unionByName(
        recommend.revenue_topk(hy, "hybrid_score", TOP_K, keys)
    )


@register("revenue_topk", sql(round_cols("SELECT * FROM r_rev", REV_COLS), HYB_CTES))
def q_revenue_topk(spark, sf_dir):
    """E12 + G3: top-1000 metrics for the ML-only and the hybrid ranking."""
    return revenue_rows(spark, sf_dir)


@register("revenue_impact", sql(round_cols("""
SELECT m.metric, m.ml_only, m.hybrid, (m.hybrid - m.ml_only) / nullif(m.ml_only, 0) * 100.0 AS improvement_pct
FROM (
  SELECT unnest(['precision', 'total_revenue', 'avg_revenue_per_rec', 'avg_basket_expansion']) AS metric,
         unnest([CAST(a.precision AS DOUBLE), a.total_revenue, a.avg_revenue_per_rec, a.avg_basket_expansion])
           AS ml_only,
         unnest([CAST(b.precision AS DOUBLE), b.total_revenue, b.avg_revenue_per_rec, b.avg_basket_expansion])
           AS hybrid
  FROM (SELECT * FROM r_rev WHERE strategy = 'ml_probability') a,
       (SELECT * FROM r_rev WHERE strategy = 'hybrid_score') b) m""",
    ["ml_only", "hybrid", "improvement_pct"]), HYB_CTES))
def q_revenue_impact(spark, sf_dir):
    """Strategy comparison with improvement in percent."""
    return recommend.revenue_impact(materialize(revenue_rows(spark, sf_dir), "revenue"))
