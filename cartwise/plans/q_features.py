"""Registered queries: product text, similarity, derived features, evaluation (C14, D6, D7, D13, E6, E9, F9, F10,
C3, C4, J1, J9, J13, L5-L7, M4-M6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise.operators import evaluation, features, similarity, text_factors
from cartwise.plans.oracle import _xavg, r2, round_cols, sql
from cartwise.plans.q_graph import PAIR_CTES, freq_pairs
from cartwise.plans.q_prep import tables
from cartwise.plans.q_recommend import HYB_CTES, hybrid
from cartwise.plans.registry import register

SIM_CTES = PAIR_CTES + """,
r_e AS (
  SELECT product_id, CAST(embedding AS DOUBLE[]) AS e,
         sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM r_emb),
r_psim AS (
  SELECT f.p1, f.p2, f.cnt,
         CASE WHEN a.n > 0 AND b.n > 0 THEN list_inner_product(a.e, b.e) / (a.n * b.n) ELSE 0.0 END AS similarity
  FROM r_fp f JOIN r_e a ON f.p1 = a.product_id JOIN r_e b ON f.p2 = b.product_id),
r_ends AS (
  SELECT p1 AS product_id, cnt, similarity FROM r_psim UNION ALL SELECT p2, cnt, similarity FROM r_psim),
r_simf1 AS (
  SELECT product_id, sum(cnt * similarity) / sum(cnt) AS avg_semantic_similarity,
         max(similarity) AS max_semantic_similarity, sum(cnt) AS w
  FROM r_ends GROUP BY product_id),
r_simf AS (
  SELECT f.product_id, f.avg_semantic_similarity, f.max_semantic_similarity,
         sqrt(sum(e.cnt * pow(e.similarity - f.avg_semantic_similarity, 2)) / f.w) AS semantic_diversity
  FROM r_ends e JOIN r_simf1 f ON e.product_id = f.product_id
  GROUP BY f.product_id, f.avg_semantic_similarity, f.max_semantic_similarity, f.w)
"""


def pair_sims(spark, sf_dir):
    return similarity.pair_similarity(freq_pairs(spark, sf_dir), tables(spark, sf_dir)["product_embeddings"])


@register("product_text", sql("""
SELECT DISTINCT p.product_id, p.product_name, d.department, a.aisle,
       p.product_name || ' ' || a.aisle || ' ' || d.department AS combined_text
FROM r_products p LEFT JOIN r_departments d ON p.department_id = d.department_id
LEFT JOIN r_aisles a ON p.aisle_id = a.aisle_id"""))
def q_product_text(spark, sf_dir):
    """J1 + D6 + C14: combined product text."""
    t = tables(spark, sf_dir)
    return features.product_text(t["products"], t["departments"], t["aisles"])


@register("text_vectors")
def q_text_vectors(spark, sf_dir):
    """M5: hashed TF-IDF vectors (384 wide) of the product text."""
    t = tables(spark, sf_dir)
    return similarity.text_vectors(features.product_text(t["products"], t["departments"], t["aisles"]))


@register("text_factors")
def q_text_factors(spark, sf_dir):
    """M5: dense vectors (64 wide) of the product text, factors of the product-term matrix."""
    t = tables(spark, sf_dir)
    text = features.product_text(t["products"], t["departments"], t["aisles"])
    return text_factors.fit(text).transform(text)


@register("pair_similarity", sql(round_cols("SELECT * FROM r_psim", ["similarity"]), SIM_CTES))
def q_pair_similarity(spark, sf_dir):
    """D13 + J13: cosine of both members of each frequent pair."""
    return pair_sims(spark, sf_dir)


@register("semantic_similarity_features", sql(round_cols(
    "SELECT * FROM r_simf", ["avg_semantic_similarity", "max_semantic_similarity", "semantic_diversity"]),
    SIM_CTES))
def q_semantic_similarity_features(spark, sf_dir):
    """Count-weighted mean, max and population std of neighbour similarity."""
    return similarity.similarity_features(pair_sims(spark, sf_dir))


FEAT_CTES = f"""
r_pb AS (
  SELECT p.*, a.premium_score, a.necessity_score, a.impulse_score, a.cross_sell_score, a.is_food, a.price
  FROM r_products p LEFT JOIN r_attrs a ON p.product_id = a.product_id),
r_dist AS (
  SELECT department_id, price, count(*) AS ties FROM r_pb WHERE price IS NOT NULL GROUP BY 1, 2),
r_dist2 AS (
  SELECT department_id, price,
         (CAST(coalesce(sum(ties) OVER (PARTITION BY department_id ORDER BY price
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
          + (ties + 1) / 2.0::DOUBLE) / CAST(sum(ties) OVER (PARTITION BY department_id) AS DOUBLE) AS pct_raw
  FROM r_dist),
r_dept AS (SELECT department_id, {_xavg('price')} AS dept_avg FROM r_pb GROUP BY 1),
r_prf0 AS (
  SELECT b.*, {r2('d.pct_raw')} AS price_percentile, {r2('b.price / nullif(e.dept_avg, 0)')} AS price_vs_dept_avg
  FROM r_pb b LEFT JOIN r_dist2 d ON b.department_id = d.department_id AND b.price = d.price
  LEFT JOIN r_dept e ON b.department_id = e.department_id),
r_prf AS (
  SELECT *, CAST(coalesce(price_percentile > 0.7, false) AS INTEGER) AS is_premium_priced FROM r_prf0),
r_dsf AS (
  SELECT *, {r2('premium_score * necessity_score')} AS revenue_potential,
         {r2('cross_sell_score * (10 - impulse_score)')} AS attr_basket_expansion_score,
         {r2('premium_score * price_percentile')} AS price_premium_alignment
  FROM r_prf)
"""
PRF_DOUBLES = ["premium_score", "necessity_score", "impulse_score", "cross_sell_score", "price",
               "price_percentile", "price_vs_dept_avg"]


def derived(spark, sf_dir):
    t = tables(spark, sf_dir)
    return features.derived_features(t["products"], t["product_attributes"])


@register("price_rank_features", sql(round_cols("SELECT * FROM r_prf", PRF_DOUBLES), FEAT_CTES))
def q_price_rank_features(spark, sf_dir):
    """D7 + F9 + C4 + F10: percentile in department (average ties), premium flag, price vs department mean."""
    t = tables(spark, sf_dir)
    return features.price_rank_features(t["products"], t["product_attributes"])


@register("derived_semantic_features", sql(round_cols(
    "SELECT * FROM r_dsf", PRF_DOUBLES + ["revenue_potential", "attr_basket_expansion_score",
                                          "price_premium_alignment"]), FEAT_CTES))
def q_derived_semantic_features(spark, sf_dir):
    """M4: all 12 derived product features (C3 at two digits, half-even)."""
    return derived(spark, sf_dir)


EVAL_CTES = HYB_CTES + """,
r_ev AS (
  SELECT label, CAST(ml_probability >= 0.5 AS INTEGER) AS prediction, ml_probability AS score FROM r_hyb)
"""


def eval_rows(spark, sf_dir):
    """Deterministic scored rows: score = ml_probability stand-in, prediction = score >= 0.5."""
    return hybrid(spark, sf_dir).select(
        "label", (F.col("ml_probability") >= 0.5).cast("int").alias("prediction"),
        F.col("ml_probability").alias("score"))


@register("class_distribution", sql(round_cols("""
SELECT reordered AS label, count(*) AS count, count(*) / (SELECT count(*) FROM r_merged)::DOUBLE AS share
FROM r_merged GROUP BY reordered""", ["share"])))
def q_class_distribution(spark, sf_dir):
    """Target distribution over all lines."""
    from cartwise.plans.q_prep import merged

    return evaluation.class_distribution(merged(spark, sf_dir).select(F.col("reordered").alias("label")))


@register("binary_metrics", sql(round_cols("""
SELECT avg(CAST(prediction = label AS DOUBLE)) AS accuracy, count(*) AS n FROM r_ev""", ["accuracy"]), EVAL_CTES))
def q_binary_metrics(spark, sf_dir):
    """L5 accuracy on deterministic scores."""
    return evaluation.binary_metrics(eval_rows(spark, sf_dir))


@register("roc_auc", sql(round_cols("""
SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc
FROM (SELECT s, pos, neg,
             CAST(coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS DOUBLE) AS below
      FROM (SELECT score AS s, sum(label) AS pos, sum(1 - label) AS neg FROM r_ev GROUP BY score))""",
    ["auc"]), EVAL_CTES))
def q_roc_auc(spark, sf_dir):
    """L5 exact AUC with tie averaging."""
    return evaluation.roc_auc(eval_rows(spark, sf_dir))


@register("confusion_matrix", sql("""
SELECT label, count_if(prediction = 0) AS pred_0, count_if(prediction = 1) AS pred_1 FROM r_ev GROUP BY label""",
                                  EVAL_CTES))
def q_confusion_matrix(spark, sf_dir):
    """L6."""
    return evaluation.confusion_matrix(eval_rows(spark, sf_dir))


@register("classification_report", sql(round_cols("""
WITH c AS (
  SELECT count_if(label = 0 AND prediction = 0) AS c00, count_if(label = 0 AND prediction = 1) AS c01,
         count_if(label = 1 AND prediction = 0) AS c10, count_if(label = 1 AND prediction = 1) AS c11 FROM r_ev),
k AS (
  SELECT '0' AS class, c00 AS tp, c10 AS fp, c01 AS fn FROM c
  UNION ALL SELECT '1', c11, c01, c10 FROM c),
p AS (
  SELECT class, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0.0) AS precision,
         coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0.0) AS recall, tp + fn AS support FROM k),
q AS (
  SELECT class, precision, recall,
         coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1, support FROM p)
SELECT class, precision, recall, f1, support FROM q
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM q
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), sum(support) FROM q""", ["precision", "recall", "f1"]),
    EVAL_CTES).replace("\nWITH c AS (", "\n, c AS (").replace("SELECT * REPLACE", "SELECT * REPLACE", 1))
def q_classification_report(spark, sf_dir):
    """Per-class precision/recall/F1/support with macro and weighted means."""
    return evaluation.classification_report(eval_rows(spark, sf_dir))
