"""Registered queries: reports over deterministic scores and a model-free importance.

The same report operators that the model queries use, on inputs that SQL can
replay: the key-hash probability against the hybrid score, and the distance
of the class means as importance.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise.operators import training
from cartwise.plans.oracle import round_cols, sql
from cartwise.plans.q_features import EVAL_CTES, hybrid
from cartwise.plans.q_models import _ALL_FEATURES, _ENH_CTES, matrix
from cartwise.plans.registry import register

SPREAD_CTES = _ENH_CTES + """,
r_imp AS (
""" + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(abs(avg(CASE WHEN reordered = 1 THEN coalesce({c}, 0)::DOUBLE END) "
    f"- avg(CASE WHEN reordered = 0 THEN coalesce({c}, 0)::DOUBLE END)) "
    f"/ nullif(max(coalesce({c}, 0)::DOUBLE) - min(coalesce({c}, 0)::DOUBLE), 0), 0.0) AS importance, "
    f"'{'Enhanced' if c in training.ENHANCED_FEATURES else 'Traditional'}' AS category FROM r_enh"
    for c in _ALL_FEATURES) + ")"


def spread(spark, sf_dir):
    return training.class_spread(matrix(spark, sf_dir, _ALL_FEATURES), _ALL_FEATURES)


@register("spread_importance", sql(round_cols("SELECT * FROM r_imp", ["importance"]), SPREAD_CTES))
def q_spread_importance(spark, sf_dir):
    """Model-free importance per feature with its category."""
    return spread(spark, sf_dir)


@register("spread_by_category", sql(round_cols("""
SELECT category, sum(importance) AS importance, count(*) AS n_features,
       sum(importance) / (SELECT sum(importance) FROM r_imp) * 100.0 AS share_pct
FROM r_imp GROUP BY category""", ["importance", "share_pct"]), SPREAD_CTES))
def q_spread_by_category(spark, sf_dir):
    """E7 + E8 + N8 over the model-free importance."""
    return training.importance_by_category(spread(spark, sf_dir))


@register("spread_ranking", sql(round_cols(
    "SELECT * FROM r_imp ORDER BY importance DESC, feature LIMIT 20", ["importance"]), SPREAD_CTES))
def q_spread_ranking(spark, sf_dir):
    """G1 + G2 + N9: the 20 features of most model-free importance."""
    return training.feature_ranking(spread(spark, sf_dir), 20)


def _auc_sql(score: str) -> str:
    return f"""(SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))
    FROM (SELECT pos, neg, CAST(coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                                AS DOUBLE) AS below
          FROM (SELECT {score} AS s, sum(label) AS pos, sum(1 - label) AS neg FROM r_hyb GROUP BY {score})))"""


COMPARE_CTES = EVAL_CTES + f""",
r_cmp AS (
  SELECT 'accuracy' AS metric, avg(CAST((ml_probability >= 0.5) = (label = 1) AS DOUBLE)) AS base,
         avg(CAST((hybrid_score >= 0.5) = (label = 1) AS DOUBLE)) AS enhanced FROM r_hyb
  UNION ALL SELECT 'auc', {_auc_sql('ml_probability')}, {_auc_sql('hybrid_score')}),
r_cmpx AS (SELECT *, (enhanced - base) / nullif(base, 0) * 100.0 AS improvement_pct FROM r_cmp)
"""


def compared(spark, sf_dir):
    rows = hybrid(spark, sf_dir)

    def scored(name, score):
        pred = rows.select("label", (F.col(score) >= 0.5).cast("int").alias("prediction"), F.col(score).alias("score"))
        return training.evaluate(pred, name)

    return training.model_comparison(scored("base", "ml_probability"), scored("enhanced", "hybrid_score"))


@register("score_comparison", sql(round_cols("SELECT * FROM r_cmpx", ["base", "enhanced", "improvement_pct"]),
                                  COMPARE_CTES))
def q_score_comparison(spark, sf_dir):
    """L9 + E17: key-hash probability against hybrid score, side by side."""
    return compared(spark, sf_dir)


@register("score_performance_summary", sql(round_cols("""
SELECT max(base) FILTER (metric = 'accuracy') AS base_accuracy, max(enhanced) FILTER (metric = 'accuracy') AS enhanced_accuracy,
       max(base) FILTER (metric = 'auc') AS base_auc, max(enhanced) FILTER (metric = 'auc') AS enhanced_auc,
       max(improvement_pct) FILTER (metric = 'accuracy') AS accuracy_improvement_pct,
       max(improvement_pct) FILTER (metric = 'auc') AS auc_improvement_pct
FROM r_cmpx""", ["base_accuracy", "enhanced_accuracy", "base_auc", "enhanced_auc", "accuracy_improvement_pct",
                 "auc_improvement_pct"]), COMPARE_CTES))
def q_score_performance_summary(spark, sf_dir):
    """N7 over the deterministic scores: accuracy, AUC and improvements in one row."""
    of = lambda metric, col: F.max(F.when(F.col("metric") == metric, F.col(col)))
    return compared(spark, sf_dir).agg(
        of("accuracy", "base").alias("base_accuracy"), of("accuracy", "enhanced").alias("enhanced_accuracy"),
        of("auc", "base").alias("base_auc"), of("auc", "enhanced").alias("enhanced_auc"),
        of("accuracy", "improvement_pct").alias("accuracy_improvement_pct"),
        of("auc", "improvement_pct").alias("auc_improvement_pct"))
