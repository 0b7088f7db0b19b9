"""Basket-expansion potential per product (N2: E1-E3, D9, D10, C18, C19, E11).

Scale notes: the per-order basket size is a ``groupBy`` joined back on
``order_id``, not a window over the order.  The two distinct counts of E1 are
groups by (product, value) below one aggregate by product, so a hot product is
spread over tasks.
Min/max for normalisation are one global aggregate read through scalar
subqueries (merged into one by the optimizer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.expr import minmax
from cartwise.operators.graph import cross_sell_strength
from cartwise.operators.order_stats import quantiles

NORMALIZED = ["order_frequency", "user_reach", "avg_price", "reorder_rate", "avg_basket_size_with_product",
              "cross_sell_strength"]
# Weights of the composite basket expansion score.
SCORE_WEIGHTS = {
    "avg_basket_size_with_product_norm": 0.25,
    "cross_sell_strength_norm": 0.25,
    "reorder_rate_norm": 0.20,
    "avg_price_norm": 0.15,
    "user_reach_norm": 0.15,
}


def product_activity(lines: DataFrame) -> DataFrame:
    """Per product: distinct orders, distinct users, mean price, reorder rate.

    Lines are summed up per (product, order) first, which needs no shuffle
    where they are bucketed by order; distinct (product, user) pairs are added
    to those rows, and one aggregate by product counts both.
    """
    price = F.col("price").cast("decimal(18,4)")
    orders = lines.groupBy("product_id", "order_id").agg(
        F.sum(price).alias("spent"), F.count("price").alias("priced"),
        F.sum(F.col("reordered").cast("double")).alias("reorders"), F.count("reordered").alias("flagged"))
    users = lines.select("product_id", "user_id").distinct()
    rows = orders.unionByName(users, allowMissingColumns=True)
    return rows.groupBy("product_id").agg(
        F.count("order_id").alias("order_frequency"),
        F.count("user_id").alias("user_reach"),
        F.try_divide(F.sum("spent").cast("double"), F.sum("priced").cast("double")).alias("avg_price"),
        F.try_divide(F.sum("reorders"), F.sum("flagged")).alias("reorder_rate"),
    )


def basket_sizes(lines: DataFrame) -> DataFrame:
    """Lines per order."""
    return lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("basket_size"))


def basket_size_with_product(lines: DataFrame) -> DataFrame:
    """Mean size of the baskets containing each product."""
    return (
        lines.select("order_id", "product_id")
        .join(basket_sizes(lines), "order_id")
        .groupBy("product_id")
        .agg(F.avg("basket_size").alias("avg_basket_size_with_product"))
    )


def basket_metrics(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """E1 + E3 + cross-sell strength (NULL outside the graph)."""
    return (
        product_activity(lines)
        .join(basket_size_with_product(lines), "product_id", "left")
        .join(cross_sell_strength(edges), "product_id", "left")
    )


def normalize(metrics: DataFrame, columns: list[str] = NORMALIZED) -> DataFrame:
    """Min-max normalise each column to ``<col>_norm``; 0 when there is no spread."""
    present = [c for c in columns if c in metrics.columns]
    if not present:
        return metrics
    # One aggregate, one scalar subquery (a struct of all bounds); every
    # reference below is the same subquery, which Spark evaluates once.
    bounds = metrics.agg(
        F.struct(
            *[F.min(F.col(c).cast("double")).alias(f"{c}__lo") for c in present],
            *[F.max(F.col(c).cast("double")).alias(f"{c}__hi") for c in present],
        ).alias("b")
    ).scalar()
    cols = {}
    for c in present:
        lo, hi = bounds.getField(f"{c}__lo"), bounds.getField(f"{c}__hi")
        cols[f"{c}_norm"] = minmax(F.col(c).cast("double"), lo, hi)
    return metrics.withColumns(cols)


def expansion_score(normalized: DataFrame) -> DataFrame:
    """Weighted composite (C19); NULL propagates from missing parts."""
    score = None
    for c, w in SCORE_WEIGHTS.items():
        term = F.lit(w) * F.col(c)
        score = term if score is None else score + term
    return normalized.withColumn("basket_expansion_score", score)


def analyze_basket_expansion(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """Metrics, normalised metrics and the composite score per product."""
    return expansion_score(normalize(basket_metrics(lines, edges)))


def score_summary(scored: DataFrame, column: str = "basket_expansion_score") -> DataFrame:
    """describe(): count, mean, sample std, min, quartiles, max.

    The quartiles are exact order statistics found by narrowing ranges
    (``order_stats``); the rest is one aggregate.
    """
    c = F.col(column)
    quarter, half, three = (F.lit(q).cast("double") for q in quantiles(scored, column, [0.25, 0.5, 0.75]))
    return scored.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        F.max(c).alias("max"),
    ).select("count", "mean", "std", "min", quarter.alias("p25"), half.alias("p50"), three.alias("p75"), "max")


def top_products(scored: DataFrame, n: int = 5, column: str = "basket_expansion_score") -> DataFrame:
    """n best products by score, ties to the smallest id (G4 nlargest)."""
    return (
        scored.where(F.col(column).isNotNull())
        .orderBy(F.desc(column), "product_id")
        .limit(n)
        .select("product_id", column)
    )
