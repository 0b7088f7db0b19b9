"""Recommendation operators: demo baskets, cross-sell, hybrid score, revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.operators import heavy


def first_items_per_user(lines: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` products of every user by (order_number, add_to_cart_order, product_id).

    ``row_number() <= n`` per user is planned with a WindowGroupLimit below
    the exchange, so a hot user only ships its first n rows per partition.
    """
    w = Window.partitionBy("user_id").orderBy("order_number", "add_to_cart_order", "product_id")
    return (
        lines.select("user_id", "order_id", "product_id", "order_number", "add_to_cart_order")
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= n)
        .select("user_id", "order_id", "product_id", "add_to_cart_order")
    )


# Hybrid score weights (ML probability, expansion, price, strength).
HYBRID_WEIGHTS = {"alpha": 0.4, "beta": 0.3, "gamma": 0.2, "delta": 0.1}
# Cross-sell score weights (network, expansion, price share, strength).
CROSS_SELL_WEIGHTS = {"network": 0.4, "expansion": 0.3, "price": 0.2, "strength": 0.1}


def product_features(lines: DataFrame, scored_products: DataFrame | None = None) -> DataFrame:
    """One row per product from its first line (C16) plus graph-side scores.

    Product-level columns are constant per product; "first" = smallest
    order_id, via ``min_by`` (a partial aggregate, no window).
    Expansion score and strength are NULL -> 0 as in the feature merge.
    """
    first = lines.groupBy("product_id").agg(
        F.min_by(F.struct("product_name", "price"), "order_id").alias("f")
    ).select("product_id", "f.product_name", "f.price")
    if scored_products is None:
        return first.withColumns({"basket_expansion_score": F.lit(0.0), "cross_sell_strength": F.lit(0.0)})
    sp = scored_products.select("product_id", "basket_expansion_score", "cross_sell_strength")
    return first.join(sp, "product_id", "left").withColumns(
        {
            "basket_expansion_score": F.coalesce("basket_expansion_score", F.lit(0.0)),
            "cross_sell_strength": F.coalesce("cross_sell_strength", F.lit(0.0)),
        }
    )


def cross_sell_candidates(baskets: DataFrame, edges: DataFrame, carry: tuple[str, ...] = (),
                          heavy_rows: int = heavy.ROWS) -> DataFrame:
    """Graph neighbours of basket items, minus the basket itself.

    basket_id, product_id (candidate), network_strength = sum of edge weights
    from the basket's items to the candidate, and the columns ``carry`` of
    the edges, which depend on the candidate alone.  An item of more than
    about ``heavy_rows`` basket lines is split: its lines are salted by basket
    and its edges repeated.  The neighbour fan-out and the basket's own items
    meet in one aggregate, combined map-side, that also drops the members.
    """
    b = baskets.select("basket_id", F.col("product_id").alias("item"))
    e = edges.select(F.col("src").alias("item"), "dst", F.col("weight").cast("double").alias("weight"), *carry)
    fan = heavy.salted_join(b, e, "item", heavy.parts_of(b, "item", heavy_rows), ("basket_id",))
    fan = fan.select("basket_id", F.col("dst").alias("product_id"), "weight", *carry, F.lit(False).alias("member"))
    own = baskets.select("basket_id", "product_id", F.lit(True).alias("member"))
    rows = fan.unionByName(own, allowMissingColumns=True).groupBy("basket_id", "product_id").agg(
        F.sum("weight").alias("network_strength"), *[F.max(c).alias(c) for c in carry], F.max("member").alias("member"))
    return rows.where(~F.col("member")).drop("member")


def cross_sell(baskets: DataFrame, edges: DataFrame, features: DataFrame, top_n: int = 5,
               weights: dict | None = None, heavy_rows: int = heavy.ROWS) -> DataFrame:
    """Top-n cross-sell recommendations for every basket at once.

    score = .4 network + .3 expansion + .2 price / max(price) + .1 strength;
    candidates without a feature row are dropped (D16); order by score desc,
    product_id.  The scores ride on the edges, so candidates are not joined
    to the features; names are joined to the top rows.  ``row_number() <= n``
    is planned as a WindowGroupLimit, so a large basket ships at most n
    candidates per map partition.
    """
    w = {**CROSS_SELL_WEIGHTS, **(weights or {})}
    max_price = features.agg(F.max("price")).scalar()
    carry = ("basket_expansion_score", "price", "cross_sell_strength")
    scores = features.select(F.col("product_id").alias("dst"), *carry)
    scored = cross_sell_candidates(baskets, edges.join(scores, "dst"), carry, heavy_rows).withColumn(
        "recommendation_score",
        F.lit(w["network"]) * F.col("network_strength")
        + F.lit(w["expansion"]) * F.col("basket_expansion_score")
        + F.lit(w["price"]) * F.try_divide(F.col("price"), max_price)
        + F.lit(w["strength"]) * F.col("cross_sell_strength"),
    )
    win = Window.partitionBy("basket_id").orderBy(F.desc("recommendation_score"), "product_id")
    top = scored.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= top_n)
    return top.join(features.select("product_id", "product_name"), "product_id").select(
        "basket_id", "rank", "product_id", "product_name", "price", "recommendation_score", "network_strength")


def hybrid_scores(rows: DataFrame, weights: dict | None = None) -> DataFrame:
    """Alpha p + beta expansion + gamma price_norm + delta strength.

    ``rows`` has ml_probability, basket_expansion_score, price,
    cross_sell_strength (NULL -> 0).  price_norm is min-max over the rows
    (0 without spread); strength is not normalised.  Weights are arguments,
    never shared mutable defaults.
    """
    w = {**HYBRID_WEIGHTS, **(weights or {})}
    r = rows.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
         for c in ("basket_expansion_score", "price", "cross_sell_strength")}
    )
    b = r.agg(F.struct(F.min("price").alias("lo"), F.max("price").alias("hi")).alias("b")).scalar()
    lo, hi = b.getField("lo"), b.getField("hi")
    price_norm = F.when(hi > lo, (F.col("price") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return r.withColumn(
        "hybrid_score",
        F.lit(w["alpha"]) * F.col("ml_probability")
        + F.lit(w["beta"]) * F.col("basket_expansion_score")
        + F.lit(w["gamma"]) * price_norm
        + F.lit(w["delta"]) * F.col("cross_sell_strength"),
    )


REVENUE_METRICS = ["precision", "total_revenue", "avg_revenue_per_rec", "avg_basket_expansion"]


def revenue_topk(rows: DataFrame, score_column: str, top_k: int = 1000, order_keys=("row_id",)) -> DataFrame:
    """Metrics of the top-k rows by score (ties: order keys ascending).

    precision = mean label, revenue = sum label * price, per recommendation =
    revenue / k requested, mean expansion.  The top-k is a
    TakeOrderedAndProject: each task keeps k rows, the final merge sees
    k x tasks rows.
    """
    top = rows.orderBy(F.desc(score_column), *order_keys).limit(int(top_k))
    revenue = F.sum(F.col("label") * F.col("price"))
    return top.agg(
        F.avg("label").alias("precision"),
        revenue.alias("total_revenue"),
        (revenue / F.lit(float(top_k))).alias("avg_revenue_per_rec"),
        F.avg("basket_expansion_score").alias("avg_basket_expansion"),
    ).select(F.lit(score_column).alias("strategy"), *REVENUE_METRICS)


def revenue_impact(metrics: DataFrame, base: str = "ml_probability", new: str = "hybrid_score") -> DataFrame:
    """Per metric, both strategies and the improvement in percent (NULL if base is 0).

    ``metrics`` holds one E12 row per strategy; a conditional aggregate puts
    the two side by side (no join), then the metrics are unpivoted.
    """
    from cartwise.functions.expr import pct_change

    side = metrics.agg(
        *[F.max(F.when(F.col("strategy") == base, F.col(m).cast("double"))).alias(f"b_{m}") for m in REVENUE_METRICS],
        *[F.max(F.when(F.col("strategy") == new, F.col(m).cast("double"))).alias(f"n_{m}") for m in REVENUE_METRICS],
    )
    stack = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("metric"),
                    F.col(f"b_{m}").alias("ml_only"),
                    F.col(f"n_{m}").alias("hybrid"),
                    pct_change(F.col(f"n_{m}"), F.col(f"b_{m}")).alias("improvement_pct"),
                )
                for m in REVENUE_METRICS
            ]
        )
    )
    return side.select(stack.alias("r")).select("r.*")
