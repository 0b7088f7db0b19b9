"""Preprocessing (N1): joins, imputation, user/product/recency features.

Scale notes
* No broadcast hints: AQE broadcasts a side, ``aisles`` and ``departments``
  included, only when its measured size is small, and splits skewed
  partitions otherwise.
* Per-user / per-product statistics are ``groupBy`` aggregates joined back on
  their key, not windows: partial aggregation keeps a hot user or product
  (a third of all rows) from landing in one window task, and AQE splits the
  hot partition of the join.
* The median is an exact order statistic found by narrowing ranges; it runs
  when the plan is built and enters it as a literal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.expr import exact_avg, exact_sum
from cartwise.operators.order_stats import quantiles
from cartwise.operators.sampling import hash_sample

PRODUCT_COLUMNS = ["product_id", "product_name", "aisle_id", "department_id", "aisle", "department"]


def product_dim(products: DataFrame, aisles: DataFrame, departments: DataFrame) -> DataFrame:
    """products ⋈ aisles ⋈ departments (inner), with the texts that the tables have."""
    out = products.join(aisles, "aisle_id").join(departments, "department_id")
    return out.select(*[c for c in PRODUCT_COLUMNS if c in out.columns])


def attach_prices(products: DataFrame, prices: DataFrame | None) -> DataFrame:
    """products ⟕ prices on product_id (D3); duplicate price rows fan out.

    Without a price table the column is NULL (optional source, A3).
    """
    if prices is None:
        return products.withColumn("price", F.lit(None).cast("double"))
    return products.join(prices.select("product_id", "price"), "product_id", "left")


def union_order_lines(prior: DataFrame, train: DataFrame) -> DataFrame:
    """UNION ALL of prior and train order lines (H1)."""
    return prior.unionByName(train)


def merge_order_lines(lines: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """lines ⋈ orders on order_id ⋈ products on product_id, both inner.

    Products without texts are joined first, and the lines are dealt by order
    for the second join: they come out as a table bucketed by order needs them.
    """
    if "product_name" in products.columns:
        return lines.join(orders, "order_id").join(products, "product_id")
    keys = ["product_id", "order_id"]
    rest = [c for df in (lines, orders, products) for c in df.columns if c not in keys]
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.join(products, "product_id").repartition(n, "order_id").join(orders, "order_id").select(*keys, *rest)


def without_texts(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the product texts."""
    texts = {"products": "product_name", "aisles": "aisle", "departments": "department"}
    return {**tables, **{name: tables[name].drop(text) for name, text in texts.items()}}


def merge_all(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(merged order lines, products with names and prices)."""
    prods = product_dim(tables["products"], tables["aisles"], tables["departments"])
    prods = attach_prices(prods, tables.get("product_prices"))
    lines = union_order_lines(tables["order_products_prior"], tables["order_products_train"])
    return merge_order_lines(lines, tables["orders"], prods), prods


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of NULLs per column (C13), one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in columns])


def impute_missing(merged: DataFrame) -> DataFrame:
    """days_since_prior_order NULL -> 0; price NULL -> median over lines.

    The median is exact: prices are counted per distinct price over all lines
    and the middle rank is found by narrowing ranges (``order_stats``).
    """
    (median_price,) = quantiles(merged, "price", [0.5])
    return merged.withColumns(
        {
            "days_since_prior_order": F.coalesce(F.col("days_since_prior_order"), F.lit(0.0)),
            "price": F.coalesce(F.col("price"), F.lit(median_price).cast("double")),
        }
    )


def user_stats(lines: DataFrame) -> DataFrame:
    """Per user (F1-F4): line count, max order number, mean and sum of price."""
    return lines.groupBy("user_id").agg(
        F.count("product_id").alias("average_basket_size"),
        F.max("order_number").alias("purchase_frequency"),
        exact_avg("price").alias("user_avg_order_value"),
        exact_sum("price").alias("user_total_spent"),
    )


def product_stats(lines: DataFrame) -> DataFrame:
    """Per product (F5, F6): mean reordered flag and summed price."""
    return lines.groupBy("product_id").agg(
        F.avg("reordered").alias("product_reorder_rate"),
        exact_sum("price").alias("product_revenue_contribution"),
    )


def user_product_stats(lines: DataFrame) -> DataFrame:
    """Per (user, product) (F8): last order number containing the product."""
    return lines.groupBy("user_id", "product_id").agg(F.max("order_number").alias("product_last_ordered"))


def add_base_features(merged: DataFrame) -> DataFrame:
    """User, product and recency features (F1-F8) on every line."""
    # User statistics ride on the (user, product) table (narrow, one row per
    # distinct pair), so the wide line table meets both in a single shuffle on
    # (user_id, product_id) and a second one on product_id: two shuffles of
    # the wide rows instead of three.
    per_pair = user_product_stats(merged).join(user_stats(merged), "user_id")
    out = merged.join(per_pair, ["user_id", "product_id"]).join(product_stats(merged), "product_id")
    return out.withColumn("order_recency", F.col("purchase_frequency") - F.col("order_number"))


def preprocess(tables: dict[str, DataFrame], fraction: float = 0.02, seed: int = 42, materialize=None):
    """(sampled lines, all feature lines, products).

    ``materialize`` (e.g. ``cartwise.session.materialize``) is applied to the
    merged lines, which four aggregates and the median read.
    """
    merged, prods = merge_all(tables)
    if materialize is not None:
        merged = materialize(merged, "merged")
    feats = add_base_features(impute_missing(merged))
    sampled = hash_sample(feats, fraction, ["order_id", "product_id"], seed=seed)
    return sampled, feats, prods
