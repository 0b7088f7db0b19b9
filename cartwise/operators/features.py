"""Product text and derived product features (J1, D6, M4: D7, F9, F10, C3, C4).

Department-level statistics are hot by nature (a few departments hold all
products), so none of them is a window over a department:
* rank percentile: aggregate to distinct (department, price) with counts,
  running counts by ranges of (department, price) (``order_stats``), join back;
* department mean: ``groupBy`` + join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.expr import exact_avg, round2
from cartwise.operators.order_stats import running_before


def product_text(products: DataFrame, departments: DataFrame, aisles: DataFrame) -> DataFrame:
    """products ⟕ departments ⟕ aisles; combined_text = name aisle department (NULL if any part is)."""
    p = products.join(departments, "department_id", "left").join(aisles, "aisle_id", "left")
    text = F.concat(F.col("product_name"), F.lit(" "), F.col("aisle"), F.lit(" "), F.col("department"))
    return p.select("product_id", "product_name", "department", "aisle", text.alias("combined_text")).dropDuplicates()


def rank_pct(df: DataFrame, group: str, value: str) -> DataFrame:
    """Adds ``<value>_pct_raw``: average-tie rank / count within ``group`` (NULL for NULL values).

    Equivalent to pandas ``rank(pct=True)``: (below + (ties + 1) / 2) / n.
    """
    dist = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_ties"))
    dist = running_before(dist, group, value, "_ties", "_below")
    totals = dist.groupBy(F.col(group).alias("_group")).agg(F.sum("_ties").alias("_n"))
    pct = (F.col("_below") + (F.col("_ties") + 1) / 2.0) / F.col("_n")
    dist = dist.join(totals, F.col(group).eqNullSafe(F.col("_group"))).select(group, value, pct.alias(f"{value}_pct_raw"))
    return df.join(dist, [group, value], "left")


def price_rank_features(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """products ⟕ attributes, then price_percentile, is_premium_priced, price_vs_dept_avg."""
    df = products.join(attributes, "product_id", "left")
    df = rank_pct(df, "department_id", "price")
    dept = df.groupBy("department_id").agg(exact_avg("price").alias("_dept_avg"))
    df = df.join(dept, "department_id", "left")
    pct = round2(F.col("price_pct_raw"))
    return df.withColumns(
        {
            "price_percentile": pct,
            "is_premium_priced": F.coalesce(pct > 0.7, F.lit(False)).cast("int"),
            "price_vs_dept_avg": round2(F.try_divide(F.col("price"), F.col("_dept_avg"))),
        }
    ).drop("price_pct_raw", "_dept_avg")


def derived_semantic_features(df: DataFrame) -> DataFrame:
    """revenue_potential, attribute basket_expansion_score, price_premium_alignment (C3), 2 digits."""
    return df.withColumns(
        {
            "revenue_potential": round2(F.col("premium_score") * F.col("necessity_score")),
            "attr_basket_expansion_score": round2(F.col("cross_sell_score") * (10 - F.col("impulse_score"))),
            "price_premium_alignment": round2(F.col("premium_score") * F.col("price_percentile")),
        }
    )


def derived_features(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """M4: all 12 attribute-based product features."""
    return derived_semantic_features(price_rank_features(products, attributes))
