"""Mergeable distinct counts (E1): sketches per product and period instead of recounting.

A table of sketches has one row per product and period and is kept up by
writing the rows of a new period.  Any set of its rows merges to one count, the
same in whatever order and grouping; the exact operator (``expansion.product_activity``) has to read all lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base-two logarithm of the hashes that a sketch keeps: 2**12 are 32 KB at most and a standard error of about 1.6 %;
#: counts up to that are exact.
ENTRIES = 12
#: Relative error that an estimate stays in with 99.9 % of products: over three standard errors.
BOUND = 0.06
#: The measures of E1 that count distinct values, and their columns.
COUNTS = {"order_frequency": "order_id", "user_reach": "user_id"}


def activity_sketches(lines: DataFrame, period: str, entries: int = ENTRIES) -> DataFrame:
    """One row per product and ``period``: sketches of its orders and users, combined map-side."""
    return lines.groupBy("product_id", period).agg(
        *[F.theta_sketch_agg(F.col(c).cast("long"), F.lit(entries)).alias(f"{name}_sketch") for name, c in COUNTS.items()])


def merge_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches merged over everything but ``by``."""
    return sketches.groupBy(*by).agg(*[F.theta_union_agg(f"{n}_sketch", F.lit(ENTRIES)).alias(f"{n}_sketch") for n in COUNTS])


def estimates(sketches: DataFrame, *by: str) -> DataFrame:
    """``by`` and the estimated distinct counts of each row."""
    return sketches.select(*by, *[F.theta_sketch_estimate(f"{n}_sketch").alias(n) for n in COUNTS])


def activity_estimates(sketches: DataFrame) -> DataFrame:
    """product_id, order_frequency and user_reach, estimated over all periods."""
    return estimates(merge_sketches(sketches, "product_id"), "product_id")
