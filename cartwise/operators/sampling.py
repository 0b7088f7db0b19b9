"""Deterministic sampling and splitting.

Every choice is a function of the row key through ``unit_hash``, so results
do not depend on partitioning, retries or executor loss, and SQL engines can
replay them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.functions.expr import SEED, unit_hash

# Buckets of each half of the hash, used to find the cut of an exact-size sample.
_BUCKETS = 1 << 16


def hash_sample(df: DataFrame, fraction: float, keys: list[str], seed: int = SEED) -> DataFrame:
    """Rows whose key hash is below ``fraction`` (about fraction * n rows)."""
    return df.where(unit_hash(*keys, seed=seed) < F.lit(float(fraction)))


def _half_even(x: float) -> int:
    return int(round(x))


def hash_sample_exact(
    df: DataFrame, keys: list[str], n: int | None = None, fraction: float | None = None, seed: int = SEED
) -> DataFrame:
    """Exactly ``n`` (or round(fraction * count)) rows with the smallest key hash.

    Distributed: the hash has 32 bits.  A histogram of its upper half (one
    small aggregate) gives the bucket in which the cut falls, a histogram of
    the lower half inside that bucket the very hash; rows below it are kept by
    a filter.  Only rows of that one hash (about count / 2^32) are ordered,
    by the key columns, to fill the rest.
    """
    h = unit_hash(*keys, seed=seed)
    tagged = df.withColumn("_h", (h * float(_BUCKETS * _BUCKETS)).cast("long"))
    if n is None:
        total = tagged.count()
        n = _half_even(float(fraction) * total)
    if n <= 0:
        return df.limit(0)
    high = _cut(tagged, F.shiftright("_h", 16), n)
    if high is None:
        return df
    first, rest = high
    low = _cut(tagged.where(F.shiftright("_h", 16) == first), F.col("_h").bitwiseAND(_BUCKETS - 1), rest)
    at = first * _BUCKETS + low[0]
    edge = tagged.where(F.col("_h") == at).orderBy(*keys).limit(int(low[1]))
    return tagged.where(F.col("_h") < at).unionByName(edge).drop("_h")


def _cut(rows: DataFrame, bucket, n: int) -> tuple[int, int] | None:
    """(bucket, rows wanted of it) where the first ``n`` rows by bucket end; None if there are no more than ``n``.

    There are at most 65536 buckets: a single ordered window over them is bounded.
    """
    hist = rows.groupBy(bucket.cast("long").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    cut = hist.withColumn("_upto", upto).where(F.col("_upto") >= n).orderBy("_b").limit(1).collect()
    return (cut[0]["_b"], n - (cut[0]["_upto"] - cut[0]["_n"])) if cut else None


def train_test_split(df: DataFrame, keys: list[str], test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds ``is_train``: hash of ('split', key) below 1 - test_size."""
    h = unit_hash(F.lit("split"), *keys, seed=seed)
    return df.withColumn("is_train", h < F.lit(1.0 - float(test_size)))
