"""Column-expression helpers.  All JVM-side built-ins, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the seed every deterministic choice is keyed on.
SEED = 42
_TWO_32 = 4294967296.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round2(x) -> Column:
    """Two-digit half-even rounding of a double (0.125 -> 0.12, 0.375 -> 0.38).

    ``rint`` works on the binary value like numpy does; ``bround`` rounds the
    decimal text and differs on values such as 0.575.
    """
    return F.rint(_c(x) * 100.0) / 100.0


def unit_hash(*keys, seed: int | str = SEED) -> Column:
    """Deterministic uniform number in [0, 1) from key columns.

    First 8 hex digits of md5('<seed>|k1|k2..') as an integer / 2^32.  The same
    value is reproducible in any SQL engine with md5, so sampling and splits
    are replayable and independent of partitioning.
    """
    parts = [F.lit(str(seed))] + [_c(k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / _TWO_32


def exact_sum(x, scale: int = 4) -> Column:
    """Sum of a money column in exact DECIMAL, returned as double.

    The result does not depend on partitioning, task order or retries
    (a double sum does), so reruns and engines agree bit for bit.
    """
    return F.sum(_c(x).cast(f"decimal(18,{scale})")).cast("double")


def exact_avg(x, scale: int = 4) -> Column:
    """exact_sum / count of non-NULL values; NULL for no values."""
    return F.try_divide(exact_sum(x, scale), F.count(_c(x)).cast("double"))


def pct_change(new, base) -> Column:
    """100 * (new - base) / base; NULL when base is 0 (no division error)."""
    return F.try_divide(_c(new) - _c(base), _c(base)) * 100.0


def minmax(x, lo, hi) -> Column:
    """(x - lo) / (hi - lo), 0 when there is no spread (or no values)."""
    x, lo, hi = _c(x), _c(lo), _c(hi)
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(F.lit(0.0))


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def l2norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine similarity; 0 when either vector has zero length."""
    na = _c(norm_a) if norm_a is not None else l2norm(a)
    nb = _c(norm_b) if norm_b is not None else l2norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))
