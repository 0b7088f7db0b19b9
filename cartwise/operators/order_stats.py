"""Exact order statistics and running sums without an ordering in one task.

Order statistics: values are counted per distinct value first (combined
map-side), then a histogram over the range that holds a wanted rank narrows
that range until a few values are left.  Each round is one aggregate with a
bounded number of rows.

Running sums: rows lie in ranges of about equal size; the ranges' totals and
the rows inside a range are summed up on their own, so neither a hot group
nor the whole table meets in one window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.session import by_range, materialize

#: Buckets of a range in one round.
BUCKETS = 1024
#: Distinct values that are ordered outright.
FEW = 4096


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value double, n) of the non-NULL values, staged."""
    rows = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value"))
    return materialize(rows.agg(F.count(F.lit(1)).alias("n")), "value-counts")


def _at_ranks(counts: DataFrame, ranks: list[int], low: float, high: float, before: int, total: int,
              buckets: int, few: int) -> dict[int, float]:
    """Values at 0-based ``ranks``, all of which lie among the ``total`` rows in [low, high] after ``before`` others."""
    if low == high:
        return dict.fromkeys(ranks, low)
    here = counts.where(F.col("value").between(low, high))
    if total <= few:
        out, passed, wanted = {}, before, sorted(ranks)
        for r in here.orderBy("value").collect():
            passed += r["n"]
            while wanted and wanted[0] < passed:
                out[wanted.pop(0)] = r["value"]
        return out
    # halves of the ends, so that the width of a range does not overflow
    share = (F.col("value") / 2 - low / 2) / (high / 2 - low / 2)
    bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
    found = here.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("values"),
                                                F.min("value").alias("low"), F.max("value").alias("high"))
    out, passed = {}, before
    for r in sorted(found.collect(), key=lambda r: r["b"]):
        own = [k for k in ranks if passed <= k < passed + r["n"]]
        if own:
            out |= _at_ranks(counts, own, r["low"], r["high"], passed, r["values"], buckets, few)
        passed += r["n"]
    return out


def values_at(counts: DataFrame, ranks: Sequence[int], buckets: int = BUCKETS, few: int = FEW) -> dict[int, float]:
    """The values at 0-based ranks of a (value, n) table; infinities and then NaN come last as in Spark's order."""
    finite = F.abs("value") < float("inf")
    s = counts.agg(
        F.sum(F.when(F.col("value") == -math.inf, F.col("n"))).alias("first"), F.sum(F.when(finite, F.col("n"))).alias("n"),
        F.sum(F.when(F.col("value") == math.inf, F.col("n"))).alias("last"), F.count(F.when(finite, 1)).alias("values"),
        F.min(F.when(finite, F.col("value"))).alias("low"), F.max(F.when(finite, F.col("value"))).alias("high")).first()
    first, n, last = (s[c] or 0 for c in ("first", "n", "last"))
    inside = sorted({k for k in ranks if first <= k < first + n})
    out = _at_ranks(counts, inside, s["low"], s["high"], first, s["values"], buckets, few) if inside else {}
    for k in ranks:
        if k not in out:
            out[k] = -math.inf if k < first else math.inf if k < first + n + last else math.nan
    return out


def quantiles(df: DataFrame, column: str, fractions: Sequence[float], buckets: int = BUCKETS,
              few: int = FEW) -> list[float | None]:
    """Exact quantiles with linear interpolation; None for each where there are no values.

    The position of a fraction p among n values is (n - 1) p.  The driver sees
    ``buckets`` counts a round and ``few`` distinct values at the end.
    """
    counts = value_counts(df, column)
    n = counts.agg(F.sum("n")).first()[0] or 0
    if not n:
        return [None] * len(fractions)
    at = [(n - 1) * p for p in fractions]
    found = values_at(counts, sorted({f(x) for x in at for f in (math.floor, math.ceil)}), buckets, few)
    out = []
    for x in at:
        low, high = math.floor(x), math.ceil(x)
        a, b = found[low], found[high]
        out.append(a if low == high or a == b else (high - x) * a + (x - low) * b)
    return out


def running_before(df: DataFrame, group: str, value: str, n: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``n`` over the rows of its group that stand before it by ``value``.

    (group, value) is unique.  Rows are range-partitioned by it.  A running
    sum over the ranges' totals and one inside each range give the sum before
    a row over all groups, and the least of a group is where the group starts.
    """
    rows = by_range(df, group, value, name="_range")
    ranges = rows.groupBy("_range").agg(F.sum(n).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_range").orderBy(group, value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(ranges, "_range")
    rows = materialize(rows.withColumn("_all", F.col("_inside") + F.col("_shift")).drop("_inside", "_shift", "_range"), "running")
    starts = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_all").alias("_start"))
    out = rows.join(starts, F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn(name, F.col("_all") - F.col("_start")).drop("_all", "_start", "_group")
