import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwise.operators import expansion, features, order_stats, prep


def _column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


@pytest.mark.parametrize("buckets,few,cases", [
    (8, 3, [[5.0] * 50 + [7.0, 6.5], [-1e300, 1e300, 0.0, 1e-300, 5.0, 5.0, -2.0, 8.0, 8.5]]),
    (1024, 4096, [[3.0], [2.0**k for k in range(-500, 500)]]),
])
def test_quantiles_of_all_kinds_of_values(spark, buckets, few, cases):
    for values in cases:
        got = order_stats.quantiles(_column(spark, [*values, None]), "x", [0.0, 0.25, 0.5, 1.0], buckets, few)
        for p, q in zip([0.0, 0.25, 0.5, 1.0], got):
            at = (len(values) - 1) * p
            low, high = sorted(values)[math.floor(at)], sorted(values)[math.ceil(at)]
            want = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
            assert q == want


def test_quantiles_without_values_and_beyond_finite_ones(spark):
    assert order_stats.quantiles(_column(spark, [None, None]), "x", [0.5]) == [None]
    assert order_stats.quantiles(_column(spark, []), "x", [0.5, 1.0]) == [None, None]
    odd = _column(spark, [-math.inf, 1.0, 2.0, math.inf, math.nan])
    got = order_stats.quantiles(odd, "x", [0.0, 0.25, 0.5, 0.75, 1.0])
    assert got[:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got[4])


def test_a_million_distinct_values(spark):
    n = 1_000_003
    df = spark.range(n).select(((F.col("id") * 7919) % n / 1000.0).alias("x"))
    want = [np.quantile(np.arange(n) / 1000.0, p) for p in (0.1, 0.5, 0.999)]
    assert order_stats.quantiles(df, "x", [0.1, 0.5, 0.999]) == pytest.approx(want, rel=1e-12)


def _plan(df):
    return df._jdf.queryExecution().toString().lower()


def test_no_percentile_in_the_plans(spark):
    lines = spark.createDataFrame([(1, 2.0, None), (2, None, 3.0), (3, 9.0, 1.0)],
                                  "order_id long, price double, days_since_prior_order double")
    imputed = prep.impute_missing(lines)
    assert [r["price"] for r in imputed.orderBy("order_id").collect()] == [2.0, 5.5, 9.0]
    summary = expansion.score_summary(lines.withColumnRenamed("price", "basket_expansion_score"))
    assert [summary.first()[c] for c in ("p25", "p50", "p75")] == [3.75, 5.5, 7.25]
    for df in (imputed, summary):
        assert "percentile" not in _plan(df) and "median" not in _plan(df)


def test_running_sums_by_group(spark):
    rng = random.Random(4)
    rows = {(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(400)) for _ in range(900)}
    rows = [(g, v, rng.randrange(5)) for g, v in rows]
    df = spark.createDataFrame(rows, "g string, v int, n long")
    got = order_stats.running_before(df, "g", "v", "n").collect()
    want = Counter()
    for g, v, n in rows:
        want[g, v] = sum(m for h, w, m in rows if h == g and w < v)
    assert len(got) == len(rows) and all(r["before"] == want[r["g"], r["v"]] for r in got)
    assert order_stats.running_before(df.limit(0), "g", "v", "n").collect() == []


def test_rank_pct_has_no_window_of_a_department(spark):
    rows = [(i, 1 if i % 10 else 2, float(i % 37) if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "product_id int, department_id int, price double")
    ranked = features.rank_pct(df, "department_id", "price")
    for d in (1, 2):
        own = [p for _, g, p in rows if g == d and p is not None]
        for r in ranked.where(F.col("department_id") == d).collect():
            want = None if r.price is None else (sum(p < r.price for p in own) + (own.count(r.price) + 1) / 2) / len(own)
            assert r.price_pct_raw == (None if want is None else pytest.approx(want))
    assert "windowspecdefinition(department_id" not in _plan(ranked).replace("#", "").replace(" ", "")
    assert " window" not in _plan(ranked)
