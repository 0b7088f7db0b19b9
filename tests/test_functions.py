import math

from pyspark.sql import functions as F

from cartwise.functions.expr import cosine, minmax, pct_change, round2, unit_hash


def test_round2_half_even_on_binary_value(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (0.575,)], "x double")
    got = [r[0] for r in df.select(round2("x")).collect()]
    assert got == [0.12, 0.38, 0.57]


def test_cosine_zero_vector_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine("a", "b")).collect()]
    assert got[0] == 0.0 and math.isclose(got[1], 1.0)


def test_pct_change_from_zero_is_null(spark):
    df = spark.createDataFrame([(5.0, 0.0), (6.0, 4.0)], "n double, b double")
    got = [r[0] for r in df.select(pct_change("n", "b")).collect()]
    assert got[0] is None and math.isclose(got[1], 50.0)


def test_minmax_constant_and_null(spark):
    df = spark.createDataFrame([(7.0,), (7.0,), (None,)], "x double")
    got = [r[0] for r in df.select(minmax("x", F.lit(7.0), F.lit(7.0))).collect()]
    assert got == [0.0, 0.0, 0.0]


def test_unit_hash_range_and_stability(spark):
    df = spark.range(1000)
    a = sorted(r[0] for r in df.select(unit_hash("id")).collect())
    b = sorted(r[0] for r in df.repartition(7).select(unit_hash("id")).collect())
    assert a == b and 0.0 <= a[0] and a[-1] < 1.0
