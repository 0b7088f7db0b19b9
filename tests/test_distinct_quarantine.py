import os
import tempfile

from pyspark.sql import functions as F

from cartwise.operators import distinct
from cartwise.sources import files, schemas


def test_sketches_merge_to_the_whole_and_stay_in_the_bound(spark):
    lines = spark.range(60_000).select(
        (F.col("id") % 7 % 3).alias("product_id"), (F.col("id") * 31 % 20_011).alias("order_id"),
        (F.col("id") % 900).alias("user_id"), (F.col("id") % 5).alias("period"))
    exact = {r.product_id: (r.o, r.u) for r in lines.groupBy("product_id").agg(
        F.count_distinct("order_id").alias("o"), F.count_distinct("user_id").alias("u")).collect()}
    sketches = distinct.activity_sketches(lines, "period")
    whole = {r.product_id: (r.order_frequency, r.user_reach) for r in distinct.activity_estimates(sketches).collect()}
    assert whole.keys() == exact.keys()
    for p, found in whole.items():
        assert all(abs(a - b) <= distinct.BOUND * b for a, b in zip(found, exact[p]))
    # however the periods are put together on the way
    for first, second in ((("period < 2"), ("period >= 2")), (("period in (0, 3)"), ("period not in (0, 3)"))):
        parts = [distinct.merge_sketches(sketches.where(w), "product_id") for w in (first, second)]
        merged = distinct.activity_estimates(parts[0].unionByName(parts[1]))
        assert {r.product_id: (r.order_frequency, r.user_reach) for r in merged.collect()} == whole
    # a late period is added without the others' lines
    late = distinct.activity_sketches(lines.where("period = 4"), "period")
    kept = sketches.where("period < 4").unionByName(late)
    assert {r.product_id: r.user_reach for r in distinct.activity_estimates(kept).collect()} == {p: w[1] for p, w in whole.items()}


def _checked(spark, text, schema=schemas.ORDERS):
    path = os.path.join(tempfile.mkdtemp(prefix="cartwise-scan-"), "t.csv")
    with open(path, "w") as f:
        f.write(",".join(schema.fieldNames()) + "\n" + text)
    good, bad = files.read_checked(spark, path, schema)
    return good, {r.raw: r.reason for r in bad.collect()}


def test_each_kind_of_malformed_line(spark):
    good, bad = _checked(spark, "1,7,1,2,8,\n2,7,2,3,9,30.0\nx,7,3,1,8,1\n4,7,3,1,8,soon\n5,7,3\n6,7,3,1,8,1,2\n,7,4,1,8,3.5\n")
    assert sorted(r.order_id for r in good.collect()) == [1, 2]
    assert bad["x,7,3,1,8,1"] == "type:order_id" and bad["4,7,3,1,8,soon"] == "type:days_since_prior_order"
    assert bad["5,7,3"] == "fields" and bad["6,7,3,1,8,1,2"] == "fields"
    assert [r for r in bad.values() if r.startswith("required")] == ["required:order_id"]
    assert good.count() + len(bad) == 7


def test_quoted_values_empty_files_and_clean_files(spark):
    good, bad = _checked(spark, '1,"a, b",3,4\n2,plain,3,4\n', schemas.PRODUCTS)
    assert {r.product_id: r.product_name for r in good.collect()} == {1: "a, b", 2: "plain"} and bad == {}
    good, bad = _checked(spark, "")
    assert good.collect() == [] and bad == {} and good.columns == schemas.ORDERS.fieldNames()
