from collections import Counter

from pyspark.sql import functions as F

from cartwise.operators import heavy, pairs, recommend


def _baskets(spark):
    rows = [(b, 0) for b in range(3000)] + [(b, 1 + (b * 7 + k) % 400) for b in range(3000) for k in range(2)]
    return spark.createDataFrame(sorted(set(rows)), "basket_id bigint, product_id bigint")


def _edges(spark):
    rows = [(0, d, 2) for d in range(1, 30)] + [(s, (s * 3) % 400 + 1, 1) for s in range(1, 400)]
    rows += [(d, s, w) for s, d, w in rows]
    return spark.createDataFrame(sorted({(s, d): (s, d, w) for s, d, w in rows if s != d}.values()),
                                 "src bigint, dst bigint, weight bigint")


def test_sketch_finds_every_heavy_key_and_merges(spark):
    rows = [("hot",)] * 5000 + [(f"k{i % 3000}",) for i in range(9000)] + [(None,)] * 4000
    df = spark.createDataFrame(rows, "k string").withColumn("day", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(7)))
    whole = heavy.heavy_keys(heavy.frequency_sketch(df, "k"), "k", 1000).collect()
    merged = heavy.heavy_keys(heavy.merge_sketches(heavy.frequency_sketch(df, "k", ("day",))), "k", 1000).collect()
    for found in (whole, merged):
        assert [r["k"] for r in found] == ["hot"] and 5000 <= found[0]["n"] <= 5000 + 18000 * 4 / heavy.TRACKED


def test_sketch_of_few_counters_keeps_the_heavy_key(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    found = heavy.heavy_keys(heavy.frequency_sketch(df, "k", tracked=64), "k", 5000, most=64).collect()
    assert [r["k"] for r in found] == [-1]


def test_a_hot_item_is_dealt_evenly(spark):
    baskets = _baskets(spark).withColumnRenamed("product_id", "item")
    edges = _edges(spark).withColumnRenamed("src", "item")
    parts = heavy.parts_of(baskets, "item", 200)
    assert {r["item"]: r["parts"] for r in parts.collect()}[0] == 15
    left = heavy.with_parts(baskets, parts, "item").withColumn("part", heavy.part_of(F.col("parts"), "basket_id"))
    groups = [r["count"] for r in left.groupBy("item", "part").count().collect()]
    assert max(groups) < 2 * 200 < max(Counter(r["item"] for r in baskets.collect()).values())
    # the rows of a task of the join's shuffle, with as many tasks as a third of the hot item would fill
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = left.repartition(16, "item", "part").groupBy(F.spark_partition_id().alias("p")).count()
        sizes = sorted(r["count"] for r in dealt.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes[-1] < 2.5 * sizes[len(sizes) // 2]
    plain = Counter(tuple(r) for r in baskets.join(edges, "item").select("item", "basket_id", "dst", "weight").collect())
    split = heavy.salted_join(baskets, edges, "item", parts, ("basket_id",)).select("item", "basket_id", "dst", "weight")
    assert Counter(tuple(r) for r in split.collect()) == plain


def test_cross_sell_is_the_same_however_items_are_split(spark):
    baskets, edges = _baskets(spark), _edges(spark)
    feats = spark.range(0, 390).select(F.col("id").alias("product_id"), F.concat(F.lit("p"), "id").alias("product_name"),
                                       F.when(F.col("id") % 5 > 0, F.col("id") * 0.5).alias("price"),
                                       (F.col("id") % 7).cast("double").alias("basket_expansion_score"),
                                       (F.col("id") % 3).cast("double").alias("cross_sell_strength"))
    weight = {(r.src, r.dst): r.weight for r in edges.collect()}
    basket = {}
    for r in baskets.collect():
        basket.setdefault(r.basket_id, set()).add(r.product_id)
    expected = Counter()
    for b, own in basket.items():
        for (s, d), w in weight.items():
            if s in own and d not in own:
                expected[b, d] += w
    for rows in (50, heavy.ROWS):
        got = recommend.cross_sell_candidates(baskets, edges, heavy_rows=rows).collect()
        assert {(r.basket_id, r.product_id): r.network_strength for r in got} == expected
    tops = [sorted(map(tuple, recommend.cross_sell(baskets, edges, feats, 3, heavy_rows=rows).collect()), key=repr)
            for rows in (50, heavy.ROWS)]
    assert tops[0] == tops[1] and len(tops[0]) == 3 * len(basket)
    assert all(t[2] < 390 for t in tops[0])


def test_joins_of_empty_tables(spark):
    assert recommend.cross_sell_candidates(_baskets(spark).limit(0), _edges(spark)).collect() == []
    assert recommend.cross_sell_candidates(_baskets(spark).limit(5), _edges(spark).limit(0)).collect() == []
    lines = spark.createDataFrame([], "order_id bigint, product_id bigint, add_to_cart_order int")
    assert pairs.basket_pairs(lines).collect() == []
