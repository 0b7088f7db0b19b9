import numpy as np
from pyspark.sql import functions as F

from cartwise.operators import balance, enrich, training


def test_price_reply_lines(spark):
    members = spark.createDataFrame([(i, f"n{i}", 0, i) for i in range(1, 7)],
                                    "product_id bigint, product_name string, batch_id long, pos int")
    reply = "1. $1,234.50\n2. abc\n3.99\n12\n5. 3.5"
    replies = spark.createDataFrame([(0, reply)], "batch_id long, reply string")
    got = {r.pos: r.price for r in enrich.parse_price_replies(replies, members).collect()}
    assert got == {1: 1234.5, 2: 0.0, 3: 99.0, 4: 12.0, 5: 3.5, 6: None}


def test_short_and_repeated_replies(spark):
    members = spark.createDataFrame([(1, "a", 0, 1), (2, "b", 0, 2)],
                                    "product_id bigint, product_name string, batch_id long, pos int")
    replies = spark.createDataFrame([(0, "1. 5"), (0, "1. 5")], "batch_id long, reply string")
    parsed = enrich.parse_price_replies(replies, members)
    assert parsed.count() == 2
    left = enrich.pending(members.select("product_id"), enrich.priced(parsed)).collect()
    assert [r.product_id for r in left] == [2]
    longer = replies.unionByName(spark.createDataFrame([(0, "1. 5\n2. 6")], "batch_id long, reply string"))
    assert sorted(r.price for r in enrich.parse_price_replies(longer, members).collect()) == [5.0, 6.0]


def test_category_reply_short_and_long(spark):
    members = spark.createDataFrame([(i, f"n{i}", 0, i) for i in range(1, 4)] + [(i, f"n{i}", 1, i - 3) for i in range(4, 7)],
                                    "product_id bigint, product_name string, batch_id long, pos int")
    replies = spark.createDataFrame([(0, "a, b"), (1, " c,d , e, f")], "batch_id long, reply string")
    got = {r.product_id: r.llm_category for r in enrich.parse_category_replies(replies, members).collect()}
    assert got == {1: "a", 2: "b", 4: "c", 5: "d", 6: "e"}


def test_attribute_reply_default(spark):
    replies = spark.createDataFrame([(1, '{"premium_score": '), (2, '{"premium_score":1,"necessity_score":2,'
                                     '"impulse_score":3,"cross_sell_score":4,"is_food":1,"price":2.5}')],
                                    "product_id bigint, reply string")
    got = {r.product_id: r for r in enrich.parse_attribute_replies(replies).collect()}
    assert (got[1].premium_score, got[1].is_food, got[1].price, got[1].is_default) == (5.0, 0, 3.99, True)
    assert (got[2].cross_sell_score, got[2].is_default) == (4.0, False)


def test_resume_adds_nothing_twice(spark):
    products = spark.range(1, 1201).select(F.col("id").alias("product_id"), F.concat(F.lit("p"), "id").alias("product_name"))
    members, req = enrich.price_requests(products)
    assert req.count() == 3 and members.agg(F.max("pos")).first()[0] == 500
    done = members.select("product_id")
    members2, req2 = enrich.price_requests(products, done)
    assert req2.count() == 0 and members2.count() == 0


def test_smote_with_few_minority_rows(spark):
    rows = [(i, float(i), 0) for i in range(20)] + [(100, 1.0, 1), (101, 2.0, 1)]
    df = spark.createDataFrame(rows, "row_id long, f double, label int")
    for part, low, high in ((df, 1.0, 2.0), (df.where("row_id <> 101"), 1.0, 1.0)):
        out = balance.smote(part, ["f"], id_cols=("row_id",))
        assert out.where("label = 1").count() == 20
        assert out.where("label = 1").agg(F.min("f"), F.max("f")).first()[0] >= low
        assert out.where("label = 1").agg(F.max("f")).first()[0] <= high


def test_smote_with_both_classes_above_the_bound(spark):
    rows = [(i, i, float(i), int(i % 10 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "order_id long, product_id long, f double, reordered int")
    part = training.labelled_share(df, ["order_id", "product_id"], n=100)
    n = {r.reordered: r.n for r in part.groupBy("reordered").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert 60 < n[1] < 150 and 7 < n[0] / n[1] < 13
    out = balance.smote(training.training_matrix(part, ["f"]), ["f"])
    got = {(r.label, r.is_synthetic): r.n for r in balance.class_counts(out).collect()}
    assert got == {(0, False): n[0], (1, False): n[1], (1, True): n[0] - n[1]}
    even = df.where("reordered = 1").limit(100).unionByName(df.where("reordered = 0").limit(100))
    same = training.training_matrix(even, ["f"])
    got = {(r.label, r.is_synthetic): r.n for r in balance.class_counts(balance.smote(same, ["f"])).collect()}
    assert got == {(0, False): 100, (1, False): 100, (0, True): 0}


def test_smote_balances_on_segments(spark):
    rows = [(i, float(i), float(-i), 0) for i in range(40)] + [(100 + i, 100.0 + i, 5.0, 1) for i in range(8)]
    df = spark.createDataFrame(rows, "row_id long, f double, g double, label int")
    out = balance.smote(df, ["f", "g"], id_cols=("row_id",))
    counts = {r.label: r.n for r in out.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts[0] == counts[1] == 40
    syn = out.where("is_synthetic").collect()
    assert all(100.0 <= r.f <= 107.0 and r.g == 5.0 for r in syn)


def test_neighbours_are_exact_for_large_offsets_and_many_blocks(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([1e9 + rng.standard_normal(300), rng.standard_normal(300) * 3])
    x[10] = x[11] = x[12]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<double>")
    expect = set()
    for i in range(300):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(300), d)) if j != i][:5]
        expect |= {(i, r + 1, int(j)) for r, j in enumerate(order)}
    for block in (4096, 40):
        got = {(r.idx, r.rank, r.nb_idx) for r in balance.minority_neighbors(df, 5, block).collect()}
        assert got == expect


def _nearest(x, k):
    out = set()
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:k]
        out |= {(i, r + 1, int(j)) for r, j in enumerate(order)}
    return out


def test_copies_and_few_rows_have_all_their_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (400, 2)).astype(float)
    x[:150] = [2.0, 2.0]  # a hot group of equal rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<double>").repartition(5)
    for block, pivots, bins in ((20, 4, 3), (4096, 16, 64), (3, 16, 64)):
        got = {(r.idx, r.rank, r.nb_idx) for r in balance.minority_neighbors(df, 5, block, pivots, bins).collect()}
        assert got == _nearest(x, 5)
    few = {(r.idx, r.rank, r.nb_idx) for r in balance.minority_neighbors(df.where("idx in (1, 2, 300)"), 5).collect()}
    assert {(i, j) for i, _, j in few} == {(i, j) for i in (1, 2, 300) for j in (1, 2, 300) if i != j}
    assert balance.minority_neighbors(df.limit(0), 5).collect() == []


def test_pivots_skip_most_pairs_of_blocks(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.exponential(1000, 4000), rng.standard_normal(4000) * 20, rng.integers(0, 24, 4000)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<double>")
    blocks = balance.Blocks(df, 4000, block_rows=50, pivots=8, bins=16)
    inside = blocks.rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).groupBy("block", "slot").applyInArrow(
        balance._nearest(5), balance._NEAR)
    visits = blocks.visits(inside, 5)
    slots = int(blocks.slots.sum())
    assert slots > 60
    # a row is compared with a small part of all slots, and no slot that holds a neighbour is left out
    assert visits.count() < 0.2 * 4000 * slots
    place = {r.idx: (r.block, r.slot) for r in blocks.rows.collect()}
    seen = {(r.idx, r.block, r.slot) for r in visits.collect()}
    for i, _, j in _nearest(x[:], 5):
        assert place[i] == place[j] or (i, *place[j]) in seen


def test_search_points_differ_to_the_trainer():
    points = training.choose_param_maps(10)
    assert len({(p["numTrees"], p["maxDepth"], training.least_rows(p)) for p in points}) == 10
    assert training.least_rows({"minInstancesPerNode": 1, "min_samples_split": 10}) == 5
    assert training.least_rows({"minInstancesPerNode": 4, "min_samples_split": 2}) == 4


def test_smote_rows_hash_once_and_lie_between_neighbours(spark):
    from cartwise.functions.expr import SEED, unit_hash

    df = spark.range(40).selectExpr("id AS row_id", "CAST(id AS DOUBLE) AS f", "CAST(id * id AS DOUBLE) AS g",
                                    "IF(id < 10, 1, 0) AS label")
    out = balance.smote(df, ["f", "g"], id_cols=("row_id",))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("zip_with") == 0
    syn = out.where("is_synthetic").withColumn("u", unit_hash(F.lit("u"), "synthetic_no", seed=SEED)).collect()
    ends = {(a, b): (float(a), float(b)) for a in range(10) for b in range(10) if a != b}
    for r in syn:  # one u for both features: on the line between the same two rows
        assert any(r.f == a + r.u * (b - a) and r.g == a * a + r.u * (b * b - a * a) for a, b in ends.values())
    assert len(syn) == 20


def test_labelled_share_is_hashed_once_and_whole_where_small(spark):
    df = spark.range(400).selectExpr("id AS order_id", "id AS product_id", "CAST(id % 2 AS INT) AS reordered")
    few = training.labelled_share(df, ["order_id", "product_id"], n=200)
    assert few.count() == 400 and "md5" not in few._jdf.queryExecution().optimizedPlan().toString()
    part = training.labelled_share(df, ["order_id", "product_id"], n=50)
    plan = part._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < part.count() < 200 and "md5" not in plan


def test_rows_of_a_large_fit_do_not_hang_on_their_order(spark):
    rows = spark.range(1000).selectExpr("id AS order_id", "id % 7 AS product_id", "CAST(id AS DOUBLE) AS f")
    dealt = [training.dealt_for_fit(r, ["order_id", "product_id"], training.DEALT_ROWS) for r in (rows, rows.orderBy(F.desc("f")).repartition(3))]
    a, b = [d.withColumn("at", F.spark_partition_id()).collect() for d in dealt]
    assert dealt[0].rdd.getNumPartitions() == training.FIT_FILES
    assert a == b and len(a) == 1000
    assert training.dealt_for_fit(rows, ["order_id"], training.DEALT_ROWS - 1) is rows
