import datetime
import random

from cartwise.sources import testdata


def _write(spark, d, seed=3):
    """orders and lineitem with NULL keys, repeated rows, orders without lines and one frequent customer."""
    r = random.Random(seed)
    day = lambda: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=r.randrange(40))
    orders = [(k, r.choice([None, 1, 1, 1, 2, 3, 4]), day()) for k in range(60)]
    orders += [orders[5], orders[17], (None, 1, day())]
    lines = [(r.choice([None, *range(0, 50), 99]), r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, 1, 2, 3])) for _ in range(400)]
    lines += lines[:20]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    return orders, lines


def _expected(orders, lines):
    users, numbered = {}, []
    for o in sorted(orders, key=lambda o: (o[2], -1 if o[0] is None else o[0])):
        users[o[1]] = users.get(o[1], 0) + 1
        numbered.append((o[0], o[1], users[o[1]]))
    distinct = {}
    for o, p, n in lines:
        if o is not None:
            distinct.setdefault((o, p), []).append(n)
    met = [(o, p, u, k, ns) for (o, p), ns in distinct.items() for key, u, k in numbered if key == o and u is not None]
    out = []
    for o, p, u, k, ns in met:
        if p is None:
            continue
        first = min(x[3] for x in met if x[2] == u and x[1] == p)
        last = max(x[3] for x in met if x[2] == u)
        out.append((o, p, min((n for n in ns if n is not None), default=None), int(k > first), k == last))
    return sorted(out, key=repr)


def test_order_lines_match_plain_loops_on_odd_rows(spark, tmp_path):
    d = str(tmp_path)
    want = _expected(*_write(spark, d))
    got = sorted((tuple(r) for r in testdata._order_lines(spark, d).collect()), key=repr)
    assert got == want and len(want) > 100


def test_order_lines_shuffle_the_lines_twice(spark, tmp_path):
    d = str(tmp_path)
    _write(spark, d)
    plan = testdata._order_lines(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    # one scan for the lines, one for the keys of the orders that have any
    assert plan.count("l_partkey") and sum("Relation" in x and "l_orderkey" in x for x in plan.splitlines()) == 2
    assert "Aggregate [user_id" in plan and plan.count("RepartitionByExpression") == 1


def test_basket_queries_merge_the_lines_once(spark, monkeypatch):
    from cartwise.operators import prep
    from cartwise.plans import registry

    registry.load_all()
    calls, merge = [], prep.merge_all
    monkeypatch.setattr(prep, "merge_all", lambda tables: calls.append(1) or merge(tables))
    assert registry.QUERIES["basket_metrics"](spark, "/root/testdata/sf0.001").count() > 100
    assert len(calls) == 1


def test_orders_are_shuffled_once_by_user(spark, tmp_path):
    d = str(tmp_path)
    orders, _ = _write(spark, d)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = testdata._numbered_orders(spark, d)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # both windows by user on one shuffle, and one a side of the join by order
        assert plan.count("Window [") == 2 and plan.count("Exchange hashpartitioning") == 3, plan
        assert got.count() == len(orders) and got.columns == [*testdata.ORDER_COLUMNS, "is_last"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_score_queries_stage_no_more_columns_than_they_read(spark, monkeypatch):
    from cartwise import session
    from cartwise.plans import q_features, q_prep, registry

    r = random.Random(5)
    rows = [(p, o, o % 7, 1 + o // 7, o % 5, o % 24, None if o < 7 else 3.0, n, r.randrange(2), 1, 2, None if p == 4 else float(p))
            for o in range(60) for n, p in enumerate(r.sample(range(1, 9), 3), 1)]
    lines = spark.createDataFrame(rows, """product_id long, order_id long, user_id long, order_number int, order_dow int,
        order_hour_of_day int, days_since_prior_order double, add_to_cart_order int, reordered int, aisle_id int,
        department_id int, price double""").repartition(4, "order_id")
    merged = []
    monkeypatch.setattr(q_prep, "thin_merged", lambda *_: merged.append(1) or lines)
    registry._SCOPE.append({})
    known = len(session._TABLES)
    try:
        got = q_features.eval_rows(spark, "own rows")
        assert got.columns == ["label", "prediction", "score"] and 10 < got.count() < 100
    finally:
        registry._SCOPE.pop()
    assert len(merged) == 1 and [t.table.columns for t in session._TABLES[known:]] == [q_prep.SCORE_COLUMNS]
