import math

from cartwise.operators import graph, pairs


def _lines(spark, baskets):
    rows = []
    for oid, items in enumerate(baskets):
        for pos, p in enumerate(items, start=1):
            rows.append((oid, p, pos))
    return spark.createDataFrame(rows, "order_id bigint, product_id bigint, add_to_cart_order int")


def _edges(spark, triples):
    rows = []
    for u, v, w in triples:
        rows += [(u, v, w), (v, u, w)]
    return spark.createDataFrame(rows, "src bigint, dst bigint, weight bigint")


def test_directed_pairs_last_inserted_weight(spark):
    lines = _lines(spark, [[1, 2]] * 6 + [[2, 1]] * 5)
    fp = pairs.frequent_pairs(lines, min_support=5, mode="directed")
    w = {(r.src, r.dst): r.weight for r in graph.edges_from_pairs(fp).collect()}
    assert w == {(1, 2): 5, (2, 1): 5}
    canon = pairs.frequent_pairs(lines, min_support=5, mode="canonical").collect()
    assert [(r.p1, r.p2, r.cnt) for r in canon] == [(1, 2, 11)]


def test_support_per_direction(spark):
    lines = _lines(spark, [[1, 2]] * 3 + [[2, 1]] * 3)
    assert pairs.frequent_pairs(lines, min_support=5, mode="directed").count() == 0
    canon = pairs.frequent_pairs(lines, min_support=5, mode="canonical").collect()
    assert [(r.p1, r.p2, r.cnt) for r in canon] == [(1, 2, 6)]


def test_empty_graph_summary(spark):
    lines = _lines(spark, [[1], [2]])
    e = graph.edges_from_pairs(pairs.frequent_pairs(lines, min_support=2))
    r = graph.network_summary(e).collect()[0]
    assert r.n_nodes == 0 and r.n_edges == 0 and r.avg_degree is None


def test_degree_star(spark):
    e = _edges(spark, [(0, i, 1) for i in range(1, 5)])
    d = {r.product_id: r.degree_centrality for r in graph.degree_centrality(e).collect()}
    assert d[0] == 1.0 and d[1] == 0.25


def test_betweenness_closed_forms(spark):
    path = {r.product_id: r.betweenness_centrality for r in graph.betweenness(_edges(spark, [(1, 2, 1), (2, 3, 1)]), k=None).collect()}
    assert math.isclose(path[2], 1.0) and path[1] == 0.0
    star = {r.product_id: r.betweenness_centrality
            for r in graph.betweenness(_edges(spark, [(0, i, 1) for i in range(1, 5)]), k=None).collect()}
    assert math.isclose(star[0], 1.0) and star[3] == 0.0
    cyc = graph.betweenness(_edges(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 1, 1)]), k=None).collect()
    assert all(math.isclose(r.betweenness_centrality, 1 / 6) for r in cyc)


def test_pagerank_regular_graph(spark):
    e = _edges(spark, [(1, 2, 3), (2, 3, 3), (3, 4, 3), (4, 1, 3)])
    pr = graph.pagerank(e).collect()
    assert all(math.isclose(r.pagerank, 0.25) for r in pr) and all(r.converged for r in pr)


def test_strength_is_mean_neighbour_weight(spark):
    e = _edges(spark, [(1, 2, 4), (1, 3, 6)])
    s = {r.product_id: r.cross_sell_strength for r in graph.cross_sell_strength(e).collect()}
    assert s == {1: 5.0, 2: 4.0, 3: 6.0}


def test_hot_order_block_split_equals_plain(spark):
    baskets = [list(range(1, 41))] + [[1, 2, 3], [2, 3, 4], [5, 6]] * 3
    lines = _lines(spark, baskets)
    plain = {tuple(r) for r in pairs.basket_pairs(lines).collect()}
    split = {tuple(r) for r in pairs.basket_pairs(lines, block=3).collect()}
    assert plain == split and len(plain) == 40 * 39 // 2 + 3 * 3 + 3 * 3 + 3 * 1


def _exchanges_above_scan(df, table):
    """Exchange nodes between the root of the executed plan and each scan of ``table``."""
    prepared = df._jdf.queryExecution().executedPlan().toString().split("\n")
    found, path = [], []
    for line in prepared:
        depth = len(line) - len(line.lstrip(" :+-"))
        path = [p for p in path if p[0] < depth] + [(depth, line)]
        if table in line and "Scan" in line:
            below_join = []
            for _, node in reversed(path[:-1]):
                if "Join" in node:
                    break
                below_join.append(node)
            found.append([x for x in below_join if "Exchange" in x])
    return found


def test_rounds_and_levels_never_shuffle_the_edges(spark):
    from cartwise.session import Bucketed

    e = _edges(spark, [(i, (i * 7 + k) % 500, 1 + k) for i in range(500) for k in range(1, 5)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    trans = Bucketed(e.selectExpr("src", "dst", "0.25D AS p"), "src", "t")
    try:
        ranks = e.selectExpr("src AS node", "0.002D AS rank").distinct()
        once = graph.pagerank_round(trans.table, ranks, 500, 0.85)
        cur = ranks.selectExpr("0L AS s", "node AS v", "1.0D AS sigma")
        level = graph.next_level(trans.table.select("src", "dst"), cur, cur.limit(3))
        for df in (once, level):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Bucketed: true" in plan.replace("Bucketed: false", "")
            found = _exchanges_above_scan(df, trans.name)
            assert found and not any(found), plan
        assert once.count() == 500
    finally:
        trans.drop()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rounds_keep_the_newest_stages_and_tables_are_dropped(spark):
    import os

    from cartwise.session import Rounds

    rounds = Rounds("kept", keep=2)
    for i in range(4):
        out = rounds.put(spark.range(i + 1))
    here = [os.path.exists(p.removeprefix("file:")) for p in rounds.paths]
    assert here == [True, True] and out.count() == 4 and len(rounds.paths) == 2
    before = {t.name for t in spark.catalog.listTables()}
    graph.centrality_table(_edges(spark, [(1, 2, 1), (2, 3, 4), (3, 4, 1)])).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_pairs_of_lines_bucketed_by_order_shuffle_no_lines(spark):
    from cartwise.session import Bucketed

    lines = _lines(spark, [[1, 2, 3], [2, 3, 4], [5, 6]] * 40)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    table = Bucketed(lines, "order_id", "lines")
    try:
        got = pairs.basket_pairs(table.table)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        assert got.count() == (3 + 3 + 1) * 40
        assert not pairs.pruning_pays(table.table, 2)
        assert pairs.pruning_pays(_lines(spark, [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(20)]), 2)
    finally:
        table.drop()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_late_pruning_equals_early_pruning_on_odd_lines(spark, monkeypatch):
    # product 9 has one line beside a repeated one: the pair is met twice, the product is not
    rows = [(1, 1, 1), (1, 1, 1), (1, 9, 2), (2, 1, 1), (2, 2, 2), (3, 1, 1), (3, 2, None), (4, 1, 1), (4, 2, 2),
            (5, None, 1), (5, 1, 2), (6, None, 1), (6, 1, 2), (7, 2, 1), (7, 1, 1)]
    lines = spark.createDataFrame(rows, "order_id bigint, product_id bigint, add_to_cart_order int")
    for mode in ("directed", "canonical"):
        for first in (None, 4):
            got = []
            for pays in (True, False):
                monkeypatch.setattr(pairs, "pruning_pays", lambda *_, pays=pays: pays)
                found = pairs.frequent_pairs(lines, 2, mode, max_orders=first)
                got.append((found.columns, sorted(tuple(r) for r in found.collect())))
            assert got[0] == got[1] and len(got[0][1]) == 1, got


def test_late_pruning_counts_the_lines_before_it_looks_up_their_products(spark, monkeypatch):
    lines, counted, count = _lines(spark, [[1, 2, 3], [2, 3, 4], [5, 6]] * 20), [], pairs.frequent_items
    monkeypatch.setattr(pairs, "frequent_items", lambda df, n: counted.append(df) or count(df, n))
    assert not pairs.pruning_pays(lines, 2)
    got = {(r["p1"], r["p2"]): r["cnt"] for r in pairs.frequent_pairs(lines, 2).collect()}
    assert got == {(1, 2): 20, (1, 3): 20, (2, 3): 40, (2, 4): 20, (3, 4): 20, (5, 6): 20}
    plan = counted[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(counted) == 1 and "Join" not in plan, plan
