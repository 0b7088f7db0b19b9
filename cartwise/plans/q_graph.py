"""Registered queries: pairs, graph and basket expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise.operators import distinct, expansion, graph, pairs
from cartwise.plans.oracle import _xavg, round_cols, sql
from cartwise.plans.q_prep import merged, score_imputed, thin_merged
from cartwise.plans.registry import once, register, stage, staged

# Fixed value used by the checked queries: at the test scales support 5 leaves
# (almost) no pair, support 2 leaves thousands (see FIXTURES.md).
MIN_SUPPORT = 2
PAGERANK_ROUNDS = 20


def pair_lines(spark, sf_dir):
    """Order, product and position of every merged line, staged: mining reads them four times.

    A query that has staged wider lines reads them, and merges the lines no second time.
    """
    columns = ["order_id", "product_id", "add_to_cart_order"]
    for wider in ("lines", "score-lines"):
        if (lines := staged(wider, spark, sf_dir)) is not None:
            return lines.select(*columns)
    return stage("pair-lines", spark, sf_dir, lambda: thin_merged(spark, sf_dir).select(*columns), by="order_id")


def freq_pairs(spark, sf_dir, mode="directed"):
    """Frequent pairs, mined once a query."""
    return once(f"freq-pairs-{mode}", spark, sf_dir,
                lambda: pairs.frequent_pairs(pair_lines(spark, sf_dir), min_support=MIN_SUPPORT, mode=mode))


def edges(spark, sf_dir):
    """Symmetric edges, materialised: every graph measure reads them."""
    return stage("edges", spark, sf_dir, lambda: graph.edges_from_pairs(freq_pairs(spark, sf_dir)))


PAIR_CTES = f"""
r_pl AS (SELECT order_id, product_id, add_to_cart_order AS pos FROM r_merged),
r_fi AS (SELECT product_id FROM r_pl GROUP BY product_id HAVING count(DISTINCT order_id) >= {MIN_SUPPORT}),
r_pl2 AS (SELECT * FROM r_pl WHERE product_id IN (SELECT product_id FROM r_fi)),
r_pairs AS (
  SELECT a.order_id, a.product_id AS p1, b.product_id AS p2, a.pos AS pos1, b.pos AS pos2
  FROM r_pl2 a JOIN r_pl2 b ON a.order_id = b.order_id
   AND (a.pos < b.pos OR (a.pos = b.pos AND a.product_id < b.product_id))),
r_fp AS (
  SELECT p1, p2, count(*) AS cnt, min(order_id) AS first_order FROM r_pairs
  GROUP BY p1, p2 HAVING count(*) >= {MIN_SUPPORT}),
r_und AS (
  SELECT least(p1, p2) AS u, greatest(p1, p2) AS v, arg_max(cnt, first_order) AS weight
  FROM r_fp GROUP BY 1, 2),
r_edges AS (
  SELECT u AS src, v AS dst, weight FROM r_und
  UNION ALL SELECT v AS src, u AS dst, weight FROM r_und WHERE u <> v),
r_strength AS (
  SELECT src AS product_id, avg(CAST(weight AS DOUBLE)) AS cross_sell_strength FROM r_edges GROUP BY src)
"""


def _pr_ctes(rounds: int) -> str:
    out = [
        "r_wout AS (SELECT src, sum(CAST(weight AS DOUBLE)) AS w_out FROM r_edges GROUP BY src)",
        "r_trans AS (SELECT e.src, e.dst, e.weight / w.w_out AS p FROM r_edges e JOIN r_wout w ON e.src = w.src)",
        "r_nodes AS (SELECT DISTINCT src AS node FROM r_trans)",
        "r_nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM r_nodes)",
        "r_pr0 AS (SELECT node, 1.0::DOUBLE / (SELECT n FROM r_nn) AS rank FROM r_nodes)",
    ]
    for i in range(1, rounds + 1):
        out.append(
            f"r_pr{i} AS (SELECT nd.node, 0.15::DOUBLE / (SELECT n FROM r_nn) + 0.85::DOUBLE * coalesce(c.s, 0.0) "
            f"AS rank FROM r_nodes nd LEFT JOIN (SELECT t.dst, sum(t.p * r.rank) AS s FROM r_trans t "
            f"JOIN r_pr{i - 1} r ON t.src = r.node GROUP BY t.dst) c ON nd.node = c.dst)"
        )
    return ",\n".join(out)


@register("sample_orders", sql("SELECT DISTINCT order_id FROM r_merged ORDER BY order_id LIMIT 10000"))
def q_sample_orders(spark, sf_dir):
    """The first 10000 distinct orders (the reference's mining window; a parameter)."""
    return pairs.first_orders(merged(spark, sf_dir), 10000)


@register("basket_pairs", sql("""
SELECT a.order_id, a.product_id AS p1, b.product_id AS p2, a.pos AS pos1, b.pos AS pos2
FROM r_pl a JOIN r_pl b ON a.order_id = b.order_id
 AND (a.pos < b.pos OR (a.pos = b.pos AND a.product_id < b.product_id))""", PAIR_CTES))
def q_basket_pairs(spark, sf_dir):
    """Every ordered pair inside every order."""
    return pairs.basket_pairs(pair_lines(spark, sf_dir))


@register("frequent_pairs", sql("SELECT * FROM r_fp", PAIR_CTES))
def q_frequent_pairs(spark, sf_dir):
    """E5 + C8, directed by basket position, support >= 2 per direction."""
    return freq_pairs(spark, sf_dir)


@register("frequent_pairs_canonical", sql(f"""
SELECT least(p1, p2) AS p1, greatest(p1, p2) AS p2, count(*) AS cnt FROM r_pairs
GROUP BY 1, 2 HAVING count(*) >= {MIN_SUPPORT}""", PAIR_CTES))
def q_frequent_pairs_canonical(spark, sf_dir):
    """E5 + C8, order-free pairs."""
    return freq_pairs(spark, sf_dir, mode="canonical")


@register("edges", sql("SELECT * FROM r_edges", PAIR_CTES))
def q_edges(spark, sf_dir):
    """K1: symmetric weighted edges."""
    return edges(spark, sf_dir)


@register("network_summary", sql("""
SELECT count(DISTINCT src) AS n_nodes, count_if(src <= dst) AS n_edges,
       CAST(2 * count_if(src <= dst) AS DOUBLE) / nullif(count(DISTINCT src), 0) AS avg_degree
FROM r_edges""", PAIR_CTES))
def q_network_summary(spark, sf_dir):
    """E14."""
    return graph.network_summary(edges(spark, sf_dir))


@register("degree_centrality", sql(round_cols("""
SELECT src AS product_id,
       CASE WHEN (SELECT count(DISTINCT src) FROM r_edges) > 1
            THEN CAST(count(*) + count_if(src = dst) AS DOUBLE) / ((SELECT count(DISTINCT src) FROM r_edges) - 1)
            ELSE 1.0::DOUBLE END AS degree_centrality
FROM r_edges GROUP BY src""", ["degree_centrality"]), PAIR_CTES))
def q_degree_centrality(spark, sf_dir):
    """K2."""
    return graph.degree_centrality(edges(spark, sf_dir))


@register("cross_sell_strength", sql(round_cols("""
SELECT p.product_id, s.cross_sell_strength FROM r_product_dim p LEFT JOIN r_strength s
ON p.product_id = s.product_id""", ["cross_sell_strength"]), PAIR_CTES))
def q_cross_sell_strength(spark, sf_dir):
    """Mean neighbour weight; NULL for products outside the graph."""
    from cartwise.plans.q_prep import tables
    from cartwise.operators import prep

    t = tables(spark, sf_dir)
    prods = prep.product_dim(t["products"], t["aisles"], t["departments"]).select("product_id")
    return prods.join(graph.cross_sell_strength(edges(spark, sf_dir)), "product_id", "left")


@register("pagerank", sql(round_cols("SELECT node AS product_id, rank AS pagerank FROM r_pr%d" % PAGERANK_ROUNDS,
                                     ["pagerank"]), PAIR_CTES + ",\n" + _pr_ctes(PAGERANK_ROUNDS)))
def q_pagerank(spark, sf_dir):
    """K4 with a fixed number of rounds (oracle: the same rounds unrolled)."""
    pr = graph.pagerank(edges(spark, sf_dir), fixed_iterations=PAGERANK_ROUNDS)
    return pr.select("product_id", "pagerank")


def _pr_converged_ctes(rounds: int = 50, tol: str = "1e-6") -> str:
    errs = " UNION ALL ".join(
        f"SELECT {i} AS it, sum(abs(a.rank - b.rank)) AS err FROM r_pr{i} a JOIN r_pr{i - 1} b ON a.node = b.node"
        for i in range(1, rounds + 1))
    ranks = " UNION ALL ".join(f"SELECT {i} AS it, node, rank FROM r_pr{i}" for i in range(1, rounds + 1))
    return _pr_ctes(rounds) + f""",
r_prerr AS ({errs}),
r_prstop AS (
  SELECT CAST(coalesce(min(it) FILTER (WHERE err < (SELECT n FROM r_nn) * {tol}), {rounds}) AS INTEGER) AS it,
         coalesce(bool_or(err < (SELECT n FROM r_nn) * {tol}), false) AS conv
  FROM r_prerr),
r_prall AS ({ranks})"""


def _pr_converged_sql() -> str:
    body = """SELECT a.node AS product_id, a.rank AS pagerank, s.it AS iterations, s.conv AS converged
FROM r_prall a JOIN r_prstop s ON a.it = s.it"""
    return sql(round_cols(body, ["pagerank"]), PAIR_CTES + ",\n" + _pr_converged_ctes())


@register("pagerank_converged", _pr_converged_sql())
def q_pagerank_converged(spark, sf_dir):
    """K4 as the reference runs it: until n*1e-6 L1 change, at most 50 rounds."""
    return graph.pagerank(edges(spark, sf_dir), max_iter=50)


BTW_DEPTH = 64  # unrolled BFS levels in the oracle; the test graphs are far shallower


def _btw_ctes(depth: int = BTW_DEPTH, k: int = 1000) -> str:
    from cartwise.plans.oracle import h

    out = [
        "r_adj AS MATERIALIZED (SELECT DISTINCT src, dst FROM r_edges WHERE src <> dst)",
        "r_bn AS MATERIALIZED (SELECT DISTINCT src AS node FROM r_adj)",
        f"r_bsrc AS MATERIALIZED (SELECT node AS s FROM r_bn ORDER BY {h('node')}, node LIMIT {k})",
        "r_l0 AS MATERIALIZED (SELECT s, s AS v, 1.0::DOUBLE AS sigma FROM r_bsrc)",
    ]
    for i in range(1, depth + 1):
        prev2 = f" ANTI JOIN r_l{i - 2} q ON g.s = q.s AND g.v = q.v" if i >= 2 else ""
        out.append(
            f"r_l{i} AS MATERIALIZED (SELECT g.* FROM (SELECT c.s, a.dst AS v, sum(c.sigma) AS sigma "
            f"FROM r_l{i - 1} c JOIN r_adj a ON c.v = a.src GROUP BY c.s, a.dst) g "
            f"ANTI JOIN r_l{i - 1} p ON g.s = p.s AND g.v = p.v{prev2})"
        )
    out.append(f"r_d{depth} AS MATERIALIZED (SELECT s, v, sigma, 0.0::DOUBLE AS delta FROM r_l{depth})")
    for i in range(depth - 1, -1, -1):
        out.append(
            f"r_d{i} AS MATERIALIZED (SELECT l.s, l.v, l.sigma, l.sigma * coalesce(u.c, 0.0) AS delta "
            f"FROM r_l{i} l LEFT JOIN (SELECT d.s, a.dst AS v, sum((1.0 + d.delta) / d.sigma) AS c "
            f"FROM r_d{i + 1} d JOIN r_adj a ON d.v = a.src GROUP BY d.s, a.dst) u ON l.s = u.s AND l.v = u.v)"
        )
    union = " UNION ALL ".join(f"SELECT s, v, delta FROM r_d{i}" for i in range(depth + 1))
    out.append(f"r_bacc AS (SELECT v AS product_id, sum(delta) AS b FROM ({union}) WHERE s <> v GROUP BY v)")
    out.append(
        "r_bscale AS (SELECT CASE WHEN n > 2 THEN 1.0 / ((n - 1) * (n - 2)) * n / least(n, "
        f"{k}) ELSE 1.0 END AS f FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM r_bn))"
    )
    return ",\n".join(out)


@register("betweenness_sampled", sql(round_cols("""
SELECT n.node AS product_id, coalesce(b.b, 0.0) * (SELECT f FROM r_bscale) AS betweenness_centrality
FROM r_bn n LEFT JOIN r_bacc b ON n.node = b.product_id""", ["betweenness_centrality"]),
    PAIR_CTES + ",\n" + _btw_ctes()))
def q_betweenness(spark, sf_dir):
    """K3: Brandes over k = min(1000, n) hash-chosen sources."""
    return graph.betweenness(edges(spark, sf_dir), k=1000)


CENT_CTES = PAIR_CTES + ",\n" + _pr_converged_ctes() + ",\n" + _btw_ctes() + """,
r_deg AS (
  SELECT src AS product_id,
         CASE WHEN (SELECT count(DISTINCT src) FROM r_edges) > 1
              THEN CAST(count(*) + count_if(src = dst) AS DOUBLE) / ((SELECT count(DISTINCT src) FROM r_edges) - 1)
              ELSE 1.0::DOUBLE END AS degree_centrality
  FROM r_edges GROUP BY src),
r_btw AS (
  SELECT n.node AS product_id, coalesce(b.b, 0.0) * (SELECT f FROM r_bscale) AS betweenness_centrality
  FROM r_bn n LEFT JOIN r_bacc b ON n.node = b.product_id),
r_prc AS (SELECT a.node AS product_id, a.rank AS pagerank FROM r_prall a JOIN r_prstop s ON a.it = s.it),
r_cent AS (
  SELECT d.product_id, d.degree_centrality, b.betweenness_centrality, p.pagerank
  FROM r_deg d LEFT JOIN r_btw b ON d.product_id = b.product_id LEFT JOIN r_prc p ON d.product_id = p.product_id)
"""
CENT_COLS = ["degree_centrality", "betweenness_centrality", "pagerank"]


@register("centrality_table", sql(round_cols("SELECT * FROM r_cent", CENT_COLS), CENT_CTES))
def q_centrality_table(spark, sf_dir):
    """K6: degree, betweenness and PageRank per node."""
    return graph.centrality_table(edges(spark, sf_dir))


@register("top_centrality", sql(round_cols(" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{m}' AS measure, product_id, {m} AS value FROM r_cent WHERE {m} IS NOT NULL "
    f"ORDER BY {m} DESC, product_id LIMIT 1)" for m in CENT_COLS), ["value"]), CENT_CTES))
def q_top_centrality(spark, sf_dir):
    """Top product per centrality measure."""
    table = graph.centrality_table(edges(spark, sf_dir))
    return graph.top_by_measure(table, ["degree_centrality", "betweenness_centrality", "pagerank"])


EXP_CTES = PAIR_CTES + """,
r_act AS (
  SELECT product_id, count(DISTINCT order_id) AS order_frequency, count(DISTINCT user_id) AS user_reach,
         {xavg} AS avg_price, avg(reordered) AS reorder_rate
  FROM r_imputed GROUP BY product_id),
r_bsize AS (SELECT order_id, count(*) AS basket_size FROM r_imputed GROUP BY order_id),
r_bswp AS (
  SELECT f.product_id, avg(b.basket_size) AS avg_basket_size_with_product
  FROM r_imputed f JOIN r_bsize b ON f.order_id = b.order_id GROUP BY f.product_id),
r_bm AS (
  SELECT a.*, b.avg_basket_size_with_product, s.cross_sell_strength
  FROM r_act a LEFT JOIN r_bswp b ON a.product_id = b.product_id
  LEFT JOIN r_strength s ON a.product_id = s.product_id),
r_bounds AS (
  SELECT min(order_frequency)::DOUBLE AS of_lo, max(order_frequency)::DOUBLE AS of_hi,
         min(user_reach)::DOUBLE AS ur_lo, max(user_reach)::DOUBLE AS ur_hi,
         min(avg_price) AS ap_lo, max(avg_price) AS ap_hi,
         min(reorder_rate) AS rr_lo, max(reorder_rate) AS rr_hi,
         min(avg_basket_size_with_product) AS bs_lo, max(avg_basket_size_with_product) AS bs_hi,
         min(cross_sell_strength) AS cs_lo, max(cross_sell_strength) AS cs_hi
  FROM r_bm),
r_norm AS (
  SELECT m.*,
    CASE WHEN of_hi > of_lo THEN (order_frequency - of_lo) / (of_hi - of_lo) ELSE 0.0 END AS order_frequency_norm,
    CASE WHEN ur_hi > ur_lo THEN (user_reach - ur_lo) / (ur_hi - ur_lo) ELSE 0.0 END AS user_reach_norm,
    CASE WHEN ap_hi > ap_lo THEN (avg_price - ap_lo) / (ap_hi - ap_lo) ELSE 0.0 END AS avg_price_norm,
    CASE WHEN rr_hi > rr_lo THEN (reorder_rate - rr_lo) / (rr_hi - rr_lo) ELSE 0.0 END AS reorder_rate_norm,
    CASE WHEN bs_hi > bs_lo THEN (avg_basket_size_with_product - bs_lo) / (bs_hi - bs_lo) ELSE 0.0 END
      AS avg_basket_size_with_product_norm,
    CASE WHEN cs_hi > cs_lo THEN (cross_sell_strength - cs_lo) / (cs_hi - cs_lo) ELSE 0.0 END
      AS cross_sell_strength_norm
  FROM r_bm m, r_bounds),
r_score AS (
  SELECT *, 0.25 * avg_basket_size_with_product_norm + 0.25 * cross_sell_strength_norm
          + 0.20 * reorder_rate_norm + 0.15 * avg_price_norm + 0.15 * user_reach_norm AS basket_expansion_score
  FROM r_norm)
""".replace("{xavg}", _xavg("price"))
NORM_DOUBLES = ["avg_price", "reorder_rate", "avg_basket_size_with_product", "cross_sell_strength"]
NORM_COLS = [f"{c}_norm" for c in expansion.NORMALIZED]


def lines_for_expansion(spark, sf_dir):
    return score_imputed(spark, sf_dir).select("order_id", "product_id", "user_id", "price", "reordered")


def metrics(spark, sf_dir):
    """Basket metrics per product, materialised (normalisation reads them twice)."""
    return stage("basket-metrics", spark, sf_dir,
                 lambda: expansion.basket_metrics(lines_for_expansion(spark, sf_dir), edges(spark, sf_dir)))


def scored(spark, sf_dir):
    return expansion.expansion_score(expansion.normalize(metrics(spark, sf_dir)))


@register("basket_sizes", sql("SELECT * FROM r_bsize", EXP_CTES))
def q_basket_sizes(spark, sf_dir):
    """E2."""
    return expansion.basket_sizes(lines_for_expansion(spark, sf_dir))


@register("basket_size_with_product", sql(round_cols("SELECT * FROM r_bswp", ["avg_basket_size_with_product"]),
                                          EXP_CTES))
def q_basket_size_with_product(spark, sf_dir):
    """D9 + E3."""
    return expansion.basket_size_with_product(lines_for_expansion(spark, sf_dir))


@register("basket_metrics", sql(round_cols("SELECT * FROM r_bm", NORM_DOUBLES), EXP_CTES))
def q_basket_metrics(spark, sf_dir):
    """E1 + E3 + E15 per product."""
    return expansion.basket_metrics(lines_for_expansion(spark, sf_dir), edges(spark, sf_dir))


@register("normalized_metrics", sql(round_cols("SELECT * FROM r_norm", NORM_DOUBLES + NORM_COLS), EXP_CTES))
def q_normalized_metrics(spark, sf_dir):
    """C18."""
    return expansion.normalize(metrics(spark, sf_dir))


@register("basket_expansion_score", sql(round_cols("SELECT * FROM r_score",
                                                   NORM_DOUBLES + NORM_COLS + ["basket_expansion_score"]), EXP_CTES))
def q_basket_expansion_score(spark, sf_dir):
    """C19 composite over the normalised metrics."""
    return scored(spark, sf_dir)


@register("score_summary", sql(round_cols("""
SELECT count(basket_expansion_score) AS count, avg(basket_expansion_score) AS mean,
       stddev_samp(basket_expansion_score) AS std, min(basket_expansion_score) AS min,
       quantile_cont(basket_expansion_score, 0.25) AS p25, quantile_cont(basket_expansion_score, 0.5) AS p50,
       quantile_cont(basket_expansion_score, 0.75) AS p75, max(basket_expansion_score) AS max
FROM r_score""", ["mean", "std", "min", "p25", "p50", "p75", "max"]), EXP_CTES))
def q_score_summary(spark, sf_dir):
    """describe() of the composite score."""
    return expansion.score_summary(scored(spark, sf_dir))


@register("top_expansion_products", sql(round_cols("""
SELECT product_id, basket_expansion_score FROM r_score WHERE basket_expansion_score IS NOT NULL
ORDER BY basket_expansion_score DESC, product_id LIMIT 5""", ["basket_expansion_score"]), EXP_CTES))
def q_top_expansion_products(spark, sf_dir):
    """Five best products by expansion score (a top-k report)."""
    return expansion.top_products(scored(spark, sf_dir), 5)


@register("activity_estimates", sql("""
SELECT product_id, count(DISTINCT order_id) AS order_frequency, count(DISTINCT user_id) AS user_reach,
       true AS orders_within, true AS users_within
FROM r_merged GROUP BY product_id"""))
def q_activity_estimates(spark, sf_dir):
    """E1 from sketches per product and weekday: exact counts, and whether the estimates are within their bound."""
    lines = merged(spark, sf_dir).select("product_id", "order_id", "user_id", "order_dow")
    found = distinct.activity_estimates(distinct.activity_sketches(lines, "order_dow"))
    exact = lines.groupBy("product_id").agg(*[F.count_distinct(c).alias(f"exact_{n}") for n, c in distinct.COUNTS.items()])
    near = lambda n: F.abs(F.col(n) - F.col(f"exact_{n}")) <= distinct.BOUND * F.col(f"exact_{n}")
    return exact.join(found, "product_id").select(
        "product_id", F.col("exact_order_frequency").alias("order_frequency"), F.col("exact_user_reach").alias("user_reach"),
        near("order_frequency").alias("orders_within"), near("user_reach").alias("users_within"))
