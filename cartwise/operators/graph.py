"""Product graph on DataFrames.

The undirected weighted graph is a symmetric edge table (src, dst, weight):
every undirected edge appears in both orientations, a self loop once.

Iterative algorithms (PageRank, Brandes betweenness) keep their state as
DataFrames and drive iteration from the driver with one scalar action per
round.  The edges are written once in buckets of their source, the state of a
round as a stage in the session's checkpoint folder (survives executor loss).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.expr import SEED, unit_hash
from cartwise.session import Bucketed, Rounds, materialize, together


def edges_from_pairs(pairs: DataFrame) -> DataFrame:
    """Symmetric edges from frequent pairs (K1).

    When both directions of a pair survived (directed mode), the weight is the
    count of the direction that appeared later (``first_order``), as repeated
    insertion into an undirected graph keeps the last weight.
    """
    u, v = F.least("p1", "p2"), F.greatest("p1", "p2")
    if "first_order" in pairs.columns:
        und = pairs.groupBy(u.alias("u"), v.alias("v")).agg(F.max_by("cnt", "first_order").alias("weight"))
    else:
        und = pairs.select(u.alias("u"), v.alias("v"), F.col("cnt").alias("weight"))
    fwd = und.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight")
    back = und.where(F.col("u") != F.col("v")).select(F.col("v").alias("src"), F.col("u").alias("dst"), "weight")
    return fwd.unionByName(back)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("product_id")).distinct()


def network_summary(edges: DataFrame) -> DataFrame:
    """Nodes, undirected edges, mean degree 2E/N (NULL for an empty graph)."""
    return edges.agg(
        F.count_distinct("src").alias("n_nodes"),
        F.count_if(F.col("src") <= F.col("dst")).alias("n_edges"),
    ).withColumn("avg_degree", F.try_divide(F.col("n_edges") * 2.0, F.col("n_nodes")))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """degree / (n - 1); a self loop counts twice; n = 1 gives 1 (K2)."""
    n = nodes_of(edges).agg(F.count(F.lit(1))).scalar()
    deg = edges.groupBy(F.col("src").alias("product_id")).agg(
        (F.count(F.lit(1)) + F.count_if(F.col("src") == F.col("dst"))).alias("degree")
    )
    return deg.select(
        "product_id",
        F.when(n > 1, F.col("degree") / (n - 1)).otherwise(F.lit(1.0)).alias("degree_centrality"),
    )


def cross_sell_strength(edges: DataFrame) -> DataFrame:
    """Mean edge weight over the distinct neighbours of each node."""
    return edges.groupBy(F.col("src").alias("product_id")).agg(
        F.avg(F.col("weight").cast("double")).alias("cross_sell_strength")
    )


def pagerank(
    edges: DataFrame,
    damping: float = 0.85,
    max_iter: int = 50,
    tol: float = 1.0e-6,
    fixed_iterations: int | None = None,
    stage_every: int = 5,
) -> DataFrame:
    """Weighted PageRank (K4): product_id, pagerank, iterations, converged.

    r0 = 1/n; r' = (1-d)/n + d * sum_{u~v} r(u) w(u,v) / W(u).  Stops when the
    L1 change is below n * tol or after ``max_iter`` rounds (``converged``
    says which, instead of raising).  ``fixed_iterations`` runs exactly that
    many rounds without a convergence test (used by the SQL oracle).
    Every node of a symmetric edge table has out-weight, so there are no
    dangling nodes.

    The transition table is written once in buckets of ``src``: a round
    shuffles the ranks (one row a node) to it and the contributions, summed
    map-side, away from it, never the edges.  Old and new rank stand in one
    row, so the change is one aggregate; only the newest two rounds stay.
    """
    spark = edges.sparkSession
    w_out = edges.groupBy("src").agg(F.sum(F.col("weight").cast("double")).alias("w_out"))
    trans = Bucketed(edges.join(w_out, "src").select("src", "dst", (F.col("weight") / F.col("w_out")).alias("p")),
                     "src", "transitions")
    rounds = Rounds("pagerank", keep=2)
    ranks = rounds.put(trans.table.select(F.col("src").alias("node")).distinct().withColumn("rank", F.lit(1.0)))
    n = ranks.count()
    if n == 0:
        trans.drop()
        return spark.createDataFrame([], "product_id bigint, pagerank double, iterations int, converged boolean")
    ranks = ranks.select("node", F.lit(1.0 / n).alias("rank"))
    limit = fixed_iterations if fixed_iterations is not None else max_iter
    converged, done = False, 0
    for i in range(1, limit + 1):
        new, done = pagerank_round(trans.table, ranks, n, damping), i
        if fixed_iterations is None:
            new = rounds.put(new)
            err = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            converged = err is not None and err < n * tol
        elif i % stage_every == 0 or i == limit:
            new = rounds.put(new)
        ranks = new.select("node", "rank")
        if converged:
            break
    trans.drop()
    return ranks.select(
        F.col("node").alias("product_id"),
        F.col("rank").alias("pagerank"),
        F.lit(done).alias("iterations"),
        F.lit(converged or fixed_iterations is not None).alias("converged"),
    )


def pagerank_round(trans: DataFrame, ranks: DataFrame, n: int, damping: float) -> DataFrame:
    """(node, old, rank) after one round over a transition table bucketed by ``src``."""
    given = trans.join(ranks, trans.src == ranks.node).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("s"))
    new = F.lit((1.0 - damping) / n) + F.lit(damping) * F.coalesce("s", F.lit(0.0))
    return ranks.join(given, ranks.node == given.dst, "left").select("node", F.col("rank").alias("old"), new.alias("rank"))


def choose_sources(nodes: DataFrame, k: int | None, seed: int = SEED) -> DataFrame:
    """k nodes with the smallest key hash (all when k is None or k >= n)."""
    if k is None:
        return nodes
    h = unit_hash("product_id", seed=seed)
    return nodes.orderBy(h, "product_id").limit(int(k))


def betweenness(
    edges: DataFrame,
    k: int | None = 1000,
    seed: int = SEED,
    source_batch: int = 1000,
    normalized: bool = True,
) -> DataFrame:
    """Sampled shortest-path betweenness of an unweighted undirected graph (K3).

    Brandes' algorithm, level-synchronous over DataFrames, for all sources of
    a batch at once.  Forward: frontier (s, v, sigma) joins the adjacency, sums
    path counts and drops nodes of the previous or current level (in an
    undirected graph neighbours differ by at most one level), so each round
    touches frontier-sized data only.  Backward: from the deepest level,
    delta(v) = sum over children w of sigma(v)/sigma(w) * (1 + delta(w)).
    Scores sum delta_s(v) for v != s, times 1/((n-1)(n-2)) (n > 2) and n/k.
    Sources are the k nodes with the smallest key hash (reproducible; k = n is
    exact).  The adjacency is written once in buckets of ``src``, so a level
    shuffles its frontier to it, never the edges.  Every level is staged for
    the way back and deleted with its batch.
    """
    spark = edges.sparkSession
    adjacency = Bucketed(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct(), "src", "adjacency")
    adj = adjacency.table
    nodes = materialize(adj.select(F.col("src").alias("product_id")).distinct(), "nodes")
    n = nodes.count()
    kk = n if k is None else min(int(k), n)
    sources = materialize(choose_sources(nodes, kk if kk < n else None, seed), "sources") if kk else None
    n_batches = max(1, -(-kk // source_batch))
    sums = Rounds("betweenness", keep=2)
    totals = None
    for bi in range(n_batches if sources is not None else 0):
        # Batches by key hash: no source list goes through the driver.
        batch = sources.where(F.pmod(F.xxhash64("product_id"), F.lit(n_batches)) == bi).select(
            F.col("product_id").alias("s")
        )
        levels = Rounds("levels")
        part = _brandes_batch(adj, batch, levels)
        if totals is not None:
            part = totals.unionByName(part).groupBy("product_id").agg(F.sum("b").alias("b"))
        totals = sums.put(part)
        levels.delete(spark)
    adjacency.drop()
    if totals is None:
        totals = spark.createDataFrame([], "product_id bigint, b double")
    scale = 1.0
    if normalized:
        scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        if n > 2 and kk:
            scale *= n / kk
    else:
        scale = 0.5
    return nodes.join(totals, "product_id", "left").select(
        "product_id", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("betweenness_centrality")
    )


def next_level(adj: DataFrame, cur: DataFrame, prev: DataFrame | None) -> DataFrame:
    """(s, v, sigma) of the nodes one step beyond ``cur``; ``adj`` is bucketed by ``src``."""
    out = cur.join(adj, cur.v == adj.src).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
    for seen in (cur, prev):
        if seen is not None:
            out = out.join(seen.select("s", "v"), ["s", "v"], "left_anti")
    return out


def _brandes_batch(adj: DataFrame, sources: DataFrame, stages: Rounds) -> DataFrame:
    cur = stages.put(sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("sigma")))
    levels, prev = [cur], None
    while True:
        nxt = stages.put(next_level(adj, cur, prev))
        if nxt.isEmpty():
            break
        levels.append(nxt)
        prev, cur = cur, nxt
    # Backward accumulation from the deepest level.
    child = levels[-1].withColumn("delta", F.lit(0.0))
    acc = child.select("s", "v", "delta")
    for lvl in reversed(levels[:-1]):
        coef = child.select("s", F.col("v").alias("w"), ((1.0 + F.col("delta")) / F.col("sigma")).alias("c"))
        up = coef.join(adj, coef.w == adj.src).groupBy("s", F.col("dst").alias("v")).agg(F.sum("c").alias("c"))
        child = stages.put(
            lvl.join(up, ["s", "v"], "left").select(
                "s", "v", "sigma", (F.col("sigma") * F.coalesce("c", F.lit(0.0))).alias("delta")
            )
        )
        acc = acc.unionByName(child.select("s", "v", "delta"))
    return (
        acc.where(F.col("s") != F.col("v"))
        .groupBy(F.col("v").alias("product_id"))
        .agg(F.sum("delta").alias("b"))
    )


def centrality_table(edges: DataFrame, k: int | None = 1000, pagerank_iter: int = 50) -> DataFrame:
    """One row per node: degree, betweenness and PageRank (K6)."""
    deg = degree_centrality(edges)
    btw, pr = together(edges.sparkSession, lambda: betweenness(edges, k=k), lambda: pagerank(edges, max_iter=pagerank_iter))
    return deg.join(btw, "product_id", "left").join(pr.select("product_id", "pagerank"), "product_id", "left")


def top_by_measure(table: DataFrame, measures: list[str]) -> DataFrame:
    """Top product per measure, ties to the smallest id.

    A global ``min(struct(-value, product_id))``: partial aggregation per
    partition, one row per measure reaches the final task.
    """
    parts = []
    for m in measures:
        best = table.where(F.col(m).isNotNull()).agg(
            F.min(F.struct((-F.col(m).cast("double")).alias("k"), F.col("product_id").alias("p"))).alias("b")
        )
        parts.append(
            best.where(F.col("b").isNotNull()).select(
                F.lit(m).alias("measure"), F.col("b.p").alias("product_id"), (-F.col("b.k")).alias("value")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
