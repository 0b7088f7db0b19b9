"""Co-purchased product pairs.

Pairs are enumerated by one self equi-join with the residual condition
position(a) < position(b) (position = (add_to_cart_order, product_id)), then
counted with partial aggregation right after the join.

Scale notes
* Apriori pruning (exact): a pair can only reach ``min_support`` orders if
  both of its products do, so lines of products below the threshold are
  removed with a left-semi join before the self-join.  That join shuffles the
  lines; where few of them can go (``pruning_pays``), only the frequent pairs
  are held against their products' lines instead, with the same result.
* Ordinary orders join themselves on the order alone, which shuffles nothing
  where the lines are bucketed by order.
* A huge order is cut into blocks by product hash, and each (order, block,
  block) is a join key of its own, so no task enumerates more than about
  BLOCK^2 pairs of it, whatever its size.  Huge orders are found by a
  frequency sketch of the lines (one pass, one row), not by counting every
  order.
  The (p1, p2) count is combined map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.operators import heavy
from cartwise.session import materialize

# Lines of an order that one block holds, expected.
BLOCK = 1000
# Share of the lines that pruning may remove at most before it is worth a shuffle of the lines.
PRUNED = 0.25


def first_orders(lines: DataFrame, max_orders: int | None) -> DataFrame:
    """The first ``max_orders`` distinct order ids by id (C15); all if None."""
    ids = lines.select("order_id").distinct()
    if max_orders is None:
        return ids
    return ids.orderBy("order_id").limit(int(max_orders))


def frequent_items(lines: DataFrame, min_support: int) -> DataFrame:
    """Products with at least ``min_support`` lines, an upper bound of the orders they are in."""
    counts = lines.groupBy("product_id").agg(F.count(F.lit(1)).alias("item_support"))
    return counts.where(F.col("item_support") >= min_support).select("product_id")


def pruning_pays(lines: DataFrame, min_support: int) -> bool:
    """Whether lines of rare products may be more than PRUNED of all: each rare product has ``min_support - 1`` at most."""
    n, products = lines.agg(F.count("product_id"), F.approx_count_distinct("product_id")).first()
    return (min_support - 1) * products > PRUNED * n


def _of_first_orders(lines: DataFrame, max_orders: int | None) -> DataFrame:
    if max_orders is None:
        return lines
    return lines.join(first_orders(lines, max_orders), "order_id", "left_semi")


def basket_pairs(lines: DataFrame, max_orders: int | None = None, min_support: int = 1,
                 block: int = BLOCK) -> DataFrame:
    """All ordered pairs inside each order (D11): order_id, p1, p2, pos1, pos2.

    ``p1`` comes before ``p2`` in the basket.  Lines of products that cannot
    reach ``min_support`` are pruned first (exact).  In an order of more than
    about ``block`` lines the left copy of a line goes to (own block, j) and
    the right copy to (i, own block) for every i, j of its order, so every
    pair of an order meets in exactly one key.
    """
    base = lines.select("order_id", "product_id", F.col("add_to_cart_order").alias("pos"))
    base = _of_first_orders(base, max_orders)
    huge = materialize(heavy.parts_of(base, "order_id", block), "huge-orders").withColumnRenamed("parts", "blocks")
    if min_support > 1:
        base = base.join(frequent_items(base, min_support), "product_id", "left_semi")
    before = (F.col("pos1") < F.col("pos2")) | ((F.col("pos1") == F.col("pos2")) & (F.col("p1") < F.col("p2")))

    def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        a = left.select(*keys, F.col("product_id").alias("p1"), F.col("pos").alias("pos1"))
        b = right.select(*keys, F.col("product_id").alias("p2"), F.col("pos").alias("pos2"))
        return a.join(b, keys).where(before).select("order_id", "p1", "p2", "pos1", "pos2")

    if huge.isEmpty():
        return joined(base, base, ["order_id"])
    ordinary = base.join(F.broadcast(huge), "order_id", "left_anti")
    cut = base.join(F.broadcast(huge), "order_id").withColumn("own", heavy.part_of(F.col("blocks"), "product_id"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = cut.withColumn("b1", F.col("own")).withColumn("b2", every), cut.withColumn("b2", F.col("own")).withColumn("b1", every)
    return joined(ordinary, ordinary, ["order_id"]).unionByName(joined(*sides, ["order_id", "b1", "b2"]))


def frequent_pairs(
    lines: DataFrame, min_support: int = 5, mode: str = "directed", max_orders: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Pair counts with ``cnt >= min_support``.

    ``directed``: (p1, p2) in basket order, each direction counted and
    thresholded on its own; ``first_order`` = the first order (by id) holding
    the pair, used to pick the edge weight when both directions survive.
    (order_id, product_id) is the line key, so a pair occurs at most once per
    order and the two directions of a pair never share their first order.
    ``canonical``: (least, greatest) counted together.
    """
    if mode not in ("directed", "canonical"):
        raise ValueError(f"unknown pair mode {mode!r}")
    early = min_support <= 1 or pruning_pays(lines, min_support)
    if not early:
        lines = lines.where(F.col("product_id").isNotNull())
    pairs = basket_pairs(lines, max_orders=max_orders, min_support=min_support if early else 1, block=block)
    if mode == "canonical":
        counts = pairs.select(F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2")).groupBy("p1", "p2").agg(
            F.count(F.lit(1)).alias("cnt"))
    else:
        counts = pairs.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("cnt"), F.min("order_id").alias("first_order"))
    counts = counts.where(F.col("cnt") >= min_support)
    if early:
        return counts
    # repeated lines may lift a pair above its products: those are held to the same support
    counts = materialize(counts, "pair-counts")
    ends = counts.select(F.explode(F.array("p1", "p2")).alias("product_id")).distinct()
    # counted map-side before the ends are looked up, so that no line is shuffled
    items = frequent_items(_of_first_orders(lines.select("order_id", "product_id"), max_orders), min_support)
    items = items.join(ends, "product_id", "left_semi")
    for end in ("p1", "p2"):
        counts = counts.join(items.withColumnRenamed("product_id", end), end, "left_semi")
    return counts.select("p1", "p2", "cnt", *[c for c in counts.columns if c == "first_order"])
