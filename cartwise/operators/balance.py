"""SMOTE class balancing as Spark jobs (I4).

Synthetic row s (0 <= s < G, G = majority - minority):
  base = minority row number (s mod m) in key-hash order,
  neighbour = rank 1 + floor(n_s * h('n', s)) among its k nearest minority rows
              (n_s = neighbours found, k normally), ties by row key,
  point = base + h('u', s) * (neighbour - base), label = minority label.
Minority rows meet their neighbours by equi-joins on the row number.  The
numbers s of a row are cut into parts; a part holds the row and its neighbours,
and its synthetic rows are made in place, without a shuffle of them.

Nearest neighbours are exact at every size and pruned by pivots: rows lie in
blocks of about equal distance to their nearest pivot, the k-th distance in a
row's own block bounds what it looks for, and by the triangle inequality a
block whose distances to some pivot are too far off cannot hold a neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.functions.expr import SEED, unit_hash
from cartwise.session import materialize

# Minority rows of a block, expected, and query rows compared at once inside a pair of blocks.
BLOCK_ROWS = 1024
CHUNK = 256
# Synthetic rows that one row of SMOTE's plan stands for, and the shares that those rows are dealt in.
PART = 1024
DEALS = 48
# Most pivots, most blocks of a pivot, and rows that pivots are chosen from: what the driver and each task hold of them.
PIVOTS = 16
BINS = 64
SAMPLE = 4096


def number_by_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``idx`` = 0-based rank by (hash of the keys, keys) without a global window.

    The top 16 bits of the hash cut the rows into 65536 even ranges; range
    sizes are prefix-summed over that small table, rows are numbered inside.
    """
    b = df.withColumn("_h", F.xxhash64(*keys)).withColumn("_bk", F.shiftright("_h", 48))
    sizes = b.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.select(
        "_bk",
        F.coalesce(F.sum("_n").over(Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
    )
    w = Window.partitionBy("_bk").orderBy("_h", *keys)
    return b.join(offs, "_bk").withColumn("idx", F.col("_off") + F.row_number().over(w) - 1).drop("_bk", "_off", "_h")


def _nearest(k: int):
    """The k nearest rows of side 1 for every row of side 0 in one pair of blocks, ties by ordinal."""

    def run(table: pa.Table) -> pa.Table:
        side, ordinal = table["side"].to_numpy(), table["idx"].to_numpy()
        x = np.array(table["x"].to_pylist(), dtype=np.float64).reshape(len(side), -1)
        q, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        r = r[np.argsort(ordinal[r], kind="stable")]
        out: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, len(q), CHUNK):
            rows = q[at : at + CHUNK]
            d2 = np.zeros((len(rows), len(r)))
            for c in range(x.shape[1]):  # plain differences: nothing cancels, whatever the offset of a column
                d2 += (x[rows, c][:, None] - x[r, c][None, :]) ** 2
            d2[ordinal[rows][:, None] == ordinal[r][None, :]] = np.inf
            take = min(k, len(r))
            if not take:
                continue
            best = np.argsort(d2, axis=1, kind="stable")[:, :take]
            near = np.take_along_axis(d2, best, axis=1)
            keep = np.isfinite(near)
            out[0].append(np.repeat(ordinal[rows], take).reshape(near.shape)[keep])
            out[1].append(ordinal[r][best][keep])
            out[2].append(np.sqrt(near[keep]))
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"idx": cols[0].astype(np.int64), "nb_idx": cols[1].astype(np.int64), "distance": cols[2]})

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = np.zeros((len(x), len(pivots)))
    for c in range(x.shape[1]):
        d2 += (x[:, c][:, None] - pivots[None, :, c]) ** 2
    return np.sqrt(d2)


def choose_pivots(rows: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray:
    """``n`` rows far from each other, among those with the smallest hash of their number (at most ``sample``)."""
    taken = rows.orderBy(F.xxhash64("idx"), "idx").limit(sample).select("x").collect()
    x = np.array([r["x"] for r in taken], dtype=np.float64)
    chosen, gap = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(x, x[chosen[-1] :][:1])[:, 0])
    return x[chosen]


def _may_hold(x: np.ndarray, bound: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(rows, blocks): whether a block may hold a row no further off than ``bound``, by the triangle inequality."""
    d = _distances(x, pivots)
    gap = np.maximum(low[None] - d[:, None, :], d[:, None, :] - high[None]).max(axis=2)
    # differences and so distances are exact to about 1e-15 of their size; empty blocks have an infinite gap
    room = bound[:, None] + 1e-9 * d.max(axis=1, initial=0.0)[:, None]
    return (gap <= room) & np.isfinite(low[:, 0])[None]


class Blocks:
    """Rows (idx, x) by block: nearest pivot, and range of the distance to it; crowded blocks have several slots.

    ``low`` and ``high`` are the least and largest distance to each pivot in
    each block.  There are PIVOTS x BINS blocks at most, whatever the rows.
    """

    def __init__(self, rows: DataFrame, n: int, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS, bins: int = BINS):
        wanted = max(1, -(-n // block_rows))
        self.pivots = choose_pivots(rows, min(pivots, wanted))
        bins = min(bins, max(1, -(-wanted // len(self.pivots))))
        own = self._mapped(rows, "cell int, own double", lambda x, d: (d.argmin(axis=1).astype(np.int32), d.min(axis=1)))
        cut = [i / bins for i in range(1, bins)] or [1.0]
        cuts = {r["cell"]: r["q"] for r in own.groupBy("cell").agg(F.percentile_approx("own", cut).alias("q")).collect()}
        edges = [np.array(cuts.get(c, [])[: bins - 1]) for c in range(len(self.pivots))]

        def place(x, d):
            cell = d.argmin(axis=1)
            bin_of = [np.searchsorted(edges[c], v, side="right") for c, v in zip(cell, d[np.arange(len(d)), cell])]
            return (cell * bins + np.array(bin_of, dtype=np.int64).reshape(len(cell))).astype(np.int32),

        placed = materialize(self._mapped(rows, "block int", place, keep=True), "minority-blocks")
        spans = self._mapped(placed, "d array<double>", lambda x, d: (pa.array(list(d), pa.list_(pa.float64())),), ("block",))
        spans = spans.select("block", F.posexplode("d").alias("pivot", "d")).groupBy("block", "pivot").agg(
            F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n"))
        blocks = len(self.pivots) * bins
        self.low, self.high = np.full((blocks, len(self.pivots)), np.inf), np.full((blocks, len(self.pivots)), -np.inf)
        self.slots = np.zeros(blocks, dtype=np.int64)
        for r in spans.collect():
            self.low[r["block"], r["pivot"]], self.high[r["block"], r["pivot"]] = r["low"], r["high"]
            self.slots[r["block"]] = -(-r["n"] // block_rows)
        at = [F.lit(int(s)) for s in np.maximum(self.slots, 1)]
        slot = F.pmod(F.xxhash64("idx"), F.element_at(F.array(*at), F.col("block") + 1)).cast("int")
        self.rows = placed.withColumn("slot", slot)

    def _mapped(self, rows: DataFrame, schema: str, of, keep=False) -> DataFrame:
        """New columns from each row's vector and its distances to the pivots; ``keep``: behind idx and x, or those named."""
        pivots, kept = self.pivots, ("idx", "x") if keep is True else keep or ()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("x"))
                made = [c if isinstance(c, pa.Array) else pa.array(c) for c in of(x, _distances(x, pivots))]
                names = [f.split()[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], names=[*kept, *names])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), schema]))

    def visits(self, inside: DataFrame, k: int) -> DataFrame:
        """(idx, x, block, slot): every slot but its own that a row has to be compared with.

        ``inside`` holds the neighbours (idx, nb_idx, distance) found in the
        rows' own slots; a row with fewer than ``k`` of them has no bound.
        """
        bounds = inside.groupBy("idx").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
        bounded = self.rows.join(bounds, "idx", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        slots, pivots, low, high = self.slots, self.pivots, self.low, self.high

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNK):
                    b = whole.slice(at, CHUNK)
                    row, block = np.nonzero(_may_hold(_matrix(b.column("x")), b.column("bound").to_numpy(), pivots, low, high))
                    times = slots[block]
                    row, block = np.repeat(row, times), np.repeat(block, times)
                    slot = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    other = (block != b.column("block").to_numpy()[row]) | (slot != b.column("slot").to_numpy()[row])
                    row, block, slot = row[other], block[other], slot[other]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("idx").take(pa.array(row)), b.column("x").take(pa.array(row)),
                         pa.array(block.astype(np.int32)), pa.array(slot.astype(np.int32))], names=["idx", "x", "block", "slot"])

        return bounded.select("idx", "x", "block", "slot", "bound").mapInArrow(
            run, "idx long, x array<double>, block int, slot int")


_NEAR = "idx long, nb_idx long, distance double"


def minority_neighbors(minority: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS,
                       bins: int = BINS) -> DataFrame:
    """(idx, x) -> idx, rank (1..k), nb_idx, distance: the k nearest other rows, exact, ties by idx.

    Of equal vectors only the k + 1 with the smallest idx can be anybody's
    neighbours, and all further ones have the first k of them: copies never
    meet each other.  The others are compared inside their own slot of a
    block first, and then with the slots of ``Blocks`` that the bound from
    there does not rule out.  Queries of one slot are dealt in groups of a
    bounded size.
    """
    x = F.transform("x", lambda v: v.cast("double"))
    copy = F.row_number().over(Window.partitionBy("x").orderBy("idx"))
    rows = minority.select(F.col("idx").cast("long").alias("idx"), x.alias("x"))
    first = materialize(rows.withColumn("copy", copy).where(F.col("copy") <= k + 1), "minority-distinct")
    more = rows.join(first.select("idx"), "idx", "left_anti").join(
        first.where(F.col("copy") <= k).select("x", F.col("idx").alias("nb_idx")), "x")
    more = more.select("idx", "nb_idx", F.lit(0.0).alias("distance"))
    first = first.select("idx", "x")
    n = first.count()
    if not n:
        return rows.limit(0).select("idx", F.lit(0).alias("rank"), F.col("idx").alias("nb_idx"), F.lit(0.0).alias("distance"))
    blocks = Blocks(first, n, block_rows, pivots, bins)
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    inside = materialize(blocks.rows.select("*", both).groupBy("block", "slot").applyInArrow(_nearest(k), _NEAR), "near-inside")
    visits = materialize(blocks.visits(inside, k), "near-visits")
    deals = visits.groupBy("block", "slot").agg(F.ceil(F.count(F.lit(1)) / (4 * block_rows)).cast("int").alias("deals"))
    deal = F.pmod(F.xxhash64("idx"), F.col("deals")).cast("int")
    queries = visits.join(deals, ["block", "slot"]).select("block", "slot", deal.alias("deal"), "idx", "x", F.lit(0).alias("side"))
    every = F.explode(F.sequence(F.lit(0), F.col("deals") - 1))
    refs = blocks.rows.join(deals, ["block", "slot"]).select("block", "slot", every.alias("deal"), "idx", "x", F.lit(1).alias("side"))
    outside = queries.unionByName(refs).groupBy("block", "slot", "deal").applyInArrow(_nearest(k), _NEAR)
    w = Window.partitionBy("idx").orderBy("distance", "nb_idx")
    near = inside.unionByName(outside).unionByName(more).withColumn("rank", F.row_number().over(w).cast("int"))
    return near.where(F.col("rank") <= k).select("idx", "rank", "nb_idx", "distance")


def class_counts(balanced: DataFrame) -> DataFrame:
    """label, is_synthetic, n of SMOTE's rows; the smaller class has a synthetic row even where none were made."""
    counts = balanced.groupBy("label", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))
    none = counts.where(~F.col("is_synthetic")).orderBy("n", "label").limit(1).select(
        "label", F.lit(True).alias("is_synthetic"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(none).groupBy("label", "is_synthetic").agg(F.sum("n").alias("n"))


def smote(df: DataFrame, features: list[str], label: str = "label", k: int = 5, seed: int = SEED,
          id_cols: tuple[str, ...] = ("order_id", "product_id")) -> DataFrame:
    """Oversample the minority class to the majority size (I4).

    ``df`` has unique ``id_cols``, numeric ``features`` and a 0/1 ``label``.
    Returns the original rows plus synthetic ones, which have NULL keys, their
    number in ``synthetic_no`` and ``is_synthetic``; features NULL -> 0 first,
    as the reference fills them.  The neighbours used are the k nearest, or
    all others where there are no more; a single minority row is repeated.
    """
    spark, keys = df.sparkSession, list(id_cols)
    base = df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features],
                     F.col(label).cast("int").alias("label"))
    plain = base.withColumn("is_synthetic", F.lit(False)).withColumn("synthetic_no", F.lit(None).cast("long"))
    counts = {r["label"]: r["n"] for r in base.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return plain
    minority_label = min(counts, key=lambda c: (counts[c], c))
    m, big = counts[minority_label], max(counts.values())
    minority = base.where(F.col("label") == minority_label).select(*keys, F.array(*features).alias("x"))
    minority = materialize(number_by_hash(minority, keys).select("idx", "x"), "smote-minority")
    nbrs = materialize(minority_neighbors(minority, k), "smote-knn")
    near = nbrs.join(minority.select(F.col("idx").alias("nb_idx"), F.col("x").alias("nx")), "nb_idx").groupBy("idx").agg(
        F.sort_array(F.collect_list(F.struct("rank", "nx"))).alias("near"))
    # the numbers idx, idx + m, ... of a row lie in parts, which are dealt evenly: rows are made where their part is
    missing = big - m
    parts = minority.join(near, "idx", "left").where(F.col("idx") < missing).withColumn(
        "at", F.explode(F.sequence("idx", F.lit(missing - 1).cast("long"), F.lit(PART * m).cast("long"))))
    parts = materialize(parts.select("at", F.col("x").alias("bx"), "near").repartition(DEALS, "at"), "smote-parts")
    last = F.least(F.col("at") + (PART - 1) * m, F.lit(missing - 1).cast("long"))
    syn = parts.withColumn("s", F.explode(F.sequence("at", last, F.lit(m).cast("long"))))
    pick = F.floor(unit_hash(F.lit("n"), "s", seed=seed) * F.size("near")).cast("int")
    # picked row and hash are columns of their own, computed once a row and not once a feature
    syn = syn.select("s", "bx", F.coalesce(F.get("near", pick)["nx"], "bx").alias("nx"),
                     unit_hash(F.lit("u"), "s", seed=seed).alias("u"))
    none = [F.lit(None).cast(base.schema[c].dataType).alias(c) for c in keys]
    a, b = F.col("bx"), F.col("nx")
    values = [(a[i] + F.col("u") * (b[i] - a[i])).alias(c) for i, c in enumerate(features)]
    parts = [plain, syn.select(*none, *values, F.lit(minority_label).alias("label"), F.lit(True).alias("is_synthetic"),
                               F.col("s").alias("synthetic_no"))]
    return reduce(DataFrame.unionByName, parts)
