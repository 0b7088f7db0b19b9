"""Boosted trees with logistic loss over binned rows (L2), as MLlib's boosted trees grow them.

The first tree is fitted to the labels -1 and 1, each further one to the
negative gradient of the loss, with ``step`` as its weight; a node takes the
split with the largest fall in variance, ties to the first feature and
threshold.  The result is an MLlib model.

What differs is how rows are kept.  Split points come from counts over all
rows.  A row is then one code of two bytes for two features, its margin and
its residual, in blocks that lie in a stage; a round writes the blocks with
the new margins and reads codes and residuals once a level.  Sums are of
integers, so neither the order of the rows nor their partitions change a tree.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.session import Rounds

# Rows of a block, and rows whose values are counted at once.
BLOCK = 1 << 14
COUNTED = 1 << 18
# Most bytes of a file of blocks; there are as many of equal size for each core.
FILE_BYTES = 110_000_000
# Low bits of a double that a first cell of values leaves out; cells with more than 1 / FINE of the rows and several
# values are cut into CUTS, in ROUNDS at most.
LOW_BITS = 40
FINE = 256
CUTS = 256
ROUNDS = 3
# Residuals, which lie in [-4, 4], are whole multiples of this.  The sum of a block's residuals and, below it, its
# number of rows (COUNT_BITS) have 53 bits: one sum of doubles has both, exactly.
UNIT = 2.0**-21
COUNT_BITS = 15
# Bits of a bin where two features share a code.
PAIR_BITS = 5


def _matrices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[np.ndarray]:
    """(columns, rows) arrays of about ``n`` rows."""
    held, rows = [], 0
    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns]))
        rows += b.num_rows
        if rows >= n:
            yield np.concatenate(held, axis=1)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held, axis=1)


def _first_cell(v: np.ndarray) -> np.ndarray:
    """Values alike but for LOW_BITS have one cell, and the one of them whose LOW_BITS are zero (a whole number) its own."""
    bits = v.view(np.int64)
    return (bits >> LOW_BITS) * 2 + (bits & ((1 << LOW_BITS) - 1) != 0)


def _cells(rows: DataFrame, edges: dict[int, np.ndarray | None]) -> dict[int, np.ndarray]:
    """Per column of ``edges`` its cells of values by size: number of rows, least and largest value.

    A cell lies between two edges, or is a ``_first_cell`` where there are none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _matrices(batches, COUNTED):
            for at, (f, cut) in enumerate(edges.items()):
                v = np.sort(x[at][~np.isnan(x[at])] + 0.0)  # -0.0 is 0.0
                cell = _first_cell(v) if cut is None else np.searchsorted(cut, v, side="right")
                first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(v)])
                last = np.r_[first[1:], len(v)][: len(first)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), f, np.int32)), pa.array(cell[first].astype(np.int64)),
                     pa.array((last - first).astype(np.int64)), pa.array(v[first]), pa.array(v[last - 1])],
                    names=["f", "cell", "n", "low", "high"])

    parts = rows.select(*[rows.columns[f] for f in edges]).mapInArrow(run, "f int, cell long, n long, low double, high double")
    found = parts.groupBy("f", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    f, n, low, high = (found.column(c).to_numpy() for c in ("f", "n", "low", "high"))
    out = {}
    for k in edges:
        mine = np.flatnonzero(f == k)
        mine = mine[np.argsort(low[mine])]
        out[k] = np.stack([n[mine].astype(np.float64), low[mine], high[mine]])
    return out


def _thresholds(cells: np.ndarray, n_bins: int) -> np.ndarray:
    """Thresholds that part the rows most evenly, between neighbouring cells, as MLlib strides over values."""
    n, low, high = cells
    between = (high[:-1] + low[1:]) / 2.0
    if len(between) <= n_bins - 1:
        return between
    stride = n.sum() / n_bins
    out, target, seen = [], stride, np.cumsum(n)
    for i in range(len(between)):
        if abs(seen[i] - target) < abs(seen[i + 1] - target):
            out.append(between[i])
            target += stride
    return np.array(out[: n_bins - 1])


def split_points(rows: DataFrame, n_bins: int) -> tuple[int, list[np.ndarray]]:
    """Number of rows, and the thresholds of each column from counts over all of them."""
    found, edges, n = {}, dict.fromkeys(range(len(rows.columns))), 0
    for _ in range(ROUNDS):
        cells = _cells(rows, edges)
        n = max(n, *(int(c[0].sum()) for c in cells.values()))
        edges = {}
        for f, (count, low, high) in cells.items():
            wide = (count > n / FINE) & (low < high) & (low / 2 + high / 2 > low)
            found[f] = cells[f]
            if wide.any():
                finer = [np.linspace(a, b, CUTS) for a, b in zip(low[wide], high[wide])]
                edges[f] = np.unique(np.concatenate([low, np.nextafter(low[wide], np.inf), *finer]))
        if not edges:
            break
    return n, [_thresholds(found[f], min(n_bins, max(n, 1))) for f in range(len(rows.columns))]


_BLOCK = "codes binary, y binary, margin binary, residual binary, squares binary, count binary, total binary"
_PARTS = "slot int, count binary, total binary"
# Most bytes of histograms that the driver merges; more are merged by slot in a shuffle.
AT_DRIVER = 1 << 26


def _residual(y: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What a tree is fitted to, in multiples of UNIT: the label, or the loss's negative gradient at the margin."""
    r = y.astype(np.float64) if margin is None else 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * margin, 700.0)))
    return np.rint(r / UNIT).astype(np.int32)


class _Grown:
    """A tree over bins in arrays; rows go to ``child`` up to the bin ``cut`` of ``feature`` and else to the next node."""

    def __init__(self):
        self.feature, self.cut, self.child, self.gain = [0], [0], [0], [0.0]
        self.count, self.total, self.depth = [0], [0], 0

    def split(self, at: int, feature: int, cut: int, gain: float, stats: list[tuple[int, int]]) -> list[int]:
        self.feature[at], self.cut[at], self.child[at], self.gain[at] = feature, cut, len(self.child), gain
        for n, total in stats:
            for column, v in ((self.feature, 0), (self.cut, 0), (self.child, 0), (self.gain, 0.0), (self.count, n),
                              (self.total, total)):
                column.append(v)
        return [self.child[at], self.child[at] + 1]

    def mean(self) -> np.ndarray:
        return np.array(self.total) * UNIT / np.maximum(self.count, 1)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        return np.array(self.feature), np.array(self.cut), np.array(self.child), self.depth


class _Layout:
    """How the bins of a row are kept: two features a code where they have few bins, else one."""

    def __init__(self, features: int, n_bins: int):
        self.features, self.paired = features, n_bins <= 1 << PAIR_BITS
        self.side = 1 << PAIR_BITS if self.paired else n_bins
        f = np.arange(features)
        self.column = f // 2 if self.paired else f
        self.shift = np.where(f % 2 == 0, PAIR_BITS, 0) if self.paired else f * 0
        self.mask = self.side - 1 if self.paired else (1 << 16) - 1

    def codes(self, bins: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((int(self.column[-1]) + 1, len(bins[0])), dtype=np.uint16)
        for f, v in enumerate(bins):
            out[self.column[f]] |= v.astype(np.uint16) << self.shift[f].astype(np.uint16)
        return out

    def histogram(self, codes: np.ndarray, slot: np.ndarray | None, slots: int, r: np.ndarray) -> list[np.ndarray]:
        """Rows and their summed residuals by slot, feature and bin."""
        both = np.empty((slots, self.features, self.side))
        weight, wide = r * float(1 << COUNT_BITS) + 1.0, self.side ** 2 if self.paired else self.side
        base = 0 if slot is None else slot * wide
        for c in range(len(codes)):
            sums = np.bincount(base + codes[c].astype(np.intp), weights=weight, minlength=slots * wide)
            if not self.paired:
                both[:, c] = sums.reshape(slots, wide)
                continue
            sums = sums.reshape(slots, self.side, self.side)
            both[:, 2 * c] = sums.sum(axis=2)
            if 2 * c + 1 < self.features:
                both[:, 2 * c + 1] = sums.sum(axis=1)
        both = both.astype(np.int64)
        return [both & ((1 << COUNT_BITS) - 1), both >> COUNT_BITS]

    def walk(self, codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, depth: int) -> np.ndarray:
        """The node each row of a block stands at."""
        at, row = np.zeros(codes.shape[1], dtype=np.intp), np.arange(codes.shape[1])
        column, shift = self.column[feature], self.shift[feature].astype(np.uint16)
        for _ in range(depth):
            below = child[at]
            bins = (codes[column[at], row] >> shift[at]) & self.mask
            at = np.where(below > 0, below + (bins > cut[at]), at)
        return at


def _values(batch: pa.RecordBatch, column: str, i: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch[column][i].as_buffer(), kind)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The histograms of the blocks' only slot, added up."""
    sums = None
    for b in batches:
        found = [np.stack([_values(b, c, i, np.int64) for i in range(b.num_rows)]).sum(axis=0) for c in ("count", "total") if b.num_rows]
        if found:
            sums = found if sums is None else [x + y for x, y in zip(sums, found)]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *(pa.array([v.tobytes()]) for v in sums)],
                                         names=["slot", "count", "total"])


def _best(side: int):
    """The best split of a slot from the histograms of its parts: feature -1 where none lowers the variance."""

    def run(table: pa.Table) -> pa.Table:
        count, total = (sum(np.frombuffer(v, np.int64) for v in table[c].to_pylist()).reshape(-1, side)
                        for c in ("count", "total"))
        n, s = int(count[0].sum()), int(total[0].sum())
        left_n, left_s = count.cumsum(axis=1)[:, :-1], total.cumsum(axis=1)[:, :-1]
        right_n, right_s, mean = n - left_n, s - left_s, s * UNIT / max(n, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ends = (left_s * UNIT) ** 2 / left_n + (right_s * UNIT) ** 2 / right_n
        gain = np.where((left_n > 0) & (right_n > 0), ends / max(n, 1) - mean * mean, 0.0)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (0, 0)
        if not gain.size or gain[f, b] <= 1e-13 * mean * mean:  # what rounding leaves of equal rows
            f, b, g, ln, ls = -1, 0, 0.0, 0, 0
        else:
            g, ln, ls = float(gain[f, b]), int(left_n[f, b]), int(left_s[f, b])
        return pa.table({"slot": table["slot"][:1].cast(pa.int32()), "feature": pa.array([f], pa.int32()),
                         "cut": pa.array([b], pa.int32()), "gain": [g], "n": [n], "s": [s], "left_n": [ln], "left_s": [ls]})

    return run


class _Rows:
    """The binned rows of a fit; ``stage`` holds them with the margin after the trees so far."""

    def __init__(self, rows: DataFrame, n_bins: int):
        self.n, self.points = split_points(rows.drop(rows.columns[-1]), n_bins)
        self.layout, self.rounds = _Layout(len(self.points), n_bins), Rounds("boosting", keep=1)
        points, layout = self.points, self.layout

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in _matrices(batches, BLOCK):
                for at in range(0, whole.shape[1], BLOCK):
                    x = whole[:, at : at + BLOCK]
                    codes = layout.codes([np.searchsorted(p, v, side="left") for p, v in zip(points, x)])
                    y = np.where(x[-1] > 0, 1, -1).astype(np.int8)
                    yield pa.RecordBatch.from_pydict({"codes": [codes.tobytes()], "y": [y.tobytes()]})

        cores, row_bytes = rows.sparkSession.sparkContext.defaultParallelism, 2 * (int(layout.column[-1]) + 1) + 13
        self.files = min(max(1, -(-self.n // BLOCK)), cores * -(-self.n * row_bytes // (cores * FILE_BYTES)) or 1)
        dealt = rows.mapInArrow(blocks, "codes binary, y binary").repartition(self.files)
        self.stage = self.rounds.put(self._moved(dealt, None))

    def _moved(self, stage: DataFrame, tree: _Grown | None, weight: float = 1.0) -> DataFrame:
        """Blocks with the margin after ``tree``, the squares of the old residuals by its nodes, and the root's histogram."""
        layout = self.layout
        arrays, first = (tree.arrays(), tree.mean() * weight) if tree else (None, None)
        names = [c.split()[0] for c in _BLOCK.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    y = _values(b, "y", i, np.int8)
                    codes = _values(b, "codes", i, np.uint16).reshape(-1, len(y))
                    margin, squares = None, np.zeros(0)
                    if arrays is not None:
                        at, old = layout.walk(codes, *arrays), _values(b, "residual", i, np.int32) * UNIT
                        squares = np.bincount(at, weights=old * old, minlength=len(first))
                        before = _values(b, "margin", i, np.float64)
                        margin = first[at] + before if len(before) else first[at]
                    r = _residual(y, margin)
                    count, total = layout.histogram(codes, None, 1, r)
                    made = (codes, y, np.zeros(0) if margin is None else margin, r, squares, count, total)
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()]) for v in made], names=names)

        return stage.mapInArrow(run, _BLOCK)

    def move(self, tree: _Grown, weight: float) -> np.ndarray:
        """Add ``tree`` to the margins; returns the squared residuals it was fitted to, summed by the node rows end at."""
        self.stage = self.rounds.put(self._moved(self.stage.drop("squares", "count", "total"), tree, weight))
        return sum(np.frombuffer(v, np.float64) for v in self.stage.select("squares").toArrow()["squares"].to_pylist())

    def _histograms(self, tree: _Grown, active: list[int]) -> DataFrame:
        if not tree.depth:
            return self.stage.select("count", "total").mapInArrow(_added, _PARTS)
        arrays, slots = tree.arrays(), len(active)
        slot_of = np.full(len(tree.child), -1, dtype=np.intp)
        slot_of[active] = np.arange(slots)
        layout = self.layout

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for b in batches:
                for i in range(b.num_rows):
                    r = _values(b, "residual", i, np.int32)
                    codes = _values(b, "codes", i, np.uint16).reshape(-1, len(r))
                    slot = slot_of[layout.walk(codes, *arrays)]
                    here = np.flatnonzero(slot >= 0)
                    if len(here) < len(r):
                        codes, slot, r = codes.take(here, axis=1), slot[here], r[here]
                    found = layout.histogram(codes, slot, slots, r)
                    sums = found if sums is None else (sums[0] + found[0], sums[1] + found[1])
            if sums is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(slots, dtype=np.int32)), *(pa.array([v.tobytes() for v in part]) for part in sums)],
                    names=["slot", "count", "total"])

        return self.stage.select("codes", "residual").mapInArrow(run, _PARTS)

    def grow(self, max_depth: int) -> _Grown:
        """A tree on the residuals at the present margins, level by level."""
        tree, active = _Grown(), [0]
        best = "slot int, feature int, cut int, gain double, n long, s long, left_n long, left_s long"
        while active:
            deeper, parts = [], self._histograms(tree, active)
            if self.files * len(active) * self.layout.features * self.layout.side * 16 <= AT_DRIVER:
                found, run = parts.toArrow(), _best(self.layout.side)
                splits = [run(found.filter(pc.equal(found["slot"], slot))).to_pylist()[0] for slot in range(len(active))]
            else:
                splits = [r.asDict() for r in parts.groupBy("slot").applyInArrow(_best(self.layout.side), best).collect()]
            for r in sorted(splits, key=lambda r: r["slot"]):
                at = active[r["slot"]]
                tree.count[at], tree.total[at] = r["n"], r["s"]
                if r["feature"] >= 0 and tree.depth < max_depth:
                    sides = [(r["left_n"], r["left_s"]), (r["n"] - r["left_n"], r["s"] - r["left_s"])]
                    deeper += tree.split(at, r["feature"], r["cut"], r["gain"], sides)
            tree.depth += bool(deeper)
            active = [c for c in deeper if tree.count[c] > 1] if tree.depth < max_depth else []
        return tree


def _ml_tree(jvm, gateway, tree: _Grown, squares: np.ndarray, points: list[np.ndarray], n_features: int):
    """``tree`` as an MLlib regression tree."""
    ml, mean = jvm.org.apache.spark.ml, tree.mean()

    def node(at: int):
        sides = [node(tree.child[at] + i) for i in (0, 1)] if tree.child[at] else []
        square = float(squares[at]) if not sides else sides[0][1] + sides[1][1]
        stats, n = gateway.new_array(jvm.double, 3), tree.count[at]
        stats[0], stats[1], stats[2] = float(n), tree.total[at] * UNIT, square
        calculator = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, n)
        impurity = max(square / max(n, 1) - float(mean[at]) ** 2, 0.0)
        if not sides:
            return ml.tree.LeafNode(float(mean[at]), impurity, calculator), square
        f = tree.feature[at]
        split = ml.tree.ContinuousSplit(f, float(points[f][tree.cut[at]]))
        return ml.tree.InternalNode(float(mean[at]), impurity, tree.gain[at], sides[0][0], sides[1][0], split, calculator), square

    return ml.regression.DecisionTreeRegressionModel(f"dtr_{uuid.uuid4().hex[:12]}", node(0)[0], n_features)


def fit(train: DataFrame, features: list[str], label: str = "label", maxIter: int = 20, maxDepth: int = 5,
        stepSize: float = 0.1, maxBins: int = 32, seed: int | None = None):
    """An MLlib ``GBTClassificationModel`` of the 0/1 ``label``.  Nothing is drawn, so ``seed`` changes nothing."""
    from pyspark.ml.classification import GBTClassificationModel

    spark = train.sparkSession
    rows = _Rows(train.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double")), maxBins)
    if not rows.n:
        raise ValueError("no rows to fit trees on")
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, maxIter)
    weights = gateway.new_array(jvm.double, maxIter)
    for i in range(maxIter):
        weights[i] = 1.0 if i == 0 else stepSize
        tree = rows.grow(maxDepth)
        trees[i] = _ml_tree(jvm, gateway, tree, rows.move(tree, weights[i]), rows.points, len(features))
    rows.rounds.delete(spark)
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"gbtc_{uuid.uuid4().hex[:12]}", trees, weights, len(features), 2))
