"""Embedding near-duplicates: PCA-ordered tiled comparison with suffix-norm bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm.components import components
from cartwise.session import materialize

THRESHOLD = 0.98
#: Vectors of a tile, expected; a pair of tiles is one unit of work.
TILE = 4096
#: Rows of the blocks that are multiplied at once inside a unit.
BLOCK = 512
#: The bound is widened by this much against rounding; links are decided on the given vectors.
SLACK = 1e-6


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow of large components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row pair in double precision."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, the axes of the second moments of the unit vectors, largest first.

    Every task sends one d x d sum; they are added in Spark, and d x d numbers
    reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, v in _by_dim(b.column(0)):
                u = unit_rows(v)
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, m in sums.items():
            yield pa.RecordBatch.from_pydict({"d": [d] * d, "i": list(range(d)), "row": m.tolist()})

    parts = classes.select("v").mapInArrow(run, "d long, i long, row array<double>")
    cells = parts.select("d", "i", F.posexplode("row").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x"))
    axes: dict[int, np.ndarray] = {}
    for r in cells.orderBy("d", "i", "j").toLocalIterator():
        axes.setdefault(r["d"], np.zeros((r["d"], r["d"])))[r["i"], r["j"]] = r["x"]
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() for d, m in axes.items()}


def _by_dim(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) of a list column."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, flat[starts[rows][:, None] + np.arange(d)]


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float,
                same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) index arrays of the pairs with cosine >= threshold; of one tile with itself, i < j.

    Products are summed over the leading axes first.  What the other axes can
    add is at most the product of the two suffix norms; pairs that cannot
    reach the threshold any more are left out, the rest go on.
    """
    d = len(axes)
    cuts = [0, *sorted({min(d, x) for x in (8, 16, 32)}), d]
    cuts = sorted(set(cuts))
    far = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def ready(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        y = unit_rows(v) @ axes
        order = np.argsort(y[:, 0], kind="stable")
        y = y[order]
        rest = [np.sqrt(np.maximum(0, np.einsum("ij,ij->i", y[:, c:], y[:, c:]))) for c in cuts]
        return order, y, rest, v

    left = ready(a)
    right = left if same else ready(b)
    for s in range(0, len(a), BLOCK):
        oa, ya, ra = left[0][s : s + BLOCK], left[1][s : s + BLOCK], [x[s : s + BLOCK] for x in left[2]]
        for t in range(s if same else 0, len(b), BLOCK):
            ob, yb, rb = right[0][t : t + BLOCK], right[1][t : t + BLOCK], [x[t : t + BLOCK] for x in right[2]]
            if ya[0, 0] - yb[-1, 0] > far or yb[0, 0] - ya[-1, 0] > far:
                continue
            dot = ya[:, : cuts[1]] @ yb[:, : cuts[1]].T
            alive = dot + ra[1][:, None] * rb[1][None, :] >= threshold - SLACK
            if same and s == t:
                alive &= np.tri(len(ya), len(yb), -1, dtype=bool).T
            i, j = np.nonzero(alive)
            dot = dot[i, j]
            for k in range(1, len(cuts) - 1):
                if not len(i):
                    break
                dot = dot + np.einsum("ij,ij->i", ya[i, cuts[k] : cuts[k + 1]], yb[j, cuts[k] : cuts[k + 1]])
                alive = dot + ra[k + 1][i] * rb[k + 1][j] >= threshold - SLACK
                i, j, dot = i[alive], j[alive], dot[alive]
            if len(i):
                i, j = oa[i], ob[j]
                linked = cosines(left[3][i], right[3][j]) >= threshold
                yield i[linked], j[linked]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the links (i, j) connect it with."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(axes: dict[int, np.ndarray], threshold: float):
    """The work on one pair of tiles: link counts per class and a spanning forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table["side"].to_numpy()
        ids, copies = table["cid"].to_numpy(), table["copies"].to_numpy()
        _, _, v = next(_by_dim(table["v"].chunk(0)))
        same = not (side == 1).any()
        at = [np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))]
        links = np.zeros(len(ids), dtype=np.int64)
        label = np.arange(len(ids))
        for i, j in close_pairs(v[at[0]], v[at[1]], axes[v.shape[1]], threshold, same):
            i, j = at[0][i], at[1][j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label = spanning(len(ids), np.concatenate((np.arange(len(ids)), i)), np.concatenate((label, j)))
        some, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({
            "a": np.concatenate((ids[some], ids[moved])),
            "b": np.concatenate((ids[some], ids[label[moved]])),
            "links": np.concatenate((links[some], np.zeros(len(moved), dtype=np.int64))),
        })

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vec_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null label and equal dimension are compared.
    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing: n_links 0, component_id their vec_id.  Repeated rows
    are vectors of their own; equal vectors are one class and are compared
    once.  A null vec_id takes part but is never the smallest; kept is true
    where vec_id and component_id are equal, both null included.  Other
    columns are not read, no rows give no rows.

    Vectors are laid in slabs along the first principal axis, as wide as two
    linked unit vectors can be apart, so only equal and adjacent slabs meet.  A
    slab with more than ``tile`` classes is split by hash into tiles, and each
    pair of tiles is one unit: a label or slab that holds most rows is many
    units of bounded size.  Units return counts and a spanning forest, never
    all pairs.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vec_col).alias("v"))
    if not isinstance(rows.schema["v"].dataType.elementType, (T.FloatType, T.DoubleType)):
        rows = rows.withColumn("v", v.cast("array<double>"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    usable = F.col("label").isNotNull() & v.isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = rows.where("usable").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    axes = principal_axes(classes)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    first = {d: a[:, 0] for d, a in axes.items()}

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slab = np.zeros(b.num_rows, dtype=np.int64)
            for d, at, m in _by_dim(b.column(b.schema.get_field_index("v"))):
                slab[at] = np.floor(unit_rows(m) @ first[d] / width)
            yield b.append_column("slab", pa.array(slab))

    thin = classes.select("cid", "copies", "label", "v", F.size("v").alias("dim"))
    placed = materialize(thin.mapInArrow(slabs, T.StructType([*thin.schema.fields, T.StructField("slab", T.LongType())])), "vector-slabs")
    key = ["label", "dim", "slab"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sizes = materialize(sizes, "vector-tiles")
    beside = sizes.select("label", "dim", (F.col("slab") - 1).alias("slab"), F.col("tiles").alias("after"))
    behind = sizes.select("label", "dim", (F.col("slab") + 1).alias("slab"), F.col("tiles").alias("before"))
    sizes = sizes.join(beside, key, "left").join(behind, key, "left")
    own = placed.join(sizes, key).withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))

    def unit(slab, step, a, b, side):
        return F.struct(slab.alias("slab"), F.lit(step).alias("step"), a.cast("int").alias("ta"),
                        b.cast("int").alias("tb"), side.cast("int").alias("side"))

    def upto(n):  # 0 .. n-1, none for null
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    t, s = F.col("tile"), F.col("slab")
    units = F.concat(
        F.transform(upto(F.col("tiles")), lambda o: unit(s, 0, F.least(t, o), F.greatest(t, o), (t > o))),
        F.transform(upto(F.coalesce("after", F.lit(0))), lambda o: unit(s, 1, t, o, F.lit(0))),
        F.transform(upto(F.coalesce("before", F.lit(0))), lambda o: unit(s - 1, 1, o, t, F.lit(1))),
    )
    work = own.select("label", "dim", "cid", "copies", "v", F.explode(units).alias("u"))
    work = work.select("label", "dim", "u.*", "cid", "copies", "v")
    found = work.groupBy("label", "dim", "slab", "step", "ta", "tb").applyInArrow(
        _compare(axes, threshold), "a long, b long, links long")
    found = materialize(found, "vector-links")
    counts = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    comp = components(found.where("a <> b").select("a", "b")).withColumnRenamed("id", "cid")
    comp = comp.select("cid", F.col("label").alias("root"))
    named = classes.join(comp, "cid", "left").join(counts, "cid", "left")
    named = named.withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(
        "label", "v", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    good = rows.where("usable").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    bad = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                          F.col("vec_id").alias("component_id"))
    both = good.unionByName(bad)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
