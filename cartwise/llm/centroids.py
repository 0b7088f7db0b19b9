"""Centroid clustering on integer vectors with subvector dictionaries.

The vectors are read once into segments of bounded size.  In a segment every
block of a few dimensions is dictionary-encoded without loss: its distinct
subvectors, and one code per vector.  A round computes the exact distances of
the distinct subvectors to the centroids once, adds the partial distances up
by code, and sums the new centroids as counts of codes times subvectors.  All
arithmetic is on integers, so results do not depend on the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.session import materialize

CLUSTERS = 16
ROUNDS = 3
COMPONENTS = 64
SCALE = 64
#: Vectors of one segment; bounds its dictionaries and the memory of a task.
SEGMENT = 8192
#: Block widths that a segment chooses from.
WIDTHS = (1, 2, 4, 8)
#: Largest component: squared distances of this many components still fit a long.
LARGEST = 1 << 26

_SEGMENT_SCHEMA = "vec_ids array<long>, width int, codes binary, sizes binary, entries binary"


def integer_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of the vectors with exactly ``components`` finite components.

    Null vectors, other lengths and vectors with a null or non-finite
    component are left out.  Repeated rows stay, and so do null ids.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    unusable = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") == components) & ~unusable)
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * float(scale))).alias("v"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: str = "1") -> np.ndarray:
    """The vectors with the smallest hash of ``seed:vec_id``, in that order; null ids come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return np.array([r["v"] for r in rows.orderBy(order, "v").limit(clusters).collect()], dtype=np.int64)


def encode_segment(v: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    """(width, codes per block, distinct subvectors per block) of an integer matrix.

    Of the widths that divide the dimensions, the one is taken whose
    dictionaries and codes cost the fewest operations in a round.
    """
    best = None
    for width in widths:
        if v.shape[1] % width:
            continue
        codes, entries = [], []
        for at in range(0, v.shape[1], width):
            block = np.ascontiguousarray(v[:, at : at + width])
            key = block.view([("", block.dtype)] * width).ravel() if width > 1 else block.ravel()
            _, first, code = np.unique(key, return_index=True, return_inverse=True)
            codes.append(code.astype(np.uint16 if len(first) <= 1 << 16 else np.uint32))
            entries.append(block[first])
        cost = sum(e.size for e in entries) + len(v) * len(codes)
        if best is None or cost < best[0]:
            best = cost, width, codes, entries
    return best[1:]


class Segment:
    """A decoded segment: partial distances and sums go by code, never by vector."""

    def __init__(self, n: int, width: int, codes: bytes, sizes: bytes, entries: bytes):
        self.n, self.width = n, width
        self.sizes = np.frombuffer(sizes, np.int32)
        kind = np.uint16 if len(codes) == 2 * n * len(self.sizes) else np.uint32
        self.codes = np.frombuffer(codes, kind).reshape(len(self.sizes), n)
        rows = np.frombuffer(entries, np.int32).reshape(-1, width)
        self.entries = np.split(rows, np.cumsum(self.sizes)[:-1])

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each vector; of equal distances the smaller number."""
        total = np.zeros((self.n, len(centroids)), dtype=np.int64)
        for b, (code, own) in enumerate(zip(self.codes, self.entries)):
            part = np.zeros((len(own), len(centroids)), dtype=np.int64)
            for j in range(self.width):
                gap = own[:, j, None].astype(np.int64) - centroids[None, :, b * self.width + j]
                part += gap * gap
            total += part[code]
        cluster = total.argmin(axis=1)
        return cluster, total[np.arange(self.n), cluster]

    def sums(self, cluster: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, componentwise sums) of each cluster."""
        parts = []
        for code, own in zip(self.codes, self.entries):
            seen = np.bincount(cluster * len(own) + code, minlength=clusters * len(own)).reshape(clusters, len(own))
            parts.append(seen @ own.astype(np.int64))
        return np.bincount(cluster, minlength=clusters), np.concatenate(parts, axis=1)


def encode(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Integer vectors as a staged table of dictionary-encoded segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            v = flat.reshape(b.num_rows, -1) if b.num_rows else flat.reshape(0, 1)
            if len(v) and (np.abs(v.astype(np.float64)) > LARGEST).any():
                raise ValueError(f"a component is larger than {LARGEST}: its distances would not fit a long")
            for at in range(0, b.num_rows, segment):
                ids.append(b.column(0).slice(at, segment))
                held.append(v[at : at + segment].astype(np.int32))
                while sum(map(len, held)) >= segment:
                    ids, held, out = _cut(ids, held, segment)
                    yield out
        if held:
            yield _cut(ids, held, segment)[2]

    return materialize(rows.mapInArrow(run, _SEGMENT_SCHEMA), "centroid-segments")


def _cut(ids: list[pa.Array], held: list[np.ndarray], segment: int):
    """The first ``segment`` vectors as a row, and the rest."""
    all_ids, v = pa.concat_arrays(ids), np.concatenate(held)
    width, codes, entries = encode_segment(v[:segment])
    wide = max(c.dtype.itemsize for c in codes)
    row = pa.RecordBatch.from_arrays([
        pa.array([all_ids[:segment].to_pylist()], pa.list_(pa.int64())), pa.array([width], pa.int32()),
        pa.array([b"".join(c.astype(f"u{wide}").tobytes() for c in codes)]),
        pa.array([np.array([len(e) for e in entries], np.int32).tobytes()]),
        pa.array([b"".join(e.astype(np.int32).tobytes() for e in entries)]),
    ], names=["vec_ids", "width", "codes", "sizes", "entries"])
    rest = len(v) > segment
    return [all_ids[segment:]] if rest else [], [v[segment:]] if rest else [], row


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Segment]]:
    for i in range(batch.num_rows):
        ids = batch.column(0)[i].values
        yield ids, Segment(len(ids), *(batch.column(c)[i].as_py() for c in range(1, 5)))


def improve(segments: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the mean of their vectors; empty ones stay.

    A task sends one row per cluster and dimension, and Spark adds them up.
    """
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for _, s in _segments(b):
                n, t = s.sums(s.nearest(centroids)[0], k)
                counts, sums = counts + n, sums + t
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k), dims)), pa.array(np.tile(np.arange(dims), k)),
             pa.array(np.repeat(counts, dims)), pa.array(sums.ravel())], names=["cluster", "dim", "n", "total"])

    parts = segments.mapInArrow(run, "cluster long, dim long, n long, total long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        if r["n"]:
            out[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return out


def assign(segments: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, s in _segments(b):
                cluster, distance = s.nearest(centroids)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return segments.mapInArrow(run, "vec_id long, cluster int, distance long")


def centroid_digest(centroid: np.ndarray) -> str:
    """Lower-case hex SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS,
            scale: int = SCALE, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Vectors as in ``integer_vectors``; centroids start as in
    ``first_centroids`` (fewer vectors than clusters: one centroid each) and
    take ``rounds`` rounds before the last assignment.  Repeated rows count
    each time, a null id is a vector like any other, other columns are
    ignored, an empty table gives no rows.  A component beyond 2**26 after
    scaling raises: its distance would not fit a long.  The driver holds the
    centroids only (clusters x components).
    """
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = integer_vectors(vectors, components, scale, id_col, vector_col)
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    segments = encode(rows)
    for _ in range(rounds):
        centroids = improve(segments, centroids)
    found = materialize(assign(segments, centroids), "centroid-assignment")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    inertia = sum(r["s"] for r in sums)
    facts = spark.createDataFrame(
        [(r["cluster"], r["s"], inertia, centroid_digest(centroids[r["cluster"]])) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(*[c.split()[0] for c in schema.split(", ")])
