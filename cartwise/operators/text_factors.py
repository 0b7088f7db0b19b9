"""Dense text vectors (M5): a low-rank factorisation of the product-term matrix.

Terms are hashed into a fixed number of columns.  The Gram matrix of the
counts is summed up in the tasks and added by Spark; it holds whole numbers,
so it does not depend on how the rows are partitioned.  The driver sees that
one matrix of bounded size, weighs it by inverse document frequency and takes
its leading eigenvectors, onto which the rows are projected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the hashed matrix: the driver holds their square, a task sends half of it.
COLUMNS = 512
#: Dimensions of a vector.
DIMENSIONS = 64
#: Rows of the dense block that a task multiplies at once.
CHUNK = 4096


def term_columns(texts: DataFrame, columns: int = COLUMNS, key: str = "product_id", text: str = "combined_text") -> DataFrame:
    """(key, terms array<int>): the column of each word, repeats included; NULL and blank texts have none."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\W+")
    words = F.filter(words, lambda w: w != "")
    return texts.select(key, F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(columns)).cast("int")).alias("terms"))


def _counts(terms: pa.Array, columns: int) -> np.ndarray:
    """The dense count matrix of some rows."""
    sizes = np.diff(terms.offsets.to_numpy())
    cell = np.repeat(np.arange(len(sizes)), sizes) * columns + terms.flatten().to_numpy(zero_copy_only=False)
    return np.bincount(cell, minlength=len(sizes) * columns).reshape(len(sizes), columns).astype(np.float64)


def gram(terms: DataFrame, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """(Gram matrix of the counts, rows that hold each column), both exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((columns, columns)), np.zeros(columns)
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                x = _counts(b.column(0).slice(at, CHUNK), columns)
                total += x.T @ x
                rows += (x > 0).sum(axis=0)
        i, j = np.nonzero(np.triu(total))
        held = np.flatnonzero(rows)
        # row -1 counts the rows that hold a column
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((i, np.full(len(held), -1)))), pa.array(np.concatenate((j, held))),
             pa.array(np.concatenate((total[i, j], rows[held])).astype(np.int64))], names=["i", "j", "v"])

    out, held = np.zeros((columns, columns)), np.zeros(columns)
    parts = terms.select("terms").mapInArrow(run, "i long, j long, v long")
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r["i"] < 0:
            held[r["j"]] = r["v"]
        else:
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out, held


@dataclass
class TextFactors:
    """A fitted factorisation: weights of the columns, orthonormal basis (columns x dimensions), eigenvalues of all."""

    weight: np.ndarray
    basis: np.ndarray
    values: np.ndarray

    @property
    def explained(self) -> float:
        """Share of the weighted matrix's squared norm that the vectors keep."""
        total = float(self.values.sum())
        return float(self.values[: self.basis.shape[1]].sum()) / total if total > 0 else 1.0

    def transform(self, texts: DataFrame, key: str = "product_id", text: str = "combined_text", unit: bool = True) -> DataFrame:
        """(key, embedding array<float>): each row's projection, of length one if ``unit`` (zero for no words)."""
        weight, basis = self.weight, self.basis
        terms = term_columns(texts, len(weight), key, text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNK):
                    b = whole.slice(at, CHUNK)
                    y = (_counts(b.column(1), len(weight)) * weight) @ basis
                    if unit:
                        norm = np.linalg.norm(y, axis=1, keepdims=True)
                        y = np.divide(y, norm, out=np.zeros_like(y), where=norm > 0)
                    flat = pa.array(y.astype(np.float32).ravel())
                    ends = pa.array(np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32)[: len(y) + 1])
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], names=[key, "embedding"])

        kind = terms.schema[key].dataType.simpleString()
        return terms.mapInArrow(run, f"{key} {kind}, embedding array<float>")


def fit(texts: DataFrame, dimensions: int = DIMENSIONS, columns: int = COLUMNS, key: str = "product_id",
        text: str = "combined_text") -> TextFactors:
    """Factors of all rows with words: inverse document frequencies ln((n + 1) / (rows + 1)) and the leading directions.

    Directions beyond the matrix's rank are left out; the sign of each is
    that of its largest component, so equal inputs give equal vectors.
    """
    terms = term_columns(texts, columns, key, text).where(F.size("terms") > 0)
    counts, held = gram(terms, columns)
    n = terms.count()
    weight = np.where(held > 0, np.log((n + 1) / (held + 1)), 0.0)
    values, vectors = np.linalg.eigh(counts * weight[:, None] * weight[None, :])
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    rank = int((values > 1e-9 * max(float(values[0]), 1e-300)).sum())
    basis = vectors[:, : max(1, min(dimensions, rank))]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    return TextFactors(weight, basis, values)
