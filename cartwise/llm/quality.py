"""Quality classifier: averaged hashed subword embeddings and a softmax, trained by numpy SGD.

Features of a text are its words, its pairs of neighbouring words and its byte
n-grams, each hashed to one of BUCKETS learned vectors.  A document is the
mean of its feature vectors; a softmax layer gives the class probabilities.
A pair of equal words hashes to one bucket whatever the word, so repetition is
a feature of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm.text import Words, free_name, mix64, slices, text_bytes

BUCKETS = 1 << 14
DIM = 16
GRAMS = (3, 4)
#: SGD steps, whatever the number of rows.
STEPS = 400
RATE = 80.0
BATCH = 64
SEED = 11
#: Labelled rows that the classifier is fitted on, at most: those with the smallest MD5 of the id.
TRAIN_ROWS = 4000
FOLDS, TEST_FOLD = 4, 2
ACCEPT = 0.7


def _kinds(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, texts they belong to, ascending) for words, word pairs and each n-gram length."""
    w = Words(texts, lower=False)
    low = np.uint64(BUCKETS - 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    yield w.hash & low, owner
    if len(owner) > 1:
        pair = owner[1:] == owner[:-1]
        yield (mix64(w.hash[1:] ^ w.hash[:-1]) & low)[pair], owner[1:][pair]
    raw = np.frombuffer(w.data, dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    for n in GRAMS:
        if len(raw) >= n:
            m = len(raw) - n + 1
            gram = raw[:m].copy()
            for k in range(1, n):
                gram |= raw[k : k + m] << np.uint32(8 * k)
            gram *= np.uint32(0x9E3779B1 + 2 * n)
            last = np.ones(len(raw), dtype=bool)
            for k in range(n):  # not over the end of a text
                last[np.maximum(0, ends - k)] = False
            last = last[:m]
            yield (gram >> np.uint32(32 - BUCKETS.bit_length() + 1))[last], owner[:m][last]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds): the features of text ``t`` are ``buckets[bounds[t]:bounds[t + 1]]``."""
    kinds = list(_kinds(texts))
    owner = np.concatenate([o for _, o in kinds])
    bucket = np.concatenate([b.astype(np.int32) for b, _ in kinds])
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
    return bucket[np.argsort(owner, kind="stable")], bounds


@dataclass
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def table(self) -> np.ndarray:
        """What each bucket adds to the log odds of label 1; averaging and the softmax are linear in it."""
        return self.vectors.astype(np.float64) @ (self.weights[:, 1] - self.weights[:, 0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1; a text without features gets that of the bias alone."""
        return score(self.table(), float(self.bias[1] - self.bias[0]), texts)


def score(table: np.ndarray, bias: float, texts: list[bytes]) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for bucket, owner in _kinds(texts):
        total += np.bincount(owner, weights=table[bucket], minlength=len(texts))
        n += np.bincount(owner, minlength=len(texts))
    odds = bias + total / np.maximum(1, n)
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS, rate: float = RATE,
          seed: int = SEED) -> Model:
    """SGD on (distinct buckets, shares) per document; the rate falls to zero in a line."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, 2)), np.zeros(2)
    if not len(rows):
        return Model(vectors, weights, bias)
    share = np.bincount(labels, minlength=2) + 1.0
    bias = np.log(share / share.sum())
    step = 0
    while step < steps:
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            if step == steps:
                break
            pick = order[at : at + BATCH]
            x = np.zeros((len(pick), BUCKETS), dtype=np.float32)
            for k, r in enumerate(pick):
                x[k, rows[r][0]] = rows[r][1]
            mean = (x @ vectors).astype(np.float64)
            z = mean @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p /= len(pick)
            lr = rate * (1 - step / steps)
            to_mean = (p @ weights.T).astype(np.float32)
            weights -= min(lr, 1.0) * (mean.T @ p)
            bias -= min(lr, 1.0) * p.sum(axis=0)
            vectors -= np.float32(lr) * (x.T @ to_mean)
            step += 1
    return Model(vectors, weights, bias)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled rows outside the test fold, ``train_rows`` at most.

    Rows with a null id or label are left out; of repeated ids the smallest
    label and text count.  Each sampled text is reduced to bucket shares on
    the executors (at most BUCKETS numbers, however long the text), and only
    these reach the driver.  Without labelled rows all scores are one half.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where("id is not null and y in (0, 1)").where(fold(F.col("id"), FOLDS) != TEST_FOLD)
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    known = known.orderBy(F.md5(F.col("id").cast("string")), "id").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2):
                bucket, bounds = features(text_bytes(part.column(2)))
                own = [np.unique(bucket[s:e], return_counts=True) for s, e in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([i.astype(np.int16) for i, _ in own], pa.list_(pa.int16())),
                     pa.array([(c / c.sum()).astype(np.float32) for _, c in own], pa.list_(pa.float32()))],
                    names=["id", "y", "bucket", "share"])

    found = sample.mapInArrow(run, "id long, y int, bucket array<short>, share array<float>").toArrow()
    rows = [(b.values.to_numpy(), s.values.to_numpy()) for b, s in zip(found["bucket"], found["share"])]
    order = np.argsort(found["id"].to_numpy(), kind="stable")
    model = train([rows[i] for i in order], found["y"].to_numpy().astype(np.int64)[order])
    del rows, found  # the sample is the largest thing the driver ever holds: give its memory back
    pa.default_memory_pool().release_unused()
    return model


def with_score(docs: DataFrame, model: Model, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` and the score of each whole text; null and empty texts are scored too."""
    at, names = docs.columns.index(text_col), [*docs.columns, score_col]
    shipped = docs.sparkSession.sparkContext.broadcast((model.table(), float(model.bias[1] - model.bias[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shipped.value
        for b in batches:
            for part in slices(b, at):
                scores = score(table, bias, text_bytes(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             accept: float = ACCEPT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.  Other columns are not read."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_score(rows, model).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == TEST_FOLD).alias("held_out"), "score",
        (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             accept: float = ACCEPT) -> DataFrame:
    """``docs`` without the rows scored under ``accept``; all columns unchanged, whatever their names.

    Null, empty and blank texts have the score of the bias alone and repeated
    rows one score each, so they stay or go together; whole texts are scored,
    however long.  Ids and labels decide nothing, so a null id is no matter.
    Without labelled rows all scores are one half, under ACCEPT.  No rows give
    no rows.
    """
    name = free_name(docs.columns, "score")
    rows = with_score(docs, fit(docs, labels, id_col, text_col), name, text_col)
    return rows.where(F.col(name) >= accept).select(*docs.columns)
