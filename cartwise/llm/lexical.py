"""Ranked lexical search, reversed: documents stream past an inverted index over the items.

The items are the query set.  Blocks of items with a bounded number of terms
become a broadcast inverted index; the terms of each document that some item
holds are counted once into a staged table, which gives the corpus statistics
and then flows through the index, updating one bounded heap per item.  The
heaps of all tasks are merged in two levels.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cartwise.llm.text import slices, text_bytes
from cartwise.session import materialize

TOP = 10
#: (item, term) entries of one broadcast index; further items make further blocks, a pass each.
BLOCK_ENTRIES = 1_000_000
#: Scores (documents x items) that a task holds at once.
CELLS = 1 << 20
#: Groups of tasks whose heaps are merged first.
MERGE_GROUPS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and digits and of all other characters, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, terms): the distinct terms of each item; rows of one id are one item, none without terms."""
    folded = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    rows = items.select(F.col(id_col).alias("item_id"),
                        F.explode(F.array_distinct(F.split(folded, SEPARATORS))).alias("term"))
    return rows.where("term <> ''").groupBy("item_id").agg(F.collect_set("term").alias("terms"))


class Index:
    """Inverted index of a block of items: for each term the items that hold it."""

    def __init__(self, ids: list, sets: list[list[str]]):
        self.ids = ids
        self.number: dict[bytes, int] = {}
        pairs = [(self.number.setdefault(t.encode(), len(self.number)), i) for i, own in enumerate(sets) for t in own]
        pairs.sort()
        self.items = np.array([i for _, i in pairs], dtype=np.int64)
        self.first = np.searchsorted([t for t, _ in pairs], np.arange(len(self.number) + 1))
        #: Weights stay below 2**16 and a term's share below 2**20, so sums are exact in doubles up to 2**17 terms.
        self.split = max(map(len, sets)) > 1 << 17

    def count(self, text: bytes) -> tuple[int, list[int], list[int]]:
        """(all terms, known terms' numbers, how often they occur) of a text."""
        own = terms(text)
        seen = [(self.number[t], n) for t, n in Counter(own).items() if t in self.number]
        return len(own), [t for t, _ in seen], [n for _, n in seen]

    def scores(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """Sum of the values of each document's terms for each item, as (documents, items)."""
        size = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        cell = np.repeat(doc, size) * len(self.ids) + self.items[at]
        value = np.repeat(value, size)
        add = lambda v: np.bincount(cell, v, n_docs * len(self.ids)).astype(np.int64)
        total = (add(value >> 26) << 26) + add(value & ((1 << 26) - 1)) if self.split else add(value)
        return total.reshape(n_docs, len(self.ids))


class Heaps:
    """The best documents of each item; the smallest entry of a full heap is its threshold."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.heaps: list[list[tuple]] = [[] for _ in range(items)]
        self.score = np.zeros(items, np.int64)
        self.doc = np.full(items, np.iinfo(np.int64).min)

    def update(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """Offer the scores (documents, items) of some documents; equal scores prefer the smaller id, null last."""
        order = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], dtype=np.int64)
        better = (scores > self.score) | ((scores == self.score) & (scores > 0) & (order[:, None] < self.doc))
        for d, i in zip(*(x.tolist() for x in np.nonzero(better))):
            entry, heap = (int(scores[d, i]), ids[d] is not None, -(ids[d] or 0)), self.heaps[i]
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.top:
                self.score[i] = heap[0][0]
                self.doc[i] = -heap[0][2] if heap[0][1] else np.iinfo(np.int64).max

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for i, heap in enumerate(self.heaps):
            for score, known, doc in heap:
                yield i, -doc if known else None, score


def _blocks(items: DataFrame, entries: int) -> Iterator[Index]:
    """Indexes of at most ``entries`` entries (one item at least), read partition by partition."""
    ids, sets, held = [], [], 0
    for row in items.toLocalIterator():
        if held and held + len(row["terms"]) > entries:
            yield Index(ids, sets)
            ids, sets, held = [], [], 0
        ids.append(row["item_id"])
        sets.append(row["terms"])
        held += len(row["terms"])
    if ids:
        yield Index(ids, sets)


def _count(docs: DataFrame, index) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents with a term, staged; the texts are read once per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = index.value.count
        for b in batches:
            for part in slices(b, "text"):
                found = [count(t) for t in text_bytes(part.column(1))]
                keep = pa.array([n > 0 for n, _, _ in found], pa.bool_())
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([n for n, _, _ in found], pa.int64()),
                     pa.array([t for _, t, _ in found], pa.list_(pa.int32())),
                     pa.array([c for _, _, c in found], pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])
                yield out.filter(keep)

    return materialize(docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>"), "lexical-counts")


def _document_frequency(counted: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term of the index, counted in the tasks and added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    found = counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in found.toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def _length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 90 + (90 * n * n_docs) div n_terms of each length."""
    if len(n) and int(n.max()) * 90 * n_docs >= 1 << 62:
        return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], dtype=np.int64)
    return 10 + 90 * n * n_docs // n_terms


def _best(counted: DataFrame, index, weights, n_docs: int, n_terms: int, top: int, id_type: T.DataType) -> DataFrame:
    """(item_id, doc_id, score): each task's heaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = index.value, weights.value
        heaps, rows = Heaps(len(own.ids), top), max(1, CELLS // len(own.ids))
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                n = part.column(1).to_numpy()
                sizes = np.diff(part.column(2).offsets.to_numpy())
                doc = np.repeat(np.arange(len(n)), sizes)
                term = part.column(2).flatten().to_numpy().astype(np.int64)
                tf = part.column(3).flatten().to_numpy()
                m = _length_norm(n, n_docs, n_terms)
                value = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                heaps.update(own.scores(doc, term, value, len(n)), part.column(0).to_pylist())
        out = list(heaps.rows())
        yield pa.RecordBatch.from_arrays(
            [pa.array([own.ids[i] for i, _, _ in out], to_arrow_type(id_type)), pa.array([d for _, d, _ in out], pa.int64()),
             pa.array([s for _, _, s in out], pa.int64())], names=["item_id", "doc_id", "score"])

    schema = T.StructType([T.StructField("item_id", id_type), T.StructField("doc_id", T.LongType()),
                           T.StructField("score", T.LongType())])
    return counted.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text", block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item with a score above 0.

    Null texts have no terms.  Every row of ``docs`` is a document of its own;
    rows of ``items`` with equal ids are one item, and an item without terms
    or hits has no rows.  Equal scores go by ascending doc_id, null last, and
    copies of a row take ranks of their own.  Whole texts are counted,
    whatever their length; other columns are ignored; empty tables give no
    rows.  Items beyond ``block_entries`` terms are searched for block by
    block, one pass over the documents each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    queries = item_terms(items, item_id, item_text)
    id_type = queries.schema["item_id"].dataType
    found = None
    for block in _blocks(queries, block_entries):
        index = spark.sparkContext.broadcast(block)
        counted = _count(rows, index)
        n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = _document_frequency(counted, len(block.number))
        weights = spark.sparkContext.broadcast(np.array([weight(n_docs, int(x)) for x in df], dtype=np.int64))
        best = _best(counted, index, weights, n_docs, n_terms, top, id_type)
        found = best if found is None else found.union(best)
    if found is None:
        found = spark.createDataFrame([], T.StructType([T.StructField("item_id", id_type)]).add("doc_id", "long").add("score", "long"))
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    group = found.withColumn("task_group", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    near = group.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "task_group").orderBy(*order)))
    near = near.where(F.col("rank") <= top).drop("rank", "task_group")
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return last.where(F.col("rank") <= top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
