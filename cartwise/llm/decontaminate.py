"""Benchmark decontamination: size-partitioned MinHash containment search.

A short item inside a long document has a Jaccard similarity near zero, so
equal MinHash sketches of both sides would miss it.  The sketch is one-sided:
of an item's ``q`` shingles the bottom-m by hash are kept.  Items are
partitioned by size (powers of two of ``q``); ``m`` follows from the size, so
that a document which holds the wanted share of the shingles holds at least
one of the sketch: of ``q`` shingles ``q - ceil(t q)`` may be missing, and one
more than that is looked for.  Only a sketch hash proposes an item, and not
to documents with too few shingles for its partition.  Proposals are verified
by exact shingle containment on the words, with all of the item's shingles,
so the result has neither misses nor false hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cartwise.llm.text import Words, free_name, gram_hash, grams_inside, slices, text_bytes

WIDTH = 5
THRESHOLD = 0.8
#: Words of benchmark items that one broadcast holds; more items are searched for block by block.
BLOCK_WORDS = 1_000_000


def needed(q: int, threshold: float) -> int:
    """Shingles of ``q`` that a document must hold."""
    return max(1, math.ceil(threshold * q - 1e-9))


class Sketches:
    """The items of one block: the bottom-m sketch of each, by which they are proposed, and all shingles to verify."""

    def __init__(self, ids: list, texts: list[bytes], width: int, threshold: float):
        self.ids, self.need = ids, []
        #: All shingles of an item and their hashes, ascending; bound of its size partition.
        self.strings: list[list[bytes]] = []
        self.hashes: list[np.ndarray] = []
        self.least: list[int] = []
        w = Words(texts, lower=True)
        lengths = np.minimum(np.diff(w.first), width)
        grams = {n: gram_hash(w.hash, n) for n in set(lengths.tolist()) if n}
        sketch: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, n in enumerate(lengths.tolist()):
            a, b = int(w.first[i]), int(w.first[i + 1]) - n + 1
            own = {w.span(p, p + n): p for p in range(a, b)} if n else {}
            at = np.fromiter(own.values(), dtype=np.int64, count=len(own))
            h = grams[n][at] if n else np.zeros(0, dtype=np.uint64)
            order = np.argsort(h, kind="stable")
            strings = list(own)
            self.strings.append([strings[k] for k in order.tolist()])
            self.hashes.append(h[order])
            self.need.append(needed(len(own), threshold))
            self.least.append(needed(1 << max(0, len(own).bit_length() - 1), threshold))
            if n:
                sketch.setdefault(n, []).append((self.hashes[i][: len(own) - self.need[i] + 1], i))
        #: By shingle length: the sketch hashes, ascending, the item of each, and a table of their low bits.
        self.sketch = {n: self._index(found) for n, found in sketch.items()}

    @staticmethod
    def _index(found: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The table passes one in sixteen or fewer of hashes that are in no sketch."""
        hashes = np.concatenate([h for h, _ in found])
        items = np.repeat([i for _, i in found], [len(h) for h, _ in found])
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        bits = max(16, (16 * len(hashes)).bit_length())
        table = np.zeros(1 << bits, dtype=bool)
        table[hashes & np.uint64((1 << bits) - 1)] = True
        return hashes, items[order], table

    def proposals(self, w: Words, n: int, g: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) that share a hash of the item's sketch, unless the text is too short for the item's partition."""
        hashes, items, table = self.sketch[n]
        at = np.flatnonzero(table[g & np.uint64(len(table) - 1)] & grams_inside(w.first, len(w.hash), n))
        left, right = np.searchsorted(hashes, g[at], "left"), np.searchsorted(hashes, g[at], "right")
        at, left, right = at[left < right], left[left < right], right[left < right]
        owner = np.searchsorted(w.first, at, side="right") - 1
        room = np.diff(w.first) - n + 1
        return sorted({(d, i) for d, a, b in zip(owner.tolist(), left.tolist(), right.tolist())
                       for i in items[a:b].tolist() if room[d] >= self.least[i]})

    def found(self, w: Words, n: int, order: np.ndarray, sorted_g: np.ndarray, item: int) -> int:
        """How many of an item's shingles a text holds, of which these are the places and hashes by hash."""
        left = np.searchsorted(sorted_g, self.hashes[item], "left").tolist()
        right = np.searchsorted(sorted_g, self.hashes[item], "right").tolist()
        return sum(any(w.span(p, p + n) == s for p in order[a:b]) for s, a, b in zip(self.strings[item], left, right))

    def hits(self, texts: list[bytes]) -> list[list[tuple]]:
        """Per text: (item id, its shingles, those found) of the items that it holds."""
        out: list[list[tuple]] = [[] for _ in texts]
        w = Words(texts, lower=True)
        for n in self.sketch:
            g = gram_hash(w.hash, n)
            if not len(g):
                continue
            text = None
            for d, item in self.proposals(w, n, g):
                if d != text:
                    text, a, b = d, int(w.first[d]), int(w.first[d + 1]) - n + 1
                    order = np.argsort(g[a:b], kind="stable")
                    sorted_g, order = g[a:b][order], order + a
                found = self.found(w, n, order, sorted_g, item)
                if found >= self.need[item]:
                    out[d].append((self.ids[item], len(self.strings[item]), found))
        return out


def search(docs: DataFrame, items: DataFrame, hits_col: str = "hits", width: int = WIDTH,
           threshold: float = THRESHOLD, text_col: str = "text", item_id: str = "item_id",
           item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with an array column of the items each row holds (item_id, n_shingles, n_found).

    A document holds an item if at least ``threshold`` of the item's distinct
    ``width``-word shingles (A-Z lower-cased) occur in it.  An item of fewer
    words is one shingle of its own length; null and blank items are never
    found, null and blank documents hold nothing.  Repeated documents and
    repeated items each count on their own.  The items are a query set: they
    are read in blocks of bounded size and each block passes over all
    documents in a broadcast, without a shuffle of the documents.
    """
    spark = docs.sparkSession
    texts = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    words = texts.select(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-words // block_words))
    id_type = texts.schema["item_id"].dataType
    hit = T.StructType([T.StructField("item_id", id_type), T.StructField("n_shingles", T.IntegerType()),
                        T.StructField("n_found", T.IntegerType())])
    for k in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        block = spark.sparkContext.broadcast(
            Sketches(part["item_id"].to_pylist(), text_bytes(part["text"].combine_chunks()), width, threshold))
        name = free_name(docs.columns, f"{hits_col}_{k}")
        docs = _with_hits(docs, name, block, text_col, T.ArrayType(hit))
        if k:
            docs = docs.withColumn(merged, F.concat(merged, name)).drop(name)
        else:
            merged = name
    return docs.withColumnRenamed(merged, hits_col) if merged != hits_col else docs


def _with_hits(docs: DataFrame, name: str, block, text_col: str, kind: T.ArrayType) -> DataFrame:
    at, names, arrow = docs.columns.index(text_col), [*docs.columns, name], to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = block.value
        for b in batches:
            for part in slices(b, at):
                found = [[dict(zip(("item_id", "n_shingles", "n_found"), h)) for h in row]
                         for row in sketches.hits(text_bytes(part.column(at)))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, arrow)], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): one row per document row and item it holds."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = search(rows, items, width=width, threshold=threshold).select("doc_id", F.explode("hits").alias("hit"))
    return rows.select("doc_id", "hit.*", (F.col("hit.n_found") / F.col("hit.n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", width: int = WIDTH,
                  threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns unchanged."""
    name = free_name(docs.columns, "hits")
    found = search(docs, items, name, width, threshold, text_col)
    return found.where(F.size(name) == 0).select(*docs.columns)
