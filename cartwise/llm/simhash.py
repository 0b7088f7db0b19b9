"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm.components import components
from cartwise.llm.text import free_name, text_bytes
from cartwise.session import materialize

WIDTH = 3
DISTANCE = 2
SEED = 42
#: Members of a block up to which all of its pairs are compared directly.
DIRECT = 64


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """SimHash of one text: bit set if set in over half the shingle hashes; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    ends = ends.tolist()[min(width, len(words)) - 1 :]
    one = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, dtype=np.int64), len(ends)
    for at in range(0, n, 1 << 16):
        h = np.array([one(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])],
                     dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in text_bytes(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _blocks(distance: int) -> list[int]:
    """Masks: fingerprints within ``distance`` bits agree on at least one of them.

    64 bits are cut into ``2 * (distance + 1)`` blocks; any ``distance + 1`` of
    them that differ leave ``distance + 2`` equal, so each choice of that many
    blocks is a mask and one choice at least is free of differing bits.
    """
    n = 2 * (distance + 1)
    cuts = [64 * i // n for i in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(block[i] for i in keep) for keep in combinations(range(n), n - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits(mask: int) -> list[int]:
    return [i for i in range(64) if mask >> i & 1]


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) links that connect exactly the distinct fingerprints within ``distance`` bits.

    Each fingerprint enters one block key per mask.  In a block of up to
    DIRECT members all pairs are verified.  A larger block (many variants of
    one text) never enumerates its pairs: with distance 2 every member also
    visits the values one bit beside it outside the mask; two members within
    two bits meet at such a value, and each visitor is linked to the smallest
    visitor, which is within two bits and verified again.  So links differ in
    number from all pairs, but not in what they connect.  With distance 1 a
    member is linked to the fingerprints that stand at the values it visits;
    with distance 0 distinct fingerprints have no links.
    """
    if distance > 2:
        raise ValueError("large blocks are resolved for distances up to 2")
    masks = _blocks(distance)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])))
    keyed = keyed.select("fp", F.col("pos").alias("mask"), F.col("col").alias("key"))
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keyed.join(sizes, ["mask", "key"]), "simhash-blocks")
    small = members.where(F.col("n") <= DIRECT).select("mask", "key", "fp")
    pairs = (
        small.select("mask", "key", F.col("fp").alias("a"))
        .join(small.select("mask", "key", F.col("fp").alias("b")), ["mask", "key"])
        .where((F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b"), distance))
        .select("a", "b")
    )
    if distance == 0:
        return pairs
    outside = F.array(*[
        F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in _bits(~m & (1 << 64) - 1)]) for m in masks
    ])
    visits = members.where(F.col("n") > DIRECT).select(
        "mask", "fp", F.explode(F.element_at(outside, F.col("mask") + 1)).alias("flip")
    )
    visits = visits.select("mask", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    if distance == 1:
        there = members.where(F.col("n") > DIRECT).select("mask", F.col("fp").alias("at"))
        beside = visits.join(there, ["mask", "at"]).where(F.col("at") < F.col("fp"))
        return pairs.unionByName(beside.select(F.col("at").alias("a"), F.col("fp").alias("b"))).distinct()
    least = visits.groupBy("mask", "at").agg(F.min("fp").alias("a"))
    stars = (
        visits.join(least, ["mask", "at"])
        .where((F.col("a") < F.col("fp")) & _near(F.col("a"), F.col("fp"), distance))
        .select("a", F.col("fp").alias("b"))
    )
    return pairs.unionByName(stars).distinct()


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp) -> (fp, label, component_id) for each distinct fingerprint.

    label: the smallest fingerprint of the component; component_id: the
    smallest doc_id in it (null if it has none).
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    linked = components(fingerprint_links(nodes.select("fp"), distance))
    nodes = nodes.join(linked.withColumnRenamed("id", "fp"), "fp", "left")
    nodes = nodes.select("fp", "least", F.coalesce("label", "fp").alias("label"))
    ids = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    return nodes.join(ids, "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty or blank texts have fingerprint zero and link like any other.
    Repeated rows each give a row.  A null doc_id takes part in the grouping
    but is never the smallest id; a component of null ids only has a null
    component_id.  Other columns are not read.  No rows give no rows.
    """
    prints = materialize(fingerprints(docs, width, id_col, text_col), "simhash")
    return prints.join(classes(prints, distance), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id.

    Of repeated rows with that id one stays.  A group of null ids only keeps
    the row with the smallest fingerprint, then text hash.  All columns of
    ``docs`` come back unchanged, whatever their names.
    """
    prints = materialize(fingerprints(docs, width, id_col, text_col), "simhash")
    groups = materialize(classes(prints, distance), "simhash-classes")
    order = free_name(docs.columns, "order_in_group")
    stays = groups.where("component_id is not null").select(F.col("component_id").alias(id_col)).distinct()
    tie = F.xxhash64(*[F.col(c) for c in docs.columns])
    named = docs.where(F.col(id_col).isNotNull()).join(stays, id_col, "left_semi")
    named = named.withColumn(order, F.row_number().over(Window.partitionBy(id_col).orderBy(tie)))
    lost = docs.where(F.col(id_col).isNull())
    label, fp, pick = (free_name(docs.columns, c) for c in ("label", "fp", "pick"))
    printed = _with_print(lost, fp, width, text_col)
    only_null = groups.where("component_id is null").select(F.col("fp").alias(fp), F.col("label").alias(label))
    printed = printed.join(only_null, fp)
    printed = printed.withColumn(pick, F.row_number().over(Window.partitionBy(label).orderBy(fp, tie)))
    rest = printed.where(F.col(pick) == 1).select(*docs.columns)
    return named.where(F.col(order) == 1).select(*docs.columns).unionByName(rest)


def _with_print(docs: DataFrame, name: str, width: int, text_col: str) -> DataFrame:
    """All columns and the fingerprint of each row."""
    at = docs.columns.index(text_col)
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(at).cast(pa.string()))
            fps = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
