"""Substring dedup: de Bruijn compaction of repeated word windows.

Every window of SPAN consecutive words is an edge of the token de Bruijn graph
over all documents.  The graph is compacted before it is shuffled:

1. Each document's edge sequence is cut into paths at marked minimizers, a
   property of the words alone, so copies are cut alike.  A path's content is
   its word sequence.  Equal paths are joined in Spark: all but the first
   occurrence repeat an earlier one as a whole and leave.
2. Among the distinct paths, those whose minimizers occur in no other path
   (and once in their own) are nonbranching and are done: no edge of theirs
   is anywhere else.  The edges at branching minimizers are expanded and
   grouped one by one to find those that occur earlier.
3. Removed edges of one document that follow the same source coordinates
   close up to spans, and each span is verified word by word against the
   text at its source coordinates (BLAKE2b digests of both word sequences).

Hashes of paths and edges are 128 bits wide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.text import Words, _powers, gram_hash, mix64, slices, text_bytes
from cartwise.session import materialize

SPAN = 20
#: Words of a minimizer; a window of SPAN words holds SPAN - ANCHOR + 1 of them.
ANCHOR = 5
#: One in so many minimizers starts a new path.
MARK = 8
#: Compressed text that is worked on at once.
SLICE_BYTES = 400_000
_NO_ID = (1 << 63) - 1
_SECOND = 0xA0761D6478BD642F


class Edges:
    """The windows of several texts: minimizer, 128-bit hash and path of each."""

    def __init__(self, texts: list[bytes], span: int):
        self.words = w = Words(texts, lower=False)
        anchor = min(ANCHOR, span)
        n = len(w.hash)
        m = max(0, n - span + 1)
        g = gram_hash(w.hash, anchor)
        reach, have = span - anchor + 1, 1
        low = g
        while have < reach:
            step = min(have, reach - have)
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
            have += step
        self.grams, self.reach = g, reach
        owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
        inside = owner[:m] == owner[span - 1 : span - 1 + m]
        #: Start (word number over all texts), text, and minimizer of each window.
        self.at = np.flatnonzero(inside)
        self.text = owner[:m][inside]
        self.low = low[:m][inside]
        new_text = np.ones(len(self.at), dtype=bool)
        new_text[1:] = self.text[1:] != self.text[:-1]
        new_run = new_text.copy()
        new_run[1:] |= self.low[1:] != self.low[:-1]
        self.run = np.flatnonzero(new_run)
        marked = mix64(self.low[self.run] + np.uint64(1)) % np.uint64(MARK) == 0
        #: First window of each path, and the number of windows of each.
        self.path = self.run[marked | new_text[self.run]]
        self.path_len = np.diff(np.concatenate((self.path, [len(self.at)])))

    def twice(self) -> np.ndarray:
        """Of each run, whether its minimizer may stand at two places: a word run comes again close by."""
        g = self.grams
        again = np.zeros(len(g) + 1, dtype=np.int64)
        for d in range(1, self.reach):
            again[1 : len(g) - d + 1] |= g[:-d] == g[d:]
        again = np.cumsum(again)
        last = np.concatenate((self.run[1:], [len(self.at)])) - 1
        a, b = self.at[self.run], self.at[last] + self.reach
        return (last - self.run >= self.reach) | (again[b] > again[a])

    def start(self, windows: np.ndarray) -> np.ndarray:
        """Word number of the windows within their own text."""
        return self.at[windows] - self.words.first[self.text[windows]]

    def hashes(self, windows: np.ndarray, lengths: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hash of the ``lengths`` words from each window's start, as two signed columns."""
        h, at = self.words.hash, self.at[windows]
        out = []
        for values, scale in ((h, 1), (mix64(h ^ np.uint64(_SECOND)), 3)):
            up, down = _powers(scale * (len(h) + 1))
            sums = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(values * up[: scale * len(h) : scale], out=sums[1:])
            out.append(mix64((sums[at + lengths] - sums[at]) * down[scale * at] + np.uint64(scale)).view(np.int64))
        return out[0], out[1]


def _map(df: DataFrame, schema: str, run_slice) -> DataFrame:
    """Apply ``run_slice(batch, texts) -> columns`` to slices of the packed texts of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            at = b.schema.get_field_index("packed")
            for part in slices(b, at, SLICE_BYTES):
                columns = run_slice(part, [unpack(x) for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _lists(batch: pa.RecordBatch, name: str) -> list[list[dict]]:
    return [x or [] for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, packed text, did (null id: last) and dup (0, 1, .. for different texts of one id).

    One hash exchange by did carries the texts, compressed; every pass of the
    same plan reads it again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for part in slices(b, 3):
                packed = pa.array([pack(t) for t in text_bytes(part.column(3))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], packed], names=["doc_id", "did", "th", "packed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("did"), F.xxhash64("text").alias("th"), "text")
    rows = rows.mapInArrow(run, "doc_id long, did long, th long, packed binary")
    order = Window.partitionBy("did").orderBy("doc_id", "th")
    return rows.select("doc_id", "packed", "did", (F.dense_rank().over(order) - 1).alias("dup"))


def _paths(base: DataFrame, span: int) -> DataFrame:
    def run(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        e = Edges(texts, span)
        h1, h2 = e.hashes(e.path, e.path_len + span - 1)
        text = e.text[e.path]
        return {"h1": h1, "h2": h2, "did": _column(batch, "did")[text], "dup": _column(batch, "dup")[text],
                "start": e.start(e.path).astype(np.int32), "n": e.path_len.astype(np.int32)}

    return _map(base.select("did", "dup", "packed"), "h1 long, h2 long, did long, dup int, start int, n int", run)


def _minimizers(base: DataFrame, span: int) -> DataFrame:
    """(low, path, twice): the minimizers of each path; twice if one may stand at two places of it."""

    def run(_: pa.RecordBatch, texts: list[bytes]) -> dict:
        e = Edges(texts, span)
        h1, _h2 = e.hashes(e.path, e.path_len + span - 1)
        path = np.searchsorted(e.path, e.run, side="right") - 1
        low, twice = e.low[e.run].view(np.int64), e.twice()
        order = np.lexsort((low, path))
        again = np.zeros(len(order), dtype=bool)
        again[1:] = (path[order][1:] == path[order][:-1]) & (low[order][1:] == low[order][:-1])
        twice[order[again]] = True
        return {"low": low, "path": h1[path], "twice": twice}

    return _map(base.select("did", "dup", "packed"), "low long, path long, twice boolean", run)


def _minimizers_of(base: DataFrame, span: int) -> DataFrame:
    """(low, did): the distinct minimizers of each document."""

    def run(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        e = Edges(texts, span)
        low, text = e.low[e.run].view(np.int64), e.text[e.run]
        order = np.lexsort((low, text))
        low, text = low[order], text[order]
        new = np.ones(len(low), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
        low, text = low[new], text[new]
        return {"low": low, "did": _column(batch, "did")[text]}

    return _map(base.select("did", "dup", "packed"), "low long, did long", run)


def _branch_edges(joined: DataFrame, span: int) -> DataFrame:
    """The windows at branching minimizers, outside of the paths that already left."""

    def run(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        e = Edges(texts, span)
        keep = np.zeros(len(e.at), dtype=bool)
        first = np.searchsorted(e.text, np.arange(len(texts) + 1))
        did, dup = _column(batch, "did"), _column(batch, "dup")
        for t, (lows, gone) in enumerate(zip(_lists(batch, "lows"), _lists(batch, "gone"))):
            a, b = first[t], first[t + 1]
            if a == b or not lows:
                continue
            keep[a:b] = np.isin(e.low[a:b].view(np.int64), np.array(lows, dtype=np.int64))
            for x in gone:
                if x["dup"] == dup[t]:
                    keep[a + x["start"] : a + x["start"] + x["n"]] = False
        at = np.flatnonzero(keep)
        h1, h2 = e.hashes(at, span)
        text = e.text[at]
        return _local_firsts(h1, h2, did[text], dup[text].astype(np.int32), e.start(at).astype(np.int32))

    return _map(joined, "h1 long, h2 long, did long, dup int, start int, n int, sdid long, sdup int, sstart int", run)


def _local_firsts(h1, h2, did, dup, start) -> dict:
    """One row for the first place of each edge in this slice, and closed-up runs of the later places.

    Later places need no global first to be known as repeats, so an edge that
    very many documents share is one row per slice in the shuffle.  Runs have
    their length n and the place of their first edge's repeat; firsts have none.
    """
    order = np.lexsort((start, dup, did, h2, h1))
    h1, h2, did, dup, start = (x[order] for x in (h1, h2, did, dup, start))
    new = np.ones(len(h1), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    src = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
    same = (did == did[src]) & (dup == dup[src]) & (start == start[src])  # a row that is stated twice
    late = np.flatnonzero(~same)
    late = late[np.lexsort((start[late], dup[late], did[late]))]
    of = src[late]
    cut = np.ones(len(late), dtype=bool)
    for x, step in ((did[late], 0), (dup[late], 0), (start[late], 1), (did[of], 0), (dup[of], 0), (start[of], 1)):
        cut[1:] &= x[1:] == x[:-1] + step
    cut[1:] = ~cut[1:]
    runs = np.flatnonzero(cut)
    n = np.diff(np.concatenate((runs, [len(late)]))).astype(np.int32)
    late, of, one = late[runs], of[runs], np.flatnonzero(new)
    none = pa.nulls(len(one), pa.int32())
    rows = np.concatenate((one, late))
    return {
        "h1": h1[rows], "h2": h2[rows], "did": did[rows], "dup": dup[rows], "start": start[rows],
        "n": pa.concat_arrays([none, pa.array(n, pa.int32())]),
        "sdid": pa.concat_arrays([none.cast(pa.int64()), pa.array(did[of], pa.int64())]),
        "sdup": pa.concat_arrays([none, pa.array(dup[of], pa.int32())]),
        "sstart": pa.concat_arrays([none, pa.array(start[of], pa.int32())]),
    }


def repeated_spans(base: DataFrame, span: int) -> DataFrame:
    """(did, dup, start, words, sdid, sdup, sstart): words that stand at an earlier place already."""
    here = F.struct("did", "dup", "start")
    paths = _paths(base, span)
    firsts = paths.groupBy("h1", "h2", "n").agg(F.min(here).alias("src"), F.count("*").alias("k"))
    gone = paths.join(firsts.where("k > 1").select("h1", "h2", "n", "src"), ["h1", "h2", "n"]).where(here != F.col("src"))
    # a stage of its own: the paths' shuffle files go before minimizers and edges are shuffled
    gone = materialize(gone.select("did", "dup", "start", "n", "src"), "repeated-paths")

    branching = _minimizers(base, span).groupBy("low").agg(
        F.min("path").alias("p1"), F.max("path").alias("p2"), F.max("twice").alias("twice"))
    branching = branching.where("p1 <> p2 or twice").select("low")
    lows = _minimizers_of(base, span).join(branching, "low", "left_semi")
    lows = lows.groupBy("did").agg(F.collect_set("low").alias("lows"))
    left = gone.groupBy("did").agg(F.collect_list(F.struct("dup", "start", "n")).alias("gone"))
    edges = _branch_edges(base.select("did", "dup", "packed").join(lows, "did").join(left, "did", "left"), span)
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.repartition(parts, "h1", "h2")
    single = edges.where("n is null").select(
        "did", "dup", "start", F.min(here).over(Window.partitionBy("h1", "h2")).alias("src"))
    local = edges.where("n is not null").select("did", "dup", "start", (F.col("n") + span - 1).alias("words"),
                                                "sdid", "sdup", "sstart")
    again = single.where(here != F.col("src"))
    shift = F.col("src.start") - F.col("start")
    again = again.select("did", "dup", "start", F.col("src.did").alias("sdid"), F.col("src.dup").alias("sdup"),
                         shift.alias("shift"))
    track = Window.partitionBy("did", "dup", "sdid", "sdup", "shift").orderBy("start")
    again = again.withColumn("island", F.col("start") - F.row_number().over(track))
    closed = again.groupBy("did", "dup", "sdid", "sdup", "shift", "island").agg(
        F.min("start").alias("start"), (F.count("*") + span - 1).cast("int").alias("words"))
    closed = closed.select("did", "dup", "start", "words", "sdid", "sdup",
                           (F.col("start") + F.col("shift")).alias("sstart"))
    whole = gone.select("did", "dup", "start", (F.col("n") + span - 1).alias("words"), F.col("src.did").alias("sdid"),
                        F.col("src.dup").alias("sdup"), F.col("src.start").alias("sstart"))
    return whole.unionByName(closed).unionByName(local)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _source_digests(joined: DataFrame) -> DataFrame:
    """The digest of the words at each asked place."""

    def run(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        out: dict[str, list] = {k: [] for k in ("sdid", "sdup", "sstart", "words", "digest")}
        did, dup = _column(batch, "did"), _column(batch, "dup")
        for t, (text, asked) in enumerate(zip(texts, _lists(batch, "asked"))):
            words = text.split()
            for x in asked:
                if x["sdup"] == dup[t]:
                    row = (did[t], dup[t], x["sstart"], x["words"],
                           _digest(words[x["sstart"] : x["sstart"] + x["words"]]))
                    for column, value in zip(out.values(), row):
                        column.append(value)
        return {k: pa.array(v, kind) for (k, v), kind in
                zip(out.items(), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))}

    return _map(joined, "sdid long, sdup int, sstart int, words int, digest binary", run)


def _apply(joined: DataFrame, with_text: bool) -> DataFrame:
    """Remove the spans whose words equal those at their source; the rest and its digest."""

    def run(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        dup, counts, removed, kept = _column(batch, "dup"), [], [], []
        for t, (text, spans) in enumerate(zip(texts, _lists(batch, "spans"))):
            words = text.split()
            drop = np.zeros(len(words), dtype=bool)
            for x in spans:
                a, b = x["start"], x["start"] + x["words"]
                if x["dup"] == dup[t] and not drop[a:b].all() and _digest(words[a:b]) == x["digest"]:
                    drop[a:b] = True
            counts.append(len(words))
            removed.append(int(drop.sum()))
            kept.append(b" ".join(w for w, d in zip(words, drop.tolist()) if not d) if removed[-1] else b" ".join(words))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        return {"doc_id": ids, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array([k.decode() if with_text else None for k in kept], pa.string()),
                "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}

    return _map(joined, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string", run)


def dedup(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text",
          with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the kept words, null unless
    ``with_text``), kept_sha256.

    A word goes if a window of ``span`` words covers it whose sequence also
    starts earlier: in a smaller doc_id, or in the same document.  All windows
    are judged on the input.  Null and blank texts have no words.  Documents
    under ``span`` words lose none.  A null doc_id sorts last.  Rows equal in
    id and text are one document stated twice and get the same result; texts
    that differ under one id are ordered by their hash.  Other columns are not
    read; no rows give no rows.
    """
    base = _base(docs, id_col, text_col)
    spans = materialize(repeated_spans(base, span), "repeated-spans")
    asked = spans.select("sdid", "sdup", "sstart", "words").distinct()
    asked = asked.groupBy(F.col("sdid").alias("did")).agg(F.collect_list(F.struct("sdup", "sstart", "words")).alias("asked"))
    known = _source_digests(base.select("did", "dup", "packed").join(asked, "did"))
    checked = spans.join(known, ["sdid", "sdup", "sstart", "words"])
    checked = checked.groupBy("did").agg(F.collect_list(F.struct("dup", "start", "words", "digest")).alias("spans"))
    return _apply(base.join(checked, "did", "left"), with_text)
