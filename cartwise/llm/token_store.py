"""Token ids of all documents in Huffman-coded files (see ``huffman``), in global document order.

Texts are range-partitioned by id and cut to ids once; the ids are staged as
rows of bounded size.  Their global counts give one code, every staged row
becomes one file, and a manifest numbers the files in document order.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwise.llm import huffman
from cartwise.llm.text import slices
from cartwise.session import ensure_checkpoint_dir, materialize

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Ids after which a staged row, and so a file, ends (with the document that reaches it).
FILE_IDS = 4 << 20
#: Texts encoded at once, in bytes.
TEXT_BYTES = 4 << 20
#: Ids of the pieces of text that a worker remembers.
CACHE_IDS = 3 << 19
#: Pieces that are joined for one call of the library.
JOINED = 1 << 14

#: White space, and controls that some count as such.
_WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Texts with one before a space are cut by ODD, others before every space.
_DOUBLE = f"[{_WHITE}] "
#: Cuts between a character that is no white space and an ASCII white space.
ODD = re.compile(r"\s*\S+(?:[^\S \t-\r]\s*\S*)*|\s+")
#: The pattern's pieces also end between a letter and ASCII punctuation, a digit or a line end, and after a line
#: end that stands alone before a letter.  Letters here are those of Latin scripts, whose class no version changes.
_LETTER, _OTHER = "A-Za-zÀ-ÖØ-öø-ɏ", r"\n!-@\[-`{-~"
_FIRST = f"(?s)^(?P<a>.*?[{_LETTER}])(?P<b>[{_OTHER}].*)$"
_INSIDE = re.compile(f"(?<=[{_LETTER}])(?=[{_OTHER}])|(?<=[!-~{_LETTER}]\n)(?=[{_LETTER}])")


def tokenizer_file(name: str = TOKENIZER) -> bytes:
    """The definition of a public tokenizer, or of the file at a path."""
    import public_tokenizers

    path = name if "/" in name else public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


class _Memory:
    """Pieces of text met before: their ids from ``first[n]`` to ``first[n + 1]``, and in how many batches they were used."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most
        self.pieces = pa.array([], pa.string())
        self.first, self.ids, self.uses = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def forget(self) -> None:
        """If there are too many, keep the half that has been used most."""
        if len(self.ids) <= self.most:
            return
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: len(self.uses) // 2])
        size = np.diff(self.first)[keep]
        self.ids = self.ids[_runs(self.first[keep], size)]
        self.first = np.concatenate(([0], np.cumsum(size)))
        self.pieces, self.uses = self.pieces.take(pa.array(keep)), self.uses[keep] // 2

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces; new ones are encoded."""
        at = pc.index_in(pieces, value_set=self.pieces)
        missing = at.is_null()
        new, known = pieces.filter(missing), len(self.pieces)
        for i in range(0, len(new), JOINED):
            ids, sizes = self.encode(new.slice(i, JOINED))
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, ids))
        out = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        out[missing.to_numpy(zero_copy_only=False)] = known + np.arange(len(new))
        if len(new):
            self.pieces = pa.concat_arrays([self.pieces, new])
        self.uses = np.pad(self.uses, (0, len(new)))
        self.uses[out] += 1
        return out


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[k] to first[k] + size[k] of all k, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(size.sum())


class Encoder:
    """Token ids of texts, by the ``tokenizers`` library.

    A byte-level tokenizer that splits by its pattern and changes nothing
    before never joins a character to a white space after it, nor a letter to
    punctuation.  There a text is cut before its spaces and after its letters,
    and the library is asked once for each piece that has not been seen lately.  Other tokenizers get whole texts.
    """

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition.decode())
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.piecewise = self._splits(json.loads(definition))
        #: Added tokens stand in any place; a word that holds one is never cut.
        self.added = "|".join(re.escape(t["content"]) for t in json.loads(definition).get("added_tokens", [])) or r"\A\b\B"
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(self.vocabulary, np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        #: Words with a space in front, and everything else (first words, pieces of odd texts).
        self.inner = _Memory(lambda pieces: self._joined(pieces, " ", False), CACHE_IDS)
        self.outer = _Memory(lambda pieces: self._joined(pieces, "\n", True), CACHE_IDS // 2)

    @staticmethod
    def _splits(d: dict) -> bool:
        before, after = d.get("pre_tokenizer") or {}, d.get("post_processor")
        return (before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
                and d.get("normalizer") is None and d.get("truncation") is None and d.get("padding") is None
                and (after is None or after.get("type") == "ByteLevel")
                and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                            for t in d.get("added_tokens", [])))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of texts that the library gets one by one."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for own in found for i in own), np.uint32, int(sizes.sum())), sizes

    def _joined(self, pieces: pa.Array, mark: str, between: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of pieces joined by ``mark``: a space that belongs to the next piece, or a line end between.

        The text of pieces that end in no white space is cut there by the
        pattern; the ids' lengths in bytes tell where each piece ends.
        """
        texts = pieces.to_pylist()
        loose = np.array([not p or p[-1].isspace() or between and p[0].isspace() for p in texts], bool)
        firm = [p for p, out in zip(texts, loose.tolist()) if not out]
        sizes, parts = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)] * 2
        if firm:
            text = mark.join(firm) + mark if between else mark + mark.join(firm)
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in firm), np.int64, len(firm)))
            after = np.cumsum(self.token_bytes[ids])
            last = np.searchsorted(after, ends)
            if after[-1] != ends[-1] or not np.array_equal(after[last], ends):
                return self._whole([p if between else mark + p for p in texts])
            sizes[~loose] = np.diff(last + 1, prepend=0) - between
            parts[0] = np.delete(ids, last) if between else ids
        if len(firm) < len(texts):
            parts[1], sizes[loose] = self._whole([p if between else mark + p for p, out in zip(texts, loose) if out])
        first = np.zeros(len(texts), np.int64)
        for mask, base in ((~loose, 0), (loose, len(parts[0]))):
            first[mask] = base + np.cumsum(sizes[mask]) - sizes[mask]
        return np.concatenate(parts)[_runs(first, sizes)], sizes

    def _ids_of(self, words: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of distinct words with a space in front, followed by other distinct texts."""
        cut = pc.extract_regex(words, _FIRST)
        whole = pc.or_(cut.is_null(), pc.match_substring_regex(words, self.added))
        begin = pc.if_else(whole, words, cut.field("a")).dictionary_encode()
        rest = pa.concat_arrays([pc.if_else(whole, "", cut.field("b")), others]).dictionary_encode()
        for memory in (self.inner, self.outer):
            memory.forget()
        begins = self.inner.numbers(begin.dictionary)[begin.indices.to_numpy()]
        added = pc.match_substring_regex(rest.dictionary, self.added).to_pylist()
        rests = [[t] if keep else _INSIDE.split(t) if t else [] for t, keep in zip(rest.dictionary.to_pylist(), added)]
        pieces = pa.array([p for own in rests for p in own], pa.string()).dictionary_encode()
        numbers = len(self.inner.uses) + self.outer.numbers(pieces.dictionary)[pieces.indices.to_numpy()]
        first = np.concatenate((self.inner.first[:-1], self.inner.first[-1] + self.outer.first))
        ids = np.concatenate((self.inner.ids, self.outer.ids))
        # Piece numbers of each text: the begin of a word, then the pieces of its rest.
        counts = np.array([len(own) for own in rests], np.int64)[rest.indices.to_numpy()]
        starts = np.concatenate(([0], np.cumsum([len(own) for own in rests])))[rest.indices.to_numpy()]
        own = numbers[_runs(starts, counts)]
        own = np.insert(own, (np.cumsum(counts) - counts)[: len(words)], begins)
        counts[: len(words)] += 1
        size = np.diff(first)[own]
        ends = np.concatenate(([0], np.cumsum(size)))
        return ids[_runs(first[own], size)], np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each); null is an empty text."""
        texts = pc.fill_null(texts, "")
        if not len(texts) or not self.piecewise:
            return self._whole(texts.to_pylist())
        # The words between spaces, without their space; an odd text is one empty word for now.
        odd = pc.match_substring_regex(texts, _DOUBLE)
        words = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        bounds = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        word, seen = coded.indices.to_numpy(), coded.dictionary
        cut = [ODD.findall(t) for t in texts.filter(odd).to_pylist()]
        other = pa.concat_arrays([seen.take(pa.array(word[bounds[:-1]])), pa.array([p for own in cut for p in own], pa.string())])
        other = other.dictionary_encode()
        ids, sizes = self._ids_of(seen, other.dictionary)
        # All units in order: the words, with the first ones and the odd texts' pieces put in.
        own, counts, rest = word.astype(np.int64), np.diff(bounds), len(seen) + other.indices.to_numpy()
        own[bounds[:-1]] = rest[: len(texts)]
        if cut:
            at, lengths = np.flatnonzero(odd.to_numpy(zero_copy_only=False)), np.array([len(c) for c in cut])
            spread = np.ones(len(own), np.int64)
            spread[bounds[at]] = lengths
            own, starts = np.repeat(own, spread), (np.cumsum(spread) - spread)[bounds[at]]
            own[_runs(starts, lengths)] = rest[len(texts) :]
            counts[at] = lengths
        size, first = sizes[own], np.cumsum(sizes) - sizes
        ends = np.concatenate(([0], np.cumsum(size)))
        return ids[_runs(first[own], size)], np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(definition: bytes) -> Encoder:
    """The encoder of a definition, built once per worker process; a task has one core, so the library gets one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def staged_ids(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text",
               end_id: int = END_ID, file_ids: int = FILE_IDS) -> tuple[DataFrame, int]:
    """Documents in id order as staged rows of whole documents (part, seq, doc_ids, sizes, ids), and the vocabulary size.

    The shuffle is keyed by id, a hash of the text and the row's place in the
    input, so rows of one id (or of none: they come last) spread over ranges.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(tokenizer_file(tokenizer))
    vocabulary = Encoder(definition.value).vocabulary
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("same", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = (F.col("doc_id").asc_nulls_last(), F.col("same"), F.col("place"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = worker_encoder(definition.value), TaskContext.get().partitionId(), 0
        doc_ids, sizes, held, n = [], [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(held)], pa.binary())],
                names=["part", "seq", "doc_ids", "sizes", "ids"])

        for b in batches:
            for piece in slices(b, "text", TEXT_BYTES):
                flat, own = encoder.encode(piece.column(1))
                ends = np.cumsum(own)
                ids = np.insert(flat.astype(kind), ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
                first, at = 0, 0
                while first < len(ends):
                    # documents up to the one that fills the row
                    last = min(int(np.searchsorted(ends, at + file_ids - n)) + 1, len(ends))
                    stop = int(ends[last - 1])
                    doc_ids += piece.column(0)[first:last].to_pylist()
                    sizes += (own[first:last] + 1).tolist()
                    held.append(ids[at:stop].tobytes())
                    n, first, at = n + stop - at, last, stop
                    if n >= file_ids:
                        yield row()
                        seq, doc_ids, sizes, held, n = seq + 1, [], [], [], 0
        if doc_ids:
            yield row()

    schema = "part int, seq int, doc_ids array<long>, sizes array<long>, ids binary"
    return materialize(rows.mapInArrow(run, schema), "token-ids"), vocabulary


def id_counts(staged: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs, over all rows; tasks count, Spark adds up, the driver holds one number an id."""
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=vocabulary)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in staged.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def store_root(spark: SparkSession) -> str:
    """A new folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/token-store/{uuid.uuid4().hex}"


def write(staged: DataFrame, vocabulary: int, root: str, max_bits: int = huffman.MAX_BITS,
          block: int = huffman.BLOCK) -> DataFrame:
    """One file under ``root`` for each staged row, all with the code of the global counts.

    Returns the manifest (path, part, seq, n_docs, n_ids, start), staged:
    ``start`` is the number of ids before the file.  Each attempt of a task
    writes files of its own name and the manifest lists those of the attempts
    that ended, so a lost executor leaves at worst files nothing refers to.
    """
    code = huffman.Code(huffman.code_lengths(id_counts(staged, vocabulary), max_bits))
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part, seq = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                ids = np.frombuffer(b.column(4)[i].as_buffer(), kind)
                sizes = b.column(3)[i].values.to_numpy()
                path = f"{root}/{part:08d}-{seq:08d}-{uuid.uuid4().hex}.ids"
                fs, at = _open(path)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(at, compression=None) as out:
                    huffman.write_file(out, code, b.column(2)[i].as_py(), sizes, ids, block)
                yield pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([part], pa.int32()), "seq": pa.array(
                    [seq], pa.int32()), "n_docs": [len(sizes)], "n_ids": [len(ids)]})

    files = materialize(staged.mapInArrow(run, "path string, part int, seq int, n_docs long, n_ids long"), "token-files")
    # Two levels: the files of a range, and the ranges (as many as the shuffle had partitions).
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    files = files.withColumn("start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    return files.select("path", "part", "seq", "n_docs", "n_ids", (F.col("start") + F.col("shift")).alias("start"))


def read(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files of a manifest, decoded from them.

    ``ids`` (array<long>, left out unless asked for) and the CRC-32 of the ids
    as little-endian 32-bit integers include the end id.  A file whose payload
    does not match its checksum raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = _open(path)
                with fs.open_input_file(at) as stream:
                    reader = huffman.Reader(stream)
                    reader.check()
                    yield from _documents(reader, start, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    files = manifest.select("path", "start")
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, schema)


def _documents(reader: huffman.Reader, start: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    rows, ids, held = [], [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
        if with_ids:
            ends = np.cumsum([0] + [r[2] for r in rows])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int64))))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    for doc, parts in reader.documents():
        crc, n = 0, 0
        for p in parts:
            crc, n = zlib.crc32(np.ascontiguousarray(p, "<u4"), crc), n + len(p)
        rows.append((doc, start, n, crc))
        ids += parts if with_ids else []
        start, held = start + n, held + n
        if held >= huffman.PIECE or len(rows) >= 10_000:
            yield batch()
            rows, ids, held = [], [], 0
    if rows:
        yield batch()


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents to files and read them back: (doc_id, start, n_tokens, ids_crc32).

    A null or empty text has the end id only.  Repeated rows are documents of
    their own, rows of one id stand by text hash and place in the input, null
    ids come last; texts of any length are encoded whole; other columns are
    ignored; an empty table writes no file and gives no rows.
    """
    staged, vocabulary = staged_ids(docs, tokenizer, id_col, text_col)
    return read(write(staged, vocabulary, store_root(docs.sparkSession)), with_ids=False)
