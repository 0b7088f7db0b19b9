"""Canonical length-limited Huffman coding of token ids, and its file format.

A file holds a run of documents: header, code lengths, document index,
checkpoints, payload.  Every block of ``block`` ids starts at a checkpoint
(its bit offset in the payload), so blocks are decoded on their own, many at
once, by one table look-up an id.

Layout (little-endian)::

    8 bytes  magic
    header   n_docs, n_ids, payload bytes (u64); block, n_symbols, code-length bytes, payload CRC-32 (u32)
    lengths  zlib of one byte for each symbol: code length, 0 if unused
    index    n_docs x i64 doc ids, n_docs x u8 (0: the id is null), n_docs x u64 ids of the document
    points   one u64 bit offset a block
    payload  codes, most significant bit first
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"IDHUFF1\n"
HEADER = struct.Struct("<QQQIIII")
#: Longest code; the decoding table has two to this power entries at most.
MAX_BITS = 18
#: Ids between two checkpoints.
BLOCK = 1024
#: Ids that are packed or decoded at once (a multiple of BLOCK).
PIECE = 1 << 20


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Best code lengths of at most ``max_bits`` (package-merge); 0 for symbols that never occur.

    More symbols than ``max_bits`` can tell apart raise the limit; a single
    symbol has one bit.
    """
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    level, merged = leaf, [np.ones(len(leaf), dtype=bool)]
    for _ in range(max(max_bits, int(len(leaf) - 1).bit_length()) - 1):
        both = np.concatenate((leaf, level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)))
        at = np.argsort(both, kind="stable")
        level = both[at]
        merged.append(at < len(leaf))
    take, bits = 2 * len(leaf) - 2, np.zeros(len(leaf), dtype=np.uint8)
    for is_leaf in reversed(merged):
        own = int(is_leaf[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    lengths[order] = bits
    return lengths


class Code:
    """The canonical code of some lengths: codes by symbol, and the decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.bits = int(lengths.max(initial=1))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        span = np.int64(1) << (self.bits - lengths[order].astype(np.int64))
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[order] = (np.cumsum(span) - span) >> (self.bits - lengths[order].astype(np.int64))
        self._order, self._span, self._table = order, span, None

    @property
    def table(self) -> np.ndarray:
        """32 x symbol + length for each value of the next ``bits`` bits."""
        if self._table is None:
            self._table = np.zeros(1 << self.bits, dtype=np.uint32)
            self._table[: self._span.sum()] = np.repeat(self._order << 5 | self.lengths[self._order], self._span)
        return self._table

    def pack(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """The codes of ``ids`` as bytes, and the bit offset of each block."""
        if not len(ids):
            return b"", np.zeros(0, dtype=np.int64)
        length = self.lengths[ids].astype(np.int64)
        if not length.all():
            raise ValueError("an id has no code")
        end = np.cumsum(length)
        start = end - length
        word = start >> 5
        value = self.codes[ids] << (64 - (start & 31) - length).astype(np.uint64)
        out = np.zeros(int(end[-1] >> 5) + 2, dtype=np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: -(-int(end[-1]) // 8)], start[::block]

    def unpack(self, payload: bytes, points: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """``n`` ids from blocks that start at the bit offsets ``points``; all blocks step together."""
        table = self.table
        raw = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.empty((min(block, n), len(points)), dtype=np.uint32)
        at, last, shift = points.astype(np.int64), 8 * len(payload), np.uint32(32 - self.bits)
        for row in out:
            key = (window[at >> 3] << (at & 7).astype(np.uint32)) >> shift
            row[:] = table[key]
            at = np.minimum(at + (row & 31), last)
        return (out >> 5).T.ravel()[:n]


def write_file(out, code: Code, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> None:
    """Write documents (their ids one after the other) to a binary stream."""
    pieces, points, at = [], [], 0
    step = max(block, PIECE // block * block)
    for i in range(0, len(ids), step):
        data, own = code.pack(ids[i : i + step], block)
        points.append(own + 8 * at)
        pieces.append(data)
        at += len(data)
    lengths = zlib.compress(code.lengths.tobytes())
    crc = 0
    for data in pieces:
        crc = zlib.crc32(data, crc)
    out.write(MAGIC + HEADER.pack(len(doc_ids), len(ids), at, block, len(code.lengths), len(lengths), crc) + lengths)
    out.write(np.array([i or 0 for i in doc_ids], "<i8").tobytes())
    out.write(np.array([i is not None for i in doc_ids], "u1").tobytes())
    out.write(np.asarray(sizes, "<u8").tobytes())
    out.write(np.concatenate([*points, np.zeros(0, np.int64)]).astype("<u8").tobytes())
    for data in pieces:
        out.write(data)


class Reader:
    """Random and sequential access to one file, given an object with ``seek`` and ``read``."""

    def __init__(self, stream):
        self.stream = stream
        if stream.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of coded ids")
        n_docs, self.n_ids, self.size, self.block, symbols, packed, self.crc = HEADER.unpack(stream.read(HEADER.size))
        self.code = Code(np.frombuffer(zlib.decompress(stream.read(packed)), np.uint8))
        if len(self.code.lengths) != symbols:
            raise ValueError("the code lengths are cut off")
        ids = np.frombuffer(stream.read(8 * n_docs), "<i8").tolist()
        known = stream.read(n_docs)
        self.doc_ids = [i if k else None for i, k in zip(ids, known)]
        self.sizes = np.frombuffer(stream.read(8 * n_docs), "<u8").astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.points = np.frombuffer(stream.read(8 * blocks), "<u8").astype(np.int64)
        self.body = len(MAGIC) + HEADER.size + packed + 17 * n_docs + 8 * blocks

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids ``first`` to ``first + n`` of the file; only the blocks that hold them are read."""
        n = min(n, self.n_ids - first)
        if n <= 0:
            return np.zeros(0, np.uint32)
        low, high = first // self.block, -(-(first + n) // self.block)
        start = int(self.points[low]) >> 3
        end = -(-int(self.points[high]) // 8) if high < len(self.points) else self.size
        self.stream.seek(self.body + start)
        data = self.stream.read(end - start)
        if len(data) != end - start:
            raise ValueError("the payload is cut off")
        there = min(high * self.block, self.n_ids) - low * self.block
        found = self.code.unpack(data, self.points[low:high] - 8 * start, there, self.block)
        return found[first - low * self.block :][:n]

    def check(self) -> None:
        """Raise unless the payload is whole."""
        self.stream.seek(self.body)
        crc, left = 0, self.size
        while left and (data := self.stream.read(min(left, 1 << 20))):
            crc, left = zlib.crc32(data, crc), left - len(data)
        if left or crc != self.crc:
            raise ValueError("the payload does not match its checksum")

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """(doc id, its ids in pieces) of each document, decoding PIECE ids at a time."""
        step = max(self.block, PIECE // self.block * self.block)
        held, at = np.zeros(0, np.uint32), 0
        for doc, size in zip(self.doc_ids, self.sizes.tolist()):
            parts = []
            while size:
                if not len(held):
                    held = self.ids(at, step)
                    at += step
                parts.append(held[:size])
                size, held = size - len(parts[-1]), held[len(parts[-1]) :]
            yield doc, parts
