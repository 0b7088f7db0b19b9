"""Word helpers shared by the text operators.

Words are the runs ``[^\\x20\\x09-\\x0D]+``.  ``bytes.split()`` cuts at exactly
those six bytes and ``bytes.lower()`` maps exactly A-Z, so both work on the
UTF-8 bytes of a text without decoding it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK64 = (1 << 64) - 1


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``most_bytes`` of text (one row at least)."""
    col = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = np.random.default_rng(7).integers(1, 1 << 63, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to ``n``."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """All words of several texts at once: byte ranges, owner text and 64-bit hash.

    ``first[d]:first[d+1]`` are the words of text ``d``.  The hash is a
    polynomial of the word's bytes modulo 2**64, scrambled; it only proposes
    matches, which the operators verify on the words or on wider hashes.
    """

    def __init__(self, texts: list[bytes], lower: bool):
        data = b"\n".join(texts) + b"\n"
        self.data = data.lower() if lower else data
        raw = np.frombuffer(self.data, dtype=np.uint8)
        space = _SPACE[raw]
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        self.start = np.flatnonzero(before & ~space)
        self.end = np.flatnonzero(space & ~before)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends))).astype(np.int64)
        up, down = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
        self.hash = mix64((sums[self.end] - sums[self.start]) * down[self.start])

    def span(self, i: int, j: int) -> bytes:
        """Words ``i`` to ``j`` (exclusive), joined by one space."""
        return b" ".join(self.data[self.start[i] : self.end[j - 1]].split()) if j > i else b""


def gram_hash(h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (runs over text borders included)."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    up = np.full(len(h) + 1, base, dtype=np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(len(h) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    m = len(h) - n + 1
    return mix64((sums[n:] - sums[:m]) * down[:m])


def grams_inside(first: np.ndarray, total: int, n: int) -> np.ndarray:
    """Of the runs of ``n`` words over all texts, those that stay inside one text."""
    m = max(0, total - n + 1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return owner[:m] == owner[n - 1 : n - 1 + m]


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column is called so (case ignored)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted
