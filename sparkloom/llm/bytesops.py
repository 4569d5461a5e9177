"""Vectorised work on the UTF-8 bytes of a column of texts: words, word hashes, shingle hashes.

Texts are never turned into Python strings here: an Arrow string array gives its bytes and offsets, and
every step is a numpy operation over all bytes or all words of a bounded piece of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space: space and \t \n \v \f \r. Everything else belongs to a word.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(batch: pa.RecordBatch, text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about `most` bytes of text each; a longer text makes a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        end = min(end, n)
        yield batch.slice(begin, end - begin)
        begin = end


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more entry at the end).

    space tells for each byte whether it parts words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~space[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for pieces of usual size."""
    if n > len(_POWERS[0]):
        size = max(n, 2 * PIECE_BYTES + 8)
        both = []
        for b in (_BASE, _BASE_INV):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        if n > 2 * PIECE_BYTES + 8:
            return both[0][:n], both[1][:n]
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


class Spans:
    """Hashes of any spans of bytes, each in constant time, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:-1], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_of(word: bytes) -> int:
    """The hash that Spans gives these bytes."""
    data = np.frombuffer(word, np.uint8)
    return int(Spans(data).hash(np.array([0]), np.array([len(data)]))[0])


_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of `width` words that lies in one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(firsts[:-1], counts)
    h = np.zeros(len(doc), np.uint64)
    for k in range(width):
        h = mix(h * _STEPS[0] + hashes[begin + k] * _STEPS[k % 5] + np.uint64(k))
    return h, doc


def text_shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (lower case): hashes and times in the text, ordered by text and hash, and where each text's begin."""
    import pyarrow.compute as pc

    data, offsets = column_bytes(pc.utf8_lower(column))
    starts, ends, firsts = words(data, offsets)
    h, doc = shingles(Spans(data).hash(starts, ends), firsts, width)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    return h[at], times, np.searchsorted(doc[at], np.arange(len(column) + 1), "left")


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after the other, and where each begins (one more entry at the end)."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return data[at], offsets


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow string array."""
    own, offsets = gather(data, starts, ends)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(own)))


#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
