"""Words and rolling hashes of whole texts as numpy arrays, many documents at a time.

Texts stay UTF-8 bytes: white space is ASCII, so words can be cut and hashed without decoding.
Hashes are polynomials modulo 2^64 over random byte values, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def space_table() -> np.ndarray:
    """True for the bytes that part words: blank and 9 to 13."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def lower_table() -> np.ndarray:
    """Bytes with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


SPACES = space_table()
LOWER = lower_table()
# Word characters for loose matching: letters, digits and every byte of a longer UTF-8 sequence.
LOOSE = ~np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
# One random value a byte, from a fixed seed.
BYTE_VALUES = np.random.default_rng(20260).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _ODD), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of the base and of its inverse."""
    size = CHUNK_BYTES + 1
    while size < n:
        size *= 2
    return _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of some whole texts.

    `start` and `end` are byte offsets of words in `data`, `doc` is the number of a word's text and
    `first[i]:first[i + 1]` are the words of text i. `cut` marks bytes where a new word begins without
    white space before it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = SPACES, cut: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        inside = ~spaces[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        if cut is not None:
            edge[:-1] |= cut
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.inside, self.begins = inside, begins
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        """One 64-bit hash a word; `fold` maps bytes first (lower case)."""
        values = BYTE_VALUES if fold is None else BYTE_VALUES[fold]
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(values[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def spaced(self, fold: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one blank between, and where each begins and ends."""
        data = self.data[self.inside]
        if fold is not None:
            data = fold[data]
        number = np.cumsum(self.begins)[self.inside] - 1
        out = np.full(len(data) + len(self), 0x20, np.uint8)
        out[np.arange(len(data)) + number] = data
        size = self.end - self.start
        start = np.cumsum(size) - size + np.arange(len(self))
        return out.tobytes(), start, start + size


def rolling(values: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of `width` neighbouring values; entry i begins at value i."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    values = mix(values + np.uint64(salt)) if salt else values
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def whole(doc: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the first words of runs of `width` words that stay inside one text."""
    n = len(doc) - width + 1
    return np.flatnonzero(doc[:n] == doc[width - 1 :]) if n > 0 else np.zeros(0, np.int64)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole texts of about `limit` bytes; a longer text is a run of its own."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def binary_runs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of fixed-size values as one binary array; run i ends before row ends[i]."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = np.concatenate([[0], ends]).astype(np.int64) * width
    values = np.ascontiguousarray(values)
    made = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return made.cast(pa.binary())
