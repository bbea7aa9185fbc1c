"""Words of whole texts as numpy arrays, for use inside Arrow tasks.

A word is a run of characters other than space and U+0009 to U+000D. Those are single bytes that never
occur inside a longer UTF-8 sequence, so words are cut and hashed on the bytes of an Arrow column, many
rows at a time and without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2^64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        for name, base in (("_POWERS", _BASE), ("_INVERSES", pow(_BASE, -1, 1 << 64))):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            globals()[name] = np.cumprod(run, dtype=np.uint64)
    return _POWERS, _INVERSES


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values; runs may cross rows."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n - width + 1])


@dataclass
class Words:
    """Words of some rows: byte spans in ``data``, hashes, and ``first[i]`` to ``first[i + 1]`` for row i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``CHUNK_BYTES`` of text; a longer row comes alone."""
    sizes = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset:sizes.offset + len(sizes) + 1]
    at = 0
    while at < len(batch):
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1
        to = min(len(batch), max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def cut(column: pa.Array, fold: np.ndarray = AS_IS) -> Words:
    """Cuts each row into words; ``fold`` maps bytes before hashing (``LOWER`` lower-cases A-Z)."""
    data, offsets = text_bytes(column)
    n = len(data)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | edge[1:n]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=sums[1:])
    value = (sums[end] - sums[start]) * down[start]
    value = mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(data, start, end, value, np.searchsorted(start, offsets))
