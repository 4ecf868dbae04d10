"""Words and n-grams of whole batches of texts as numpy arrays.

A prefix sum of ``byte * P**i`` modulo 2**64 gives the polynomial hash of any
byte range by one subtraction and one product with ``P**-start``, as an odd
``P`` has an inverse there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_CHUNK = 1 << 18


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_P, -1, 1 << 64)
    made = []
    for base in (_P, inverse):
        out = np.ones(n, np.uint64)
        filled, step = 1, base
        while filled < n:
            take = min(filled, n - filled)
            out[filled : filled + take] = out[:take] * np.uint64(step)
            filled, step = filled + take, step * step % (1 << 64)
        made.append(out)
    return made[0], made[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts that fit the processor's cache: first, end, bytes, offsets.

    Only a text that is longer by itself makes a larger run.
    """
    data, at = buffers(texts)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(at, at[first] + _CHUNK, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


class Prefix:
    """Hashes of any byte ranges of one run."""

    def __init__(self, data: np.ndarray):
        room = 1 << max(16, int(len(data)).bit_length())
        powers, self._inverse = _powers(room)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        h = (self._sum[end] - self._sum[start]) * self._inverse[start]
        return mixed(h + np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64)))

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n bytes from each position on that has so many."""
        k = max(len(self._sum) - n, 0)
        return mixed((self._sum[n : n + k] - self._sum[:k]) * self._inverse[:k])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters, byte for byte in UTF-8."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a letter: ASCII letters and all beyond ASCII."""
    low = data | 32
    return ((low >= 97) & (low <= 122)) | (data >= 0x80)


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; a text's edge ends a run."""
    change = np.zeros(len(inside) + 1, bool)
    change[1:-1] = inside[1:] != inside[:-1]
    change[at] = True
    edges = np.flatnonzero(change)
    if len(edges) < 2:
        return edges[:0], edges[:0]
    on = inside[edges[:-1]]
    return edges[:-1][on], edges[1:][on]
