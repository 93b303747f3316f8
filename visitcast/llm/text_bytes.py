"""Words of many texts at once, from the bytes of an Arrow column."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer text is a piece of its own.
CHUNK = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


#: Powers are kept for texts of up to 2^KEPT bytes; those of longer ones are made for each.
KEPT = 21
_kept: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2^64, 2^bits of each at least: one table serves all shorter texts."""
    if _kept and len(_kept[0][0]) >= 1 << bits:
        return _kept[0]
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(1, dtype=_U)
        for k in range(bits):
            p = np.concatenate([p, p * _U(pow(base, 1 << k, 1 << 64))])
        out.append(p)
    if bits <= KEPT:
        _kept[:] = [(out[0], out[1])]
    return out[0], out[1]


def tidied(batches: Iterator) -> Iterator:
    """Passes batches on; at the end of the task, hands memory that would wait for reuse back to the system.

    Python workers outlive their tasks, and what they hold counts beside the executor's heap.
    """
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of runs of texts, about CHUNK bytes each; nulls must have been replaced."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(texts):
        b = min(max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK))), len(texts))
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word (A-Z lower-cased unless told not to, split at ASCII blanks), and the texts' bounds among them."""
    blank = _BLANK[data]
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] |= ~blank[inner]
    last[inner - 1] |= ~blank[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(max(10, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * power[: len(data)], out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * inverse[start]), np.searchsorted(start, offsets)


class Runs:
    """Hashes of any runs of consecutive words, from prefix sums over the words' hashes."""

    def __init__(self, hashes: np.ndarray):
        power, self._inverse = _powers(max(10, int(len(hashes)).bit_length()))
        self._sums = np.zeros(len(hashes) + 1, dtype=_U)
        np.cumsum(hashes * power[: len(hashes)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from start up to end, both arrays of word numbers."""
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by minima over powers of two."""
    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[: len(x) - done], x[done:]), 2 * done
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
