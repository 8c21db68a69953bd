"""Vectorised word splitting and hashing over Arrow text buffers.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; since those are
ASCII, splitting UTF-8 bytes and splitting code points agree.  Nothing here
loops over words or characters in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Rows of a slice, so that 16 bits name one.
SLICE_ROWS = 1 << 16
_BLOCK = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection on 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(n - 1, 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in _BASES)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and the n+1 offsets between them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: byte ranges ``starts``/``ends`` in ``data``; words
    ``first[d]:first[d+1]`` belong to text d."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``which`` picks one of two independent ones."""
        out = np.empty(len(self), np.uint64)
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + _BLOCK, "right")))
            s, e = self.starts[i:j] - self.starts[i], self.ends[i:j] - self.starts[i]
            up, down = _POWERS[which].upto(int(e[-1]) + 1)
            p = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum((self.data[self.starts[i] : self.ends[j - 1]].astype(np.uint64) + _U(1)) * up[: int(e[-1])], out=p[1:])
            out[i:j] = mix64((p[e] - p[s]) * down[s] + (e - s).astype(np.uint64) * _U(_BASES[1 - which]))
            i = j
        return out

    def ngrams(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Hash of the n words from each word on; valid where ``inside(n)``."""
        m, done, power = hashes.copy(), 0, 1
        out: np.ndarray | None = None
        mult = _U(0xC2B2AE3D27D4EB4F)
        block, width = m, 1
        # binary powering: n is a sum of powers of two, each block doubled from the last
        with np.errstate(over="ignore"):
            while width <= n:
                if n & width:
                    out = block.copy() if out is None else _join(block, out, width, _power(mult, done))
                    done += width
                if width * 2 <= n:
                    block = _join(block, block, width, _power(mult, width))
                width *= 2
        del power
        return mix64(out if out is not None else m)

    def inside(self, n: int) -> np.ndarray:
        """Whether the n words from each word on lie in one text."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(len(self)) + n <= last


def _power(base: np.uint64, n: int) -> np.uint64:
    return _U(pow(int(base), n, 1 << 64))


def _join(left: np.ndarray, right: np.ndarray, width: int, scale: np.uint64) -> np.ndarray:
    """left[i] followed by right[i + width]; what has no right part keeps its left one."""
    out = left * scale
    out[: len(right) - width] += right[width:] if width < len(right) else 0
    return out


def split_words(texts: pa.Array) -> Words:
    data, offsets = buffers(texts)
    if not len(data):
        return Words(data, offsets, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    word = ~SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text, or one row, and at most
    ``SLICE_ROWS`` rows: what a worker holds at a time doesn't grow with the batch."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i, base = 0, 0
    while i < batch.num_rows:
        j = min(max(i + 1, int(np.searchsorted(size, base + limit, "right"))), i + SLICE_ROWS)
        yield batch.slice(i, j - i)
        i, base = j, int(size[j - 1])
    _give_back()


def _give_back() -> None:
    """Free memory goes back to the system, for idle Python workers stay alive beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
