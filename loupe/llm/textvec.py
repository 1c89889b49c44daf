"""Vectorised text primitives over Arrow string columns.

A column's UTF-8 bytes are viewed as one numpy array, so that tokens, hashes and
per-document counts are whole-array operations and no Python string is made.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 3 << 18
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow: dict[str, np.ndarray] = {}
_LIBC = ctypes.CDLL(None)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n:
        size = ((n >> 17) + 1) << 17
        for name, base in (("p", _P), ("i", _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[name] = np.multiply.accumulate(a)
    return _pow["p"], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def table(chars: str = "", at_least: int = 256) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    t[at_least:] = True
    return t


WHITE = table(" \t\n\r\x0b\x0c")
LETTER = table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 128)


@dataclass
class Texts:
    """Some texts: their bytes, and where each begins and ends."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def lower(self) -> Texts:
        """ASCII and the two-byte Latin-1 capitals, so that lengths stay."""
        d = self.data.copy()
        d[(d >= 65) & (d <= 90)] += 32
        if len(d) > 1:
            second = d[1:]
            up = (d[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
            second[up] += 0x20
        return Texts(d, self.start, self.end)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in mask."""
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.end] - c[self.start]

    def tokens(self, inside: np.ndarray) -> Tokens:
        """The longest runs of bytes of which inside is true; none crosses texts."""
        n = len(self.data)
        good = inside[self.data] if len(inside) == 256 else inside
        edge = np.zeros(n + 1, bool)
        edge[self.start] = True
        edge[self.end] = True
        before = np.zeros(n + 1, bool)
        before[1:] = good
        first = good & (~before[:-1] | edge[:-1])
        after = np.zeros(n, bool)
        after[:-1] = good[1:]
        last = good & (~after | edge[1:])
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        lo, hi = np.searchsorted(a, self.start), np.searchsorted(a, self.end)
        return Tokens(self, a, b, lo, hi)


@dataclass
class Tokens:
    texts: Texts
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray  # of each text, its tokens are lo to hi
    hi: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def count(self) -> np.ndarray:
        return self.hi - self.lo

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lo)), self.count)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        return span_hashes(self.texts.data if data is None else data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same wherever a span's bytes stand."""
    p, inv = _powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=c[1:])
    return mix((c[end] - c[start]) * inv[start] ^ (end - start).astype(np.uint64))


def pieces(column: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES) -> Iterator[Texts]:
    """The column in runs of whole texts of about most bytes; a longer text stands alone. Nulls are empty. Afterwards memory goes back to the system: workers that wait for their next task stand beside the JVM in an executor."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        a = chunk.cast(pa.large_string())
        if a.null_count:
            a = a.fill_null("")
        if not len(a):
            continue
        _, offsets, data = a.buffers()
        off = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            j = min(j, len(a))
            yield Texts(raw[off[i] : off[j]], off[i:j] - off[i], off[i + 1 : j + 1] - off[i])
            i = j
    release()


def release() -> None:
    """Gives memory that is free back to the system, where it is glibc that keeps it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def of(texts: list[str | None]) -> Texts:
    """For tests and small lists."""
    return next(pieces(pa.array(texts, pa.string()), 1 << 40))
