"""Word splitting and hashing on the bytes of Arrow string columns.

UTF-8 text is handled as bytes: a word class that holds all bytes from 0x80 up
never cuts a character. All words of a block are hashed at once by prefix sums
of a polynomial over random byte values, modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _table(extra: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=np.uint8)
    for b in range(128):
        if chr(b).isalpha() or bytes([b]) in [bytes([x]) for x in extra]:
            t[b] = ord(chr(b).lower())
    t[128:] = np.arange(128, 256, dtype=np.uint8)
    return t


#: ASCII letters and digits, lower-cased, and all other characters than ASCII.
WORD = _table(b"0123456789")
#: The same without digits.
LETTERS = _table(b"")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        made = []
        for b in (_B, _BINV):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


class Block:
    """Some whole texts of a column, as bytes, with the bounds of all words."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, table: np.ndarray, latin: bool = False):
        self.n = len(starts) - 1
        self.starts = starts
        self.raw = buf
        b = table[buf]
        if latin and len(b):  # capital letters of the Latin-1 page: C3 80 to C3 9E
            up = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)) + 1
            b[up] += 0x20
        self.bytes = b
        w = b != 0
        prev = np.empty_like(w)
        nxt = np.empty_like(w)
        if len(w):
            prev[0], prev[1:] = False, w[:-1]
            nxt[-1], nxt[:-1] = False, w[1:]
            cut = starts[1:-1]
            cut = cut[(cut > 0) & (cut < len(w))]
            prev[cut] = False
            nxt[cut - 1] = False
        self.s = np.flatnonzero(w & ~prev)
        self.e = np.flatnonzero(w & ~nxt) + 1
        self.doc = np.searchsorted(starts, self.s, "right") - 1
        #: The first word of each text, and the number of all words last.
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))
        self._sum = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def _prefix(self) -> np.ndarray:
        if self._sum is None:
            p, _ = powers(len(self.bytes))
            h = np.empty(len(self.bytes) + 1, dtype=np.uint64)
            h[0] = 0
            np.cumsum(_VALUES[self.bytes] * p[: len(self.bytes)], out=h[1:])
            self._sum = h
        return self._sum

    def hashes(self, s: np.ndarray, e: np.ndarray, salt: int = 0) -> np.ndarray:
        """Of the byte ranges from s to e."""
        h = self._prefix()
        _, inv = powers(len(self.bytes))
        x = (h[e] - h[s]) * inv[s]
        return mix(x + np.uint64(salt) + (e - s).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def words(self) -> np.ndarray:
        return self.hashes(self.s, self.e)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text no., hash) of every run of k words; a text of fewer words, but not none, has one."""
        w = self.words()
        n = self.counts
        m = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
        doc = np.repeat(np.arange(self.n), m)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m) + self.first[:-1][doc]
        h = np.zeros(len(doc), dtype=np.uint64)
        left = n[doc] - (at - self.first[:-1][doc])
        for i in range(k):
            ok = left > i
            h[ok] = mix(h[ok] * np.uint64(0x9E3779B97F4A7C15) + w[at[ok] + i] + np.uint64(i + 1))
        return doc, h


def blocks(column: pa.Array, table: np.ndarray, latin: bool = False, most: int = 1 << 20) -> Iterator[tuple[int, Block]]:
    """(first row, Block) of a string column, each of at most `most` bytes or one text. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, len(column))
        yield i, Block(data[off[i] : off[j]], off[i : j + 1] - off[i], table, latin)
        i = j
