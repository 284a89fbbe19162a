"""Vectorised reading of Arrow text columns: words, rolling word hashes and shingle hashes of whole texts.

A batch is worked off in slices of some hundred thousand bytes, so a worker's memory follows SLICE_BYTES and the longest
single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: \x20 and \x09-\x0D
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, SLICE_BYTES + 4096)
        with np.errstate(over="ignore"):
            for key, base in (("p", _R), ("i", _RINV)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                _POW[key] = np.cumprod(a, dtype=np.uint64)
    return _POW["p"], _POW["i"]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; seed gives independent functions."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def binary_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = a.buffers()
    o = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of some texts (A-Z lower-cased): text index, byte range and hash of each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, letters: np.ndarray | None = None):
        """letters: a table of 256 booleans for bytes that belong to words, if not all but white space."""
        b = _LOWER[data]
        self.bytes, self.offs, n = b, offs, len(b)
        inside = letters[b] if letters is not None else ~_SPACE[b]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        before = np.empty(n, bool)
        before[:1], before[1:] = False, inside[:-1]
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.empty(n, bool)
        after[-1:], after[:-1] = False, inside[1:]
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        p, self._inv = _powers(n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[:n], out=self._sum[1:])

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        s, e = (self.start, self.end) if start is None else (start, end)
        with np.errstate(over="ignore"):
            return mix((self._sum[e] - self._sum[s]) * self._inv[s])

    def per_text(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offs) - 1)


def shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's index of every k-word shingle, repeats included; a text of fewer words has one, of all."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mult = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    with np.errstate(over="ignore"):
        full = np.zeros(0, np.uint64)
        at = np.zeros(0, np.int64)
        if n >= k:
            acc = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                acc += h[j : n - k + 1 + j] * mult[j]
            ok = doc[: n - k + 1] == doc[k - 1 :]
            at = np.flatnonzero(ok)
            full = mix(acc[ok], k)
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[starts, n])
        short = count < k
        if short.any():
            s, c = starts[short], count[short]
            acc = np.zeros(len(s), np.uint64)
            for j in range(k - 1):
                has = c > j
                acc[has] += h[s[has] + j] * mult[j]
            full, at = np.r_[full, mix(acc, 7919)], np.r_[at, s]
            order = np.argsort(at, kind="stable")
            full, at = full[order], at[order]
    return full, at
