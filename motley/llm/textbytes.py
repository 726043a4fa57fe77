"""Vectorised word, line and shingle hashing over Arrow string buffers.

Everything works on the UTF-8 bytes of a whole slice of documents at once:
word borders are found with byte masks, hashes come from prefix sums of a
polynomial modulo 2**64, so no Python code runs for single words.
Words are runs of bytes outside {0x20, 0x09..0x0D}; these are ASCII, hence
splitting bytes is the same as splitting code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18  # some fifteen arrays of eight bytes for each byte of a slice live at once

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_STEPS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], dtype=_U)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to a few slices."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, SLICE_BYTES), dtype=_U)
        have[0] = 1
        have[1:] = _U(base)
        np.cumprod(have, out=have)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(32)
    return h


def strings(column: pa.Array) -> pa.Array:
    """A plain string array without nulls (null: empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 offsets into them."""
    column = strings(column)
    _, offs, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a slice of documents: byte spans, first word of each document, hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool):
        self.raw, self.offsets = raw, offsets
        space = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
        before = np.ones(len(raw) + 1, bool)
        before[1:] = space
        before[offsets] = True
        after = np.ones(len(raw) + 1, bool)
        after[:-1] = space
        after[offsets] = True
        self.space = space
        self.starts = np.flatnonzero(~space & before[:-1])
        self.ends = np.flatnonzero(~space & after[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        folded = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw) if lower else raw
        self.sums = np.zeros(len(raw) + 1, _U)
        np.cumsum((folded.astype(_U) + _U(1)) * powers(_BASE, len(raw)), out=self.sums[1:])
        self.back = powers(pow(_BASE, -1, 1 << 64), len(raw) + 1)
        self.hashes = self.spans(self.starts, self.ends)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans."""
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(_U) * _U(_WORD_BASE))

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences [first, last)."""
        n = len(self.hashes)
        sums = np.zeros(n + 1, _U)
        np.cumsum(self.hashes * powers(_WORD_BASE, n), out=sums[1:])
        back = powers(pow(_WORD_BASE, -1, 1 << 64), n + 1)
        return mix((sums[last] - sums[first]) * back[first] + (last - first).astype(_U) * _U(_BASE))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) and hashes of the full windows of ``width`` words inside documents."""
        ids = np.arange(len(self.hashes))
        docs = np.repeat(np.arange(len(self.counts)), self.counts)
        at = ids[ids + width <= self.first[1:][docs]] if len(ids) else ids
        h = np.zeros(len(at), _U)
        for k in range(width):
            h += self.hashes[at + k] * _STEPS[k]
        return at, mix(h)

    def shingle_sets(self, width: int = 5) -> list[np.ndarray]:
        """For each document its sorted distinct shingle hashes; shorter ones: the whole sequence as one."""
        at, h = self.windows(width)
        cuts = np.searchsorted(at, self.first)
        short = (self.counts > 0) & (self.counts < width)
        whole = self.runs(self.first[:-1], self.first[1:]) if short.any() else None
        out = []
        for k in range(len(self.counts)):
            if short[k]:
                out.append(whole[k : k + 1])
            else:
                part = np.sort(h[cuts[k] : cuts[k + 1]])
                if len(part) > 1:
                    part = part[np.concatenate(([True], part[1:] != part[:-1]))]
                out.append(part)
        return out


def each_slice(column: pa.Array, lower: bool):
    """(first row, row after the last, Words) for slices of a string column."""
    raw, offsets = utf8(column)
    for i, j in slices(offsets):
        yield i, j, Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
