"""Words of whole batches of texts as 64-bit hashes, in numpy, so that tasks never loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E6C63D0876A9A8F)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_tables.get(name, ())) < n:
        t = np.full(max(n, 1 << 16), base, np.uint64)
        t[0] = 1
        _tables[name] = np.cumprod(t, dtype=np.uint64)
    return _tables[name][:n]


@dataclass
class Words:
    """All words of a batch: row of each, first byte, byte after the last, hash; and the batch's bytes with each row's bounds."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts (null: none) and the bounds of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span of bytes; spans ascend and don't overlap."""
    out = np.zeros(len(start), np.uint64)
    first = 0
    while first < len(start):  # in pieces of some 2 MB, so that a very long text takes little memory
        at = start[first]
        last = max(int(np.searchsorted(end, at + (1 << 21), side="right")), first + 1)
        s, e = start[first:last] - at, end[first:last] - at
        part = data[at : at + e[-1]].astype(np.uint64)
        part += np.uint64(1)
        part *= _powers("up", _BASE, len(part))
        np.cumsum(part, out=part)
        total = part[e - 1] - np.where(s > 0, part[s - 1], np.uint64(0))
        out[first:last] = mix(total * _powers("back", _BACK, int(s[-1]) + 1)[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = last
    return out


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text; with lower, of the text with A-Z in lower case."""
    data, bounds = buffer(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = (np.searchsorted(bounds, start, side="right") - 1).astype(np.int64)
    return Words(row, start, end, span_hashes(data, start, end), data, bounds)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct run of `size` words of each text, in order of both; with fewer words, of the whole text."""
    n = w.counts()
    h = np.zeros(len(w.hash), np.uint64)
    first = np.cumsum(n) - n
    place = np.arange(len(w.hash)) - first[w.row]
    left = n[w.row] - place
    for k in range(size):
        here = np.flatnonzero((left > k) & ((left >= size) | (place == 0)))
        h[here] = mix(h[here] * np.uint64(3) + w.hash[here + k] + np.uint64(k + 1))
    use = (left >= size) | (place == 0)
    row, h = w.row[use], h[use]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]
