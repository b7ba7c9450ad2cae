"""Periodic runs of words by Crochemore's partition refinement.

Positions of a text are in one class of level L if the L words from there on are equal. A level comes from the one before: a class splits by
the classes of its positions' successors. Classes that only end positions leave don't have to be looked at, so the refinement looks at the
smaller parts alone: of the parts that a class splits into all but a largest one, and only the predecessors of their positions move
on the next level. A class keeps, for each position, the next one. Where these are L apart on level L, a square of period L begins, and its root
isn't a power itself; squares of one period at neighbouring positions are one run.

A run of at least four periods has three positions or more in each class of its squares, at least two periods apart from first to last; so smaller
classes are dropped, and they are soon all of a text without long runs. The first levels are refined for a whole batch of texts by sorting what is left;
the others text by text.

Defined cases: a null or empty text, or one without words, has n = 0 and no runs; rows of a null identifier are texts as any other; each row has a
result of its own, also where identifiers or rows repeat; an empty table gives an empty result; other columns don't matter, whatever their names; a text of any
length is whole in one task, with some hundred bytes of memory for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import slices
from rillwork.llm.words import buffer

#: Levels that are refined by sorting a batch.
SORTED_LEVELS = 4
#: Least size of a class: of any run of four periods or more, each square begins in a class of three positions.
LEAST_CLASS = 3

RUNS = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
#: Gives, for a batch's identifiers and numbers of words, the place in its own text that each word is taken from.
Places = Callable[[list, np.ndarray], np.ndarray]


@dataclass
class Split:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch: a code of each (equal for equal words), the number in each text, their bytes and lengths."""

    code: np.ndarray
    counts: np.ndarray
    flat: np.ndarray
    length: np.ndarray


def split(texts: pa.Array) -> Split:
    data, bounds = buffer(texts)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    start = np.flatnonzero(begins)
    flat = data[inside]
    at = np.concatenate([np.cumsum(inside)[start] - 1, [len(flat)]]).astype(np.int64) if len(start) else np.zeros(1, np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(flat)])
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    counts = np.diff(np.searchsorted(start, bounds))
    return Split(code, counts, flat, np.diff(at))


def taken(s: Split, places: np.ndarray) -> Split:
    """The words at the given places of their own texts, one for each place."""
    first = np.cumsum(s.counts) - s.counts
    source = np.repeat(first, s.counts) + places
    begin, length = np.cumsum(s.length) - s.length, s.length[source]
    into = np.cumsum(length) - length
    flat = s.flat[np.repeat(begin[source] - into, length) + np.arange(int(length.sum()))]
    return Split(s.code[source], s.counts, flat, length)


def early_squares(code: np.ndarray, counts: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions (in the batch) and periods of the squares of the first levels; then the positions left and their classes on the last level."""
    row = np.repeat(np.arange(len(counts)), counts)
    last = np.cumsum(counts)[row] if len(row) else row
    where, period = [], []
    alive = np.arange(len(code))
    name = np.full(len(code), -1, np.int64)
    key = row * (int(code.max(initial=0)) + 1) + code
    for level in range(1, levels + 1):
        order = np.argsort(key, kind="stable")
        key, alive = key[order], alive[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        wide = alive[begin + size - 1] - alive[begin] >= 2 * level
        stay = ((size >= LEAST_CLASS) & wide)[group]
        alive, group = alive[stay], group[stay]
        square = (group[1:] == group[:-1]) & (np.diff(alive) == level)
        where.append(alive[:-1][square])
        period.append(np.full(len(where[-1]), level))
        name[:] = -1
        name[alive] = group
        if level < levels:  # a position's next class is its own with its successor's
            up = alive[alive + level < last[alive]]
            up = up[name[np.minimum(up + 1, len(name) - 1)] >= 0]
            key = name[up] * (len(code) + 1) + name[np.minimum(up + 1, len(name) - 1)]
            alive = up
    return np.concatenate(where), np.concatenate(period), alive, name[alive]


def later_squares(positions: list[int], classes: list[int], level: int, n: int) -> list[tuple[int, int]]:
    """(period, position) of the squares of one text on the levels after `level`, whose classes are given, by smaller halves."""
    cls = dict(zip(positions, classes, strict=True))
    members: dict[int, dict[int, None]] = {}
    after: dict[int, int] = {}
    before: dict[int, int] = {}
    due: dict[int, list[int]] = {}
    for i in sorted(cls):
        mine = members.setdefault(cls[i], {})
        if mine:
            j = next(reversed(mine))
            after[j], before[i] = i, j
            due.setdefault(i - j, []).append(j)
        mine[i] = None
    fresh = max(members, default=0) + 1
    found: list[tuple[int, int]] = []
    # on the first of these levels every class is a part to look at; positions without a class, and the text's end, are one as well
    small: list[list[int]] = [list(m) for m in members.values()]
    gone = [i + 1 for i in cls if i + 1 not in cls]

    def unlink(i: int) -> None:
        a, b = before.pop(i, None), after.pop(i, None)
        if a is not None and b is not None:
            after[a], before[b] = b, a
            due.setdefault(b - a, []).append(a)
        elif a is not None:
            del after[a]
        elif b is not None:
            del before[b]

    while members and level < n // 4:
        level += 1
        parts: dict[int, list[list[int]]] = {}
        dead: list[int] = []
        for k, piece in enumerate([gone, *small]):
            at: dict[int, list[int]] = {}
            for i in piece:
                if i - 1 in cls:
                    at.setdefault(cls[i - 1], []).append(i - 1)
            for c, some in at.items():
                if k == 0:
                    dead += some
                else:
                    parts.setdefault(c, []).append(some)
        lost: list[int] = []
        for i in dead:
            c = cls.pop(i)
            del members[c][i]
            parts.setdefault(c, [])
            unlink(i)
            lost.append(i)
        small = []
        for c, pieces in parts.items():
            mine = members[c]
            split_off = []
            for some in pieces:
                if len(some) == len(mine):
                    break  # the rest of the class is one part: it stays as it is
                for i in some:
                    del mine[i]
                    unlink(i)
                some.sort()
                for a, b in zip(some, some[1:], strict=False):
                    after[a], before[b] = b, a
                    due.setdefault(b - a, []).append(a)
                members[fresh] = dict.fromkeys(some)
                for i in some:
                    cls[i] = fresh
                split_off.append(fresh)
                fresh += 1
            kinds = [k for k in (c, *split_off) if members[k]]
            if not mine:
                del members[c]
            largest = max(kinds, key=lambda k: len(members[k]), default=None)
            for k in kinds:
                if len(members[k]) < LEAST_CLASS:
                    for i in members.pop(k):
                        del cls[i]
                        before.pop(i, None)
                        after.pop(i, None)
                        lost.append(i)
                elif k != largest:
                    small.append(list(members[k]))
        gone = lost
        found += [(level, i) for i in due.pop(level, ()) if after.get(i) == i + level]
    return found


def merged(period: np.ndarray, position: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs that squares of a text or a batch make, by start, then period."""
    if not len(period):
        return (np.zeros(0, np.int64),) * 3
    order = np.lexsort((position, period))
    p, i = period[order], position[order]
    same = np.concatenate([[False], (p[1:] == p[:-1]) & (i[1:] == i[:-1])])
    p, i = p[~same], i[~same]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1)])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(p)) - 1
    start, period = i[begin], p[begin]
    length = i[end] - start + 2 * period
    keep = length >= np.maximum(least, times * period)
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs_of(code: np.ndarray, counts: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in the batch), length and period of all runs of a batch of texts, by start, then period; times is at least 4."""
    if times < 4:
        raise ValueError("classes are dropped by what runs of four periods have")
    position, period, alive, name = early_squares(code, counts, SORTED_LEVELS)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    order = np.argsort(alive)
    alive, name = alive[order], name[order]
    cut = np.searchsorted(alive, bounds)
    more = []
    for k in np.flatnonzero(np.diff(cut)):
        a, b = cut[k], cut[k + 1]
        first = int(bounds[k])
        more += [(p, i + first) for p, i in later_squares((alive[a:b] - first).tolist(), name[a:b].tolist(), SORTED_LEVELS, int(counts[k]))]
    more = np.array(more, np.int64).reshape(-1, 2)
    return merged(np.concatenate([period, more[:, 0]]), np.concatenate([position, more[:, 1]]), least, times)


def _judged(b: pa.RecordBatch, least: int, times: int, places: Places | None) -> pa.RecordBatch:
    ids = b.column("doc_id").to_pylist()
    s = split(b.column("text"))
    if places is not None:
        s = taken(s, places(ids, s.counts))
    start, length, period = runs_of(s.code, s.counts, least, times)
    bounds = np.concatenate([[0], np.cumsum(s.counts)])
    depth = np.zeros(len(s.code) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    keep = np.cumsum(depth[:-1]) == 0
    # every kept word with a space behind it
    length_kept = s.length[keep]
    into = np.cumsum(length_kept + 1) - (length_kept + 1)
    out = np.full(int((length_kept + 1).sum()), 32, np.uint8)
    out[np.repeat(into - (np.cumsum(length_kept) - length_kept), length_kept) + np.arange(int(length_kept.sum()))] = s.flat[np.repeat(keep, s.length)]
    ends = np.concatenate([[0], np.cumsum(np.where(keep, s.length + 1, 0))])[bounds]
    cut = np.searchsorted(start, bounds)
    rows = []
    for k, doc_id in enumerate(ids):
        x, n, p = (v[cut[k] : cut[k + 1]] for v in (start - bounds[k], length, period))
        lines = "".join(f"{i},{j},{q}\n" for i, j, q in zip(x.tolist(), n.tolist(), p.tolist(), strict=True))
        best = int(np.lexsort((p, x, -n))[0]) if len(x) else None
        top = (None,) * 4 if best is None else (int(x[best]), int(n[best]), int(p[best]), int(1000 * n[best] // p[best]))
        text = out[ends[k] : max(ends[k + 1] - 1, ends[k])].tobytes()
        rows.append((doc_id, len(x), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    columns = zip(*rows, strict=True) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RUNS.split(", ")])


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, places: Places | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RUNS of each document: runs of `least` words and `times` periods or more, the longest of them (ties: first start, then period), and a digest of
    the words without what any run repeats after its first period. places: has the words of a text taken from other places of it."""
    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            yield _judged(b, least, times, places)

    return own.mapInArrow(run, RUNS)


def planted_tails(ids: list, counts: np.ndarray) -> np.ndarray:
    """Of every tenth document by checksum, the words from some place on repeat with some period; the others, and rows of a null identifier, stay."""
    import zlib

    first = np.cumsum(counts) - counts
    out = np.arange(int(counts.sum())) - np.repeat(first, counts)
    for k, (doc_id, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at = np.arange(n - a)
            out[first[k] + a : first[k] + n] = a + at % p
    return out
