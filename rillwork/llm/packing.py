"""Packing by non-negative least squares over a length histogram.

A document of over `window` tokens gives full windows and a rest; each rest is one piece. Lengths count in units (rounded up), so
the histogram has at most window / unit entries, whatever the size of the data, and that alone reaches the driver. There, all
combinations of up to three lengths that fill a window exactly are columns of a least-squares problem whose non-negative solution
says how often to use each; the counts are rounded down, and what is left of the histogram is packed greedily, longest first.
The plan gives ranges of ranks within a length to slots of sequences, and each piece finds its slot from its own rank.

Defined cases: a null or empty text is a document of one token (the end); ties and repeated rows are pieces of their own, ranked in
any order; null identifiers rank first; an empty table gives an empty result; other columns don't matter. Ranks are counted by
(length, bucket) with buckets in proportion to the data, so a length that most pieces share isn't one task's work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillwork.llm.common import slices, stored
from rillwork.llm.tokens import default_vocabulary, ids_of

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenizes whole texts and cuts each into pieces of `window` ids and a rest; with_ids adds the ids themselves."""
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows, held = [], []
            for doc, ids in zip(b.column("doc_id").to_pylist(), ids_of(b.column("text"), path, end), strict=True):
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.data), len(ids)))
                    if with_ids:
                        held.append(piece.astype("<i4"))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def shallow_fillings(units: int, depth: int = 3) -> list[tuple[int, ...]]:
    """All falling tuples of at most `depth` lengths that sum to units."""
    found = []

    def grow(left: int, most: int, taken: tuple[int, ...]) -> None:
        if left == 0:
            found.append(taken)
        elif len(taken) < depth:
            for x in range(min(left, most), 0, -1):
                if x * (depth - len(taken)) < left:
                    break
                grow(left - x, x, (*taken, x))

    grow(units, units, ())
    return found


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-8 * scale:
            break
        passive[best] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 1e-10 * scale).all():
                break
            low = z <= 1e-10 * scale
            step = float(np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)))
            x[at] += step * (z - x[at])
            passive[at[x[at] <= 1e-9 * scale]] = False
            x[~passive] = 0
        x[:] = 0
        x[at] = z
    return x


def plan(histogram: np.ndarray, units: int, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often to use each, so that every piece counted in histogram[1..units] is used exactly once."""
    left = histogram.astype(np.int64).copy()
    found: list[tuple[tuple[int, ...], int]] = []
    if left[units]:
        found.append(((units,), int(left[units])))
        left[units] = 0
    if left.any():
        ways = [w for w in shallow_fillings(units, depth) if len(w) > 1 and all(left[x] for x in w)]
        if ways:
            a = np.zeros((units + 1, len(ways)))
            for j, w in enumerate(ways):
                np.add.at(a[:, j], list(w), 1)
            x = np.floor(nonnegative_least_squares(a, left.astype(float)) + 1e-6).astype(np.int64)
            for j in np.argsort(-x, kind="stable"):
                need = a[:, j].astype(np.int64)
                n = min(int(x[j]), int((left[need > 0] // need[need > 0]).min()))
                if n > 0:
                    found.append((ways[j], n))
                    left -= n * need
    while left.any():  # greedily: the longest piece, then the longest that fit beside it; as often as all are there
        way, room = [], units
        rest = left.copy()
        while room and (fits := np.flatnonzero(rest[: room + 1])).size:
            way.append(int(fits[-1]))
            rest[fits[-1]] -= 1
            room -= int(fits[-1])
        need = np.bincount(way, minlength=units + 1)
        n = int((left[need > 0] // need[need > 0]).min())
        found.append((tuple(way), n))
        left -= n * need
    return found


def _slots(found: list[tuple[tuple[int, ...], int]], units: int) -> list[np.ndarray]:
    """For each length, rows (first rank, first sequence, slot) in order of rank."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(units + 1)]
    used, sequence = [0] * (units + 1), 0
    for way, n in found:
        for slot, x in enumerate(way):
            out[x].append((used[x], sequence, slot))
            used[x] += n
        sequence += n
    return [np.array(x, np.int64).reshape(-1, 3) for x in out]


def packed(found: DataFrame, window: int = 2048, unit: int = 16, depth: int = 3, bucket_rows: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (doc_id, start, length, ...)."""
    units = -(-window // unit)
    by_length = found.withColumn("_bin", F.ceil(F.col("length") / unit).cast("int"))
    histogram = np.zeros(units + 1, np.int64)
    for r in by_length.groupBy("_bin").count().collect():
        histogram[r["_bin"]] = r["count"]
    slots = _slots(plan(histogram, units, depth), units)
    buckets = max(16, int(histogram.sum()) // bucket_rows)
    dealt = by_length.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("_bin").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("_bin", "_bucket").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy("_bin", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("_row", F.row_number().over(inner) - 1).join(bases, ["_bin", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_row")).drop("_base", "_row", "_bucket")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("_bin").to_numpy(), b.column("_rank").to_numpy()
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int32)
            for x in np.unique(size):
                here = size == x
                at = slots[x][np.searchsorted(slots[x][:, 0], rank[here], side="right") - 1]
                sequence[here], slot[here] = at[:, 1] + rank[here] - at[:, 0], at[:, 2]
            yield b.drop_columns(["_bin", "_rank"]).append_column("sequence_id", pa.array(sequence)).append_column("_slot", pa.array(slot))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    placed = ranked.select(*found.columns, "_bin", "_rank").mapInArrow(place, f"{fields}, sequence_id bigint, _slot int")
    earlier = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("_slot")


def pack_documents(docs: DataFrame, window: int = 2048, unit: int = 16, depth: int = 3, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens (ids), sequence_id, offset."""
    return packed(stored(pieces(docs, window, id_col, text_col, vocabulary, end, with_ids), "pieces"), window, unit, depth)


def sequences(placed: DataFrame, window: int = 2048, pad: int = 0) -> DataFrame:
    """From pieces with ids: one row per sequence, padded ids and the lengths of its segments; groups are one window at most."""
    item = F.struct("offset", "length", "ids")
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(item)).alias("p"), F.sum("length").alias("used"))
    ids = F.flatten(F.transform("p", lambda p: p["ids"]))
    return rows.select(
        "sequence_id", F.concat(ids, F.array_repeat(F.lit(pad), (F.lit(window) - F.col("used")).cast("int"))).alias("ids"), F.transform("p", lambda p: p["length"]).alias("segments")
    )
