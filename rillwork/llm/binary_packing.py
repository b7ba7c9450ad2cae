"""Best-fit-decreasing packing into binary id matrices.

Each task packs its own documents, some thousands at a time, so no ids cross the network and memory is bounded: a chunk's pieces
are placed longest first, each into the open sequence with the least room that still holds it, found by a segment tree over room
sizes. An overlong document is cut into full windows and a rest, losslessly. A row is one sequence: its ids, padded, as
little-endian unsigned 16-bit (32-bit for vocabularies beyond 65,536 ids) numbers; cumulative segment lengths; position resets
in the same width; and which document and which of its ids each segment holds.

Defined cases: a null or empty text is a document of one token; null identifiers stay null; ties and repeated rows are pieces of
their own; an empty table gives an empty result; other columns don't matter. There is no key, so none can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import slices
from rillwork.llm.tokens import default_vocabulary, ids_of

SEQUENCES = "doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, n_tokens int, ids binary, position_ids binary"


class Rooms:
    """How many open sequences have each room size, as a segment tree; finds the least room of at least n in log steps."""

    def __init__(self, most: int):
        self.half = 1 << most.bit_length()
        self.tree = [0] * (2 * self.half)

    def add(self, room: int, n: int) -> None:
        i = self.half + room
        while i:
            self.tree[i] += n
            i >>= 1

    def least(self, n: int) -> int | None:
        i = self.half + n
        if self.tree[i]:
            return n
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.half:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.half
            i >>= 1
        return None


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Indexes of the pieces of each sequence."""
    rooms, open_, out = Rooms(window), [[] for _ in range(window + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room = rooms.least(n) if n < window else None
        if room is None:
            room, at = window, len(out)
            out.append([])
        else:
            at = open_[room].pop()
            rooms.add(room, -1)
        out[at].append(i)
        if room > n:
            open_[room - n].append(at)
            rooms.add(room - n, 1)
    return out


def binary_sequences(docs: DataFrame, window: int = 2048, chunk_mb: int = 8, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = 1, pad: int = 0, wide: bool = False) -> DataFrame:
    """Packed sequences of all documents; chunk_mb: text that is packed together."""
    path, width = vocabulary or default_vocabulary(), "<u4" if wide else "<u2"
    if max(window, pad) > np.iinfo(width).max:
        raise ValueError("window and pad must fit the width of ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            rows: dict[str, list] = {n: [] for n in ("doc_ids", "starts", "cu_seqlens", "n_tokens", "ids", "position_ids")}
            for members in best_fit_decreasing([len(p[2]) for p in held], window):
                own = [held[i] for i in members]
                edges = np.cumsum([0, *(len(p[2]) for p in own)])
                ids, position = np.full(window, pad, width), np.zeros(window, width)
                ids[: edges[-1]] = np.concatenate([p[2] for p in own])
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    position[a:b] = np.arange(b - a)
                for name, x in zip(rows, ([p[0] for p in own], [p[1] for p in own], edges.tolist(), int(edges[-1]), ids.tobytes(), position.tobytes()), strict=True):
                    rows[name].append(x)
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
            cols = [pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)]
            for i in range(0, len(cols[0]), 512):
                yield pa.RecordBatch.from_arrays([c.slice(i, 512) for c in cols], names=list(rows))

        held: list[tuple] = []
        size = 0
        for b in slices(batches, "text"):
            for doc, ids in zip(b.column("doc_id").to_pylist(), ids_of(b.column("text"), path, end), strict=True):
                if ids.max() > np.iinfo(width).max:
                    raise ValueError(f"id {ids.max()} does not fit {width}; set wide")
                held += [(doc, s, ids[s : s + window]) for s in range(0, len(ids), window)]
                size += len(ids) * 4
            if size > chunk_mb << 20:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(pack, SEQUENCES)


def write_sequences(found: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """The matrices as Parquet files of binary columns, written by the tasks that made them; gives them as read back."""
    found.write.mode(mode).parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)
