"""Exact duplicates by a tree-merge of sorted digest runs.

Every row gives a key (SHA-256 of the text, checked by a second 64-bit hash and the length). Each task sorts the keys of its rows into
one run, folds equal keys into one entry with the kept identifier and the row count, and cuts the run into blocks. Then runs exchange
in binomial rounds: run i receives runs i+1 .. i+fan_in-1 of its block of runs; a task gets the blocks of these sorted runs in order of
their first keys and merges them as they come, so it holds about a block of each run, and again keeps one verified entry a key. Every
run is split into shards by ranges of digests, as many as the rows ask for, so no merge grows with the data; a hot key has one entry
a run at most.

Defined cases: a null text counts as empty; rows of a null identifier group by text like others, but never give the kept
identifier unless all of the group are null; rows repeating an identifier and a text count as rows, all are kept or dropped
together in the report, and drop_copies leaves one of them. An empty table gives an empty result. Other columns don't matter, whatever
their names; drop_copies passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import attach, stored, text_of, unused

#: A block of a run: its keys one after another, kept identifiers (8 bytes each), whether there is one (1), and rows (8).
BLOCK = "shard int, run int, first binary, keys binary, ids binary, has binary, sizes binary"
ENTRY = "key binary, keep_id bigint, group_size bigint"
WIDTH = 48
#: Rows that a shard has about, and entries of a block at most.
SHARD_ROWS, BLOCK_ENTRIES = 250_000, 1024


def key_of(text: Column) -> Column:
    """A text's key: 32 bytes of SHA-256, 8 of xxhash64, 8 of length."""
    return F.concat(
        F.unhex(F.sha2(text.cast("binary"), 256)), F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0")), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0"))
    )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its identifier and its text's key."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), key_of(text_of(text_col)).alias("key"))


class _Run:
    """Entries in order of their keys."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, has: np.ndarray, sizes: np.ndarray):
        self.keys, self.ids, self.has, self.sizes = keys, ids, has, sizes

    def __len__(self) -> int:
        return len(self.keys)

    def cut(self, a: int, z: int) -> _Run:
        return _Run(self.keys[a:z], self.ids[a:z], self.has[a:z], self.sizes[a:z])

    def merged(self, other: _Run, pick) -> _Run:
        """Both runs in one; entries of equal keys become one."""
        if not len(self):
            return other
        at = np.searchsorted(self.keys, other.keys, side="right") + np.arange(len(other))
        own = np.ones(len(self) + len(other), bool)
        own[at] = False

        def woven(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.empty(len(own), a.dtype)
            out[own], out[at] = a, b
            return out

        return _Run(*(woven(getattr(self, c), getattr(other, c)) for c in ("keys", "ids", "has", "sizes"))).folded(pick)

    def folded(self, pick) -> _Run:
        new = np.ones(len(self), bool)
        new[1:] = self.keys[1:] != self.keys[:-1]
        if new.all():
            return self
        at = np.flatnonzero(new)
        worst = np.iinfo(np.int64).max if pick is np.minimum else np.iinfo(np.int64).min
        ids = pick.reduceat(np.where(self.has, self.ids, worst), at)
        return _Run(self.keys[at], ids, np.logical_or.reduceat(self.has, at), np.add.reduceat(self.sizes, at))


class _Writer:
    """Gathers finished entries of one (shard, run) and gives them out in blocks, or as plain entries if last."""

    def __init__(self, last: bool):
        self.last, self.held, self.n = last, [], 0

    def add(self, shard: int, run: int, entries: _Run) -> Iterator[pa.RecordBatch]:
        self.shard, self.run = shard, run
        if len(entries):
            self.held.append(entries)
            self.n += len(entries)
        if self.n >= BLOCK_ENTRIES:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        r = _Run(*(np.concatenate([getattr(x, c) for x in self.held]) for c in ("keys", "ids", "has", "sizes")))
        self.held, self.n = [], 0
        if self.last:
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(r), [None, pa.py_buffer(r.keys.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array(r.ids, mask=~r.has), pa.array(r.sizes)], names=["key", "keep_id", "group_size"])
            return
        for a in range(0, len(r), BLOCK_ENTRIES):
            b = r.cut(a, a + BLOCK_ENTRIES)
            blobs = [b.keys[:1].tobytes(), b.keys.tobytes(), b.ids.tobytes(), b.has.tobytes(), b.sizes.tobytes()]
            cols = [pa.array([self.shard], pa.int32()), pa.array([self.run], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "run", "first", "keys", "ids", "has", "sizes"])


def _first_runs(pick, shards: int, runs: int):
    """A task's rows, in order of their keys, as one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, writer, held, shard = TaskContext.get().partitionId() % runs, _Writer(False), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), f"S{WIDTH}")
            ids, sizes = batch.column("doc_id"), np.ones(batch.num_rows, np.int64)
            has = np.asarray(ids.is_valid())
            r = _Run(keys, ids.fill_null(0).to_numpy(zero_copy_only=False), has, sizes).folded(pick)
            r = held.merged(r, pick) if held is not None else r
            held, r = r.cut(len(r) - 1, len(r)), r.cut(0, len(r) - 1)  # the last entry goes on into the next batch
            top = np.frombuffer(r.keys.tobytes(), ">u4").reshape(-1, WIDTH // 4)[:, 0].astype(np.int64) * shards >> 32
            for s in np.unique(top):
                if s != shard:
                    yield from writer.out()
                    shard = int(s)
                yield from writer.add(shard, own, r.cut(*np.searchsorted(top, [s, s + 1])))
        if held is not None:
            s = int.from_bytes(held.keys.tobytes()[:4], "big") * shards >> 32
            if s != shard:
                yield from writer.out()
            yield from writer.add(s, own, held)
        yield from writer.out()

    return run


def _merge(pick, last: bool):
    """Blocks of several sorted runs, in order of (shard, run, first key), become one run for each shard and run."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, place, held = _Writer(last), None, None
        for batch in batches:
            for i, here in enumerate(zip(batch.column("shard").to_pylist(), batch.column("run").to_pylist(), strict=True)):
                kinds = (("keys", f"S{WIDTH}"), ("ids", np.int64), ("has", bool), ("sizes", np.int64))
                block = _Run(*(np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in kinds))
                if here != place:
                    if place is not None:
                        yield from writer.add(*place, held)
                        yield from writer.out()
                    place, held = here, block
                    continue
                done = int(np.searchsorted(held.keys, block.keys[:1])[0])  # no later block has a key below this one's first
                yield from writer.add(*place, held.cut(0, done))
                held = held.cut(done, len(held)).merged(block, pick)
        if place is not None:
            yield from writer.add(*place, held)
            yield from writer.out()

    return merge


def merged_runs(rows: DataFrame, keep: str = "min", fan_in: int = 16) -> DataFrame:
    """From a stored table (doc_id, key): one row per key with keep_id, the smallest (keep="max": the largest) identifier, and group_size."""
    pick = np.maximum if keep == "max" else np.minimum
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    runs = rows.rdd.getNumPartitions()
    level = rows.sortWithinPartitions("key").mapInArrow(_first_runs(pick, shards, max(1, runs)), BLOCK)
    while True:
        runs = -(-runs // fan_in)
        level = (
            level.withColumn("run", F.expr(f"run div {fan_in}").cast("int"))
            .repartition("shard", "run")
            .sortWithinPartitions("shard", "run", "first")
            .mapInArrow(_merge(pick, runs <= 1), ENTRY if runs <= 1 else BLOCK)
        )
        if runs <= 1:
            return level


def _reported(rows: DataFrame, keep: str) -> DataFrame:
    """From stored digests: the digests with keep_id, group_size and kept."""
    groups = stored(merged_runs(rows, keep), "digest-groups")
    return attach(rows, groups, "key", "group_size", rows.count()).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = _reported(stored(digests(docs, id_col, text_col), "digests"), keep)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat identifier and text, one. Texts move once, to the
    decision on them; rows of equal identifier and text fold in their tasks before."""
    place, other = unused(docs, "_place"), unused(docs, "_place_kept")
    at = lambda id_, key: F.concat(F.coalesce(id_.cast("string").cast("binary"), F.lit("none").cast("binary")), key)
    found = _reported(stored(digests(docs, id_col, text_col), "digests"), keep).filter("kept").select(at(F.col("doc_id"), F.col("key")).alias(other))
    kept = stored(found.groupBy(other).agg(F.count("*").alias("n")), "kept")
    own = docs.withColumn(place, at(F.col(f"`{id_col}`").cast("bigint"), key_of(text_of(text_col))))
    if not kept.filter("n > 1").isEmpty():
        own = own.dropDuplicates([place])
    return own.join(kept.select(other).hint("shuffle_hash"), F.col(place) == F.col(other), "left_semi").drop(place)
