"""Near duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

A text's set is its distinct word shingles. Texts of equal sets, by 128 bits, are one node. A SuperMinHash signature gives every element a
random permutation of the signature's places: its rank in that order plus a random fraction is the value it offers a place, and
a place keeps the least offer, so places are filled without repetition; a text stops as soon as all its places hold less than the
next rank. Nodes that agree in all rows of a band are in one bucket; buckets of one node are dropped at once. In each of two turns a
bucket has a centre, and each node tries the centre that it meets in most buckets. Buckets whose members the confirmed links don't
join stay: a node leaves those where no partner can be near enough, by the shingles that it has alone, and the rest is compared pair by
pair inside the bucket, in blocks of `block` nodes: nodes of the bucket's largest component meet its other nodes only, and these meet each
other. Every link is confirmed on the full sets. Buckets, centres and components of any size are
joined in parts.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text with fewer words
than a shingle is one shingle; rows of a null identifier are their own component (null) and stay; rows repeating an identifier are
one document for the component and stay or go together by it; an empty table gives an empty result; other columns don't matter, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import attach, dropped, slices, stored, unused
from rillwork.llm.components import components
from rillwork.llm.words import mix, shingles, words

SIZE = 128
PARITY = 2048
_STEP = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 56) - 1)


def signatures(row: np.ndarray, h: np.ndarray, rows: int, size: int = SIZE) -> np.ndarray:
    """SuperMinHash of each row's elements: rank in the top byte of each value, a random fraction below it."""
    least = np.full(rows * size, np.iinfo(np.uint64).max, np.uint64)
    active = np.arange(rows)
    order: np.ndarray | None = None
    for rank in range(size):
        draw = mix(h + np.uint64((rank + 1) * _STEP % (1 << 64)))
        pick = rank + (draw >> np.uint64(32)).astype(np.int64) * (size - rank) // (1 << 32)
        if rank == 0:
            place = pick
        else:
            if order is None:
                order = np.tile(np.arange(size, dtype=np.uint8), (len(h), 1))
                first = (mix(h + np.uint64(_STEP)) >> np.uint64(32)).astype(np.int64) * size // (1 << 32)
                e = np.arange(len(h))
                order[e, first], order[e, 0] = 0, first.astype(np.uint8)
            e = np.arange(len(h))
            place = order[e, pick].astype(np.int64)
            order[e, pick] = order[:, rank]
        np.minimum.at(least, row * size + place, (np.uint64(rank) << np.uint64(56)) | (mix(draw) & _LOW))
        worst = least.reshape(rows, size)[active].max(axis=1)
        going = worst >= (np.uint64(rank + 1) << np.uint64(56))
        if not going.all():
            active = active[going]
            still = np.zeros(rows, bool)
            still[active] = True
            stay = still[row]
            row, h = row[stay], h[stay]
            order = order[stay] if order is not None else None
        if not len(h):
            break
    return least.reshape(rows, size)


def bands_for(num: int, den: int, size: int = SIZE, loss: float = 1e-6) -> int:
    """The most rows a band can have so that a pair at the threshold misses all bands with a chance of at most `loss`."""
    t = num / den
    return max(r for r in range(1, size + 1) if (1 - t**r) ** (size // r) <= loss)


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and hashes of all shingles, set sizes, and two independent hashes of each whole set."""
    w = words(texts, lower=True)
    row, h = shingles(w, size)
    n = np.bincount(row, minlength=w.rows)
    whole = np.zeros((2, w.rows), np.uint64)
    for k, seed in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        np.add.at(whole[k], row, mix(h ^ np.uint64(seed)))
    node, proof = mix(whole + n.astype(np.uint64))
    return row, h, n, node, proof


def _fingerprints(shingle: int, rows_per_band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            row, h, n, node, proof = _sets(b.column("text"), shingle)
            s = signatures(row, h, b.num_rows)
            count = SIZE // rows_per_band
            keys = np.zeros((b.num_rows, count), np.uint64)
            for k in range(rows_per_band):
                keys = mix(keys * np.uint64(3) + s[:, k : count * rows_per_band : rows_per_band])
            keys = mix(keys + np.arange(count, dtype=np.uint64) * np.uint64(_STEP))
            empty = n == 0
            short = (mix(s) >> np.uint64(48)).astype("<u2")
            offsets = pa.array(np.arange(0, b.num_rows * count + 1, count, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(n.astype(np.int64)),
                    pa.array(node.view(np.int64), mask=empty),
                    pa.array(proof.view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64))),
                    pa.array([x.tobytes() for x in short], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "node", "proof", "bands", "signature"],
            )

    return run


def _set_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, h, n, node, proof = _sets(b.column("text"), shingle)
            edges = np.concatenate([[0], np.cumsum(n)])
            sets = pa.array([h[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(proof.view(np.int64)), sets], names=["node", "proof", "set"])

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            b = batch.slice(at, 256)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("set")]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("node").to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate(sets))], names=["node", "h"])


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set the parity of its elements in PARITY places. Two sets' parities differ in no more places than the sets in elements."""
    for b in batches:
        if b.num_rows:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("set")]
            bits = np.zeros((len(sets), PARITY), np.uint8)
            for i, x in enumerate(sets):
                bits[i] = np.bincount((mix(x) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["node", "parity"])


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                good = []
                for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    good.append(den * common >= num * (len(x) + len(y) - common))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run


def _like(num: int, den: int) -> int:
    """Places two signatures of SIZE must share so that a pair at the threshold is missed with a chance of some 1e-6."""
    t = num / den
    return int(np.floor(SIZE * t - 4.8 * np.sqrt(SIZE * t * (1 - t))))


def _block_pairs(num: int, den: int, least: int):
    """Inside a group (or between its two sides): pairs of different components, near enough in size, signature and parities (these
    bound the elements that only one of both has from below, so they lose no link); each pair in the first band that both share."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, root, n, side, alone = (t[c].to_numpy() for c in ("node", "root", "n_shingles", "side", "alone"))
        s = np.frombuffer(b"".join(t["signature"].to_pylist()), "<u2").reshape(len(t), SIZE)
        parity = np.frombuffer(b"".join(t["parity"].to_pylist()), np.uint64).reshape(len(t), PARITY // 64)
        bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        band = t["band"][0].as_py()
        found = []
        for i in range(len(t)):
            common = np.minimum(n - alone, n[i] - alone[i])
            near = (root != root[i]) & (node > node[i]) & (den * common >= num * (n + n[i] - common))
            if side.any():
                near &= side != side[i]
            at = np.flatnonzero(near)
            at = at[(s[at] == s[i]).sum(axis=1) >= least]
            apart = np.bitwise_count(parity[at] ^ parity[i]).sum(axis=1, dtype=np.int64)
            at = at[(den + num) * apart <= (den - num) * (n[at] + n[i])]
            at = at[(bands[at] == bands[i]).argmax(axis=1) == band]
            found += [(node[i], node[j]) for j in at]
        found = np.array(found, np.int64).reshape(-1, 2)
        return pa.table([found[:, 0], found[:, 1]], names=["a", "b"])

    return run


def _alike(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, SIZE) for c in ("s_a", "s_b"))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return run


PAIR = "a bigint, b bigint"


def _as(table: DataFrame, side: str, *columns: str) -> DataFrame:
    """Columns of a table of nodes under names of one side of a pair."""
    return table.select(F.col("node").alias(side), *(F.col(c).alias(f"{c[0]}_{side}") for c in columns))


def _met(pairs: DataFrame, left: DataFrame, right: DataFrame, once: bool = False) -> DataFrame:
    """Pairs with columns of both nodes. A node may be `a` of any share of the pairs, and `b` too, but for once: then it is `b` of one pair."""
    total = pairs.count()

    def met(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
        sizes = stored(pairs.groupBy(key).agg(F.count("*").alias("_n")), "sizes")
        return attach(rows, other.join(sizes, key), key, "_n", total, "inner", sizes).drop("_n")

    return met(pairs.join(right, "b") if once else met(pairs, right, "b"), left, "a")


def _told_apart(rows: DataFrame, clashes: list[int]) -> DataFrame:
    """Nodes of more than one set, as their second hashes tell, become one node for each of them."""
    return rows.withColumn("node", F.when(F.col("node").isin(clashes), F.xxhash64("node", "proof")).otherwise(F.col("node"))) if clashes else rows


def near_components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Links: den * intersection >= num * union."""
    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    per_band = bands_for(num, den)
    prints = stored(own.mapInArrow(_fingerprints(shingle, per_band), "doc_id bigint, n_shingles bigint, node bigint, proof bigint, bands array<bigint>, signature binary"), "fingerprints")

    def nodes_of(prints: DataFrame) -> DataFrame:
        firsts = (F.first(c).alias(c) for c in ("n_shingles", "bands", "signature"))
        named = prints.filter("node is not null and doc_id is not null")
        return stored(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *firsts, F.min("proof").alias("_low"), F.max("proof").alias("_high")), "nodes")

    nodes = nodes_of(prints)
    # sets are one node if their 128 bits agree; sets that share the first 64 alone are a few in 10^10
    clashes = [r[0] for r in nodes.filter("_low != _high").select("node").collect()]
    if clashes:
        dropped(nodes)
        prints = _told_apart(prints, clashes)
        nodes = nodes_of(prints)
    nodes = nodes.drop("_low", "_high")
    least = _like(num, den)
    placed, traits = _shared_buckets(nodes, SIZE // per_band)
    sets = _sets_of(own, traits, shingle, clashes)

    def likely(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        near = _met(pairs, _as(traits, "a", "n_shingles", "signature"), _as(traits, "b", "n_shingles", "signature"), once=True)
        near = near.filter(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)").select("a", "b", "s_a", "s_b")
        return stored(near.mapInArrow(_alike(least), PAIR), "likely")

    def confirmed(pairs: DataFrame, once: bool = False) -> DataFrame:
        rows = _met(pairs, sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), once)
        return stored(rows.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(num, den), PAIR), "confirmed")

    roots = None
    for turn in range(2):
        found = confirmed(likely(_centre_pairs(placed, turn)), once=True)
        roots = stored(components(found if roots is None else found.union(roots.select("root", "node"))), "roots")
        before, placed = placed, _unsettled(placed, roots)
        dropped(before)
    close = stored(_apart_pairs(placed, traits, sets, num, den, least, block), "close")
    if not close.isEmpty():
        roots = stored(components(confirmed(close).union(roots.select("root", "node"))), "roots")
    linked = roots.join(nodes.select("node", "doc_id"), "node")
    lowest = stored(linked.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_n")), "lowest")
    answer = stored(attach(linked, lowest, "root", "_n", roots.count(), "inner").select(F.col("node").alias("_node"), "component_id"), "answer")
    whole = nodes.select(F.col("node").alias("_node"), "doc_id").join(answer, "_node", "left").select("_node", F.coalesce("component_id", "doc_id").alias("component_id"))
    return _answered(prints, whole)


def _shared_buckets(nodes: DataFrame, bands: int) -> tuple[DataFrame, DataFrame]:
    """Rows (bucket, _n, band, node, root) of the buckets with two nodes or more, and these nodes with their traits; both stored."""
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = stored(buckets.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1"), "buckets")
    placed = stored(attach(buckets, sizes, "bucket", "_n", nodes.count() * bands, "inner").withColumn("root", F.col("node")), "placed")
    traits = stored(nodes.join(placed.select("node").distinct(), "node", "left_semi"), "traits")
    return placed, traits


def _sets_of(own: DataFrame, members: DataFrame, shingle: int, clashes: list[int]) -> DataFrame:
    """Full sets of some nodes, made again from one document's text each."""
    wanted = members.select("node", F.col("doc_id").alias("_d"))
    texts = own.join(wanted.select("_d").distinct().hint("shuffle_hash"), own["doc_id"] == F.col("_d"), "left_semi").select("text")
    made = _told_apart(texts.mapInArrow(_set_rows(shingle), "node bigint, proof bigint, set binary"), clashes).drop("proof")
    return stored(made.join(wanted.select("node").hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"]), "sets")


def _centre_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """Each node with the centre, of another component, that it meets in most buckets; other centres in each turn."""
    first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), F.col("node").alias("a"), F.col("root").alias("_root"))).alias("c")
    centres = stored(placed.groupBy("bucket").agg(first, F.count("*").alias("_n")).select("bucket", "c.a", "c._root", "_n"), "centres")
    met = attach(placed.drop("_n"), centres, "bucket", "_n", placed.count(), "inner").filter("root != _root").groupBy("node", "a").agg(F.count("*").alias("_k"))
    return met.groupBy("node").agg(F.max(F.struct("_k", "a")).alias("m")).select("m.a", F.col("node").alias("b"))


def _unsettled(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the buckets that hold members of two components or more, with the roots that the links give."""
    now = stored(placed.drop("root", "_n").join(roots.hint("shuffle_hash"), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    mixed = now.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low != _high").select("bucket", "_n")
    mixed = stored(mixed, "mixed")
    out = stored(attach(now, mixed, "bucket", "_n", now.count(), "inner"), "placed")
    dropped(now)
    return out


def _apart_pairs(placed: DataFrame, traits: DataFrame, sets: DataFrame, num: int, den: int, least: int, block: int) -> DataFrame:
    """Pairs of the buckets that are still apart, by size, signature, parities and shingles that a node has alone among all their nodes."""
    own = sets.join(placed.select("node").distinct(), "node", "left_semi")
    alone = own.mapInArrow(_elements, "node bigint, h bigint").groupBy("h").agg(F.min("node").alias("node"), F.count("*").alias("_n")).filter("_n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    known = stored(traits.drop("doc_id").join(own.mapInArrow(_parities, "node bigint, parity binary"), "node").join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0))), "known")
    # a node needs a partner of at least the bucket's least size, and shares with it at most what it hasn't alone
    sized = stored(placed.drop("_n").join(known.select("node", "n_shingles", "alone"), "node"), "sized")
    low = stored(sized.groupBy("bucket").agg(F.min("n_shingles").alias("_low"), F.count("*").alias("_n")), "low")
    can = stored(attach(sized, low, "bucket", "_n", sized.count(), "inner").filter(f"{den + num} * (n_shingles - alone) >= {num} * (n_shingles + _low)").select("bucket", "band", "node", "root"), "can")
    return _dealt(_by_minor(can), block).join(known, "node").groupBy("bucket", "kind", "p", "q").applyInArrow(_block_pairs(num, den, least), PAIR)


def _by_minor(rows: DataFrame) -> DataFrame:
    """Rows with the number of nodes in their bucket's largest component (_major), of the others (_minor), and whether a row is one of these
    (minor). Buckets of one component are left out."""
    of = rows.groupBy("bucket", "root").agg(F.count("*").alias("_k")).groupBy("bucket").agg(F.max(F.struct("_k", "root")).alias("top"), F.sum("_k").alias("_n"))
    sizes = of.filter("_n > top._k").select("bucket", "_n", F.col("top._k").alias("_major"), F.col("top.root").alias("_top"), (F.col("_n") - F.col("top._k")).alias("_minor"))
    sizes = stored(sizes, "sizes")
    met = attach(rows, sizes, "bucket", "_n", rows.count(), "inner")
    return stored(met.withColumn("minor", F.col("root") != F.col("_top")).drop("_n", "_top"), "by-minor")


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows in groups (bucket, kind, p, q): kind 0 holds part p of the minor nodes beside part q of the major ones, kind 1 two parts of the
    minor nodes. side tells both sides of a group apart; in a group of one part all are 0."""
    parts = {x: F.greatest(F.ceil(F.col(f"_{x}") / block), F.lit(1)).cast("int") for x in ("minor", "major")}
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), parts["minor"]).otherwise(parts["major"])).cast("int")
    all_of = lambda x: F.sequence(F.lit(0), parts[x] - 1)
    place = lambda kind, p, q, side: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), side.alias("side"))
    side = lambda o: F.when(mine < o, 1).when(mine > o, 2).otherwise(0)
    beside = F.transform(all_of("major"), lambda o: place(0, mine, o, F.lit(2)))
    among = F.transform(all_of("minor"), lambda o: place(1, F.least(mine, o), F.greatest(mine, o), side(o)))
    major = F.transform(all_of("minor"), lambda o: place(0, o, mine, F.lit(1)))
    return rows.select("bucket", "band", "node", "root", F.explode(F.when(F.col("minor"), F.concat(beside, among)).otherwise(major)).alias("at")).select("bucket", "band", "node", "root", "at.*")


def _answered(prints: DataFrame, answer: DataFrame) -> DataFrame:
    """Every document with its node's component. Documents of one node are many where copies are, so they are joined in parts."""
    rows = prints.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("_node"))
    sizes = stored(rows.filter("_node is not null").groupBy("_node").agg(F.count("*").alias("_size")), "sizes")
    found = attach(rows, answer.join(sizes, "_node"), "_node", "_size", prints.count(), sizes=sizes)
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each component, with all their columns."""
    place, other = unused(docs, "_place"), unused(docs, "_place_kept")
    at = lambda c: F.coalesce(c.cast("bigint").cast("string"), F.lit("none"))
    kept = near_components(docs, shingle, num, den, id_col, text_col).filter("kept").select(at(F.col("doc_id")).alias(other)).distinct()
    return docs.withColumn(place, at(F.col(f"`{id_col}`"))).join(kept.hint("shuffle_hash"), F.col(place) == F.col(other), "left_semi").drop(place)
