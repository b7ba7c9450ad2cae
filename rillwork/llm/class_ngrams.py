"""Brown class-based bigram model of words.

Every word of the training texts has a class of its own choice, the one by which the texts are likeliest. The HEAD most frequent words
are exchanged in two steps. First the SEEDS most frequent ones move one after another, by their table of bigrams, until none moves. Then
all head words move in rounds over the texts: a Spark job counts the classes beside each word, each word finds its best class, and half
of them (by hash) move at a time; rounds end when no word moves or the likelihood gains less than LEAST_GAIN of itself. A word outside
the head, of which there may be any number, counts as one rare word for its neighbours, and takes the class with the largest likelihood
by the classes before its own occurrences. The number of classes grows with the vocabulary.

A text's probability is the product of class transitions P(c | class of the word before), smoothed towards P(c), and of word emissions
P(w | c) with one more count for every word of the class and for one unknown word. A word that training doesn't have may be of any class.

Scoring looks frequent words up in a broadcast of at most KNOWN words; counts and classes of all others come through a join.

Defined cases: a null or empty text is one end token; a null identifier counts as the empty text for the held-out rule; repeated rows
and ties each give their row; an empty table gives an empty result; without training texts every word is unknown; other columns don't
matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import dropped, slices, stored
from rillwork.llm.words import Words, mix, words

#: Words that the driver exchanges by their bigrams; words with a class of their own beside others; words whose counts are broadcast.
SEEDS, HEAD, KNOWN = 1000, 16_384, 200_000
#: Tokens that the smoothing of transitions weighs as much as.
PRIOR = 50.0
#: Share of the log-likelihood that a round must gain for another one.
LEAST_GAIN = 1e-3
#: Stands for the end of a text among words' hashes.
END_WORD = 0x5F6E_6400_656E_6421
_TOKENS = 4_000_000  # that a task folds at a time


def held_out(column: str, modulus: int = 7, remainder: int = 2):
    """Whether crc32 of the identifier as text leaves the remainder."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def classes_for(types: int) -> int:
    """Classes for a vocabulary: some twice its fourth root."""
    return int(min(1024, max(16, 2 * types**0.25)))


def _folded(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """Words beside classes, each once, with the sum of their counts."""
    h, g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, first, inverse = np.unique(mix(h + g.astype(np.uint64)), return_index=True, return_inverse=True)
    return [(h[first], g[first], np.bincount(inverse, weights=n).astype(np.int64))]


def _counting(pairs):
    """Folds what pairs(Words) gives, hashes and numbers of classes, whenever some millions are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts):
            h, g, n = _folded(parts)[0]
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(g[i : i + 100_000].astype(np.int32)), pa.array(n[i : i + 100_000])], names=["word", "g", "n"])

        parts, held = [], 0
        for b in slices(batches, "text"):
            h, g = pairs(words(b.column("text"), lower=True))
            parts += _folded([(h, g, np.ones(len(h), np.int64))])
            held += len(parts[-1][0])
            if held > 3_000_000:
                parts = _folded(parts)
                held = len(parts[0][0])
                if held > 2_000_000:
                    yield from out(parts)
                    parts, held = [], 0
        if parts:
            yield from out(parts)

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n of all texts of docs."""
    pairs = lambda w: (w.hash, np.zeros(len(w.hash), np.int64))
    return docs.select("text").mapInArrow(_counting(pairs), "word bigint, g int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """The `most` most frequent words; of ties, some by hash. Only these and some figures for each doubling reach the driver."""

    def least(rows: DataFrame, key, room: int) -> tuple[int | None, int, int]:
        """The least value of key down to which rows fit the room, the value below it, and the room that is left."""
        levels = rows.groupBy(key.alias("s")).count().toPandas().sort_values("s", ascending=False)
        whole = levels["count"].cumsum() <= room
        fit, rest = levels[whole], levels[~whole]
        return (int(fit["s"].min()) if len(fit) else None), (int(rest["s"].max()) if len(rest) else None), room - int(fit["count"].sum())

    step = F.floor(F.log2("n") * 8).cast("int")  # some 8 steps a doubling
    low, split, room = least(counts, step, most)
    found = [counts.filter(step >= low)] if low is not None else []
    if split is not None and room:
        level = counts.filter(step == split)
        low, split, room = least(level, F.col("n"), room)  # as many values as the level is wide
        found += [level.filter(F.col("n") >= low)] if low is not None else []
        if split is not None and room:
            ties = level.filter(F.col("n") == split)
            share = room / ties.count()
            cut = int((2 * share - 1) * (1 << 63)) if share < 1 else (1 << 63) - 1
            found.append(ties.filter(F.xxhash64("word") < cut).limit(room))
    if not found:
        return pd.DataFrame({"word": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    return pd.concat([x.toPandas() for x in found]).sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


@dataclass
class Lookup:
    """Values of words, by their sorted hashes; words that it doesn't have give `other`."""

    hashes: np.ndarray
    values: np.ndarray
    other: int

    @staticmethod
    def of(hashes: np.ndarray, values: np.ndarray, other: int) -> Lookup:
        order = np.argsort(hashes)
        return Lookup(hashes[order], values[order], other)

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), self.other, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.values[at], self.other)


def _sequence(w: Words, values: np.ndarray, end: int) -> np.ndarray:
    """Values of each text's words, with an end after each text."""
    out = np.full(len(values) + w.rows, end, values.dtype)
    out[np.arange(len(values)) + w.row] = values
    return out


def _before(s: np.ndarray, end: int) -> np.ndarray:
    """What stands before each place of a sequence; before the first, an end."""
    return np.concatenate([np.array([end], s.dtype), s[:-1]])


def _cells(cells_of, size: int):
    """Counts of the cells that cells_of(Words) gives, below size, folded by the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(size, np.int64), [], 0
        for b in slices(batches, "text"):
            held.append(cells_of(words(b.column("text"), lower=True)))
            n += len(held[-1])
            if n > _TOKENS:
                total += np.bincount(np.concatenate(held), minlength=size)
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        cell = np.flatnonzero(total)
        for i in range(0, len(cell), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + 100_000]), pa.array(total[cell[i : i + 100_000]])], names=["cell", "n"])

    return run


def _counted(docs: DataFrame, cells_of, size: int) -> DataFrame:
    return docs.select("text").mapInArrow(_cells(cells_of, size), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def item_bigrams(docs: DataFrame, seeds: Lookup, items: int) -> np.ndarray:
    """The table of bigrams of items: seeds, the rare words, the end."""

    def cells_of(w: Words) -> np.ndarray:
        s = _sequence(w, seeds.find(w.hash), items - 1)
        return _before(s, items - 1) * items + s

    found = _counted(docs, cells_of, items * items).toPandas()
    table = np.zeros(items * items, np.int64)
    table[found["cell"]] = found["n"]
    return table.reshape(items, items)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _gains(big: np.ndarray, r: np.ndarray, l: np.ndarray, own: float, rows: np.ndarray, columns: np.ndarray, flat: np.ndarray) -> np.ndarray:  # noqa: E741
    """What the log-likelihood gains by an item without a class joining each class. big: class bigrams; r, l: classes after and before the
    item; own: its bigrams with itself; rows, columns: sums of big; flat: x log x of big."""
    out, in_ = r.sum() + own, l.sum() + own
    gain = (_xlogx(big + r) - flat).sum(axis=1) + (_xlogx(big.T + l) - flat.T).sum(axis=1)
    d, here = np.diag(big), np.diag(flat)
    gain += _xlogx(d + r + l + own) - here - (_xlogx(d + r) - here) - (_xlogx(d + l) - here)
    for n_class, more in ((rows + l, out), (columns + r, in_)):  # without the item, with its neighbours
        gain -= _xlogx(n_class + more) - _xlogx(n_class)
    return gain


def exchange(table: np.ndarray, classes: int, fixed: int = 1) -> np.ndarray:
    """Class of each item; the last `fixed` items have the last classes, alone. Each sweep moves every item to the class that gives
    the training text the largest likelihood, until no item moves."""
    n, k = len(table), classes - fixed
    order = np.argsort(-table.sum(axis=1)[: n - fixed], kind="stable")
    cls = np.concatenate([np.zeros(n - fixed, np.int64), np.arange(k, classes)])
    cls[order] = np.arange(n - fixed) % k
    hot = np.eye(classes)[cls]
    t = table.astype(float)
    big = hot.T @ t @ hot
    left, right = t.T @ hot, t @ hot  # by item: counts of classes before and after it
    moved = 1
    while moved:
        moved = 0
        for i in order:
            own = t[i, i]
            a, r, l = cls[i], right[i].copy(), left[i].copy()  # noqa: E741
            r[a] -= own
            l[a] -= own
            if r.sum() + l.sum() + own == 0:
                continue
            big[a] -= r
            big[:, a] -= l
            big[a, a] -= own
            gain = _gains(big, r, l, own, big.sum(axis=1), big.sum(axis=0), _xlogx(big))[:k]
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9 * (1 + abs(gain[a])):
                b = a
            big[b] += r
            big[:, b] += l
            big[b, b] += own
            if b != a:
                moved += 1
                cls[i] = b
                left[:, a] -= t[i]
                left[:, b] += t[i]
                right[:, a] -= t[:, i]
                right[:, b] += t[:, i]
    return cls


@dataclass
class Head:
    """The head words by falling frequency, and the class of each; classes k and k+1 are the end's and the rare words'."""

    hashes: np.ndarray
    cls: np.ndarray
    k: int

    def places(self) -> Lookup:
        return Lookup.of(self.hashes, np.arange(len(self.hashes)), len(self.hashes))

    def history(self) -> Lookup:
        return Lookup.of(self.hashes, self.cls, self.k + 1)


def _contexts(train: DataFrame, head: Head) -> DataFrame:
    """cell, n: how often each head word (also the rare words and the end, as one each) has which class before it, and after it."""
    places, n, width = head.places(), len(head.hashes), head.k + 2
    cls = np.concatenate([head.cls, [head.k + 1, head.k]])

    def cells_of(w: Words) -> np.ndarray:
        s = _sequence(w, places.find(w.hash), n + 1)
        before = _before(s, n + 1)
        return np.concatenate([s * (2 * width) + cls[before], before * (2 * width) + width + cls[s]])

    return _counted(train, cells_of, (n + 2) * 2 * width)


def _class_table(contexts: DataFrame, head: Head) -> np.ndarray:
    """Class bigrams: for each item what stands before it, summed by the item's class; at most classes x classes rows reach the driver."""
    width, spark = head.k + 2, contexts.sparkSession
    cls = np.concatenate([head.cls, [head.k + 1, head.k]])
    of = spark.createDataFrame(pd.DataFrame({"item": np.arange(len(cls)), "c": cls}))
    own = contexts.select(F.expr(f"cell div {2 * width}").alias("item"), (F.col("cell") % (2 * width)).alias("g"), "n").filter(F.col("g") < width)
    found = own.join(F.broadcast(of), "item").groupBy("g", "c").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((width, width))
    table[found["g"], found["c"]] = found["n"]
    return table


def _moves(contexts: DataFrame, head: Head, table: np.ndarray, movable: np.ndarray) -> pd.DataFrame:
    """Best class of each movable head word that isn't in it, given all others'; found in tasks, a row a word that moves."""
    width, k, cls = head.k + 2, head.k, head.cls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(_chained(batches), [None]):
            rows = held
            if batch is not None and held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held, batch, strict=True)]
            elif batch is not None:
                rows = batch
            if rows is None or not len(rows[0]):
                continue
            item = rows[0] // (2 * width)
            done = len(item) if batch is None else int(np.searchsorted(item, item[-1]))  # the last item goes on into the next batch
            held = [x[done:] for x in rows]
            found = []
            for a, z in _runs(item[:done]):
                i = int(item[a])
                if i >= len(cls) or not movable[i]:
                    continue
                v = np.zeros(2 * width)
                v[rows[0][a:z] % (2 * width)] = rows[1][a:z]
                l, r = v[:width].copy(), v[width:].copy()  # noqa: E741
                big, c = table, cls[i]
                if c <= k:  # without the item itself
                    big = table.copy()
                    big[c] = np.maximum(big[c] - r, 0)
                    big[:, c] = np.maximum(big[:, c] - l, 0)
                gain = _gains(big, r, l, 0.0, big.sum(axis=1), big.sum(axis=0), _xlogx(big))[:k]
                b = int(np.argmax(gain))
                if c > k or gain[b] > gain[c] + 1e-9 * (1 + abs(gain[c])):
                    found.append((i, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int32())], names=["item", "c"])

    parted = contexts.withColumn("item", F.expr(f"cell div {2 * width}")).repartition("item").sortWithinPartitions("cell").select("cell", "n")
    return parted.mapInArrow(run, "item bigint, c int").toPandas()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield [c.to_numpy() for c in b.columns]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.zeros(0, np.int64)
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of class bigrams, but for what doesn't change with the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def exchanged_head(train: DataFrame, top: pd.DataFrame, classes: int) -> tuple[Head, np.ndarray]:
    """The head words with their classes, and the last table of class bigrams."""
    hashes = top["word"].to_numpy().view(np.uint64)
    seeds = min(SEEDS, len(hashes))
    by_bigrams = exchange(item_bigrams(train, Lookup.of(hashes[:seeds], np.arange(seeds), seeds), seeds + 2), classes + 2, fixed=2)
    # there the rare words have class k and the end k + 1; here the other way round
    cls = np.concatenate([by_bigrams[:seeds], np.full(len(hashes) - seeds, classes + 1)])
    head, before, parity = Head(hashes, cls, classes), -math.inf, (mix(hashes) & np.uint64(1)).astype(bool)
    turn, still, last = 0, 0, (head, None)
    while True:
        contexts = stored(_contexts(train, head), "contexts")
        table = _class_table(contexts, head)
        now = likelihood(table)
        if turn > 1 and now - before < LEAST_GAIN * abs(now):
            dropped(contexts)
            return (head, table) if now > before else last
        movable = (head.cls > classes) if turn == 0 else (parity == bool(turn % 2))
        moves = _moves(contexts, head, table, movable)
        dropped(contexts)
        still = 0 if len(moves) else still + 1
        if still == 2:
            return head, table
        last = head, table
        if len(moves):
            cls = head.cls.copy()
            cls[moves["item"]] = moves["c"]
            head = Head(hashes, cls, classes)
        before, turn = now if turn else -math.inf, turn + 1


def _step(table: np.ndarray, classes: int) -> np.ndarray:
    """P(c | class before) of a table of class bigrams, smoothed towards P(c)."""
    n = table[:, : classes + 1]
    share = (n.sum(axis=0) + 1) / (n.sum() + classes + 1)
    return (n + PRIOR * share) / (n.sum(axis=1, keepdims=True) + PRIOR)


def classed_words(train: DataFrame, head: Head, table: np.ndarray) -> DataFrame:
    """One row per word of the texts, and one for the end: word, n, c (its class), and the classes before it: g and their counts n_g."""
    k, history = head.k, head.history()
    known = Lookup.of(np.append(head.hashes, np.uint64(END_WORD)), np.append(head.cls, k), -1)
    with np.errstate(divide="ignore"):
        weight = np.log(_step(table, k))[:, :k]
    size = np.log(np.maximum(table.sum(axis=0)[:k], 1))

    def pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
        return _sequence(w, w.hash, END_WORD), _before(_sequence(w, history.find(w.hash), k), k)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(_pieces(batches), [None]):
            rows = held if batch is None else batch if held is None else [np.concatenate([x, y]) for x, y in zip(held, batch, strict=True)]
            if rows is None or not len(rows[0]):
                continue
            word, g, n = rows
            done = len(word) if batch is None else int(np.searchsorted(word, word[-1]))
            held = [x[done:] for x in rows]
            if not done:
                continue
            word, g, n = word[:done], g[:done], n[:done]
            at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            total = np.add.reduceat(n, at)
            best = np.add.reduceat(weight[g] * n[:, None], at) - total[:, None] * size
            c = known.find(word[at].view(np.uint64))
            c = np.where(c < 0, best.argmax(axis=1), c)
            edges = pa.array(np.append(at, done).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[at]), pa.array(total), pa.array(c.astype(np.int32)), pa.ListArray.from_arrays(edges, pa.array(g)), pa.ListArray.from_arrays(edges, pa.array(n))],
                names=["word", "n", "c", "g", "n_g"],
            )

    counts = train.select("text").mapInArrow(_counting(pairs), "word bigint, g int, n bigint").repartition("word").groupBy("word", "g").agg(F.sum("n").alias("n"))
    return counts.sortWithinPartitions("word").mapInArrow(choose, "word bigint, n bigint, c int, g array<int>, n_g array<bigint>")


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[list[np.ndarray]]:
    """Columns of batches in parts that a matrix of rows by classes may be made for."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield [c.to_numpy() for c in b.slice(i, rows).columns]


@dataclass
class Model:
    k: int
    history: Lookup  # class that a word is beside others
    step: np.ndarray  # log10 P(c | class before)
    size: np.ndarray  # log10 of the weight of a class: its tokens, its words and one
    unknown: np.ndarray  # log10 of an unknown word's probability after a class
    known: Lookup
    known_n: np.ndarray
    known_c: np.ndarray
    tokens: int
    types: int
    ends: int


def fit(train: DataFrame, classes: int | None = None) -> tuple[Model, DataFrame]:
    """The model of training texts (text), and its stored words: word, n, c."""
    counts = stored(word_counts(train), "counts")
    classes = classes or classes_for(counts.count())
    head, table = exchanged_head(train, most_frequent(counts, HEAD), classes)
    dropped(counts)
    found = stored(classed_words(train, head, table), "words")
    steps = np.zeros((classes + 2, classes + 1))
    pairs = found.select("c", F.explode(F.arrays_zip("g", "n_g")).alias("p")).groupBy("c", F.col("p.g").alias("g")).agg(F.sum("p.n_g").alias("n")).toPandas()
    steps[pairs["g"], pairs["c"]] = pairs["n"]
    sums = found.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    n, v = np.zeros(classes + 1), np.zeros(classes + 1)
    n[sums["c"]], v[sums["c"]] = sums["n"], sums["v"]
    ends = int(n[classes])
    own = found.filter(F.col("word") != END_WORD).select("word", "n", "c")
    step, weight = _step(steps, classes), n[:classes] + v[:classes] + 1
    top = most_frequent(own, KNOWN)
    hashes = top["word"].to_numpy().view(np.uint64)
    known = Lookup.of(hashes, np.arange(len(hashes)), -1)
    unknown = np.log10((step[:, :classes] / weight).sum(axis=1))
    return (
        Model(classes, head.history(), np.log10(step), np.append(np.log10(weight), 0.0), unknown, known, top["n"].to_numpy(), top["c"].to_numpy() if len(top) else np.zeros(0, np.int64), int(n.sum()), int(v.sum()), ends),
        own,
    )


FIRST = "row_id bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, words_log10 double, classes_log10 double, tail array<bigint>, tail_g array<int>"


def _first_scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m: Model = shared.value
        row_id = TaskContext.get().partitionId() << 40
        for b in slices(batches, "text"):
            w = words(b.column("text"), lower=True)
            n = w.counts()
            at = m.known.find(w.hash)
            before = _before(_sequence(w, m.history.find(w.hash), m.k), m.k)
            spot = np.arange(len(w.hash)) + w.row  # places of the words among the tokens
            has = at >= 0
            c, seen = m.known_c[at[has]], m.known_n[at[has]]
            logs = np.log10(seen + 1.0)
            term = m.step[before[spot[has]], c] - m.size[c] + logs
            ends = m.step[before[np.cumsum(n + 1) - 1], m.k]
            edges = pa.array(np.concatenate([[0], np.cumsum(np.bincount(w.row[~has], minlength=w.rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row_id + np.arange(w.rows)),
                    b.column("doc_id"),
                    b.column("held_out"),
                    pa.array(n + 1),
                    pa.array(np.bincount(w.row[has], minlength=w.rows) + int(m.ends > 0)),
                    pa.array(np.bincount(w.row[has], weights=logs, minlength=w.rows).astype(float)),
                    pa.array(np.bincount(w.row[has], weights=term, minlength=w.rows) + ends),
                    pa.ListArray.from_arrays(edges, pa.array(w.hash[~has].view(np.int64))),
                    pa.ListArray.from_arrays(edges, pa.array(before[spot[~has]].astype(np.int32))),
                ],
                names=["row_id", "doc_id", "held_out", "n_tokens", "n_known", "words_log10", "classes_log10", "tail", "tail_g"],
            )
            row_id += w.rows

    return run


def class_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("held_out", held_out("doc_id"))
    m, known = fit(own.filter(~F.col("held_out")), classes)
    spark = docs.sparkSession
    first = stored(own.mapInArrow(_first_scores(spark.sparkContext.broadcast(m)), FIRST), "scores")
    g, c = np.indices((m.k + 2, m.k)).reshape(2, -1)
    steps = spark.createDataFrame(pd.DataFrame({"g": g, "c": c, "step": m.step[g, c] - m.size[c]}), "g int, c int, step double")
    unknown = spark.createDataFrame(pd.DataFrame({"g": np.arange(m.k + 2), "unknown": m.unknown}), "g int, unknown double")
    rare = first.select("row_id", F.explode(F.arrays_zip("tail", "tail_g")).alias("t")).select("row_id", F.col("t.tail").alias("word"), F.col("t.tail_g").alias("g"))
    met = rare.join(known, "word", "left").join(F.broadcast(steps), ["g", "c"], "left").join(F.broadcast(unknown), "g")
    logs = F.log10(F.col("n") + 1)
    tail = met.select(
        "row_id", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("bigint").alias("n_tokens"), F.col("n").isNotNull().cast("bigint").alias("n_known"),
        F.coalesce(logs, F.lit(0.0)).alias("words_log10"), F.coalesce(F.col("step") + logs, "unknown").alias("classes_log10")
    )
    summed = first.drop("tail", "tail_g").union(tail).groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "words_log10", "classes_log10"))
    )
    whole, end = F.lit(math.log10(m.tokens + m.types + 1)), F.lit(math.log10(m.ends + 1))
    score = F.col("classes_log10")
    return summed.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(m.tokens).cast("bigint").alias("train_tokens"),
        (F.col("words_log10") + end - F.col("n_tokens") * whole).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
