"""Distinct segmentations of texts into vocabulary pieces: Gumbel top-k without replacement by perturbed A* over the lattice.

The lattice of a text has an edge for every vocabulary piece; a segmentation's probability is in proportion to the product of its
pieces' probabilities to the power alpha. The vocabulary file has merge ranks for scores, so a piece's probability is Zipf's,
1 / (rank + 2.7). Pieces never go on across a word mark, so the lattice is a chain of word lattices, and the search tree branches
word by word: a node is a prefix plus segmentations of the next word that are shut out. Every node holds the exact total chance of
its completions, perturbed by a Gumbel variate truncated at its parent's; the queue gives the largest node, whose completion is drawn
from the posterior (backward sums over the word's lattice) and leaves its untaken sides as new nodes. So the first k results are k
distinct segmentations drawn without replacement. log_inclusion is log(1 - exp(-exp(log_prob - threshold))), the threshold being the
next perturbed value. All draws are hashes of the seed, the row key, the sample and the word.

As in SentencePiece a text gets a leading word mark, spaces become marks and characters that no piece covers fall to byte pieces. A
mark in the text itself goes to byte pieces too, so decoding is exact.

Defined cases: a null or empty text has one segmentation, the empty one, with log_prob and log_inclusion 0; a text with fewer than k
segmentations gives all of them, however small their chances are in double precision; a null doc_id is keyed by the text; repeated rows get equal samples; an empty table gives an empty result; other columns don't matter. A task holds about `limit`
bytes of texts at a time, or one longer text.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import slices
from rillwork.llm.words import _BACK, _BASE, _powers, mix

MARK, OWN_MARK = 0x2581, 0x110000  # the second stands for a mark in the text itself
SAMPLES = "doc_id bigint, sample int, n_pieces bigint, log_prob double, perturbed double, log_inclusion double, ids binary"
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Hashes, log probabilities and bytes of a vocabulary's pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.first_byte = model.piece_to_id("<0x00>")
        ids, hashes, beginnings, self.longest = [], [], [], 1
        for i in range(n):
            if model.is_byte(i):
                self.bytes[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                s = model.id_to_piece(i)
                assert "▁" not in s.lstrip("▁"), "a piece goes on across a word mark"
                self.bytes[i] = s.replace("▁", " ").encode()
                cp = code_points(s)
                ids.append(i)
                h = mix(_hashes(cp)[1:] + np.arange(1, len(cp) + 1, dtype=np.uint64))
                hashes.append(h[-1])
                beginnings += h[:-1].tolist()
                self.longest = max(self.longest, len(cp))
        self.table = pa.array(self.bytes, pa.large_binary())
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes, self.ids = np.append(np.array(hashes, np.uint64)[order], np.uint64(2**64 - 1)), np.array(ids)[order]
        self.bucket = np.searchsorted(self.hashes, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        rank = self.ids - self.ids.min()
        zipf = -np.log(np.arange(n - self.ids.min()) + 2.7)
        total = np.log(np.exp(zipf).sum())
        self.log_p, self.byte_log_p = zipf[rank] - total, zipf[-1] - total
        self.goes_on = np.zeros(1 << 21, bool)  # by hash: beginnings of longer pieces
        self.goes_on[(np.array(beginnings, np.uint64) >> np.uint64(43)).astype(np.int64)] = True
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of h that are pieces, and which."""
        at = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        h = h[at]
        k = self.bucket[h >> np.uint64(48)]
        wrong = np.flatnonzero(self.hashes[k] != h)
        while len(wrong):
            k[wrong] += 1
            wrong = wrong[self.hashes[k[wrong]] < h[wrong]]
        good = self.hashes[k] == h
        return at[good], k[good]


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """A task reads a vocabulary once."""
    return Pieces(path)


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((mix(h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel(h: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(_uniform(h)))


def _hashes(cp: np.ndarray) -> np.ndarray:
    up = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp + np.uint64(1)) * _powers("up", _BASE, len(cp)), out=up[1:])
    return up


class Lattice:
    """Edges of many word lattices at once. The nodes of word w are its places, with one more at its end."""

    def __init__(self, cp: np.ndarray, starts: np.ndarray, vocabulary: Pieces, alpha: float):
        n, words = len(cp), len(starts) - 1
        word = np.repeat(np.arange(words), np.diff(starts))
        node_end = starts[1:] + np.arange(words)
        left = starts[1:][word] - np.arange(n)
        up, back = _hashes(cp), _powers("back", _BACK, n + 1)
        found, count = [], np.zeros(n + words, np.int64)
        # words of some 64 thousand characters at a time, which fit a processor's cache
        cuts = np.unique(np.searchsorted(starts[:-1], np.arange(0, n, 1 << 16)))
        bounds = np.r_[starts[cuts[cuts < words]], n] if n else np.zeros(1, np.int64)
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            at = np.arange(low, high)
            for size in range(1, vocabulary.longest + 1):
                h = mix((up[at + size] - up[at]) * back[at] + np.uint64(size))
                hit, k = vocabulary.find(h)
                node = at[hit] + word[at[hit]]
                found.append((node, count[node], node + size, vocabulary.ids[k], vocabulary.log_p[k]))
                count[node] += 1
                if size == 1:
                    bare = np.ones(high - low, bool)
                    bare[hit] = False
                    bare = low + np.flatnonzero(bare)
                    node = bare + word[bare]
                    found.append((node, count[node], node + 1, -1 - cp[bare].astype(np.int64), vocabulary.byte_log_p * _utf8_length(cp[bare])))
                    count[node] += 1
                at = at[vocabulary.goes_on[h >> np.uint64(43)] & (left[at] > size)]
                if not len(at):
                    break
        # edges in order of their nodes
        self.first = np.r_[0, np.cumsum(count)]
        edges = int(self.first[-1])
        self.to, self.piece, score = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges)
        for node, before, to, piece, log_p in found:
            e = self.first[node] + before
            self.to[e], self.piece[e], score[e] = to, piece, alpha * log_p
        # backward sums, from the ends of words
        total, best, rest, self.c = np.zeros(n + words), np.zeros(n + words), np.zeros(n + words), np.empty(edges)
        self.best_edge = np.full(n + words, -1)
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            order = low + np.argsort(left[low:high], kind="stable")
            node, depth = order + word[order], left[order]
            size = count[node]
            new = np.r_[0, np.cumsum(size)]
            by_depth = np.repeat(self.first[node] - new[:-1], size) + np.arange(new[-1])
            after, own, owner = self.to[by_depth], score[by_depth], np.repeat(np.arange(len(node)), size)
            lap = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1]])
            for a, z in zip(lap, np.r_[lap[1:], len(node)], strict=True):
                s, t = new[a], new[z]
                e, to, of, at, these = by_depth[s:t], after[s:t], owner[s:t] - a, new[a:z] - s, node[a:z]
                value = own[s:t] + total[to]
                most = np.maximum.reduceat(value, at)
                chance = np.exp(value - most[of])
                sums = np.add.reduceat(chance, at)
                total[these] = most + np.log(sums)
                chance /= sums[of]
                self.c[e] = chance
                value = own[s:t] + best[to]
                most = np.maximum.reduceat(value, at)
                best[these] = most
                top = np.flatnonzero(value == most[of])[::-1]
                self.best_edge[these[of[top]]] = e[top]  # of ties, the first
                # chance of any completion but the best: a sum without differences, so the smallest chances count
                first_best = self.best_edge[these]
                chance[e == first_best[of]] *= rest[self.to[first_best]]
                rest[these] = np.add.reduceat(chance, at)
        self.log_c = score + total[self.to] - np.repeat(total, count)
        self.rest = rest
        self.start, self.end = starts[:-1] + np.arange(words), node_end
        # the best path of each word
        who, cur, edges, owner = np.arange(words), self.start.copy(), [], []
        while len(who):
            e = self.best_edge[cur]
            edges.append(e)
            owner.append(who)
            cur = self.to[e]
            going = cur != self.end[who]
            who, cur = who[going], cur[going]
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        self.best_edges = (np.concatenate(edges) if edges else np.zeros(0, np.int64))[order]
        self.best_size = np.bincount(owner, minlength=words)
        self.best_log = np.add.reduceat(self.log_c[self.best_edges], np.cumsum(self.best_size) - self.best_size) if words else np.zeros(0)

    def others(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word a segmentation that isn't the best one: edges, edges of each, log probabilities."""
        who, cur, free, edges, owner = np.arange(len(words)), self.start[words], np.zeros(len(words), bool), [], []
        for step in range(1 << 40):
            if not len(who):
                break
            u = _uniform(keys[who] + np.uint64(step) * _C[3]) * np.where(free, 1.0, self.rest[cur])
            taken, safe = np.full(len(who), -1), np.full(len(who), -1)
            at, e, sum_ = np.arange(len(who)), self.first[cur], np.zeros(len(who))
            while len(at):
                w = np.where(~free[at] & (e == self.best_edge[cur[at]]), self.c[e] * self.rest[self.to[e]], self.c[e])
                sum_ += w
                safe[at[w > 0]] = e[w > 0]
                stop = sum_ > u[at]
                taken[at[stop]] = e[stop]
                e, on = e + 1, ~stop
                on &= e < self.first[cur[at] + 1]
                at, e, sum_ = at[on], e[on], sum_[on]
            taken = np.where(taken >= 0, taken, safe)  # sums may fall short by rounding
            edges.append(taken)
            owner.append(who)
            free = free | (taken != self.best_edge[cur])
            cur = self.to[taken]
            going = cur != self.end[words[who]]
            who, cur, free = who[going], cur[going], free[going]
        if not edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        owner, edges = np.concatenate(owner), np.concatenate(edges)
        order = np.argsort(owner, kind="stable")
        edges, size = edges[order], np.bincount(owner, minlength=len(words))
        return edges, size, np.add.reduceat(self.log_c[edges], np.cumsum(size) - size)

    def left(self, word: int, shut: list[tuple]) -> list[np.ndarray]:
        """For each of `shut` and each of its places, the chance of all completions there that are not in `shut`; sums without differences."""
        deepest = max(map(len, shut))
        out = [np.zeros(len(x) + 1) for x in shut]
        for d in range(deepest - 1, -1, -1):
            seen: dict[tuple, float] = {}
            for k, x in enumerate(shut):
                if d >= len(x):
                    continue
                if (known := seen.get(x[:d])) is None:
                    node = int(self.start[word]) if d == 0 else int(self.to[x[d - 1]])
                    on = {y[d]: out[j][d + 1] for j, y in enumerate(shut) if d < len(y) and y[:d] == x[:d]}
                    at = int(self.first[node])
                    chances = self.c[at : int(self.first[node + 1])].tolist()
                    for e, rest in on.items():
                        chances[e - at] *= rest
                    known = sum(chances)
                    seen[x[:d]] = known
                out[k][d] = known
        return out

    def outside(self, word: int, shut: list[tuple], key: np.uint64) -> tuple | None:
        """A segmentation of a word that is none of `shut`, all as tuples of edges; None if there is no other."""
        left = self.left(word, shut)
        cur, end, out, live = int(self.start[word]), int(self.end[word]), [], list(range(len(shut)))
        if left[0][0] <= 0:
            return None
        draws = _uniform(key + np.arange(1, end - cur + 1, dtype=np.uint64) * _C[3]).tolist()
        while cur != end:
            a, z = int(self.first[cur]), int(self.first[cur + 1])
            w = self.c[a:z].tolist()
            for e, k in {shut[k][len(out)]: k for k in live}.items():
                w[e - a] *= float(left[k][len(out) + 1])
            w = list(accumulate(w))
            e = a + min(bisect_right(w, draws[len(out)] * w[-1]), bisect_left(w, w[-1]))
            live = [k for k in live if shut[k][len(out)] == e]
            out.append(e)
            cur = int(self.to[e])
        return tuple(out)


def _utf8_length(cp: np.ndarray) -> np.ndarray:
    cp = np.where(cp == OWN_MARK, MARK, cp)
    return 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)


def _ids(piece: np.ndarray, size: np.ndarray, first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of runs of edges' pieces; a negative piece stands for the bytes of a character."""
    if not (piece < 0).any():
        return piece, size
    cp = np.where(piece < 0, -1 - piece, 0)
    cp = np.where(cp == OWN_MARK, MARK, cp)
    n = np.where(piece < 0, _utf8_length(cp), 1)
    own = np.repeat(np.arange(len(piece)), n)
    t = np.arange(len(own)) - (np.cumsum(n) - n)[own]
    c, m = cp[own], n[own]
    byte = np.where(t == 0, np.where(m == 1, c, (c >> (6 * (m - 1))) | ((0xF00 >> m) & 0xFF)), 0x80 | ((c >> (6 * (m - 1 - t))) & 0x3F))
    run = np.repeat(np.arange(len(size)), size)
    return np.where(piece[own] < 0, first_byte + byte, piece[own]), np.bincount(run, weights=n, minlength=len(size)).astype(np.int64)


def _texts_as_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with marks, bounds of words, first word of each text (and the number of words), hashes of words."""
    cp = code_points("".join(texts))
    cp = np.where(cp == MARK, np.uint64(OWN_MARK), np.where(cp == 32, np.uint64(MARK), cp))
    size = np.array([len(t) for t in texts], np.int64)
    heads = (np.cumsum(size) - size)[size > 0]
    cp = np.insert(cp, heads, np.uint64(MARK))
    size = size + (size > 0)
    bounds = np.r_[0, np.cumsum(size)]
    first = np.zeros(len(cp), bool)
    first[bounds[:-1][size > 0]] = True
    mark = cp == MARK
    first[1:] |= mark[1:] & ~mark[:-1]
    starts = np.flatnonzero(first)
    firsts = np.searchsorted(starts, bounds)
    starts = np.append(starts, len(cp))
    up, back = _hashes(cp), _powers("back", _BACK, len(cp) + 1)
    h = mix((up[starts[1:]] - up[starts[:-1]]) * back[starts[:-1]] + np.diff(starts).astype(np.uint64))
    return cp.astype(np.uint32), starts, firsts, h


class Pool:
    """Segmentations of words: the best one of each kind of word, then those that a batch has drawn."""

    def __init__(self, lat: Lattice, first_byte: int):
        self.lat, self.first_byte = lat, first_byte
        self.n = self.n_edges = self.n_ids = 0
        kinds, edges = len(lat.best_size), len(lat.best_edges)
        self.edges, self.ids = np.empty(edges, np.int32), np.empty(edges, np.uint32)
        self.begin, self.size, self.id_begin, self.id_size = (np.empty(kinds, np.int32) for _ in range(4))
        self.log = np.empty(kinds)
        self.append(lat.best_edges, lat.best_size, lat.best_log)
        self.kept = self.n, self.n_edges, self.n_ids

    def reset(self) -> None:
        self.n, self.n_edges, self.n_ids = self.kept

    def append(self, edges: np.ndarray, size: np.ndarray, log: np.ndarray) -> None:
        ids, id_size = _ids(self.lat.piece[edges], size, self.first_byte)

        def put(name: str, at: int, values: np.ndarray) -> None:
            old = getattr(self, name)
            if at + len(values) > len(old):
                grown = np.empty(max(2 * len(old), at + len(values)), old.dtype)
                grown[:at] = old[:at]
                setattr(self, name, old := grown)
            old[at : at + len(values)] = values

        put("edges", self.n_edges, edges)
        put("ids", self.n_ids, ids)
        put("begin", self.n, self.n_edges + np.cumsum(size) - size)
        put("size", self.n, size)
        put("id_begin", self.n, self.n_ids + np.cumsum(id_size) - id_size)
        put("id_size", self.n, id_size)
        put("log", self.n, log)
        self.n, self.n_edges, self.n_ids = self.n + len(size), self.n_edges + len(edges), self.n_ids + len(ids)

    def path(self, seg: int) -> tuple:
        return tuple(self.edges[self.begin[seg] : self.begin[seg] + self.size[seg]].tolist())

    def ids_of(self, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these segmentations in a row, and how many each has."""
        n = self.id_size[seg]
        return self.ids[np.repeat(self.id_begin[seg] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def sample_batch(texts: list[str], keys: np.ndarray, vocabulary: Pieces, k: int, alpha: float, part: int = 1 << 19) -> Iterator[tuple]:
    """For each text its samples: (text, sample, ids, log_prob, perturbed, log_inclusion), the largest perturbed value first.

    Words of all texts share their lattices; sampling goes through texts of about `part` characters at a time.
    """
    parts, held = [0], 0
    for i, t in enumerate(texts):
        if held and held + len(t) > part:
            parts.append(i)
            held = 0
        held += len(t)
    parts = list(zip(parts, [*parts[1:], len(texts)], strict=True))
    with np.errstate(over="ignore"):  # hashes wrap around
        split = [_texts_as_words(texts[a:z]) for a, z in parts]
        hashed = np.concatenate([h for *_, h in split])
        if len(hashed):
            _, at, kind = np.unique(hashed, return_index=True, return_inverse=True)
            cp = np.concatenate([x[0] for x in split])
            moved = np.cumsum([0] + [len(x[0]) for x in split])
            starts = np.concatenate([x[1][:-1] + m for x, m in zip(split, moved, strict=False)])
            size = np.diff(np.r_[starts, len(cp)])[at]
            own = np.cumsum(size) - size
            take = np.repeat(starts[at] - own, size) + np.arange(size.sum())
            pool = Pool(Lattice(cp[take].astype(np.uint64), np.r_[own, len(take)], vocabulary, alpha), vocabulary.first_byte)
            del cp, starts, take
    word = 0
    for (a, _), (_, _, first, h) in zip(parts, split, strict=True):
        with np.errstate(over="ignore"):
            rows = [(d, 0, np.zeros(0, np.uint32), 0.0, float(_gumbel(keys[a + d : a + d + 1] + _C[0])[0]), 0.0) for d in np.flatnonzero(np.diff(first) == 0).tolist()]
            if len(h):
                pool.reset()
                rows += _sampled(first, kind[word : word + len(h)], keys[a : a + len(first) - 1], pool, k)
        word += len(h)
        for d, *rest in rows:
            yield a + d, *rest


def _sampled(first: np.ndarray, kind: np.ndarray, keys: np.ndarray, pool: Pool, k: int) -> list[tuple]:
    """Samples of the texts that have words; kind: of each word; first: the first word of each text, and the number of words."""
    lat, docs, n_words = pool.lat, len(first) - 1, len(kind)
    doc = np.repeat(np.arange(docs), np.diff(first))
    place = np.arange(n_words) - first[doc]
    base = keys[doc] + place.astype(np.uint64) * _C[1]
    live = np.flatnonzero(np.diff(first) > 0)
    p_best, rest_best = np.exp(pool.log[kind]), lat.rest[lat.start[kind]]
    only = rest_best <= 0
    with np.errstate(divide="ignore"):
        side_best = np.log(rest_best)
    # of each text: the queue's nodes (perturbed, sample whose prefix it has, word, segmentations shut out)
    queue: list[list[tuple]] = [[] for _ in range(docs)]
    chosen: list[np.ndarray] = []
    results: list[dict[int, tuple]] = [{} for _ in range(docs)]
    top, since, parent, given = np.full(docs, -np.inf), np.zeros(docs, np.int64), np.zeros(docs, np.int64), {}
    top[live] = _gumbel(keys[live] + _C[0])
    going = live
    for r in range(k):
        salt = np.uint64(r + 1) * _C[2]
        on = np.zeros(docs, bool)
        on[going] = True
        fresh = on[doc] & (place >= since[doc])
        seg = kind.copy() if r == 0 else np.stack(chosen)[parent[doc], np.arange(n_words)]
        f = np.flatnonzero(fresh)
        seg[f] = kind[f]
        other = f[(_uniform(base[f] + salt) >= p_best[f]) & ~only[f]]
        if len(other):
            seg[other] = pool.n + np.arange(len(other))
            pool.append(*lat.others(kind[other], base[other] + salt * np.uint64(3)))
        if given:
            seg[[w for w, _ in given.values()]] = pool.n + np.arange(len(given))
            paths = [s for _, s in given.values()]
            pool.append(np.array([x for s in paths for x in s], np.int64), np.array([len(s) for s in paths], np.int64), np.array([lat.log_c[list(s)].sum() for s in paths]))
        chosen.append(seg)
        lw = pool.log[seg]
        before = np.cumsum(lw) - lw
        side, drawn_other = side_best[f], np.flatnonzero(seg[f] != kind[f])
        with np.errstate(divide="ignore"):
            side[drawn_other] = np.log1p(-np.minimum(np.exp(lw[f[drawn_other]]), 1.0))
        perturbed, of = np.full(n_words, -np.inf), doc[f]
        perturbed[f] = -np.logaddexp(-top[of], -(before[f] - before[first[of]] + side + _gumbel(base[f] + salt * np.uint64(5))))
        total = np.zeros(docs)
        total[live] = np.add.reduceat(lw, first[live])
        w = np.flatnonzero(on[doc])
        out, n = pool.ids_of(seg[w])
        out = out.astype("<u4", copy=False)
        id_bounds = np.r_[0, np.cumsum(np.bincount(doc[w], weights=n, minlength=docs).astype(np.int64))]

        following, given, next_since, next_parent, next_top = [], {}, since.copy(), parent.copy(), top.copy()
        for d in going.tolist():
            a, z = int(first[d]), int(first[d + 1])
            own_side = perturbed[a:z]
            many = min(k - r, z - a)
            for i in np.argpartition(own_side, -many)[-many:].tolist() if many < z - a else range(z - a):
                if own_side[i] > -np.inf:
                    queue[d].append((float(own_side[i]), r, a + i, [pool.path(seg[a + i])]))
            results[d][r] = (out[id_bounds[d] : id_bounds[d + 1]], float(total[d]), float(top[d]))
            q = queue[d]
            q.sort(key=lambda x: -x[0])
            del q[k - r :]
            if r + 1 < k and q:
                value, p, word, shut = q.pop(0)
                drawn = lat.outside(int(kind[word]), shut, base[word] + np.uint64(r + 2) * _C[2] * np.uint64(7))
                if drawn is None:
                    continue
                shut = [*shut, drawn]
                rest = float(lat.left(int(kind[word]), shut)[0][0])
                if rest > 0:
                    pre = float(pool.log[chosen[p][a:word]].sum())
                    g = float(_gumbel(base[word : word + 1] + np.uint64(r + 2) * _C[2] * np.uint64(11))[0])
                    q.append((float(-np.logaddexp(-value, -(pre + np.log(rest) + g))), p, word, shut))
                given[d] = (word, drawn)
                next_since[d], next_parent[d], next_top[d] = word - a + 1, p, value
                following.append(d)
        going, since, parent, top = np.array(following, np.int64), next_since, next_parent, next_top
        if not len(going):
            break
    rows = []
    for d in live.tolist():
        threshold = max((x[0] for x in queue[d]), default=-math.inf)
        for r, (x, lp, g) in results[d].items():
            gap = lp - threshold
            rows.append((d, r, x, lp, g, gap if gap < -30 else math.log(-math.expm1(-math.exp(gap))) if gap < 4 else 0.0))
    return rows


def decoded(ids: np.ndarray, bounds: np.ndarray, vocabulary: Pieces) -> pa.Array:
    """Texts of runs of piece ids: their bytes one after another, without the leading mark."""
    joined = vocabulary.table.take(pa.array(ids))
    at = np.frombuffer(joined.buffers()[1], np.int64)[bounds] if len(ids) else np.zeros(len(bounds), np.int64)
    data = joined.buffers()[2] or pa.py_buffer(b"")
    return pc.utf8_slice_codeunits(pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(at.tobytes()), data), 1).cast(pa.string())


def _samples(path: str, k: int, alpha: float, seed: int, limit: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for b in slices(batches, "text", limit):
            texts = [x or "" for x in b.column("text").to_pylist()]
            names = b.column("doc_id").to_pylist()
            keys = np.array([n % (1 << 64) if n is not None else xxhash.xxh3_64_intdigest(t) for n, t in zip(names, texts, strict=True)], np.uint64)
            keys = mix(keys * np.uint64(3) + np.array([n is None for n in names], np.uint64) + np.uint64(seed % (1 << 64)) * _C[0])
            rows, held = [], 0
            for row in sample_batch(texts, keys, vocabulary, k, alpha):
                rows.append(row)
                held += len(row[2])
                if held > limit:
                    yield batch_of(rows, names, vocabulary)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows, names, vocabulary)

    def batch_of(rows: list[tuple], names: list, vocabulary: Pieces) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        bounds = np.r_[0, np.cumsum([len(x) for x in cols[2]])]
        ids = np.concatenate(cols[2]).astype("<u4", copy=False)
        out = [
            pa.array([names[d] for d in cols[0]], pa.int64()),
            pa.array(cols[1], pa.int32()),
            pa.array(np.diff(bounds)),
            *(pa.array(cols[i], pa.float64()) for i in (3, 4, 5)),
            pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer((4 * bounds).astype(np.int64).tobytes()), pa.py_buffer(ids)]).cast(pa.binary()),
        ]
        names_out = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids"]
        return pa.RecordBatch.from_arrays([*out, decoded(ids, bounds, vocabulary)], names=[*names_out, "text"]) if with_text else pa.RecordBatch.from_arrays(out, names=names_out)

    return run


def sample_segmentations(
    docs: DataFrame,
    k: int = 3,
    alpha: float = 1.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    limit: int = 3 << 20,
    with_text: bool = False,
) -> DataFrame:
    """Up to k rows for each document: doc_id, sample, n_pieces, log_prob, perturbed, log_inclusion, ids (unsigned 32-bit,
    little-endian), and, if asked for, the text that the ids decode to."""
    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.mapInArrow(_samples(path or default_vocabulary(), k, alpha, seed, limit, with_text), SAMPLES + ", text string" * with_text)


def decode(samples: DataFrame, path: str | None = None) -> DataFrame:
    """Rows with ids, with the text of their ids in a column `text`."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(iter([batch]), "ids", 8 << 20):
                runs = [np.frombuffer(x.as_buffer(), "<u4") for x in b.column("ids")]
                texts = decoded(np.concatenate(runs), np.r_[0, np.cumsum([len(x) for x in runs])], pieces(path))
                yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, "text"])

    return samples.mapInArrow(run, T.StructType([*samples.schema.fields, T.StructField("text", T.StringType())]))
