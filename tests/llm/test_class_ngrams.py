import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rillwork.llm import class_ngrams as c

DOCS = "doc_id bigint, text string, word string, n string, row_id bigint"
WORD = r"[^\x20\x09-\x0D]+"


def corpus():
    rng = random.Random(8)
    sides = [[f"{p}{i}{s}" for i in range(300)] for p, s in (("a", "tion"), ("b", "keit"))]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(sides[i % 2], weights, k=rng.choice([0, 5, 60, 200]))), "x", "y", 1) for i in range(400)]
    rows += [(900, None, None, None, None), (None, "A0tion a0TION", None, None, None), (3, rows[3][1], None, None, None), (901, "never seen words", None, None, None)]
    return rows


def tokens(t):
    return re.findall(WORD, "".join(x.lower() if "A" <= x <= "Z" else x for x in t or "")) + [None]


@pytest.mark.parametrize(("seeds", "head", "known"), [(1000, 16_384, 200_000), (30, 100, 40), (0, 0, 0)])
def test_scores(spark, seeds, head, known, monkeypatch):
    for name, value in (("SEEDS", seeds), ("HEAD", head), ("KNOWN", known)):
        monkeypatch.setattr(c, name, value)
    rows = corpus()
    out = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    n = Counter(w for r, o in zip(rows, out, strict=True) if not o for w in tokens(r[1]))
    total, v = sum(n.values()), len(n)
    want = Counter()
    for r, o in zip(rows, out, strict=True):
        t = tokens(r[1])
        base = sum(math.log10((n[w] + 1) / (total + v + 1)) for w in t)
        want[(r[0], o, len(t), sum(n[w] > 0 for w in t), total, round(base, 6))] += 1
    got = c.class_scores(spark.createDataFrame(rows, DOCS), classes=8).collect()
    assert want == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    far = [r for r in got if r["held_out"]]
    if seeds:
        assert sum(r["score"] for r in far) > sum(r["base_score"] for r in far)  # held out, the classes tell more than single words
    assert all(r["score"] < 0 and r["perplexity"] > 1 for r in got)


def classes_of(own, names):
    found = {r["word"]: r["c"] for r in own.collect()}
    return [found[int(c.words(c.pa.array([w])).hash.view(np.int64)[0])] for w in names]


def test_probabilities_sum_to_one(spark):
    texts = ["a b a", "b c", "a a c d"]
    m, own = c.fit(spark.createDataFrame([(t,) for t in texts], "text string"), classes=3)
    assert np.allclose((10**m.step).sum(axis=1), 1)
    rows = own.collect()
    assert len(rows) == 4 and m.tokens == 12 and m.types == 5
    for g in range(m.k + 2):  # all words, the end and one unknown word
        known = sum(10 ** (m.step[g, r["c"]] - m.size[r["c"]]) * (r["n"] + 1) for r in rows)
        assert math.isclose(known + 10 ** m.step[g, m.k] + 10 ** m.unknown[g], 1)


@pytest.mark.parametrize("head", [1000, 60, 8])
def test_words_of_equal_endings_part_by_what_is_beside_them(spark, head, monkeypatch):
    """Two kinds of words take turns; nothing in the words tells which kind. Rare ones find their class too."""
    monkeypatch.setattr(c, "HEAD", head)
    rng = random.Random(7)
    weights = [1 / (i + 1) for i in range(100)]
    kinds = [[f"w{2 * i + k}same" for i in range(100)] for k in range(2)]
    texts = [" ".join(rng.choices(kinds[i % 2], weights)[0] for i in range(200)) for _ in range(60)]
    _, own = c.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), classes=2)
    seen = {w for t in texts for w in t.split()}
    a, b = (classes_of(own, [w for w in kind if w in seen]) for kind in kinds)
    most = max(sum(x == k for x in a) + sum(x != k for x in b) for k in (0, 1))
    assert most >= 0.95 * (len(a) + len(b))


def test_most_frequent_words_of_wide_steps(spark):
    rows = [(i, 5) for i in range(500)] + [(1000 + i, 5 + i) for i in range(20)]
    got = c.most_frequent(spark.createDataFrame(rows, "word bigint, n bigint"), 100)
    assert 85 <= len(got) <= 100 and set(range(1001, 1020)) <= set(got["word"])
    assert len(c.most_frequent(spark.createDataFrame(rows, "word bigint, n bigint"), 1000)) == 520


def test_exchange_against_brute_force():
    rng = np.random.default_rng(3)
    t = np.zeros((9, 9), int)
    for i in range(8):
        for j in range(8):
            t[i, j] = rng.integers(5, 9) if (i % 2) != (j % 2) else rng.integers(0, 2)
    t[8, :8] = t[:8, 8] = 1

    def likelihood(cls):
        hot = np.eye(3)[cls]
        big = hot.T @ t @ hot
        return c._xlogx(big).sum() - c._xlogx(big.sum(axis=0)).sum() - c._xlogx(big.sum(axis=1)).sum()

    cls = c.exchange(t, 3)
    best = max((likelihood(np.array([*((m >> i) & 1 for i in range(8)), 2])) for m in range(256)))
    assert likelihood(cls) > best - 1e-6 and cls[8] == 2


def test_no_rows(spark):
    assert c.class_scores(spark.createDataFrame([], DOCS)).count() == 0
