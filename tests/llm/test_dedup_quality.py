import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rillwork.llm import components, exact_dedup, near_dedup, quality
from rillwork.llm.words import words

DOCS = "doc_id bigint, text string, key string, node string, kept boolean, root bigint"
WORD = r"[^\x20\x09-\x0D]+"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def corpus():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghié") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, i = [], 0
    for _ in range(25):
        base = text(rng.choice([4, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((i, rng.choice([" ", "\n", "\t "]).join(t).capitalize()))
            i += 1
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (3, rows[3][1]), (None, rows[0][1]), (None, None)]
    return [(*r, "x", "y", True, 7) for r in rows]


def brute_near(rows, size, num, den):
    sets = []
    for r in rows:
        w = re.findall(WORD, low(r[1]))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if None not in (rows[a][0], rows[b][0]) and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(rows[a][0]), root(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((r[0] is not None, r[0] or 0, len(s), root(r[0]) if r[0] is not None else None) for r, s in zip(rows, sets, strict=True))


@pytest.mark.parametrize(("size", "num", "block"), [(3, 85, 256), (5, 80, 4)])
def test_near_components(spark, size, num, block):
    rows = corpus()
    got = near_dedup.near_components(spark.createDataFrame(rows, DOCS), size, num, 100, block=block).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got) == brute_near(rows, size, num, 100)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_chain_and_hot_bucket(spark):
    """Links that only lead through other texts, among many near copies of one text."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(150)]
    step = list(base)
    for k in range(40):
        for j in range(4):
            step[(k * 4 + j) % 200] = f"c{k}{j}"
        rows.append((1000 + k, " ".join(step)))
    rows = [(*r, "x", "y", True, 7) for r in rows]
    got = near_dedup.near_components(spark.createDataFrame(rows, DOCS), 3, 85, 100, block=32).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got) == brute_near(rows, 3, 85, 100)


def test_sets_that_share_one_hash_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 5, 7), (2, 5, 7), (3, 5, 8), (4, 6, 8)], "doc_id bigint, node bigint, proof bigint")
    node = {r.doc_id: r.node for r in near_dedup._told_apart(rows, [5]).collect()}
    assert node[1] == node[2] != node[3] and node[4] == 6 and len({node[1], node[3], 5, 6}) == 4
    assert near_dedup._told_apart(rows, []) is rows
    w = words(pa.array(["a b c", "c b a", "a b c d"]))
    row, h, n, one, two = near_dedup._sets(pa.array(["a b c", "c b a", "a b c d"]), 3)
    assert len(w.hash) == 10 and len(set(one.tolist())) == len(set(two.tolist())) == 3 and not set(one.tolist()) & set(two.tolist())


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a, b = h[:220], h[60:280]
        row = np.repeat([0, 1], [220, 220])
        s = near_dedup.signatures(row, np.concatenate([a, b]), 2)
        errors.append((s[0] == s[1]).mean() - 160 / 280)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    tiny = near_dedup.signatures(np.zeros(2, int), np.array([5, 9], np.uint64), 1)
    assert (tiny < np.iinfo(np.uint64).max).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(50)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[2000 + i] == 1000 for i in range(50)) and got[1000] == 1000
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_duplicates(spark, keep):
    rows = corpus()
    rows += [(2000 + i, rows[5][1], None, None, None, None) for i in range(60)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, DOCS), keep=keep).collect()
    pick = max if keep == "max" else min
    want = []
    for r in rows:
        own = [q[0] for q in rows if (q[1] or "") == (r[1] or "")]
        first = pick((x for x in own if x is not None), default=None)
        want.append((r[0] or 0, first, len(own), r[0] == first, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in got)
    left = exact_dedup.drop_copies(spark.createDataFrame(rows, DOCS), keep=keep)
    assert left.columns == ["doc_id", "text", "key", "node", "kept", "root"]
    texts = [r["text"] or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in rows})


def brute_quality(t):
    t = t or ""
    w = re.findall(WORD, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    cover = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice(["a", "bé", "#x", "word", "z&", "quite", f"n{rng.randrange(500)}"]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice(["\n", "\r\n"]).join(lines + lines[:2]), "k", "n", None, None))
    rows += [(100, None, "k", "n", None, None), (101, "", "k", "n", None, None), (None, "x " * 100, "k", "n", None, None), (5, rows[5][1], "k", "n", None, None), (102, "new word " + "y" * 3_000_000, "k", "n", None, None)]
    clean = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) + "." for i in range(8))
    nav = "\n".join([" | ".join(f"m{i}{j}" for j in range(12)) for i in range(9)] + ["See our privacy policy and terms"])
    rows += [(200, clean, "k", "n", None, None), (201, nav, "k", "n", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = quality.judged(docs).collect()
    key = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(str, ((r["doc_id"], *(r[k] for k in key)) for r in got))) == sorted(str((r[0], *brute_quality(r[1]))) for r in rows)
    verdict = {r["doc_id"]: r["kept"] for r in got}
    assert verdict[200] and not verdict[201] and not any(r["kept"] and r["base_failed"] for r in got)
    kept = quality.clean(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    text = next(r["text"] for r in quality.clean(spark.createDataFrame([(1, clean + "\nhome | about | news | shop | help | more", "", "", None, None)], DOCS), remove_lines=True).collect())
    assert text == clean


PROSE = "The committee asked how a privacy policy should read, and whether terms of use bind a reader who never saw them. "


def lost(text):
    found, _ = quality._judge(pa.array([text]))
    return found["lost_share"][0]


def test_a_phrase_in_prose_is_no_boilerplate():
    more = " ".join(f"Sentence {i} of the report tells of point {i * 7}, plainly." for i in range(30))
    assert lost(PROSE + more) == 0 == lost(more + "\n" + PROSE + more)
    for line in ("All rights reserved.", "Privacy Policy | Terms of Use", "© 2024 Acme Corp. ALL RIGHTS RESERVED", "Please enable JavaScript!\r"):
        assert 0 < lost(f"{more}\n{line}\n{more} End.") < 0.1


def test_menu_of_one_entry_a_line(spark):
    menu = "\n".join(["Home", "About us", "Contact", "", "Our services »"] + [f"Item number {i}" for i in range(200)])
    prose = "\n\n".join(f"Line {i} has w{i}, x{i} with y{i} and z{i}." for i in range(20))
    rows = [(1, menu, "", "", None, None), (2, prose + "\n" + "\n".join(menu.split("\n")[:5]), "", "", None, None), (3, prose, "", "", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    verdict = {r["doc_id"]: (r["kept"], r["n_failed_lines"]) for r in quality.judged(docs).collect()}
    assert verdict == {1: (False, 204), 2: (True, 0), 3: (True, 0)}  # four entries are no menu yet
    assert lost("Title of it\n" + prose) == 0 and lost("\n".join(f"He said {i}.”" for i in range(30))) == 0


def test_sentence_punctuation():
    bare = " ".join(f"cheap{i} shoes{i}" for i in range(100))
    assert lost(bare) == 1 and lost(bare + ".") == 1
    assert lost(" ".join(f"some six words make sentence {i}{m}" for i in range(20) for m in (".", "?\"", "。", "।", "؟"))) == 0
    assert lost(" ".join(["เขา ไป ตลาด"] * 30)) == 0
    assert lost("これは文です。これも文です " * 40) == 0 and lost(None) == lost("") == lost("\n\n") == 0


def test_pipeline_removes_failed_lines(spark):
    import corpus_pipeline

    prose = "\n".join(f"Line {i} has w{i}, x{i} with y{i} and z{i}." for i in range(20))
    docs = spark.createDataFrame([(1, f"All rights reserved.\n{prose}\nLine 0 has w0, x0 with y0 and z0.", "", "", None, None)], DOCS)
    assert [r["text"] for r in corpus_pipeline.quality_rules(spark, docs, "").collect()] == [prose]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert quality.judged(none).count() == exact_dedup.exact_duplicates(none).count() == near_dedup.near_components(none).count() == 0


def test_words_of_very_long_texts():
    t = "Ab\tc " * 700_000 + "\x85é"
    w = words(pa.array([t, None, "x"]), lower=True)
    assert w.counts().tolist() == [1_400_001, 0, 1] and len(set(w.hash.tolist())) == 4


@pytest.mark.parametrize("pick", [np.minimum, np.maximum])
def test_runs_merge_block_by_block(pick):
    """Several runs of sorted blocks, one block a batch, against a dictionary."""
    rng, want, blocks = np.random.default_rng(6), {}, []
    for run in range(5):
        keys = sorted({int(x) for x in rng.integers(0, 400, 120)})
        for at in range(0, len(keys), 7):
            own = keys[at : at + 7]
            ids, has, sizes = rng.integers(-50, 50, len(own)), rng.random(len(own)) < 0.8, rng.integers(1, 5, len(own))
            raw = [k.to_bytes(exact_dedup.WIDTH, "big") for k in own]
            blobs = [raw[0], b"".join(raw), ids.astype(np.int64).tobytes(), has.tobytes(), sizes.astype(np.int64).tobytes()]
            blocks.append((raw[0], pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([0], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=["shard", "run", "first", "keys", "ids", "has", "sizes"])))
            for k, i, h, n in zip(own, ids.tolist(), has.tolist(), sizes.tolist(), strict=True):
                old_id, old_n = want.get(k, (None, 0))
                best = old_id if not h else i if old_id is None else int(pick(old_id, i))
                want[k] = (best, old_n + n)
    batches = [b for _, b in sorted(blocks, key=lambda x: x[0])]
    for last in (True, False):
        out = pa.Table.from_batches(exact_dedup._merge(pick, last)(iter(batches)))
        if last:
            assert [(int.from_bytes(r["key"], "big"), (r["keep_id"], r["group_size"])) for r in out.to_pylist()] == sorted(want.items())
        else:
            keys = b"".join(out["keys"].to_pylist())
            assert [int.from_bytes(keys[i : i + exact_dedup.WIDTH], "big") for i in range(0, len(keys), exact_dedup.WIDTH)] == sorted(want)


CLASH = "doc_id bigint, text string, _text string, _clean string, _kept string, _sha2 string, _place string, _place_kept string, _parts int, bucket int"


def test_columns_of_any_name_pass_through(spark):
    prose = "\n".join(f"Line {i} has w{i}, x{i} with y{i} and z{i}." for i in range(20))
    more = ("t", "c", "k", "s", "p", "q", 5, 6)
    docs = spark.createDataFrame([(1, prose, *more), (2, prose, *more), (3, None, *more), (1, prose, *more)], CLASH)
    kept = quality.clean(docs, remove_lines=True)
    assert kept.columns == docs.columns and [r[2:] for r in kept.collect()] == [more] * 3
    one = exact_dedup.drop_copies(docs)
    assert one.columns == docs.columns and sorted((r[0], r[2:]) for r in one.collect()) == [(1, more), (3, more)]
    near = near_dedup.drop_near_copies(docs)
    assert near.columns == docs.columns and sorted(r["doc_id"] for r in near.collect()) == [1, 1, 3]


def test_pipeline_against_brute_force(spark, tmp_path):
    """All four stages on a small table, each against a plain version of what it keeps."""
    import corpus_pipeline
    from rillwork.llm.tokens import default_vocabulary, encoding

    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7))) for _ in range(900)]

    def prose(lines):
        return [" ".join(rng.choice(vocab) for _ in range(9)).capitalize() + "." for _ in range(lines)]

    rows, i = [], 0
    for _ in range(30):
        base = prose(rng.choice([4, 12, 40]))
        for _ in range(rng.choice([1, 1, 3])):
            lines = list(base)
            if rng.random() < 0.5:
                lines[rng.randrange(len(lines))] = prose(1)[0]
            if rng.random() < 0.5:
                lines.insert(rng.randrange(len(lines)), "All rights reserved.")
            rows.append((i, "\n".join(lines), "en", "s", 1))
            i += 1
    rows += [(500, None, "en", "s", 1), (501, "", "en", "s", 1), (502, rows[0][1], "en", "s", 1), (503, "\n".join(["menu"] * 80), "en", "s", 1), (None, "\n".join(prose(12)), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {}
    for d, t, *_ in rows:
        lines = [x for k, x in enumerate((t or "").split("\n")) if x != "All rights reserved." and x not in (t or "").split("\n")[:k]]
        if len(re.findall(WORD, t or "")) >= 50 and len(set((t or "").split("\n"))) > 2:
            kept[d] = "\n".join(lines)
    smallest = {}
    for d, t in kept.items():
        if t not in smallest or (d is not None and d < smallest[t]):
            smallest[t] = d
    left = [(d, t, None, None, None, None) for t, d in smallest.items()]
    root = {r[1]: r[3] for r in brute_near(left, 5, 80, 100) if r[0]}
    left = {d: t for d, t, *_ in left if d is None or root[d] == d}
    assert len(left) < len(smallest) < len(kept) < len(rows)
    enc = encoding(default_vocabulary())
    ids = {d: enc.encode(t, allowed_special="all") + [1] for d, t in left.items()}
    assert {r["doc_id"] for r in got} == set(left)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:k]) for k, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 2048
