import hashlib
import random
import zlib

import numpy as np
import pytest

from rillwork.llm import archive, binary_packing, chat, packing
from rillwork.llm.tokens import default_vocabulary, encoding

CONV = "conv_id bigint, turn bigint, role string, text string, tokens string, block string"
DOCS = "doc_id bigint, text string, length string, start string, n_chars bigint"


def brute_chat(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        all_ = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(5)
    bits = ["</s>", "[INST]", "<|end|>\n", "⁣", "⁣c", "<", "|", ">", "é", "words and ", "\n", "<<SYS>>", "<|user|>\n"]
    text = lambda n: "".join(rng.choice(bits) for _ in range(n))
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]", "x", "y"), (-7, 1, "assistant", "</s>[INST] ok [/INST]", None, None)]
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", text(20), None, None))
        rows += [(c, t + 1, "user" if t % 2 == 0 else "assistant", text(rng.choice([0, 3, 60, 4000])), None, None) for t in range(c)]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} " * 30, None, None) for t in range(400)]
    rows += [(60, None, None, None, None, None), (60, 1, "assistant", None, None, None), (None, 0, "assistant", "a", None, None), (60, 1, "assistant", None, None, None)]
    return rows


@pytest.mark.parametrize("block", [16, 1024])
def test_windows_read_back(spark, block):
    rows = conversations()
    windows = chat.chat_windows(spark.createDataFrame(rows, CONV), budget=512, history=2, block=block)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(windows).collect()}
    assert got == brute_chat(rows)
    for r in windows.collect():
        assert r["n_tokens"] <= 512 or r["n_new"] == 1
        turns = chat.turns_of(r["text"])
        assert len(turns) == r["n_repeated"] + r["n_new"]
        if r["conv_id"] in (3, 6, 9):
            assert turns[0][0] == "system"


def test_windows_hold_the_tokens_they_state(spark):
    """Turns of about one token or more a character, and ones that get escape marks."""
    bits = ["日本語の文章", "漢字", "🎉🧪", "한국어", "3141592653", "x+=[{}];", "⁣", "<|im_start|>", "[INST]", " \n", "<|endoftext|>"]
    rng = random.Random(8)
    rows = [(c, t, ["system", "user", "assistant"][0 if t == 0 else 2 - t % 2], "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))), "", "") for c in range(6) for t in range(60)]
    windows = chat.chat_windows(spark.createDataFrame(rows, CONV), budget=2048).collect()
    enc = encoding(default_vocabulary())
    assert sum(w["n_new"] for w in windows) == len(rows)
    for w in windows:
        assert w["n_tokens"] == len(enc.encode(w["text"], disallowed_special=())) and (w["n_tokens"] <= 2048 or w["n_new"] == 1)
    assert max(w["n_tokens"] for w in windows) > 1500


def test_escape_is_exact():
    for s in ("</s>[INST] ok [/INST]", "<<|", "⁣e⁣", "a|>", "<s></s>"):
        e = chat.escape(s)
        assert chat.unescape(e) == s
        assert not any(c in e for c in chat.CONTROL)


def test_chat_empty(spark):
    assert chat.read_back(chat.chat_windows(spark.createDataFrame([], CONV))).count() == 0


def documents():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([1, 20, 90, 300, 900]))), "x", None, 1) for i in range(150)]
    rows += [(500, None, None, None, None), (501, "", None, None, None), (None, "no id", None, None, None), (7, rows[7][1], None, None, None), (502, "<|endoftext|> in text", None, None, None)]
    return [*rows, (503, "long " * 30000, None, None, None)]


def test_packing_is_lossless_and_tight(spark):
    rows = documents()
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), with_ids=True).collect()
    enc = encoding(default_vocabulary())
    whole = sorted(((d if d is not None else -1), tuple(enc.encode(t or "", allowed_special="all") + [1])) for d, t, *_ in rows)
    docs, seqs = {}, {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        docs.setdefault((r["doc_id"] if r["doc_id"] is not None else -1, r["doc_tokens"]), []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    back = []
    for (d, n), ps in docs.items():
        ps.sort(key=lambda r: r["start"])
        copies = sum(p["start"] == 0 for p in ps)
        for k in range(copies):
            own = ps[k::copies]
            ids = [i for p in own for i in p["ids"]]
            assert len(ids) == n
            back.append((d, tuple(ids)))
    assert sorted(back) == whole
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert sum(r["length"] for r in got) > 0.93 * 2048 * len(seqs)
    matrix = packing.sequences(packing.pack_documents(spark.createDataFrame(rows, DOCS), with_ids=True)).collect()
    assert len(matrix) == len(seqs) and all(len(r["ids"]) == 2048 for r in matrix)


def test_packing_takes_columns_with_dots(spark):
    rows = [(1, "one two"), (2, None), (3, "")]
    plain = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    dotted = packing.pack_documents(spark.createDataFrame(rows, "`doc.id` bigint, `raw.text` string"), id_col="doc.id", text_col="raw.text")
    assert sorted(map(tuple, dotted.collect())) == sorted(map(tuple, plain.collect()))


def test_same_ids_as_the_json_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoding(default_vocabulary())
    for text in ("Déjà vu, <|endoftext|>x", "  a\n\n b c", "", "1234 don't\t\u0000", "日本語🎉"):
        assert t.encode(text, add_special_tokens=False).ids == enc.encode(text, allowed_special="all")


def test_least_squares():
    rng = np.random.default_rng(1)
    a, x = rng.random((30, 12)), np.maximum(rng.normal(size=12), 0)
    assert np.allclose(packing.nonnegative_least_squares(a, a @ x), x, atol=1e-6)
    h = np.zeros(129, np.int64)
    h[1:] = rng.integers(0, 40, 128)
    used = np.zeros(129, np.int64)
    for way, n in packing.plan(h, 128):
        assert sum(way) <= 128
        np.add.at(used, list(way), n)
    assert (used == h).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert packing.pack_documents(none).count() == 0
    assert binary_packing.binary_sequences(none).count() == 0


def test_binary_sequences_round_trip(spark, tmp_path):
    rows = documents()
    found = binary_packing.binary_sequences(spark.createDataFrame(rows, DOCS).coalesce(2))
    binary_packing.write_sequences(found, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    enc, back = encoding(default_vocabulary()), []
    for r in got:
        ids, pos, cu = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(pos) == 2048 and cu[-1] == r["n_tokens"] <= 2048
        for d, s, a, b in zip(r["doc_ids"], r["starts"], cu[:-1], cu[1:], strict=True):
            assert (pos[a:b] == np.arange(b - a)).all()
            back.append((d if d is not None else -1, s, tuple(ids[a:b].tolist())))
    want = []
    for d, t, *_ in rows:
        ids = enc.encode(t or "", allowed_special="all") + [1]
        want += [(d if d is not None else -1, s, tuple(ids[s : s + 2048])) for s in range(0, len(ids), 2048)]
    assert sorted(back) == sorted(want)


def test_best_fit_against_scan():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        i = min(fits, key=lambda i: room[i]) if fits else None
        if i is None:
            room.append(100 - n)
        else:
            room[i] -= n
    assert len(binary_packing.best_fit_decreasing(lengths, 100)) == len(room)


def test_archive(spark, tmp_path):
    big, small = "<p>" + "x" * 200, "<p>s"
    rows = [(5, "u5", big, "k"), (3, "u\r\n3", big, "k"), (9, None, big, None), (4, "u4", small, None), (2, "u2", small, None), (1, "u1", None, None), (8, "u8", "", None), (None, "n", big, None), (3, "u3", big, None), (11, "é", "é" * 60, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")
    folder = str(tmp_path / "a")
    archive.write_archive(pages, folder)
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archive.read_records(spark, folder).collect())
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    want = []
    for p, _, h, _ in rows:
        n = len((h or "").encode())
        first = min(q for q, _, g, _ in rows if q is not None and (g or "") == (h or ""))
        again = n >= 100 and p is not None and p != first
        want.append((p or 0, n, sha(h), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3]))
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    by = {int(r["header"].split("<urn:page:")[1].split(">")[0]): bytes(r["record"]) for r in archive.original_records(spark, folder).collect() if "<urn:page:" in r["header"]}
    assert by[3].endswith(b"\r\n\r\n" + big.encode() + b"\r\n\r\n") and b"WARC-Refers-To: <urn:page:3>" in by[5] and b"Content-Length: 0" in by[5]


def test_archive_empty(spark, tmp_path):
    archive.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "e"))
    assert archive.read_records(spark, str(tmp_path / "e")).count() == 0


def test_archives_of_one_name(spark, tmp_path):
    for k, text in enumerate(("<p>one", "<p>two")):
        archive.write_archive(spark.createDataFrame([(k, "u", text)], "page_id bigint, url string, html string"), str(tmp_path / str(k) / "archive"))
    for k, text in enumerate((b"<p>one", b"<p>two")):
        assert [bytes(r.record).endswith(text + b"\r\n\r\n") for r in archive.original_records(spark, str(tmp_path / str(k) / "archive")).collect()] == [True]


def test_archive_damage_is_noticed(spark, tmp_path):
    """An archive that another session wrote, whose payload isn't what its header says."""
    good = hashlib.sha256(b"x").hexdigest()
    for payload, length in ((b"x", "1"), (b"y", "1"), (b"x", "2")):
        folder = f"{tmp_path}/{payload.decode()}{length}"
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:{good}\r\nContent-Length: {length}\r\n\r\n"
        spark.createDataFrame([(good, bytearray(payload))], "payload_digest string, payload binary").write.parquet(f"{folder}/payloads")
        spark.createDataFrame([(good, 1, head)], "payload_digest string, copies bigint, header string").write.parquet(f"{folder}/records")
        if (payload, length) == (b"x", "1"):
            assert [r["payload_digest"] for r in archive.read_records(spark, folder).collect()] == [good]
        else:
            with pytest.raises(Exception, match="damaged payload"):
                archive.read_records(spark, folder).collect()


def test_archive_hot_small_payload(spark, tmp_path):
    """Most pages have one small payload."""
    rows = [(i, "u", "tiny" if i % 4 else f"page {i} " * 20) for i in range(4000)]
    archive.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "h"))
    got = archive.read_records(spark, str(tmp_path / "h"))
    assert sorted((r["page_id"], r["payload_digest"]) for r in got.collect()) == [(i, hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows]


def test_repeated_turn_numbers_are_spread(spark):
    """Far more turns of one number than a block holds: blocks stay bounded, order and digests exact."""
    rng = random.Random(4)
    rows = [(1, rng.choice([None, 0, 0, 5]), rng.choice(["user", "assistant"]), f"{rng.choice('abcdefghijklmnop' * 2)} said {i}", None, None) for i in range(900)]
    rows += [(2, t, "user", f"t {t}", None, None) for t in range(-5, 40)]
    windows = chat.chat_windows(spark.createDataFrame(rows, CONV), budget=256, block=16)
    assert max(r["n"] for r in windows.groupBy("conv_id", "block").sum("n_new").withColumnRenamed("sum(n_new)", "n").collect()) <= 16
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(windows).collect()}
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        assert got[c][:2] == (len(turns), hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in turns).encode()).hexdigest())


def test_ids_must_fit_their_width(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="fit"):
        binary_packing.binary_sequences(docs, window=70_000)
    with pytest.raises(Exception, match="does not fit"):
        binary_packing.binary_sequences(docs, end=70_000).collect()
    assert binary_packing.binary_sequences(docs, end=70_000, wide=True).count() == 1
