"""Sampled segmentations against full enumeration; main texts against small pages whose articles are known."""

import math
from collections import Counter

import numpy as np
import pytest

from rillwork.llm import gumbel_segments as gs
from rillwork.llm import html_wrapper as hw
from rillwork.llm.words import mix


@pytest.fixture(scope="module")
def vocabulary():
    return gs.pieces(gs.default_vocabulary())


def enumerated(text: str, vocabulary, alpha: float) -> dict[tuple, float]:
    """Every segmentation of a text that pieces cover, with its log probability."""
    marked = "▁" + text.replace(" ", "▁")
    known = {b.decode().replace(" ", "▁"): i for i, b in enumerate(vocabulary.bytes) if i >= vocabulary.first_byte + 256 and b}
    place = {int(i): k for k, i in enumerate(vocabulary.ids)}
    out: dict[tuple, float] = {}

    def go(at: int, ids: tuple, score: float) -> None:
        if at == len(marked):
            out[ids] = score
        for end in range(at + 1, min(len(marked), at + vocabulary.longest) + 1):
            i = known.get(marked[at:end])
            if i is not None:
                go(end, (*ids, i), score + alpha * float(vocabulary.log_p[place[i]]))

    go(0, (), 0.0)
    total = math.log(sum(math.exp(x) for x in out.values()))
    return {k: v - total for k, v in out.items()}


def keys(n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) * np.uint64(3))


def test_probabilities_and_frequencies_match_enumeration(vocabulary):
    every = enumerated("the of", vocabulary, 0.3)
    n = 6000
    first, second = Counter(), Counter()
    for d, r, ids, lp, _, _ in gs.sample_batch(["the of"] * n, keys(n), vocabulary, 2, 0.3):
        ids = tuple(int(x) for x in ids)
        assert lp == pytest.approx(every[ids], abs=1e-9)
        (second if r else first)[ids] += 1
    assert first.total() == second.total() == n
    p = {k: math.exp(v) for k, v in every.items()}
    for k in sorted(p, key=p.get)[-4:]:
        assert first[k] / n == pytest.approx(p[k], abs=0.03)
        assert second[k] / n == pytest.approx(sum(p[a] * p[k] / (1 - p[a]) for a in p if a != k), abs=0.03)


def test_samples_are_distinct_and_end_with_all(vocabulary):
    every = enumerated("a b", vocabulary, 1.0)
    rows = list(gs.sample_batch(["a b"], keys(1), vocabulary, 50, 1.0))
    assert {tuple(int(x) for x in r[2]) for r in rows} == set(every) and len(rows) == len(every)
    assert [r[4] for r in rows] == sorted((r[4] for r in rows), reverse=True)
    rows = list(gs.sample_batch(["of the people and some others"] * 40, keys(40), vocabulary, 8, 0.2, part=100))
    for d in range(40):
        own = [tuple(r[2].tolist()) for r in rows if r[0] == d]
        assert len(own) == 8 == len(set(own))


def test_segmentation_round_trip(spark, vocabulary):
    texts = ["Hello world", " a  b\n\tc ", "", None, "é▁x ñ🙂\x00", "    ", "x" * 3000, "<s> <unk> <0x41> </s>", "中文 text", "the cat " * 2000]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "a null key", 0), (0, "Hello world", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sample int")
    out = gs.decode(gs.sample_segmentations(docs, k=3, alpha=0.4)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        assert {r.text for r in by[i]} == {t or ""}
        assert {r.n_pieces for r in by[i]} == {len(r.ids) // 4 for r in by[i]}
    assert [r.log_prob for r in by[2]] == [0.0] and {r.text for r in by[None]} == {"a null key"}
    assert sorted(r.sample for r in by[0]) == [0, 0, 1, 1, 2, 2] and len({bytes(r.ids) for r in by[0]}) == 3
    assert all(r.log_inclusion <= 0 for r in out)
    assert gs.sample_segmentations(docs.limit(0)).count() == 0
    both = gs.sample_segmentations(docs, k=3, alpha=0.4, with_text=True).collect()
    assert sorted((r.doc_id or -1, r.sample, r.text) for r in both) == sorted((r.doc_id or -1, r.sample, r.text) for r in out)


def test_segmentation_takes_columns_with_dots(spark, vocabulary):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "`doc.id` bigint, `raw.text` string")
    out = gs.sample_segmentations(docs, k=1, id_col="doc.id", text_col="raw.text", with_text=True).collect()
    assert {(r.doc_id, r.text) for r in out} == {(1, "one two"), (2, "")}


def page(menu, article, extra="", host="a.example"):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><a href="/">{menu}</a></nav>{extra}{article}<footer>&copy; {menu}</footer></body></html>'


def test_main_text_of_known_pages():
    html = page(
        "Home",
        '<article><header><h1>A &amp; B</h1></header><p>One <b>two</b>,\n three<br>four<p>fi<i>ve</i> &lt;x&gt;<div class="ad">Buy</div><ul><li>l1<li>l2</ul>'
        '<section id="comments"><article class="comment"><p>First!</p></article></section><form>Name</form><script>if (a < b) "</p>"</script></article>',
        '<header>Site</header><div class="cookie-notice">Accept</div><aside>Side</aside><!-- <article>no</article> -->',
    )
    assert hw.main_text(html, None) == "A & B One two, three four five <x> l1 l2"
    assert hw.main_text("", None) == "" and hw.main_text("plain  text", None) == "plain text"
    assert hw.main_text('<div class="sidebar">x</div><div id="content"><p>kept</p></div><div id="c2"><a href="x">link</a></div>', None) == "kept"
    assert hw.main_text("<p>" * 5000 + "deep" + "<div>" * 5000 + "er", None) == "deep er"


def naive_matching(a, b):
    if a[0] != b[0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), (naive_matching(x[0], y[0]) + best(x[1:], y[1:])) if x[0][0] == y[0][0] else 0)

    return 1 + bool(set(a[2]) & set(b[2])) + best(a[5], b[5])


def test_tree_matching_against_brute_force():
    rng = np.random.default_rng(1)

    def tree(depth):
        return [str(rng.integers(3)), 1, {str(rng.integers(3)): 1}, 1, 0, [tree(depth - 1) for _ in range(rng.integers(4))] if depth else []]

    for _ in range(60):
        a, b = ["r", 1, {}, 0, 0, [tree(2) for _ in range(3)]], ["r", 1, {}, 0, 0, [tree(2) for _ in range(3)]]
        assert hw.matching(a, b) == naive_matching(a, b)
        pairs = hw.align(a[5], b[5])
        assert sum(hw.matching(a[5][i], b[5][j]) for i, j in pairs) == hw._table(a[5], b[5])[-1][-1]
        m = hw.merge(a, b)
        assert m[1] == 2 and len(m[5]) == len(a[5]) + len(b[5]) - len(pairs)


def test_constant_nodes_are_template(spark):
    """Pages without any helpful tags: what a host repeats goes, what varies stays; copies and single pages keep all."""
    body = "<div><p>Share this story with your friends</p></div><div><p>story {0} says {0} and tells of much more than that</p></div><div><a href=x>l{0}</a> <a href=y>m{0}</a></div>"
    rows = [(i, f"http://a.example/{i}", body.format(i)) for i in range(40)]
    rows += [(100 + i, "http://copies.example/", "<div><p>all the same here</p></div>") for i in range(9)]
    rows += [(200, "http://single.example/", body.format(7)), (201, None, None), (202, "http://b.example/", ""), (None, "http://single2.example/x", "<p>no id</p>")]
    pages = spark.createDataFrame([(*r, "tree") for r in rows], "page_id bigint, url string, html string, tree string").repartition(5)
    out = {r.page_id: r for r in hw.main_texts(pages).collect()}
    assert len(out) == len(rows)
    assert all(out[i].text == f"story {i} says {i} and tells of much more than that" for i in range(40))
    assert all(out[100 + i].text == "all the same here" for i in range(9))
    assert out[200].text == "Share this story with your friends story 7 says 7 and tells of much more than that"
    assert out[201].text == out[202].text == "" and out[201].n_chars == 0 and out[None].text == "no id"
    assert hw.main_texts(pages.limit(0)).count() == 0


def test_templates_do_not_depend_on_partitions(spark, monkeypatch):
    body = "<div><p>constant</p></div><div><p>v {0} {0} {0} and more</p></div>"
    pages = spark.createDataFrame([(i, "http://a.example/", body.format(i)) for i in range(300)], "page_id bigint, url string, html string")
    want = {i: f"v {i} {i} {i} and more" for i in range(300)}
    monkeypatch.setattr(hw, "BROADCAST_BYTES", 0)  # the way of many hosts
    assert {r.page_id: r.text for r in hw.main_texts(pages.repartition(40)).collect()} == want
    assert hw.host_templates(pages.repartition(40), fan_in=3).count() == 1


def test_short_articles_beside_long_template_text(spark):
    body = "<div id=top>" + "words that every page of the host has " * 9 + "</div><div id=story><p>short {0}</p></div>"
    rows = [(i, "http://a.example/", body.format(i)) for i in range(20)]
    rows += [(100 + i, "http://b.example/", f"<div id=top>all the same</div><div class={'x' * (i + 1)}></div>") for i in range(9)]
    out = {r.page_id: r.text for r in hw.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out == {i: f"short {i}" for i in range(20)} | {100 + i: "all the same" for i in range(9)}


@pytest.mark.parametrize("every", [33, 100])
def test_constant_boxes_on_few_pages(spark, every):
    """A box on three or one in a hundred pages of a large host, and one with a text of its own on each of them."""
    box = "<section><p>Meet us in town</p></section><h4>note {0}</h4>"
    rows = [(i, "http://a.example/", f"<div id=story><p>story {i} of many</p></div>" + (box.format(i) if i % every == 0 else "")) for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(6)
    out = {r.page_id: r.text for r in hw.main_texts(pages).collect()}
    assert out == {i: f"story {i} of many" + (f" note {i}" if i % every == 0 else "") for i in range(1500)}


@pytest.mark.parametrize(
    "opening",
    ['article class="post comments-open"', 'div class="content no-sidebar"', 'div id="content" class="has-sidebar"', 'div class="content-sidebar-wrap"', 'div class="social"', 'article class="widget"'],
)
def test_articles_in_boxes_that_sound_like_others(spark, opening):
    tag = opening.split()[0]
    body = "<div class=ad>buy {0}</div><div class='site-footer-links'>every page says so</div><" + opening + "><p>story {0} says {0} and more, at length</p></" + tag + "><div id=comments>reply {0}</div>"
    assert hw.main_text(body.format(7).replace("every page says so", ""), None) == "story 7 says 7 and more, at length"
    pages = spark.createDataFrame([(i, "http://a.example/", body.format(i)) for i in range(12)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in hw.main_texts(pages).collect()} == {i: f"story {i} says {i} and more, at length" for i in range(12)}


def test_long_replies_and_changing_adverts(spark):
    long = "<article><p>short {0}</p><section id=comments><article class=comment>" + "reply {0} " * 50 + "</article></section></article>"
    copies = "<div><p>one and the same article of some length</p></div><div class=ad>buy {0}</div>"
    rows = [(i, "http://a.example/", long.format(i)) for i in range(6)] + [(10 + i, "http://b.example/", copies.format(i)) for i in range(6)]
    out = {r.page_id: r.text for r in hw.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out == {i: f"short {i}" for i in range(6)} | {10 + i: "one and the same article of some length" for i in range(6)}


def test_alignment_alone_finds_the_article(spark, monkeypatch):
    """Without any list of roles the host's template says what is content; without the template the boxes beside it stay."""
    page = "<nav><ul><li><a href=x>m{0}</a><li><a href=y>n{0}</a></ul></nav><div class=ad>buy {0} now</div><article><h1>T{0}</h1>" + "<p>story {0} says {0} and more, at length, of many things</p>" * 6 + "</article><footer>at {0} h</footer>"
    rows = [(i, "http://a.example/", page.format(i)) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {i: " ".join([f"T{i}"] + [f"story {i} says {i} and more, at length, of many things"] * 6) for i in range(12)}
    assert {r.page_id: r.text for r in hw.main_texts(pages).collect()} == want
    for name, value in (("ASIDE", {"head"}), ("BESIDE", set()), ("_has", lambda root, tag: "")):
        monkeypatch.setattr(hw, name, value)
    trees = [hw.fold(hw.parse(h)) for _, _, h in rows]
    template = [*hw._merged(trees), {"varies": True, "rare": set()}]
    box = hw.content_box(template)
    assert [x[0] for x in box] == ["html", "article"] and {i: hw.main_text(h, template, box) for i, _, h in rows} == want
    assert all(hw.main_text(h, None) != want[i] for i, _, h in rows)
    monkeypatch.setattr(hw, "align", lambda a, b: [])
    assert hw.content_box([*hw._merged(trees), {}]) == []


def test_roles_deeper_than_the_tree(spark):
    deep = "<div>" * 300 + "kept<nav>menu <b>x</b></nav><div class=sidebar>side</div> too" + "</div>" * 300
    assert hw.main_text(deep, None) == "kept too"


def test_content_box_of_another_role_on_a_page():
    many = [f"<div id=main-text><p>text {i} of some length that varies</p></div><p>x</p>" for i in range(9)]
    template = [*hw._merged([hw.fold(hw.parse(x)) for x in many]), {"varies": True, "rare": set()}]
    assert hw.main_text("<section><p>another page</p></section>", template, hw.content_box(template)) == "another page"
