"""Main text of web pages by wrapper induction: DOM trees of same-host pages are aligned by simple tree matching.

A page becomes a tree of its block elements; neighbours of one label (tag, classes, id without digits) fold into one node. Trees of
a host merge into its template: matched nodes add up their pages, text digests and characters inside links. Tasks merge the trees
that they hold first, then templates of a host meet in blocks of `fan_in`, round by round, so that a host with a third of all pages
is nobody's single group. A node's text that at least half of its pages repeat (and MIN_PAGES of them) is template; what varies is a
slot. Merging keeps a template small by forgetting what few of its pages have; so the texts of each label path are also counted over the
host in one aggregation, and what is constant on a path that at most FEW of the pages have is template as well.

The template says where the content is: going down from its root as long as one box holds CONTENT of the varying, unlinked text of all
pages of the host, or is their `article` or `main` element. On a page that has that box, slots beside it are left out, whatever they are
called; only text and text elements right in the boxes around it stay. Inside, slots that are boxes of another role (menu, advert, form, comments) or mostly
links over the whole host are left out. Elements of such a role in HTML are out, but part of trees and templates. A class, id or ARIA
role only makes a candidate, and only where the whole name says so (`comments`, `cookie-notice`, `left-sidebar`, not `comments-open` or
`has-sidebar`). A candidate is content after all if it is an article or main element, has one in it, or holds most of the page's text
that varies over the host. Where a page hasn't the template's box, its own `article` or `main` elements hold the content.

Defined cases: a null or empty html gives an empty text; a page alone on its host has no template, and roles decide; equal pages of a
host count once; where no text varies over a host at all its pages are copies of one another, and their text stays; a null url is a host of its own; repeated rows stay repeated; elements deeper than MAX_DEPTH join the element at that depth, but boxes of another role stay apart; an empty
table gives an empty result; other columns don't matter. White space is what str.split takes for it.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import attach, slices, stored

MIN_PAGES, SHARE, MAX_DEPTH, RARE, FEW, CONTENT = 4, 0.5, 100, 0.05, 0.2, 0.9
#: Templates of all hosts together are broadcast up to this many bytes, and joined by host beyond.
BROADCAST_BYTES = 8 << 20

# HTML element names by kind.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math textarea select object audio video canvas title".split())
ASIDE = set("nav footer aside form menu dialog button fieldset head".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
# Words in classes, ids and roles that name a box beside the article.
BESIDE = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars side footer masthead topbar toolbar comment comments "
    "commentlist reply replies respond disqus social share sharing related recommended recommendations widget widgets pagination pager login signup search contentinfo complementary form skip".split()
)
# Words that may stand beside those and leave their meaning: places, and kinds of boxes.
NEUTRAL = set("site page top bottom left right primary secondary main global box area block bar list item items links link section inner outer wrap wrapper container first last".split())

# Those of them that name readers' replies, which may be longer than the article.
REPLIES = set("comment comments commentlist reply replies respond disqus".split())
BESIDE_MARK, ASIDE_MARK = " !", " ~"  # at the end of a label: of a candidate; of an element of another role
# HTML elements that hold one block of text or a list of them.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption address".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("aside", "beside", "items", "label", "tag")

    def __init__(self, tag: str, label: str, aside: bool, beside: bool = False):
        self.tag, self.label, self.aside, self.beside, self.items = tag, label, aside, beside, []

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]

    def own(self) -> list[str]:
        """Blocks of text between the node's child elements and breaks."""
        out, run = [], []
        for x in [*self.items, None]:
            if isinstance(x, tuple):
                run.append(x[0])
            else:
                if text := " ".join("".join(run).split()):
                    out.append(text)
                run = []
        return out

    def link_chars(self) -> tuple[int, int]:
        texts = [x for x in self.items if isinstance(x, tuple)]
        return sum(len(x[0]) for x in texts), sum(len(x[0]) for x in texts if x[1])


def _element(tag: str, attributes: str, inside: bool) -> Node:
    """inside: within an article or main element, whose own header stays."""
    names = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    named = " ".join(names.get(k, "") for k in ("class", "id"))
    beside = tag not in ("html", "body", "main") and any(map(_says_beside, f"{named} {names.get('role', '')}".split()))
    aside = tag in ASIDE or (tag == "header" and not inside)
    aside |= "hidden" in names or names.get("aria-hidden", "").lower() == "true" or "display:none" in names.get("style", "").replace(" ", "").lower()
    label = re.sub(r"\d+", "", f"{tag} {' '.join(sorted(names.get('class', '').split()))} #{names.get('id', '')}") if named.strip() else tag
    label += ASIDE_MARK if aside else BESIDE_MARK if beside else ""
    return Node(tag, label, aside, beside)


def _says_beside(name: str) -> bool:
    """Whether a class, id or role as a whole names a box beside the article."""
    parts = {x.lower() for x in _PART.findall(name)}
    return bool(parts & BESIDE) and parts <= BESIDE | NEUTRAL


def parse(page: str) -> Node:
    root = Node("html", "html", False)
    stack, at, linked, scopes = [root], 0, False, 0

    def pop_to(i: int) -> None:
        nonlocal scopes
        for x in stack[i:]:
            scopes -= x.tag in ("article", "main")
        del stack[i:]

    def add(raw: str) -> None:
        if raw:
            stack[-1].items.append((entities.unescape(raw) if "&" in raw else raw, linked))

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                linked = False
            elif tag not in INLINE:
                i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                stack[-1].items.append(None)
                if i:
                    pop_to(i)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag == "a":
            linked = True
        elif tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].items.append(None)
        elif tag not in INLINE and tag not in ("html", "body"):
            if stack[-1].tag == "p" or (stack[-1].tag == "head"):
                pop_to(len(stack) - 1)
            if tag in CLOSES:
                these, until = (x.split() for x in CLOSES[tag])
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in these:
                        pop_to(i)
                        break
                    if stack[i].tag in until:
                        break
            node = _element(tag, m[3], scopes > 0)
            if len(stack) < MAX_DEPTH or (len(stack) == MAX_DEPTH and (node.aside or node.beside)):
                stack[-1].items.append(node)
                stack.append(node)
                scopes += tag in ("article", "main")
            else:
                stack[-1].items.append(None)
        elif tag == "body" and stack[-1].tag == "head":
            pop_to(len(stack) - 1)
    rest = page[at:]
    cut = re.search(r"<[a-zA-Z/!][^>]*\Z", rest)
    add(rest[: cut.start()] if cut else rest)
    return root


# A folded node is a list: label, pages, {digest: pages}, characters, characters in links, children.


def _digest(blocks: list[str]) -> str:
    return xxhash.xxh3_64_hexdigest(" ".join(blocks))


def fold(node: Node) -> list:
    own = node.own()
    chars, links = node.link_chars()
    out = [node.label, 1, {_digest(own): 1} if own else {}, chars, links, []]
    for run in runs(node.children()):
        out[5].append(fold_run(run))
    return out


def runs(nodes: list[Node]) -> list[list[Node]]:
    out: list[list[Node]] = []
    for x in nodes:
        if out and out[-1][0].label == x.label:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def fold_run(run: list[Node]) -> list:
    out = fold(run[0])
    for x in run[1:]:
        out = merge(out, fold(x), max)
    return out


def matching(a: list, b: list) -> int:
    """Simple tree matching: pairs of nodes in the largest order-keeping match of two trees, equal texts counting once more."""
    if a[0] != b[0]:
        return 0
    return 1 + (not a[2].keys().isdisjoint(b[2])) + (_table(a[5], b[5])[-1][-1] if a[5] and b[5] else 0)


def _table(a: list, b: list) -> list[list[int]]:
    best = [[0] * (len(b) + 1)]
    for x in a:
        row, up = [0], best[-1]
        for j, y in enumerate(b):
            most = max(row[j], up[j + 1])
            row.append(max(most, up[j] + matching(x, y)) if x[0] == y[0] else most)
        best.append(row)
    return best


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of two lists of folded nodes, in order."""
    labels = [x[0] for x in a]
    if len(labels) == len(b) and len(set(labels)) == len(labels) and all(x == y[0] for x, y in zip(labels, b, strict=True)):
        return [(i, i) for i in range(len(a))]  # each has one partner
    best, i, j, out = _table(a, b), len(a), len(b), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def merge(a: list, b: list, add=int.__add__) -> list:
    texts = dict(a[2])
    for k, n in b[2].items():
        texts[k] = add(texts[k], n) if k in texts else n
    children, i, j = [], 0, 0
    for x, y in [*align(a[5], b[5]), (len(a[5]), len(b[5]))]:
        children += [*a[5][i:x], *b[5][j:y]]
        if x < len(a[5]):
            children.append(merge(a[5][x], b[5][y], add))
        i, j = x + 1, y + 1
    return [a[0], add(a[1], b[1]), texts, a[3] + b[3], a[4] + b[4], children]


def pruned(t: list, least: int = 64) -> list:
    """Without texts that few of a node's pages have, which are slots anyway, and without nodes that few of the template's pages
    have, which rare_texts() counts. A node keeps its texts until it has `least` pages itself."""
    few = t[1] * RARE if t[1] >= least else 0
    return [*t[:2], {k: n for k, n in t[2].items() if n >= few}, *t[3:5], [pruned(x, least) for x in t[5] if x[1] >= few]]


def _merged(trees: list[list]) -> list:
    """Balanced, so that no merge has one large side only."""
    while len(trees) > 1:
        trees = [pruned(merge(trees[i], trees[i + 1])) if i + 1 < len(trees) else trees[i] for i in range(0, len(trees), 2)]
    return trees[0]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html"):
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([json.dumps(fold(parse(x or "")), separators=(",", ":")) for x in b.column("html").to_pylist()])], names=["host", "tree"])


def _below(path: int, label: str) -> int:
    """The path of a child."""
    return _signed(f"{path} {label}")


def _signed(text: str) -> int:
    return (xxhash.xxh3_64_intdigest(text) ^ (1 << 63)) - (1 << 63)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each label path of a tree once with a null digest, and once with each of its texts."""
    for b in slices(batches, "tree"):
        hosts, found, besides = [], [], []
        for host, tree in zip(b.column("host").to_pylist(), b.column("tree").to_pylist(), strict=True):
            seen: dict[tuple[int, str | None], bool] = {}
            waiting = [(0, json.loads(tree), False)]
            while waiting:
                above, t, beside = waiting.pop()
                path, beside = _below(above, t[0]), beside or t[0].endswith((BESIDE_MARK, ASIDE_MARK))
                seen |= dict.fromkeys([(path, None), *((path, k) for k in t[2])], beside)
                waiting += [(path, x, beside) for x in t[5]]
            hosts += [host] * len(seen)
            found += seen
            besides += seen.values()
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string()), pa.array(besides, pa.bool_())], names=["host", "path", "digest", "beside"])


def rare_texts(trees: DataFrame) -> DataFrame:
    """One row (host, more) per host; more as JSON: varies, whether any text outside of candidates does, and rare, the constant texts of rare paths."""
    counts = stored(trees.mapInArrow(_paths, "host string, path bigint, digest string, beside boolean").groupBy("host", "path", "digest", "beside").agg(F.count("*").alias("n")), "paths")
    whole = counts.filter("digest is null").select("host", "path", F.col("n").alias("pages"))
    texts = counts.filter("digest is not null")
    fixed = texts.filter(F.col("n") >= MIN_PAGES).join(whole, ["host", "path"]).filter(F.col("n") >= SHARE * F.col("pages"))
    hosts = whole.filter(F.col("path") == _below(0, "html")).select("host", F.col("pages").alias("of"))
    rare = fixed.join(hosts, "host").withColumn("key", F.when(F.col("pages") <= FEW * F.col("of"), F.concat_ws(":", F.col("path").cast("string"), "digest")))
    by_host = rare.groupBy("host").agg(F.count_if(~F.col("beside")).alias("fixed"), F.sort_array(F.collect_list("key")).alias("rare"))
    # a host without texts varies as little as one whose texts are all constant
    held = hosts.join(texts.groupBy("host").agg(F.count_if(~F.col("beside")).alias("texts")), "host", "left").join(by_host, "host", "left")
    varies = F.coalesce("texts", F.lit(0)) > F.coalesce("fixed", F.lit(0))
    return held.select("host", F.to_json(F.struct(varies.alias("varies"), F.coalesce("rare", F.array().cast("array<string>")).alias("rare"))).alias("more"))


def _partial(most: int = 4096, chunk: int = 64):
    """Templates of the trees that a task holds; `most` trees wait at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        waiting = 0

        def out() -> pa.RecordBatch:
            rows = [(h, json.dumps(_merged(ts), separators=(",", ":"))) for h, ts in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], names=["host", "tree"])

        for batch in batches:
            for host, tree in zip(batch.column("host").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                ts = held.setdefault(host, [])
                ts.append(json.loads(tree))
                waiting += 1
                if len(ts) >= chunk:
                    waiting -= len(ts) - 1
                    held[host] = [_merged(ts)]
                if waiting >= most:
                    yield out()
                    held, waiting = {}, 0
        if held:
            yield out()

    return run


def host_of(url: str) -> Column:
    """The host of a url in lower case; of none, the empty text."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def host_templates(pages: DataFrame, fan_in: int = 32) -> DataFrame:
    """One row (host, tree) per host; tree: the host's template as JSON, with what rare_texts() says of the host as its last item."""
    own = pages.select(host_of("url").alias("host"), F.col("html").cast("string").alias("html"))
    trees = stored(own.mapInArrow(_trees, "host string, tree string").dropDuplicates(["host", "tree"]), "trees")
    made = stored(trees.mapInArrow(_partial(), "host string, tree string"), "templates")
    while True:
        counts = made.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        # templates meet in blocks of about fan_in, and in one if there are no more
        blocks = F.ceil(F.lit(most) / fan_in).cast("int")
        made = stored(
            made.groupBy("host", F.pmod(F.xxhash64("tree"), blocks).alias("block")).applyInArrow(_merge_block, "host string, tree string"), "templates"
        )


    return made.join(rare_texts(trees), "host").select("host", F.concat(F.expr("left(tree, length(tree) - 1)"), F.lit(","), "more", F.lit("]")).alias("tree"))


def _merge_block(t: pa.Table) -> pa.Table:
    trees = sorted(t["tree"].to_pylist())
    return pa.table([t["host"].slice(0, 1), pa.array([json.dumps(_merged([json.loads(x) for x in trees]), separators=(",", ":"))])], names=["host", "tree"])


def _constant(own: list[str], t: list | None) -> bool:
    return bool(own) and t is not None and t[1] >= MIN_PAGES and t[2].get(_digest(own), 0) >= max(MIN_PAGES, SHARE * t[1])


def _placed(root: Node, template: list | None) -> dict[int, list]:
    """The template's node of each of the page's nodes that has one."""
    out = {}
    waiting = [(root, template)] if template is not None else []
    while waiting:
        node, t = waiting.pop()
        out[id(node)] = t
        groups = runs(node.children())
        if t[5] and groups:
            for i, j in align([fold_run(g) for g in groups], t[5]):
                waiting += [(x, t[5][j]) for x in groups[i]]
    return out


def content_box(template: list) -> list[list]:
    """The template's nodes from its root to the one that holds the content of the host's pages; none if that is no single box."""

    def mass(t: list, marked: bool) -> int:
        if t[0].endswith(ASIDE_MARK) or (t[0].endswith(BESIDE_MARK) and not marked):
            return 0
        constant = any(n >= max(MIN_PAGES, SHARE * t[1]) for n in t[2].values())
        own = 0 if constant or 2 * t[4] > t[3] else t[3] - t[4]
        return own + sum(mass(x, marked) for x in t[5])

    marked = mass(template, False) == 0
    whole = mass(template, marked)
    if not whole or template[1] < MIN_PAGES:
        return []
    chain = [template]
    while chain[-1][0].split(" ")[0] not in ("article", "main"):
        found = next((x for x in chain[-1][5] if x[0].split(" ")[0] not in TEXTUAL and mass(x, marked) >= CONTENT * whole), None)
        if found is None:
            break
        chain.append(found)
    return chain if len(chain) > 1 else []


def _settle(root: Node, placed: dict[int, list], more: dict) -> bool:
    """Clears `beside` of candidates that are content; whether one is because of its share of the page's text.

    The share is of text that varies over the host and isn't links; of all text but links where only candidates vary at all."""
    held: list[tuple[Node, int]] = []

    def weigh(node: Node, above: int) -> tuple[int, bool]:
        path, t = _below(above, node.label), placed.get(id(node))
        own = node.own()
        chars, links = (t[3], t[4]) if t is not None and t[1] >= MIN_PAGES else node.link_chars()
        fixed = 2 * links > chars or (more["varies"] and (_constant(own, t) or f"{path}:{_digest(own)}" in more["rare"]))
        n, article = 0 if fixed else sum(map(len, own)), node.tag in ("article", "main") and not node.beside
        for x in node.children():
            if not x.aside:
                held_text, has = weigh(x, path)
                n, article = n + held_text, article or has
        if node.beside:
            node.beside = not article and node.tag not in ("article", "main")
            if node.beside:
                held.append((node, n))
        return n, article

    total, _ = weigh(root, 0)
    most = [x for x, n in held if n and (n == total if REPLIES & {y.lower() for y in _PART.findall(x.label)} else 2 * n > total)]
    for x in most:
        x.beside = False
    return bool(most)


def main_text(page: str, template: list | None, chain: list[list] = ()) -> str:
    """chain: the template's content_box()."""
    root = parse(page)
    placed = _placed(root, template)
    more = template[6] if template is not None and len(template) > 6 else {"varies": True, "rare": ()}
    keep = not _settle(root, placed, more) and not more["varies"]
    box, around = (chain[-1] if chain else None), {id(t) for t in chain[:-1]}
    boxed = box is not None and any(t is box for t in placed.values())
    scope = _has(root, "article") or _has(root, "main")
    found: list[tuple[str, bool]] = []  # block, constant over the host

    def walk(node: Node, inside: bool, beside: bool, above: int) -> None:
        """beside: the node stands right in a box around the content."""
        path, t = _below(above, node.label), placed.get(id(node))
        inside |= t is box if boxed else node.tag == scope
        own = node.own()
        outer = id(t) in around
        here = bool(own) and (inside or (outer or (beside and node.tag in TEXTUAL) if boxed else not scope))
        if here and not inside:
            chars, links = (t[3], t[4]) if t is not None and t[1] >= MIN_PAGES else node.link_chars()
            here = 2 * links <= chars
        fixed = here and (_constant(own, t) or f"{path}:{_digest(own)}" in more["rare"])
        blocks = iter(own)
        open_text = False
        for x in [*node.items, None]:
            if isinstance(x, tuple):
                open_text |= bool(x[0].strip())
                continue
            if open_text:
                block = next(blocks)
                if here:
                    found.append((block, fixed))
                open_text = False
            if isinstance(x, Node) and not x.aside and not x.beside:
                walk(x, inside, outer, path)

    walk(root, False, False, 0)
    if boxed and not found:  # the box is of another role on this page
        boxed = False
        walk(root, False, False, 0)
    return " ".join(x for x, f in found if not f or keep)


def _has(root: Node, tag: str) -> str:
    waiting = [root]
    while waiting:
        x = waiting.pop()
        if x.tag == tag:
            return tag
        waiting += [y for y in x.children() if not y.aside and not y.beside]
    return ""


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple] = {None: (None, [])}
    for b in slices(batches, "html"):
        texts = []
        for page, tree in zip(b.column("html").to_pylist(), b.column("tree").to_pylist(), strict=True):
            if tree not in known:
                if len(known) > 256:
                    known = {None: (None, [])}
                template = json.loads(tree)
                template[6]["rare"] = set(template[6]["rare"])
                known[tree] = template, content_box(template)
            texts.append(main_text(page or "", *known[tree]))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    templates = host_templates(own)
    rows = own.withColumn("host", host_of("url"))
    if (templates.agg(F.sum(F.length("tree") + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(templates), "host", "left")
    else:
        sizes = rows.groupBy("host").agg(F.count("*").alias("_size"))
        joined = attach(rows, templates.join(sizes, "host"), "host", "_size", rows.count())
    return joined.select("page_id", "url", "html", "tree").mapInArrow(_texts, "page_id bigint, url string, text string, n_chars bigint")
