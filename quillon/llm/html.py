"""Main text of web pages, with the removal of site templates.

A page is parsed into elements (unclosed ones end where HTML lets them end). A site's frame is found in
the corpus: each subtree of the whole page (navigation, paragraphs, list items and inline elements, too)
is hashed with its host, Spark counts in how many different pages of the host it stands, and subtrees
that recur across many of them are deleted. Only then elements that are never part of an article go by
their tag, role or class. Two things are no templates however often they recur: inline elements within
running text, and inside an <article> or <main> paragraphs, headings, list items, quotations and table
cells that hold more than links, for these may well repeat each other.

Text: character references decoded, white space inside a block turned into one space, trimmed, blocks
joined in page order by a line feed. A null or empty page gives an empty string. Null and repeated
page_ids and repeated rows keep a row each; exact copies of a page count once in the search for
templates; a null url is the host "". An empty table gives no rows. Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

#: A subtree is a template if it stands in so many different pages of its host, however large the host is ...
MIN_PAGES = 5
#: ... or, on a host of few pages, in so many and nearly all of them.
MIN_PAGES_SMALL = 2
NEARLY_ALL = 0.9
#: The same for subtrees that may be content that recurs: plain text without containers, or more than
#: HEAVY characters that are not links, or a part of an article.
MIN_PAGES_STRICT = 20
MIN_PAGES_SMALL_STRICT = 5
HEAVY = 200

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title script style noscript template iframe object embed svg math canvas audio video map nav menu footer aside form button select input textarea dialog".split())
BLOCKS = frozenset(
    "html body address article blockquote center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr li main ol p pre section summary table caption thead tbody tfoot tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text, and elements whose content is not shown.
PROSE = HEADINGS | frozenset("p li blockquote pre tr td th".split())
UNSEEN = frozenset("head title script style noscript template".split())
#: Tags at whose start an open element of the kind ends.
ENDS_P = BLOCKS | DROPPED - frozenset("button select input textarea svg math iframe object embed canvas audio video map script style noscript template".split())
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
# Words of class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice "
    "notification popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist replies disqus respond widget toolbar "
    "pagination pager contentinfo complementary search login".split()
)
# Those of them that mark running text, too.
MARKS_OF_PROSE = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice newsletter share sharing comment comments replies".split())
_WORDS = re.compile("[a-z0-9]+")
# Tags as most are written; HTMLParser takes the others, and those after which it may read text in another way.
_START = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][-a-zA-Z0-9]*="[^"<>&]*")*)>""")
_ATTRIBUTE = re.compile(r""" ([^=]+)="([^"]*)\"""")
_END = re.compile("</([a-zA-Z][a-zA-Z0-9]*)>")
_OTHER_TEXT = frozenset("script style title textarea xmp plaintext iframe noembed noframes noscript".split())
_HOST = re.compile(r"(?s)^.*?://([^/?#]*)")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}  # where in the open elements each tag stands

    def updatepos(self, i, j):
        return j  # lines are not counted

    def parse_starttag(self, i):
        m = _START.match(self.rawdata, i)
        tag = m and m[1].lower()
        if m is None or tag in _OTHER_TEXT:
            return super().parse_starttag(i)
        attrs = m[2]
        self.handle_starttag(tag, [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else ())
        return m.end()

    def parse_endtag(self, i):
        m = _END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def _close(self, tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """End the innermost open element of these tags, unless one of `within` was opened after it."""
        at, last = self.at, 0
        for t in tags:
            places = at.get(t)
            if places and places[-1] > last:
                last = places[-1]
        if not last:
            return
        for t in within:
            places = at.get(t)
            if places and places[-1] >= last:
                return
        for x in reversed(self.open[last:]):
            at[x.tag].pop()
        del self.open[last:]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close(("p",), ("td", "th", "table", "article", "section", "div", "li", "button", "blockquote", "body"))
        if tag in ENDS:
            names, within = ENDS[tag]
            self._close(tuple(names.split()), within)
        if tag in ("html", "body") and self.at.get(tag):
            return
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        self._close((tag,), ("article", "main", "table") if tag in ("p", "b", "i", "a", "em", "strong", "span", "li") else ())

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _elements(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]


def _is_root(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("role") == "main" or node.attrs.get("itemprop") == "articleBody"


def _marked(node: Node) -> bool:
    words = _WORDS.findall(" ".join((node.attrs.get("class", ""), node.attrs.get("id", ""), node.attrs.get("role", ""))).lower())
    return not MARKS.isdisjoint(words)


def _marked_within(node: Node) -> bool:
    """The same inside an article, where a word of an id or of running text's class may well be the article's own."""
    tokens = " ".join((node.attrs.get("class", ""), node.attrs.get("role", ""), node.attrs.get("id", ""))).lower().split()
    if node.tag in PROSE or node.tag not in BLOCKS | DROPPED:
        return not MARKS_OF_PROSE.isdisjoint(tokens)
    return not MARKS.isdisjoint([*tokens, *_WORDS.findall(node.attrs.get("class", "").lower())])


def _article(node: Node) -> bool:
    return _is_root(node) and not _marked(node)


def _survey(root: Node) -> tuple[list[Node], dict[int, Node], set[int], set[int]]:
    """All elements (parents first), their parents, those that go by tag or as hidden, and those that are or hold an article."""
    order, parent = list(_elements(root)), {}
    for x in order:
        for c in x.children:
            if isinstance(c, Node):
                parent[id(c)] = x
    dropped: set[int] = set()
    holds: set[int] = set()
    for x in order:
        if x is not root and (id(parent[id(x)]) in dropped or x.tag in DROPPED and x.tag != "form" or "hidden" in x.attrs or x.attrs.get("aria-hidden") == "true"):
            dropped.add(id(x))
        elif _article(x):
            holds.add(id(x))
            y = x
            while id(y) in parent:
                y = parent[id(y)]
                holds.add(id(y))
    for x in order:  # of a form around an article only the controls go
        if x.tag == "form" and id(x) not in holds or x is not root and id(parent[id(x)]) in dropped:
            dropped.add(id(x))
    return order, parent, dropped, holds


def prune(root: Node) -> list[Node]:
    """Take off what is never main text, in place; return the elements that hold the article, or the whole page.

    An element whose class marks it stays if an article stands in it (a page's outer frame may be named
    for its sidebar), and so does each article of the page's own, whatever its size.
    """
    order, parent, dropped, holds = _survey(root)
    inside: set[int] = set()
    for x in order:
        up = parent.get(id(x))
        within = up is not None and (id(up) in inside or id(up) in holds and _is_root(up))
        if within:
            inside.add(id(x))
        if up is not None and id(up) in dropped or id(x) not in holds and x.tag not in ("html", "body", "#root") and (_marked_within if within else _marked)(x):
            dropped.add(id(x))
        elif x.tag == "header" and id(x) not in holds:
            if within:  # an article's own head: its headings stay
                x.children = _headings(x, dropped)
            else:
                dropped.add(id(x))
    tops: list[Node] = []
    todo = [root]
    while todo:
        x = todo.pop()
        x.children = [c for c in x.children if not isinstance(c, Node) or id(c) not in dropped]
        if _is_root(x) and id(x) in holds and id(x) not in inside:
            tops.append(x)
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    return tops or [root]


def _headings(node: Node, dropped: set[int]) -> list[Node]:
    """The outermost headings below node."""
    found, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and id(x) not in dropped:
            if x.tag in HEADINGS:
                found.append(x)
            else:
                todo += reversed(x.children)
    return found


def blocks(node: Node) -> list[str]:
    """The texts of the blocks below node."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    todo: list[object] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        else:
            if x.tag in BLOCKS:
                flush()
                todo.append(None)
            elif x.tag in ("br", "td", "th"):
                run.append(" ")
            todo += reversed(x.children)
            if x.tag in ("td", "th"):
                run.append(" ")
    flush()
    return out


def subtrees(root: Node, host: str) -> dict[int, int]:
    """A 64-bit hash of host, tags and text for each element of an unpruned page (by id) that may be a template.

    The last bit is 1 if the stricter rule holds for the element.
    """
    found: dict[int, int] = {}
    order, parent, _, holds = _survey(root)
    within: set[int] = set()  # in an article
    fixed: set[int] = set()  # not shown, or in running text
    for x in order:
        up = parent.get(id(x))
        if up is None:
            continue
        if id(up) in within or id(up) in holds and _is_root(up):
            within.add(id(x))
        if x.tag in UNSEEN or id(up) in fixed and (x.tag not in BLOCKS or up.tag in UNSEEN):
            fixed.add(id(x))
        elif x.tag not in BLOCKS and x.tag not in DROPPED and _running(x, up):
            fixed.add(id(x))
    start = hashlib.blake2b(host.encode("utf-8", "surrogatepass") + b"\0", digest_size=8)
    digests: dict[int, bytes] = {}
    sizes: dict[int, tuple[int, int]] = {}  # characters, and those of links
    for x in reversed(order):  # children before parents
        h, n, linked = start.copy(), 0, 0
        h.update(x.tag.encode("utf-8", "surrogatepass"))
        for c in x.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                if text:
                    h.update(b"t" + text.encode("utf-8", "surrogatepass"))
                    n += len(text)
            elif c.tag not in UNSEEN:
                h.update(b"e" + digests[id(c)])
                n, linked = n + sizes[id(c)][0], linked + sizes[id(c)][1]
        digests[id(x)] = h.digest()
        sizes[id(x)] = n, n if x.tag == "a" else linked
        if not n or x is root or x.tag in ("html", "body") or id(x) in holds and not _article(x) or id(x) in fixed:
            continue
        if id(x) in within and (x.tag in PROSE or x.tag not in BLOCKS | DROPPED) and sizes[id(x)][1] < n:
            continue
        own = n - sizes[id(x)][1]
        strict = id(x) in within or own > HEAVY or own > 0 and (x.tag in PROSE or x.tag not in BLOCKS | DROPPED)
        found[id(x)] = int.from_bytes(digests[id(x)], "little", signed=True) & ~1 | strict
    return found


def _running(x: Node, up: Node) -> bool:
    """Whether an inline element stands in running text: beside text, or beside other elements of a paragraph."""
    beside = [c for c in up.children if c is not x and (isinstance(c, Node) and c.tag not in UNSEEN or isinstance(c, str) and c.strip())]
    return any(isinstance(c, str) for c in beside) or up.tag in PROSE and bool(beside)


def remove(root: Node, marks: dict[int, int], templates: frozenset[int]) -> None:
    """Take the elements whose mark is a template's off the page, in place.

    Articles that recur are teasers, but only on a page that has another one.
    """
    order, parent, _, holds = _survey(root)
    gone: set[int] = set()
    around: set[int] = set()  # articles, and what holds them, that have one below
    for x in order:
        up = parent.get(id(x))
        if marks.get(id(x)) in templates or up is not None and id(up) in gone:
            gone.add(id(x))
        if id(x) in holds and up is not None:
            around.add(id(up))
    kept: set[int] = set()
    if all(id(x) in gone for x in order if id(x) in holds and id(x) not in around):
        kept |= holds
        for x in order:  # and with the only articles all of their parts
            if _article(x) and id(x) in holds:
                kept.update(id(y) for y in _elements(x))
    for x in order:
        x.children = [c for c in x.children if not isinstance(c, Node) or id(c) in kept or marks.get(id(c)) not in templates]


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page (page_id, url, html)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found, seen = [], [], []
            for url, html in zip(*(batch.column(k).to_pylist() for k in range(1, 3)), strict=True):
                host = host_of(url)
                hosts.append(host)
                found.append(sorted(set(subtrees(parse(html or ""), host).values())))
                seen.append(int.from_bytes(hashlib.blake2b((html or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hosts, pa.string()), pa.array(seen, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["row", "host", "page", "subtrees"])

    # rows are told apart by a hash: page_ids may be null or repeated; rows equal in all three have the same templates
    own = pages.select(F.xxhash64("page_id", F.col("page_id").isNull(), "url", "html").alias("row"), "page_id", "url", "html")
    marked = common.stored(common.mapped(own.select("row", "url", "html"), hashed, "row long, host string, page long, subtrees array<long>"))
    # how many different pages of its host hold a subtree, against all of the host's different pages
    distinct = marked.select("host", "page").distinct()
    totals = distinct.groupBy(F.xxhash64("host").alias("on")).agg(F.count("*").alias("total"))
    held = marked.select(F.xxhash64("host").alias("on"), "page", F.explode("subtrees").alias("subtree")).distinct()
    counts = held.groupBy("on", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES_SMALL)
    strict = F.col("subtree").bitwiseAND(F.lit(1)) == 1
    many = F.col("n") >= F.when(strict, MIN_PAGES_STRICT).otherwise(MIN_PAGES)
    nearly_all = (F.col("n") >= F.when(strict, MIN_PAGES_SMALL_STRICT).otherwise(MIN_PAGES_SMALL)) & (F.col("n") >= NEARLY_ALL * F.col("total"))
    templates = counts.join(totals.hint("shuffle_hash"), "on").where(many | nearly_all).select("subtree")
    hits = common.stored(marked.select("row", F.explode("subtrees").alias("subtree")).join(templates.hint("shuffle_hash"), "subtree").groupBy("row").agg(F.collect_set("subtree").alias("templates")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for url, html, templates in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
                root = parse(html or "")
                if templates:
                    remove(root, subtrees(root, host_of(url)), frozenset(templates))
                texts.append("\n".join(b for x in prune(root) for b in blocks(x)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = own.join(hits, "row", "left").select("page_id", "url", "html", "templates")
    return common.mapped(joined, cut, "page_id long, url string, text string, n_chars long")
