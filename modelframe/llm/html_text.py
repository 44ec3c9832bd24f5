"""Main text of web pages by site template removal.

Each page is parsed into elements; every element's subtree (tags and text) is hashed. Spark counts, for each host,
on how many pages a subtree occurs; one that recurs on many of the host's pages (a share, and a number at least) is
template and is deleted. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments also go by what their tag, role, class or id says, for hosts with too few pages to count. If a page has
an article or main element, its text is the text there; else all of the body that is left. Elements around the main
element aren't dropped by what they say, nor those around articles if no text of an article is elsewhere. Template is deleted inside
an article too: boxes, lists, tables and paragraphs that recur. Parts of a passage (headings, list items, cells, words
in a sentence) stay there unless the whole recurs. If that would take more than half of the articles' text, the page is
a near copy of others of its host and its text stays whole.

Menus, adverts and footers often differ from page to page in their words, not in their build. So on pages without article
or main element a second hash counts as well: that of a box's shape (tags, names, where text stands, but no words; equal
items in a row count as one) and its place. A box is an outermost element without a passage, and stands beside no passage.
A box whose shape recurs goes too, unless that would leave less than a quarter of the page's text.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones
dropped, and joined in page order by one line feed.

Edge cases: a null or empty page gives an empty text; markup that never closes is closed at the end of the page, and a
`<` that opens no tag is text; a null url is a host of its own; pages of one host with equal trees count once; html and
body are never template, nor is all that a page has; very long and very deep pages are parsed without recursion; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelframe.llm.common import Stored, map_in_arrow, portions

#: A subtree is template if it is on at least this share of its host's pages, and on so many.
SHARE, PAGES = 0.5, 3
#: Broadcast the hosts' templates up to so many hashes; join by shuffle beyond.
BROADCAST = 1_000_000

_OPENS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_TAG_STOPS = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
# fixed values: HTML's elements by kind
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
_DROPPED = frozenset(
    "nav header footer aside form script style noscript template iframe svg head menu button select textarea title dialog "
    "object canvas audio video noembed noframes xmp".split()
)
_CLOSES_P = _BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend summary".split())
_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that name what isn't article text, and words beside them that only say place, form or number.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion promotions banner cookie cookies "
    "consent gdpr notice popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer "
    "header masthead comment comments disqus replies respond share sharing social newsletter subscribe signup related "
    "recommended pagination pager toolbar login search".split()
)
_BESIDE = frozenset(
    "a area bar bars block bottom box btn button buttons center col column container content desktop first form global group "
    "icon icons inline inner item items js l last layer left link links list main major media message minor mobile outer "
    "panel post posts primary right row secondary section site slot sticky sub text the thread top unit wrap wrapper".split()
)
#: Whole names that are no row of the words above.
_WHOLE = frozenset("side-bar skip-link skip-links skip-to-content skip-nav".split())
_PIECES = re.compile(r"[_-]+")


def _names_other(value: str) -> bool:
    """Whether a class or id has a token that names what isn't article text: as a whole, not by one of its parts."""
    for token in value.lower().split():
        parts = [p for p in _PIECES.split(token) if p and not p[0].isdigit()]
        if token in _WHOLE or any(p in _NAMES for p in parts) and all(p in _NAMES or p in _BESIDE for p in parts):
            return True
    return False


#: Elements that hold a passage, and those that only go with the list, table or section they are part of.
_PARTS = frozenset("h1 h2 h3 h4 h5 h6 hgroup li dt dd tr td th thead tbody tfoot caption figcaption legend option summary".split())
_PASSAGES = _PARTS | {"p", "pre", "blockquote", "address"}
#: What makes an element more than a box.
_PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 hgroup article main".split())


class Node:
    __slots__ = ("attributes", "dropped", "hash", "kids", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.dropped = bool(tag) and _is_dropped(tag, attributes)
        self.kids: list[Node | str] = []
        self.hash = 0


def _is_dropped(tag: str, attributes: str) -> bool:
    if tag in _DROPPED:
        return True
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and _names_other(value) or name == "role" and value.lower() in _ROLES or name == "hidden":
            return True
        if name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def parse(source: str) -> Node:
    """The page's tree; its nodes' hashes cover tags and text below."""
    root = top = Node("", None, "")
    at, size = 0, len(source)
    open_tags: dict[str, int] = {}
    #: Quotation marks of which none is left.
    unpaired: set[str] = set()

    def tag_end(at: int) -> int:
        """Where the tag's `>` stands, outside quoted values; a mark that nothing closes is like any other character."""
        while m := _TAG_STOPS.search(source, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            if m[0] not in unpaired:
                other = source.find(m[0], at)
                if other < 0:
                    unpaired.add(m[0])
                else:
                    at = other + 1
        return size

    def close(node: Node) -> Node:
        open_tags[node.tag] -= 1
        return node.parent or root

    while at < size:
        m = _OPENS.search(source, at)
        begin = m.start() if m else size
        if begin > at:
            top.kids.append(source[at:begin])
        if not m:
            break
        if not m[2]:
            end = source.find("-->" if m[0] == "<!--" else ">", m.end())
            at = size if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        tag, end = m[2].lower(), tag_end(m.end())
        attributes, at = source[m.end() : end], end + 1
        if m[1]:
            if tag == "br":
                top.kids.append("\n")
            elif open_tags.get(tag, 0):
                # an end tag closes what is open inside its element, but inline ones don't reach out of a block
                node = top
                while node.tag != tag:
                    if tag not in _BLOCK and node.tag in _BLOCK:
                        node = None
                        break
                    node = node.parent
                if node is not None:
                    while top is not node:
                        top = close(top)
                    top = close(top)
            continue
        if tag in _CLOSES_P and open_tags.get("p", 0):
            node = top
            while node.tag and node.tag != "p" and (node.tag not in _BLOCK):
                node = node.parent
            if node.tag == "p":
                while top is not node:
                    top = close(top)
                top = close(top)
        if tag in _SAME:
            ends, within = _SAME[tag]
            node, last = top, None
            while node.tag and node.tag not in within:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                while top is not last:
                    top = close(top)
                top = close(top)
        if tag in _VOID:
            top.kids.append("\n" if tag in ("br", "hr") else "")
            continue
        node = Node(tag, top, attributes)
        top.kids.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            node.kids.append(source[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        if attributes.rstrip().endswith("/") and tag not in _BLOCK and tag not in ("a", "b", "i", "em", "strong", "span"):
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        top = node
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if isinstance(k, Node)]
    for node in reversed(order):
        own = xxhash.xxh3_64()
        own.update(node.tag.encode())
        for k in node.kids:
            own.update(b"<%d>" % k.hash if isinstance(k, Node) else _SPACE.sub(" ", k).strip().encode("utf-8", "replace"))
        node.hash = own.intdigest()
    return root


def _counted(root: Node) -> Iterator[Node]:
    """The elements that may be template: not html or body, none that is or holds an article or main, no part of a passage there."""
    holds: set[int] = set()
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]
    found = []
    while stack:
        node, inside, passage = stack.pop()
        if node.tag in ("article", "main"):
            inside, up = True, node
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
        inline = node.tag not in _BLOCK
        if node.kids and node.tag not in ("", "html", "body") and not (inside and (node.tag in _PARTS or inline and passage)):
            found.append(node)
        passage = inline and passage or node.tag in _PASSAGES or any(isinstance(k, str) and k.strip() for k in node.kids)
        stack += [(k, inside, passage) for k in node.kids if isinstance(k, Node)]
    return (n for n in found if id(n) not in holds)


def _build(node: Node) -> bytes:
    """The element's tag and the names its class and id give, without numbers."""
    values = [m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(node.attributes) if m[1].lower() in ("class", "id")]
    names = sorted({re.sub("[0-9]+", "", t) for v in values for t in v.split()})
    return f"{node.tag} {' '.join(names)}".encode("utf-8", "replace")


def _boxes(root: Node) -> Iterator[tuple[Node, int]]:
    """The boxes of a page without article or main element, each with the hash of its shape and place."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if isinstance(k, Node)]
    prose: set[int] = set()
    shape: dict[int, int] = {}
    for node in reversed(order):
        own = xxhash.xxh3_64(_build(node), seed=1)
        last = None
        for k in node.kids:
            if isinstance(k, Node):
                if id(k) in prose:
                    prose.add(id(node))
                now = shape[id(k)]
                if now != last or k.tag in _BLOCK and k.tag not in _PARTS:
                    own.update(b"<%d>" % now)
                last = now
            elif k.strip():
                own.update(b"t")
                last = None
        if node.tag in _PROSE:
            prose.add(id(node))
        shape[id(node)] = own.intdigest()
    # down from the top through what holds prose
    down: list[tuple[Node, int]] = [(root, 0)]
    while down:
        node, place = down.pop()
        if node.tag in _PROSE:
            continue
        place = xxhash.xxh3_64_intdigest(_build(node) + b"%d" % place, seed=2)
        kids = [k for k in node.kids if isinstance(k, Node)]
        beside = any(k.tag in _PROSE for k in kids) or any(isinstance(k, str) and k.strip() for k in node.kids)
        for k in kids:
            if id(k) in prose:
                down.append((k, place))
            elif not beside and k.tag not in ("head", "body", "html"):
                yield k, xxhash.xxh3_64_intdigest(b"%d %d" % (place, shape[id(k)]), seed=3)


def _has_article(root: Node) -> bool:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main"):
            return True
        stack += [k for k in node.kids if isinstance(k, Node)]
    return False


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def subtree_hashes(source: str | None) -> tuple[int, list[int]]:
    """The page's hash, and the distinct ones of its subtrees, and of its boxes' shapes, that may be template."""
    root = parse(source or "")
    found = {_signed(n.hash) for n in _counted(root)}
    if not _has_article(root):
        found |= {_signed(h) for _, h in _boxes(root)}
    return _signed(root.hash), list(found)


def _text(tops: list[Node], gone: set[int], spared: set[int]) -> str:
    """The text of the elements without what is dropped, unless it is spared, or gone."""
    blocks: list[list[str]] = [[]]
    for top in tops:
        blocks.append([])
        walk: list[Node | str | None] = [top]
        while walk:
            item = walk.pop()
            if item is None:
                blocks.append([])
            elif isinstance(item, str):
                blocks[-1].append(item)
            elif not (item.dropped and id(item) not in spared or id(item) in gone):
                if item.tag in _BLOCK:
                    blocks.append([])
                    walk.append(None)
                walk += reversed(item.kids)
        blocks.append([])
    lines = (_SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks)
    # white space that references bring counts too
    lines = (" ".join(line.split()) if not line.isascii() or "\x0b" in line else line for line in lines)
    return "\n".join(line for line in lines if line)


def _holders(root: Node, tags: tuple[str, ...]) -> set[int]:
    """The dropped elements that hold one of these."""
    found, stack = set(), [root]
    while stack:
        node = stack.pop()
        if node.tag in tags:
            up = node.parent
            while up is not None:
                if up.dropped:
                    found.add(id(up))
                up = up.parent
        stack += [k for k in node.kids if isinstance(k, Node)]
    return found


def _articles(root: Node, spared: set[int]) -> list[Node]:
    """The outermost article and main elements in page order, without those in what is dropped and not spared."""
    tops, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main"):
            tops.append(node)
        else:
            stack += [k for k in reversed(node.kids) if isinstance(k, Node) and not (k.dropped and id(k) not in spared)]
    return tops


def main_text(source: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    if not source:
        return ""
    root = parse(source)
    gone = {id(n) for n in _counted(root) if _signed(n.hash) in template} if template else set()
    boxes = {id(n) for n, h in _boxes(root) if _signed(h) in template} if template and not _has_article(root) else set()

    def text(tops: list[Node], spared: set[int]) -> str:
        found = _text(tops or [root], gone, spared)
        if boxes and not tops:
            less = _text([root], gone | boxes, spared)
            if 4 * len(less) >= len(found):
                return less
        if gone and (tops or not found):
            whole = _text(tops or [root], set(), spared)
            if 2 * len(found) < len(whole):
                return whole
        return found

    # what holds the main element isn't dropped, nor what holds the article if there is no text of one elsewhere
    spared = _holders(root, ("main",))
    tops = _articles(root, spared)
    if tops and (found := text(tops, spared)):
        return found
    every = _holders(root, ("main", "article"))
    if every != spared and (found := text(_articles(root, every), every)):
        return found
    return text(tops, spared)


def templates(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """Stored rows (host, template array<long>): at most 1/share times a page's mean number of subtrees for a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b, "html")):
            found = [subtree_hashes(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([p for p, _ in found], pa.int64()), pa.array([f for _, f in found], pa.list_(pa.int64()))],
                ["host", "page", "found"],
            )

    counted = Stored(
        map_in_arrow(pages.select("host", "html"), run, "host string, page long, found array<long>")
        .groupBy("host", "page")
        .agg(F.first("found").alias("found"))
        .select("host", F.explode(F.concat("found", F.array(F.lit(0).cast("long")))).alias("hash"))
        .groupBy("host", "hash")
        .agg(F.count("*").alias("n"))
        .where((F.col("n") >= least) | (F.col("hash") == 0))
    ).df
    # hash 0 stands for a distinct page
    all_pages = counted.where("hash = 0").select("host", F.col("n").alias("pages"))
    return Stored(
        counted.where("hash != 0")
        .join(all_pages, "host")
        .where(F.col("n") >= F.col("pages") * share)
        .groupBy("host")
        .agg(F.collect_list("hash").alias("template"))
    ).df


def host(url: str = "url"):
    """The url's host in lower case, empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extracted(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages."""
    rows = pages.select(F.col("page_id").cast("long"), "url", host().alias("host"), "html")
    found = templates(rows, share, least)
    hashes = found.agg(F.sum(F.size("template"))).first()[0] or 0
    side = F.broadcast(found) if hashes <= BROADCAST else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b, "html")):
            texts = [
                main_text(h.as_py(), frozenset(t or ()))
                for h, t in zip(batch.column("html"), batch.column("template").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    given = rows.join(side, "host", "left").select("page_id", "url", "html", "template")
    return map_in_arrow(given, run, "page_id long, url string, text string, n_chars long")
