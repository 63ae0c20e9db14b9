"""Main text of web pages with removal of site templates.

Each page is parsed to a tree and its element subtrees are hashed. Spark counts, per host, on how many different pages each subtree
occurs; subtrees on many pages of the host are the site's template and are deleted. Elements that are never part of an article
(menus, forms, notices and so on) go by their kind. What remains of the article, or else of the page, is its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import bounded_batches, slices, stored

#: Hosts' templates are broadcast up to this number of subtrees, beyond it joined by a shuffle.
BROADCAST_SUBTREES = 500_000

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table select article section main div body".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr figcaption".split())
# What is not article text, by element, by word of class or id, by role.
NOISE_TAGS = frozenset("nav header footer aside form head script style noscript template iframe button select textarea input object embed svg canvas dialog menu title xmp noembed noframes audio video map".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies disclaimer disqus "
    "footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion "
    "recommended related replies reply respond searchbox share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
WORDS_BEFORE = frozenset("no has with without".split())

#: Text blocks of at least so many characters may be template wherever they stand.
LONG_BLOCK = 32
# How an element may be template: on min_share of the pages; a text block on most pages; a short one on most pages and at a page's edge.
ANY, BLOCK, EDGE = 0, 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


class Element:
    __slots__ = ("tag", "attributes", "children", "hash", "size", "kept")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.hash, self.size, self.kept = tag, attributes, [], 0, 0, False


def parse(html: str) -> Element:
    """A tree of elements and texts. Left-out and misplaced end tags are taken as browsers mostly do; nothing is an error."""
    root = Element("", {})
    stack, at, size = [root], 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P or tag in CLOSED_BY_SAME:
            ends = CLOSED_BY_SAME.get(tag, ("p",))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        text = m[3] if m[2] else m[6]
        found = Element(tag, {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(text)} if text.strip() else {})
        stack[-1].children.append(found)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
        elif tag not in VOID and not (text.endswith("/") and tag in ("svg", "path", "use")):
            stack.append(found)  # a slash does not close an HTML element
    weigh(root)
    return root


def weigh(root: Element) -> None:
    """Sets `size`, the characters of an element's text, and `kept`: no class or id makes it noise.

    Kept are articles (not those within articles), what holds the longest of them or the longest main element, and what holds most of
    the page's text.
    """
    order, parent, inside = [root], [-1], [False]
    articles, mains = [], []
    for k, e in enumerate(order):  # grows while it runs; parents come first
        for c in e.children:
            if isinstance(c, str):
                e.size += sum(map(len, c.split()))
            elif not is_apart(c):
                if not inside[k]:
                    if c.tag == "article":
                        articles.append(len(order))
                    elif c.tag == "main" or c.attributes.get("role") == "main":
                        mains.append(len(order))
                order.append(c)
                parent.append(k)
                inside.append(inside[k] or c.tag == "article")
    for k in range(len(order) - 1, 0, -1):
        order[parent[k]].size += order[k].size
    for e in order:
        e.kept = 2 * e.size > root.size
    for found in (articles, mains):
        for k in found:
            order[k].kept = True
        k = max(found, key=lambda k: order[k].size, default=-1)
        while k >= 0:
            order[k].kept = True
            k = parent[k]


def is_apart(e: Element) -> bool:
    """Whether the element's kind, role or state says that it is no article text."""
    if e.tag in NOISE_TAGS:
        return True
    a = e.attributes
    if not a or e.tag in ("html", "body", "main"):
        return False
    return a.get("role", "").lower() in NOISE_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def is_noise(e: Element) -> bool:
    """Whether the element's kind, role, class or id says that it is no article text."""
    if is_apart(e):
        return True
    a = e.attributes
    if not a or e.kept or e.tag in ("html", "body", "main"):
        return False
    for name in ("class", "id"):
        if value := a.get(name):
            for part in value.lower().split():
                words = re.split(r"[^a-z0-9]+", part)
                if any(w in NOISE_WORDS and not (k and words[k - 1] in WORDS_BEFORE) for k, w in enumerate(words)):
                    return True
    return False


def hash_subtrees(e: Element) -> int:
    """Sets each element's hash: tag, class, id, the words of its texts and its children's hashes, in order."""
    parts = [e.tag, e.attributes.get("class", ""), e.attributes.get("id", "")]
    todo = [(e, iter(e.children), parts)]
    while todo:  # no recursion: pages may nest deeply
        node, rest, parts = todo[-1]
        for c in rest:
            if isinstance(c, str):
                if words := " ".join(c.split()):
                    parts.append(words)
            else:
                todo.append((c, iter(c.children), [c.tag, c.attributes.get("class", ""), c.attributes.get("id", "")]))
                break
        else:
            node.hash = int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
            todo.pop()
            if todo:
                todo[-1][2].append(str(node.hash))
    return e.hash


def main_element(root: Element) -> tuple[Element, bool]:
    """The articles, else the main element, else the whole page; whether one was marked. Several are the children of a new element."""
    articles, mains, todo = [], [], [(root, False)]
    while todo:
        e, in_main = todo.pop()
        if e.tag == "article":
            articles.append(e)
            continue
        if not in_main and (e.tag == "main" or e.attributes.get("role") == "main"):
            mains.append(e)
            in_main = True
        todo.extend((c, in_main) for c in reversed(e.children) if not isinstance(c, str) and not is_noise(c))
    for found in (articles, mains):
        if len(found) == 1:
            return found[0], True
        if found:
            both = Element("", {})
            both.children = found
            return both, True
    return root, False


def removable(root: Element) -> Iterator[tuple[Element, int]]:
    """Elements that a site's template may hold, with the evidence that each needs. Inline elements and short blocks of articles are none."""
    main, marked = main_element(root)
    longest = main if main.tag or not marked else max(main.children, key=lambda e: e.size)
    todo = [root]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str) or c.tag in ("head", "script", "style"):
                continue
            todo.append(c)
            if c.tag in ("html", "body") or c is longest:
                continue
            if c.tag in TEXT_BLOCKS:
                if c.size >= LONG_BLOCK:
                    yield c, BLOCK
                elif c.size and not marked and c.tag not in ("td", "th", "tr"):
                    yield c, EDGE
            elif c.tag not in INLINE and c.tag not in VOID:
                yield c, ANY


def at_edges(e: Element, templates: frozenset[int], short: frozenset[int]) -> set[int]:
    """ids of the elements with a hash in `short` that stand before or after all other text of e."""
    units, todo = [], [e]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            if c.strip():
                units.append(None)
        elif c is e or not (is_noise(c) or c.hash in templates):
            if c.hash in short and c is not e:
                units.append(id(c))
            else:
                todo.extend(reversed(c.children))
    if None not in units:
        return set()
    first, last = units.index(None), len(units) - units[::-1].index(None)
    return set(units[:first] + units[last:])


def text_of(e: Element, templates=frozenset(), left_out=frozenset()) -> str:
    """The element's text without noise, template subtrees and elements whose id() is in left_out; blocks are parted by one space, white space is one space."""
    out, todo = [], [e]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
            continue
        if c is not e and (is_noise(c) or c.hash in templates or id(c) in left_out):
            out.append(" ")
            continue
        if c.tag not in INLINE:
            out.append(" ")
            todo.append(" ")
        todo.extend(reversed(c.children))
    return " ".join("".join(out).split())


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def template_subtrees(pages: DataFrame, url: str, html: str, min_pages: int, min_share: float, block_share: float) -> DataFrame:
    """Per host the hashes of its template's subtrees: on at least min_pages different pages and min_share of the host's.

    Text blocks must be on more than block_share of the pages; `_short` has those that are template at a page's edges only.

    Equal pages count once, so copies of one page are no template. The share bounds the list: a host has at most 1 / min_share
    times as many template subtrees as a page has subtrees.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            hosts, pages_, found, needs = [], [], [], []
            for u, h in zip(b["url"].to_pylist(), b["html"].to_pylist()):
                if h:
                    root = parse(h)
                    hosts.append(host_of(u))
                    pages_.append(hash_subtrees(root))
                    own = sorted({(0, ANY), *((e.hash, need) for e, need in removable(root))})  # 0 counts the host's pages
                    found.append([x for x, _ in own])
                    needs.append([x for _, x in own])
            columns = [pa.array(hosts, pa.string()), pa.array(pages_, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(needs, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "page", "found", "needs"])

    seen = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(rows, "host string, page long, found array<long>, needs array<byte>")
    each = seen.select("host", "page", F.inline(F.arrays_zip("found", "needs"))).toDF("host", "page", "subtree", "need").distinct()
    counts = stored(each.groupBy("host", "subtree", "need").count().where(F.col("count") >= min_pages), "subtree-counts")
    totals = counts.where("subtree = 0").select("host", F.col("count").alias("total"))
    enough = F.when(F.col("need") == ANY, F.col("count") >= F.col("total") * min_share).otherwise(F.col("count") > F.col("total") * block_share)
    often = counts.where("subtree <> 0").join(totals, "host").where(enough)
    lists = [F.collect_list(F.when(F.col("need") == EDGE if short else F.col("need") != EDGE, F.col("subtree"))) for short in (False, True)]
    return often.groupBy("host").agg(lists[0].alias("_templates"), lists[1].alias("_short"))


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_pages: int = 5, min_share: float = 0.1, block_share: float = 0.5) -> DataFrame:
    """Per page: the id, the url and `text`, its main text ('' for null or empty html, or if nothing remains).

    Repeated rows repeat. Pages without a readable host form one host of their own.
    """
    bounded_batches(pages.sparkSession)
    templates = stored(template_subtrees(pages, url, html, min_pages, min_share, block_share), "templates")
    total = templates.agg(F.coalesce(F.sum(F.size("_templates") + F.size("_short")), F.lit(0))).first()[0]
    own = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = own.withColumn("host", host).join(F.broadcast(templates) if total <= BROADCAST_SUBTREES else templates, "host", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts = []
            for h, templates, short in zip(*(b[c].to_pylist() for c in ("html", "_templates", "_short"))):
                if not h:
                    texts.append("")
                    continue
                root = parse(h)
                if templates or short:
                    hash_subtrees(root)
                (main, marked), templates = main_element(root), frozenset(templates or ())
                texts.append(text_of(main, templates, at_edges(main, templates, frozenset(short)) if short and not marked else ()))
            yield pa.RecordBatch.from_arrays([b["id"], b["url"], pa.array(texts, pa.string())], ["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.drop("host").mapInArrow(rows, f"id {kind}, url string, text string").withColumnsRenamed({"id": id_col, "url": url})
