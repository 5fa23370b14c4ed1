"""Main text of web pages by a site style tree.

Every page is read into a tree of elements. The trees of a host are merged: elements reached by the
same path of tag, classes and id are one node of the host's style tree. A node's importance comes
from two entropies over the pages of the host, that of its content and that of its presentation
(the sequence of its children), each as a share of the entropy of whole pages over just the pages
that hold the node; so a site whose articles repeat does not lose them, and a rare node is judged
alike on hosts of any size. A node present on ``MIN_PAGES`` pages or more whose importance
stays below ``LEAST`` is noise, as menus and notices are that repeat from page to page, and its
branch is removed from each page of that host.

Elements that declare a role (navigation, footer, form, a class naming adverts, comments and so on)
are nodes of the tree like all others, and most of them go by their importance. Entropies tell little
on small hosts and nothing against comments and adverts that differ from page to page; so declared
elements that the tree leaves are removed by their role. They count neither as content of the nodes
around them nor of the page, as comments below a copied article would make the copies look different
and the article unimportant. An element that holds an
``article`` or ``main`` is never removed, and when the style tree would leave nothing of a page, only
the declared roles are applied to it.

The tree is merged by counting (host, node, content) and (host, node, style) before and after the
shuffle, so a host with a third of all pages costs no task more than its own rows.

Text: character references are decoded, white space within a block becomes one blank, blocks are
joined by line breaks in page order; a line break element counts as white space. Cases: null html
gives an empty text; markup may be unclosed or cut off; pages without a host share the host ``""``;
repeated rows are extracted each; very long pages are read whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as markup
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellstat.llm import common
from dwellstat.llm.common import written

#: Least number of pages of a host for a node to be judged by entropy.
MIN_PAGES = 10
#: Nodes less important than this are noise.
LEAST = 0.4
#: Elements nested deeper than this become siblings; their text stays.
DEEPEST = 3000

_MAIN = {"article", "main"}
#: Elements that hold no text for readers.
_TECHNICAL = set("head title script style noscript template iframe object svg canvas math audio video datalist noembed noframes xmp".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
              "strong sub sup time tt u var wbr nobr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
_DROPPED = set("head title script style noscript template iframe object svg canvas math audio video button select textarea datalist "
               "nav footer aside form menu dialog noembed noframes xmp".split())
_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|banners?|sponsor(?:ed)?|promos?|promotions?|cookies?|consent|gdpr|notices?|alerts?|"
    r"comments?|disqus|sidebars?|nav|navbar|navigation|menus?|breadcrumbs?|footers?|share|sharing|social|related|recommended|subscribe|"
    r"subscription|newsletters?|signup|login|popups?|modals?|pagination|pager|toolbar|skip)(?:$|[\s_-])", re.I)
_PAGE_HEAD = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
#: A new element of these kinds ends an open one of the second kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPES = {"table", "ul", "ol", "dl", "article", "main", "section", "div", "body", "html", "aside", "nav", "footer", "header", "form"}
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

common.by_value(__name__)


class Node:
    """An element: its tag, its key among siblings, and its children, texts included, in order."""

    __slots__ = ("tag", "key", "names", "role", "children", "holds_main")

    def __init__(self, tag: str, names: str, role: str) -> None:
        self.tag, self.names, self.role = tag, names, role
        self.key = f"{tag}.{names}" if names else tag
        self.children: list = []
        self.holds_main = False


def parse(page: str) -> Node:
    """The element tree of a page; unclosed elements end with their parent."""
    root = Node("html", "", "")
    stack, at, size = [root], 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            rest = page[at:]
            cut = re.search(r"<[A-Za-z/!][^>]*\Z", rest)  # a tag cut off by the end of the page
            stack[-1].children.append(rest[:cut.start()] if cut else rest)
            break
        if found.start() > at:
            stack[-1].children.append(page[at:found.start()])
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ("html", "body"):  # attributes of the page itself say nothing about its parts
            if tag == "body" and any(n.tag == "head" for n in stack):
                del stack[1:]
            continue
        if tag not in _INLINE:
            _close_open(stack, {"p"})
        if tag in _CLOSES:
            _close_open(stack, _CLOSES[tag])
        names = role = ""
        if attributes and "=" in attributes:
            values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            names = " ".join(sorted({re.sub(r"\d+", "0", x) for x in f"{values.get('class', '')} {values.get('id', '')}".split()}))
            role = values.get("role", "").lower()
        node = Node(tag, names, role)
        stack[-1].children.append(node)
        if tag in _MAIN or role == "main":
            for above in stack:
                above.holds_main = True
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in _VOID and not attributes.endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    return root


def _close_open(stack: list[Node], tags: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in _SCOPES:
            return


def declared_noise(node: Node, inside_main: bool) -> bool:
    """Whether the element says that it is not part of the article."""
    if node.holds_main or node.tag in _MAIN or node.role == "main":
        return False
    if node.tag in _DROPPED or node.role in _ROLES:
        return True
    if not inside_main and (node.tag == "header" or _PAGE_HEAD.search(node.names)):
        return True
    return bool(node.names and _NOISE.search(node.names))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def style_rows(page: str) -> list[tuple[int, int, int, int]]:
    """(node, content, style, page content) hashes of a page's nodes with text; the whole page is node 0.

    Elements of equal path are one node. A declared element is a node of its own, never the same as an
    undeclared one, and no content of others.
    """
    texts: dict[str, list[str]] = {}
    styles: dict[str, list[str]] = {}

    def walk(node: Node, path: str, inside: bool) -> str:
        parts, keys = [], []
        for child in node.children:
            if isinstance(child, str):
                parts.append(child)
            elif declared_noise(child, inside):
                if child.tag not in _TECHNICAL:
                    walk(child, f"{path}/!{child.key}", inside)
            else:
                if not keys or keys[-1] != child.key:
                    keys.append(child.key)
                parts.append(walk(child, f"{path}/{child.key}", inside or child.tag in _MAIN))
        text = " ".join(" ".join(parts).split())
        if text:
            texts.setdefault(path, []).append(text)
            styles.setdefault(path, []).append(">".join(keys))
        return text

    _deep(walk, parse(page), "", False)
    whole = _digest("\n".join(texts.get("", [])))
    return [(_digest(path), _digest("\n".join(own)), _digest("\n".join(styles[path])), whole) if path else (0, whole, _digest("\n".join(styles[path])), whole)
            for path, own in texts.items()]


def _deep(walk, node: Node, *rest):
    """Calls a recursive walk with room for ``DEEPEST`` nested elements."""
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(max(old, 4 * DEEPEST))
    try:
        return walk(node, *rest)
    finally:
        sys.setrecursionlimit(old)


def text_of(page: str, noise: frozenset[int] | set[int] = frozenset(), roles: bool = True) -> str:
    """The page's text without the style tree nodes in ``noise`` and, with ``roles``, without declared noise."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        line = " ".join(markup.unescape("".join(held)).split())
        if line:
            blocks.append(line)
        held.clear()

    def walk(node: Node, path: str, inside: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                held.append(child)
                continue
            declared = declared_noise(child, inside)
            if declared and (roles or child.tag in _TECHNICAL):
                if child.tag not in _INLINE:
                    flush()
                continue
            here = f"{path}/!{child.key}" if declared else f"{path}/{child.key}"
            main = child.holds_main or child.tag in _MAIN
            if noise and not main and _digest(here) in noise:
                if child.tag not in _INLINE:
                    flush()
                continue
            block = child.tag not in _INLINE
            if block:
                flush()
            elif child.tag == "br":
                held.append(" ")
            walk(child, here, inside or child.tag in _MAIN)
            if block:
                flush()

    _deep(walk, parse(page), "", False)
    flush()
    return "\n".join(blocks)


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def site_noise(pages: DataFrame, url: str = "url", html: str = "html", least: float = LEAST) -> DataFrame:
    """(host, noise): the style tree nodes of each host whose importance is low."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, nodes, contents, styles, wholes = [], [], [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for node, content, style, whole in style_rows(page or ""):
                    hosts.append(host)
                    nodes.append(node)
                    contents.append(content)
                    styles.append(style)
                    wholes.append(whole)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int64()), pa.array(contents, pa.int64()),
                                              pa.array(styles, pa.int64()), pa.array(wholes, pa.int64())],
                                             names=["host", "node", "content", "style", "page"])

    tree = pages.select(_host(url).alias("host"), F.col(html).alias("html")).mapInArrow(
        rows, "host string, node long, content long, style long, page long")
    facets = tree.where("node <> 0").select("host", "node", F.explode(F.array(*[
        F.struct(F.lit(k).alias("facet"), F.col(k).alias("value")) for k in ("content", "style", "page")])).alias("x")).select("host", "node", "x.facet", "x.value")
    counts = facets.groupBy("host", "node", "facet", "value").agg(F.count("*").cast("double").alias("n"))
    spread = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    entropy = counts.groupBy("host", "node", "facet").agg(F.sum("n").alias("pages"), spread.alias("entropy"))
    whole = F.col("facet") == "page"
    nodes = written(entropy.groupBy("host", "node").agg(
        F.max("pages").alias("pages"), F.max(F.when(~whole, F.col("entropy"))).alias("importance"),
        F.max(F.when(whole, F.col("entropy"))).alias("page_entropy")), "style-tree")
    # equal pages have no entropy but for rounding
    low = nodes.where(f"pages >= {MIN_PAGES} AND page_entropy > 1e-9").where(F.col("importance") < least * F.col("page_entropy"))
    return low.groupBy("host").agg(F.collect_list("node").alias("noise"))


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, noise in zip(batch.column("html").to_pylist(), batch.column("noise").to_pylist(), strict=True):
                text = text_of(page or "", frozenset(noise or ()))
                texts.append(text if text or not noise else text_of(page or ""))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), _host(url).alias("host"))
    joined = rows.join(written(site_noise(pages, url, html), "site-noise"), "host", "left").select("page_id", "url", "html", "noise")
    kinds = dict(pages.dtypes)
    out = joined.mapInArrow(extract, f"page_id {kinds[key]}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
