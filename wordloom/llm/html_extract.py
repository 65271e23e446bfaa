"""HTML extraction by removing site templates.

Elements of a page become nodes over its text pieces. The subtrees that could be furniture (containers, and
outside the article paragraphs too) are hashed, Spark counts for each host on how many different pages a
hash occurs, and subtrees that recur on many pages of their host are deleted, with the elements whose tag,
role, class or id says that they are furniture. What is left of the article (or main, or body) is the text.

Only 64-bit hashes are shuffled, never pages. The recurring hashes of a host are few by construction (each
is on a fixed share of its pages), so they come to a page as one array; the table of arrays is broadcast
only up to ``broadcast_hashes`` hashes in all and joined by shuffling beyond that.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .url_filter import host_of

# Element names and words of HTML practice, in no order that matters.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg object audio video canvas".split())
FURNITURE = frozenset("head nav footer aside form button select option dialog menu fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
KEPT_INSIDE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr tbody thead".split()) | INLINE
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIBLING_WALLS = ("ul", "ol", "dl", "table", "select", "article", "main", "body")
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|popup|modal|overlay|sidebar|side-?bar|widgets?|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|respond|repl(?:y|ies)|disqus|shar(?:e|ing)|social|related|recommended|pagination|pager|skip|login|signup|search|toolbar|toc|hidden)(?:$|[\s_-]|\d)", re.I)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|topbar|site-?title)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)", re.S)
_IN_TAG = re.compile(r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")


class Node:
    __slots__ = ("tag", "parent", "start", "end", "drop", "named", "names", "inside")

    def __init__(self, tag: str, parent: Node | None, start: int, attrs: str) -> None:
        self.tag, self.parent, self.start, self.end, self.drop, self.names = tag, parent, start, -1, tag in FURNITURE, ""
        self.named, self.inside = False, parent is not None and (parent.inside or parent.tag in ("article", "main"))
        if attrs and not attrs.isspace():
            a = {(k or alone).lower(): v1 or v2 or v3 for k, v1, v2, v3, alone in _ATTR.findall(attrs)}
            self.names = f"{a.get('class', '')} {a.get('id', '')}"
            shown = a.get("style", "").replace(" ", "").lower()
            self.drop |= a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in shown or "visibility:hidden" in shown
            if tag not in ("html", "body", "article", "main"):
                self.named = bool(NAMES.search(self.names))
            elif tag == "article":
                self.drop |= bool(re.search(r"comment|reply|related|promo|sponsor", self.names, re.I))
            if a.get("role", "").lower() == "main":
                self.tag = "main"


def parse(html: str) -> tuple[list[str], list[Node]]:
    """(text pieces in page order, nodes); a piece of one space stands for the edge of a block."""
    pieces, nodes, stack, at = [], [], [], 0
    root = Node("#", None, 0, "")
    stack.append(root)
    # places in the stack of the open elements by tag, and of those that stop a block from closing a paragraph:
    # what an end tag or a sibling closes is found without walking the stack
    places, walls = defaultdict(list), []
    quotes = True  # until one is never closed

    def close(k: int) -> None:
        while len(stack) > k:
            stack[-1].end = len(pieces)
            places[stack.pop().tag].pop() if len(stack) > 1 else stack.pop()
            if walls and walls[-1] >= len(stack):
                walls.pop()

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            pieces.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        until = _IN_TAG.match(html, at).end() if quotes else html.find(">", at)
        if quotes and html[until : until + 1] not in ("<", ">"):
            quotes, until = False, html.find(">", at)
        if until < 0 or html[until] == "<" or (not quotes and html.find("<", at, until) >= 0):
            # no tag: a plain less-than sign
            pieces.append("<")
            at = m.start() + 1
            continue
        inner, at = html[at:until], until + 1
        tag = m[2].lower()
        if m[1]:
            if k := innermost((tag, "main") if tag in ("div", "section") else (tag,)):
                if tag not in INLINE:
                    pieces.append(" ")
                close(k)
            continue
        if tag in RAW:
            pieces.append(" ") if tag not in ("script", "style", "template") else None
            if not inner.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag not in INLINE:
            if tag != "wbr":
                pieces.append(" ")
            if tag not in VOID or tag == "hr":
                if walls and stack[walls[-1]].tag in CLOSED_BY_BLOCK:
                    close(walls[-1])
            if tag in SIBLINGS and (k := innermost(SIBLINGS[tag])) and k >= innermost(SIBLING_WALLS):
                close(k)
        if tag in VOID:
            continue
        node = Node(tag, stack[-1], len(pieces), inner)
        nodes.append(node)
        places[node.tag].append(len(stack))
        if node.tag in CLOSED_BY_BLOCK or node.tag not in INLINE:
            walls.append(len(stack))
        stack.append(node)
    close(0)
    titles = [x.start for x in nodes if x.tag == "h1"]
    for n in nodes:
        if n.tag == "header" or HEADER_NAMES.search(n.names):
            k = bisect_left(titles, n.start)
            n.drop |= not (n.inside and k < len(titles) and titles[k] < n.end)
    # a wrapper that holds main, or the only article, is no furniture whatever its name says
    mains = [x.start for x in nodes if x.tag == "main" and not x.drop]
    articles = [x.start for x in nodes if x.tag == "article" and not x.drop]
    held = sorted(mains + (articles if len(articles) == 1 else []))
    for n in nodes:
        if n.named:
            k = bisect_left(held, n.start)
            n.drop |= n.inside or k == len(held) or held[k] >= n.end
    return pieces, nodes


def subtree_hashes(pieces: list[str], nodes: list[Node]) -> dict[int, int]:
    """Signed 64-bit hash of each subtree that may be furniture, by its place in ``nodes``.

    A subtree is its tag, its own text and the hashes of its children, in order, so nested ones cost what their
    own text does. Attributes are left out: a menu marks the page it is on by a class.
    """
    out, content, last = {}, [[] for _ in nodes], {id(n): k for k, n in enumerate(nodes)}
    for k in range(len(nodes) - 1, -1, -1):
        n, at, own, seen = nodes[k], nodes[k].start, [], False
        # children come in reverse order
        for start, end, digest in [*reversed(content[k]), (n.end, n.end, None)]:
            text = " ".join("".join(pieces[at:start]).split())
            seen |= bool(text) or digest is not None
            own += [text] if text else []
            own += [f"<{digest:x}>"] if digest is not None else []
            at = end
        content[k] = None
        h = xxhash.xxh64_intdigest("|".join((n.tag, *own)).encode("utf-8", "surrogatepass")) if seen else None
        parent = last.get(id(n.parent))
        if parent is not None:
            content[parent].append((n.start, n.end, h))
        if h is None or n.tag in ("html", "body", "main", "article", "head") or n.tag in INLINE or (n.tag in KEPT_INSIDE and n.inside):
            continue
        out[k] = h - (1 << 64) if h >> 63 else h
    return out


def main_text(pieces: list[str], nodes: list[Node], recurring: set[int]) -> str:
    """The text left of the article, else of main, else of the page."""
    gone = bytearray(len(pieces))
    hashes = subtree_hashes(pieces, nodes) if recurring else {}
    for k, n in enumerate(nodes):
        if n.drop or hashes.get(k) in recurring:
            gone[n.start : n.end] = b"\x01" * (n.end - n.start)
    for tag in ("article", "main", None):
        keep = bytearray(len(pieces)) if tag else bytearray(b"\x01" * len(pieces))
        for n in nodes if tag else ():
            if n.tag == tag:
                keep[n.start : n.end] = b"\x01" * (n.end - n.start)
        text = " ".join("".join(x if k and not g else " " if x == " " else "" for x, k, g in zip(pieces, keep, gone, strict=True)).split())
        if text:
            return text
    return ""


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", share: float = 0.3, least_pages: int = 4, broadcast_hashes: int = 1_000_000) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row's whole html.

    A subtree recurs if it is on at least ``least_pages`` different pages of its host and on ``share`` of
    them; equal pages count once, so copies of a page do not make its article a template. Null and empty
    html give empty text; a null url has the host "". Repeated rows are each extracted.
    """
    spark = pages.sparkSession
    small_batches(spark)

    def hashes(batches):
        for b in batches:
            host, page, sub = [], [], []
            for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key = xxhash.xxh64_intdigest((x or "").encode("utf-8", "surrogatepass")) >> 1
                own = {0, *subtree_hashes(*parse(x or "")).values()}
                host += [h] * len(own)
                page += [key] * len(own)
                sub += own
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(sub, pa.int64())], names=["host", "page", "sub"])

    host = F.coalesce(host_of(F.col(url)), F.lit(""))
    seen = pages.select(host.alias("host"), F.col(html).alias("html")).mapInArrow(hashes, "host string, page long, sub long")
    counts = seen.distinct().groupBy("host", "sub").count().where(F.col("count") >= least_pages)
    counts = materialise(counts, "subtrees")
    total = counts.where("sub = 0").select("host", F.col("count").alias("pages"))
    often = counts.where("sub <> 0").join(total, "host").where(F.col("count") >= share * F.col("pages"))
    often = materialise(often.groupBy("host").agg(F.collect_set("sub").alias("recurring")), "templates")
    size = often.agg(F.coalesce(F.sum(F.size("recurring")), F.lit(0))).first()[0]
    joined = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    joined = joined.join(F.broadcast(often) if size <= broadcast_hashes else often, "host", "left").select("page_id", "url", "html", "recurring")

    def extract(batches):
        for b in batches:
            texts = [main_text(*parse(x or ""), set(r or ())) for x, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = {f.name: f.dataType.simpleString() for f in joined.schema}
    out = joined.mapInArrow(extract, f"page_id {kind['page_id']}, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
