"""Main text of web pages by removal of what a site repeats.

1. A tolerant parser turns a page into block elements; each element subtree gets
   a digest of its tags and text (bottom up, so the work is linear), joined with
   the host.  An ``article`` (else ``main``) is the page's main region: its
   subtrees, and those around it, are never candidates.
2. Spark counts, for every subtree digest, the pages of the host that hold it.
   Copies of one page count once: pages are told apart by their longest block, and
   a subtree that holds this block is no candidate on that page.
3. Subtrees that recur on at least ``min_pages`` pages and ``min_share`` of the
   host's pages are site templates.  Their digests are joined to the pages that
   hold them, which are parsed again: template subtrees go first, then what a page
   itself marks as something else than text (``nav``, ``footer``, ``aside``,
   ``form``, scripts, or a class, id or role that says so; comments on an article).
   The marks serve small hosts, on which nothing recurs often enough.

What is left are the blocks in page order: character references decoded, white
space turned into one space, trimmed, joined by line ends.  A ``br`` ends a block.

Shuffled are digests, and every page once.  A page is handled alone in memory, in
a small multiple of its size; no host is gathered anywhere.

Defined results: null or empty html has the empty text; a null or odd url is of no
host, so only marks apply; repeated rows share their decisions and all stay; an
empty table gives an empty result; other columns are kept by :func:`main_text`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from html import unescape

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import arrow_map, read_table, text_bytes, written

MIN_PAGES = 5
MIN_SHARE = 0.001

#: Fixed values of HTML: elements without content, with raw text, and with blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
BLOCK = set("""html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre
    search section summary table tbody td tfoot th thead tr caption ul head noscript template button select svg
    object audio video canvas script style title textarea xmp iframe noembed noframes""".split())
#: Elements that a start tag of these kinds ends, and the ones it does not look beyond.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
NO_P_END = set("option optgroup legend summary caption tbody td tfoot th thead tr script style title textarea xmp iframe noembed "
               "noframes button select svg object audio video canvas noscript template".split())
HEAD = set("head script style title noscript template".split())
P_SCOPE = set("html table td th caption button object template article section div body".split())

#: Elements that hold no running text, and words of a class, id or role that say so.
NO_TEXT = set("""nav footer aside form head script style title textarea xmp iframe noembed noframes noscript template
    button select svg object audio video canvas dialog menu search""".split())
MARKS = set("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer contentinfo complementary
    sidebar aside widget related recommended cookie cookies consent gdpr notice notices alert disclaimer popup modal
    newsletter subscribe subscription signup login search share sharing social comment comments respond reply replies
    disqus form toolbar skip""".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?|"
                   r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)[^>]*>", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HOST = re.compile(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)")


class Element:
    __slots__ = ("tag", "parent", "marked", "off", "main", "parts", "digest", "inside", "around", "top")

    def __init__(self, tag: str, parent: Element | None, marked: bool, main: bool):
        self.tag, self.parent, self.marked, self.main = tag, parent, marked, main
        self.parts: list[bytes] = []
        self.digest = 0
        self.inside = self.around = self.top = self.off = False


def _marked(tag: str, attrs: str) -> tuple[bool, bool]:
    """Does a start tag say that the element is no text; is it a main region?"""
    no_text, main = tag in NO_TEXT, tag == "main"
    if attrs and not attrs.isspace():
        for name, value in ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "role" and value.lower() == "main":
                main = True
            elif name in ("class", "id", "role"):
                no_text = no_text or any(w.lower() in MARKS for w in WORDS.findall(value))
            elif name == "hidden":
                no_text = True
    return no_text and tag not in ("html", "body", "main"), main


def parse(html: str, site: bytes = b"") -> tuple[list[Element], list[tuple[str, Element, int]]]:
    """Block elements of a page, and its blocks (text, element, digest) in order.
    ``site`` goes into every digest."""
    root = Element("", None, False, False)
    elements, blocks = [], []
    stack: list[Element] = [root]
    run: list[str] = []             # raw text of the block under way

    def flush() -> None:
        if run:
            text = " ".join(unescape("".join(run)).split())
            run.clear()
            if text:
                raw = text.encode()
                stack[-1].parts.append(raw)
                blocks.append((text, stack[-1], xxhash.xxh64_intdigest(site + b"\0" + raw) - 2**63))

    def close(n: int) -> None:
        flush()
        while len(stack) > n:
            e = stack.pop()
            if e.parts:
                body = b"\x01".join(e.parts)
                e.digest = xxhash.xxh64_intdigest(site + e.tag.encode() + b"\0" + body) - 2**63
                stack[-1].parts.append(b"\x02" + e.digest.to_bytes(8, "big", signed=True))

    def end_open(tags: set[str], scope: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return close(i)
            if stack[i].tag in scope:
                return None

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            run.append(html[at:])
            break
        if m.start() > at:
            run.append(html[at:m.start()])
        at = m.end()
        name = m.group(2) or m.group(4)
        if name is None:
            if m.group().startswith("<![CDATA["):
                run.append(m.group()[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = name.lower()
        if m.group(1):
            if tag not in BLOCK:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag == "br":
            flush()
            continue
        if tag not in BLOCK:
            continue
        flush()
        if stack[-1].tag == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag in ENDS:
            end_open(*ENDS[tag])
        if tag not in NO_P_END:
            end_open({"p"}, P_SCOPE)
        if tag in VOID:
            continue
        marked, main = _marked(tag, m.group(3) or "")
        e = Element(tag, stack[-1], marked, main)
        elements.append(e)
        if tag in RAW:          # its content is no text of the page, and up to its end tag no markup
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else size
            continue
        stack.append(e)
    close(1)
    _regions(elements)
    return elements, blocks


def _regions(elements: list[Element]) -> None:
    """Sets ``inside`` and ``around`` for main regions: the articles outside marked
    elements, else ``main``, else any article; and ``off`` for what is no text by
    the page's own marks.  An article in an article is a comment on it, a header
    outside the main region is the page's."""
    def above(e: Element) -> Iterable[Element]:
        while (e := e.parent) is not None:
            yield e

    articles = [e for e in elements if e.tag == "article" and not any(p.tag == "article" for p in above(e))]
    free = [e for e in articles if not any(p.marked for p in above(e))]
    mains = [e for e in elements if e.main and not any(p.main for p in above(e))]
    for e in free or mains or articles:
        e.top, e.marked = True, False
        for p in above(e):
            p.around, p.marked = True, False
    for e in elements:          # parents come first
        e.inside = e.top or e.parent.inside
        if e.tag == "article" and e.inside and not e.top and any(p.tag == "article" for p in above(e)):
            e.marked = True
        if e.tag == "header" and not e.inside and not e.around:
            e.marked = True
        e.off = e.marked or e.parent.off


def candidates(html: str, site: bytes) -> tuple[int, set[int]]:
    """What tells the page apart (digest of its longest block, that of the main
    region if there is one), and the digests of the subtrees outside the main
    region that do not hold it."""
    _, blocks = parse(html, site)
    if not blocks:
        return 0, set()
    own = max(blocks, key=lambda b: (b[1].inside, not b[1].off, len(b[0])))
    holds, e = set(), own[1]
    while e is not None:
        holds.add(id(e))
        e = e.parent
    found = set()
    for block in blocks:
        _, e, digest = block
        if e.inside:
            continue
        if block is not own and len(e.parts) > 1:
            found.add(digest)
        while e.parent is not None and not e.around and id(e) not in holds:
            found.add(e.digest)
            e = e.parent
    return xxhash.xxh64_intdigest(own[0].encode()) - 2**63, found


def kept_blocks(html: str, site: bytes, template: set[int]) -> tuple[list[str], int]:
    """Blocks that are left, and how many went with template subtrees."""
    kept, cut = [], 0
    for text, e, digest in parse(html, site)[1]:
        in_template = not e.inside and len(e.parts) > 1 and digest in template
        above = e
        while above.parent is not None and not in_template:
            in_template = not above.inside and not above.around and above.digest in template
            above = above.parent
        cut += in_template
        if not in_template and not e.off:
            kept.append(text)
    return kept, cut


def host(url: str | None) -> bytes:
    m = HOST.match(url or "")
    return m.group(1).lower().encode() if m else b""


def _subtrees(batch) -> dict:
    out = {"key": [], "site": [], "page": [], "node": []}
    for key, url, html in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html"))):
        site = host(url)
        if not html or not site:
            continue
        page, found = candidates(html, site)
        of = xxhash.xxh64_intdigest(site) - 2**63
        for node in found:
            out["key"].append(key), out["site"].append(of), out["page"].append(page), out["node"].append(node)
    return out


def site_templates(nodes: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """node and n_pages of the subtrees that recur on many pages of their site."""
    per_site = nodes.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("site_pages"))
    return nodes.select("site", "node", "page").distinct().groupBy("site", "node").agg(F.count("*").alias("n_pages")) \
        .where(F.col("n_pages") >= min_pages).join(per_site, "site") \
        .where(F.col("n_pages") >= F.col("site_pages") * min_share).select("node", "n_pages")


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES,
              min_share: float = MIN_SHARE) -> DataFrame:
    """``row`` (a struct of the page's columns without the html), text and
    n_template_blocks of every page."""
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in pages.columns}
    rest = [v for c, v in quoted.items() if c != html_col]
    url, html = quoted[url_col].cast("string"), quoted[html_col].cast("string")
    # Rows with a map have no hash, so the key is made of what the decisions rest on.
    keyed = pages.select(F.struct(*rest).alias("row"), url.alias("url"), html.alias("html"),
                         F.xxhash64(url, html).alias("key"))
    nodes = written(arrow_map(keyed.select("key", "url", "html"), "key long, site long, page long, node long",
                              lambda: _subtrees), "subtrees")
    cut = nodes.select("key", "node").distinct().join(site_templates(nodes, min_pages, min_share), "node") \
        .groupBy("key").agg(F.collect_set("node").alias("nodes"))

    def pack(batches):
        import pyarrow as pa
        for batch in batches:
            packed = [zlib.compress(h, 1) if h else None for h in text_bytes(batch, "html")]
            yield batch.set_column(batch.schema.get_field_index("html"), "html", pa.array(packed, pa.binary()))

    # Pages are shuffled compressed: Spark's own codec makes them half as small.
    packed = keyed.mapInArrow(pack, StructType([StructField("html", BinaryType()) if f.name == "html" else f
                                                for f in keyed.schema.fields]))
    joined = packed.join(cut, "key", "left").select("row", "url", "html", "nodes")

    def extract(batches):
        import pyarrow as pa
        for batch in batches:
            texts, counts = [], []
            for u, h, nodes_of in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "nodes"))):
                html_of = zlib.decompress(h).decode() if h else ""
                blocks, n = kept_blocks(html_of, host(u), set(nodes_of or ()))
                texts.append("\n".join(blocks))
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                names=["row", "text", "n_template_blocks"])

    schema = StructType([joined.schema["row"], StructField("text", StringType()),
                         StructField("n_template_blocks", LongType())])
    return joined.mapInArrow(extract, schema)


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"),
                                   "n_template_blocks")
