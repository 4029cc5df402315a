"""Main text of web pages by site template removal.

1. Each page is parsed once into its text blocks.  Elements that never hold
   the article (scripts, menus, forms and the like, by tag, role or class) are
   left out, and where the page marks its article or main part, only that part
   is kept.  Every block carries the hashes of the element subtrees around it.
2. Spark counts, per host, the different pages on which a subtree occurs; pages
   with equal content count once, so copies of an article are not a template.
3. A subtree on at least ``min_pages`` different pages and on ``ratio`` of all
   different pages of its host is template: its blocks are deleted.

White space in a block becomes one space, blocks are trimmed and joined by
``\\n`` in page order; ``<br>`` is white space.

Defined cases: a null or empty page has the empty text; malformed markup is
read as far as it goes (an unclosed element ends with its parent, an unclosed
comment or tag takes the rest); a null or unparsable url belongs to no host and
loses nothing to templates; repeated rows and ids get equal results; an empty table
gives no rows; a very long page is parsed whole.  Columns other than page_id, url
and html are never looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from html import unescape
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsdrift.session import materialize

MIN_PAGES = 8
RATIO = 0.5

BLOCKS = "host string, page_hash long, blocks array<struct<text:string,around:array<long>>>"

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rt rp s samp small "
    "span strike strong sub sup time tt u var wbr".split())
# elements that never hold the article
DROPPED = RAW | frozenset(
    "head nav footer aside form button select option datalist fieldset legend label input object canvas audio video "
    "dialog menu menuitem map applet embed".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar "
    "tablist".split())
# words of a class or id that name such parts
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adunit sponsor sponsored promo "
    "promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer header masthead "
    "topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations comment comments commentlist disqus replies reply "
    "respond widget widgets toolbar pagination pager search form alert paywall".split())
NEGATED = frozenset("no has with without".split())
READERS = frozenset("comment comments commentlist reply replies".split())
KEPT_CONTAINERS = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# a start tag on the left ends an open element on the right
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
SCOPE = frozenset("ul ol dl table article main section div body html td th blockquote".split())


def host_of(url: str | None) -> str | None:
    try:
        return (urlsplit(url).hostname or None) if url else None
    except ValueError:
        return None


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v[1:-1] if v[:1] in "\"'" else v) for k, v in ATTRIBUTE.findall(text)}


def _class_words(attributes: dict[str, str]) -> set[str]:
    out = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        before = ""
        for w in WORD.findall(name):
            w = w.lower()
            if before not in NEGATED:
                out.add(w)
            before = w
    return out


def _unwanted(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element never holds the article; ``inside``: it stands in an
    article or main element, whose own header holds the title.  There, and for
    the article itself, only a whole class token names a part; a heading's id is
    made of its text, and inline elements are parts of sentences."""
    if tag in DROPPED:
        return True
    if tag == "header":
        return not inside
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(
            r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if tag in ("html", "body"):
        return False
    if attributes.get("role", "").lower() in ROLES:
        return True
    classes = set(attributes.get("class", "").lower().split())
    if tag in KEPT_CONTAINERS:
        return bool(classes & READERS)
    if tag in HEADINGS:
        return not inside and bool(_class_words({"class": attributes.get("class", "")}) & NAMED)
    if inside:
        return tag not in INLINE and bool(classes & NAMED - {"header"})
    return bool(_class_words(attributes) & NAMED)


class _Node:
    __slots__ = ("tag", "parent", "drop", "inside", "digest", "in_header")

    def __init__(self, tag: str, parent: "_Node | None", drop: bool, inside: bool, in_header: bool):
        self.tag, self.parent, self.drop, self.inside, self.in_header = tag, parent, drop, inside, in_header
        self.digest = hashlib.blake2b(tag.encode(), digest_size=8)


def parse(html: str | None) -> list[tuple[str, list[_Node]]]:
    """Text blocks with the block-level elements around each, outermost first,
    nodes' digests complete.  Blocks outside the article are left out if the
    page has one."""
    html = html or ""
    node = root = _Node("", None, False, False, False)
    blocks: list[tuple[str, _Node]] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            n = node
            while n.tag in INLINE:
                n = n.parent
            blocks.append((text, n))
            while n is not None:  # a subtree's hash covers all text below it, in order
                n.digest.update(b"\0" + text.encode("utf-8", "surrogatepass"))
                n = n.parent

    def close(to: _Node) -> None:
        nonlocal node
        n = node
        while n is not to:
            if n.tag not in INLINE:
                node = n
                flush()
                break
            n = n.parent
        node = to

    at, end = 0, len(html)
    while m := TOKEN.search(html, at):  # from the end of raw text on
        if m.start() > at and not node.drop:
            run.append(unescape(html[at:m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            n = node
            while n is not None and n.tag != tag:
                n = n.parent
            if n is not None and n is not root:
                if tag not in INLINE:
                    flush()
                node = n.parent
            continue
        if tag == "br":
            if not node.drop:
                run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = closing.end() if closing else end
            continue
        if tag not in INLINE:
            flush()
            n = node
            while n is not root and n.tag not in SCOPE:
                if n.tag == "p":  # a block ends an open paragraph
                    node = n.parent
                    break
                n = n.parent
            ends, n = ENDS.get(tag, ()), node
            while n is not root and (n.tag in ends or n.tag not in SCOPE):
                if n.tag in ends:
                    node = n.parent
                    break
                n = n.parent
        attributes = _attributes(m[3]) if m[3] else {}
        drop = node.drop or _unwanted(tag, attributes, node.inside)
        inside = node.inside or tag in ("article", "main") or attributes.get("role") == "main"
        header = node.in_header or (tag == "header" and node.inside)
        node = _Node(tag, node, drop, inside, header)
    if at < end and not node.drop:
        run.append(unescape(html[at:]))
    flush()
    kept = []
    for text, n in blocks:
        if n.in_header and not _within(n, HEADINGS):
            continue
        if not n.drop:
            kept.append((text, n))
    for part in (("article",), ("main",)):
        marked = [(t, n) for t, n in kept if _within(n, part)]
        if marked:
            kept = marked
            break
    else:
        marked = [(t, n) for t, n in kept if n.inside]
        kept = marked or kept
    return [(t, _around(n)) for t, n in kept]


def _within(n: _Node | None, tags) -> bool:
    while n is not None:
        if n.tag in tags:
            return True
        n = n.parent
    return False


def _around(n: _Node | None) -> list[_Node]:
    out = []
    while n is not None and n.tag:
        if n.tag not in KEPT_CONTAINERS:
            out.append(n)
        n = n.parent
    return out[::-1]


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _parsed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        hosts, hashes, rows = [], [], []
        for url, html in zip(pdf["url"], pdf["html"], strict=True):
            found = parse(html if isinstance(html, str) else None)
            values: dict[int, int] = {}
            out = []
            for text, nodes in found:
                around = []
                for n in nodes:
                    if id(n) not in values:
                        values[id(n)] = int.from_bytes(n.digest.digest(), "little", signed=True)
                    around.append(values[id(n)])
                out.append({"text": text, "around": around})
            hosts.append(host_of(url if isinstance(url, str) else None))
            hashes.append(_digest("\n".join(t for t, _ in found).encode("utf-8", "surrogatepass")))
            rows.append(out)
        yield pdf.drop(columns="html").assign(host=hosts, page_hash=hashes, blocks=rows)


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES, ratio: float = RATIO) -> DataFrame:
    """host and the hashes of its template subtrees: fewer than (subtrees per
    page) / ratio for any host."""
    different = parsed.where("host is not null").groupBy("host", "page_hash").agg(
        F.first(F.array_distinct(F.flatten(F.transform("blocks", lambda b: b["around"])))).alias("subtrees"))
    counts = different.select("host", F.explode(F.concat(
        F.array(F.lit(None).cast("long")), "subtrees")).alias("subtree")).groupBy("host", "subtree").agg(
        F.count("*").alias("pages"))
    total = counts.where("subtree is null").select("host", F.col("pages").alias("host_pages"))
    return counts.where(F.col("subtree").isNotNull() & (F.col("pages") >= min_pages)).join(total, "host").where(
        F.col("pages") >= F.col("host_pages") * F.lit(ratio)).groupBy(F.col("host").alias("t_host")).agg(
        F.collect_list("subtree").alias("template"))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, ratio: float = RATIO) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``."""
    kind = dict(pages.dtypes)["page_id"]
    parsed = materialize(pages.select("page_id", "url", "html").mapInPandas(
        _parsed, f"page_id {kind}, url string, {BLOCKS}"), "page-blocks")
    known = materialize(templates(parsed, min_pages, ratio), "templates")
    none = F.array().cast("array<bigint>")
    joined = parsed.join(known, F.col("host") == F.col("t_host"), "left")
    kept = F.filter("blocks", lambda b: ~F.arrays_overlap(b["around"], F.coalesce("template", none)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
