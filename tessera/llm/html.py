"""Main text of web pages (operator 7) by consensus paths of hosts.

A page is read as blocks of text, each under a chain of elements.  The generalised path of an element is its ancestors' tags and
classes, digits written as #.  Menus, headers, footers, sidebars, notices, adverts, forms, comments and what is hidden
never count.  Containers are scored by their share of the page's text (less that of links): from the body, the search
goes down while one child holds all of it, so that no heading or lead beside a body is left out, or while the child is an article or
main element with most of it, and ends at an article.  Each page votes for the path of its container with its characters; Spark adds
the votes by host, and pages are read again with the winning path of their host: what a page alone can't tell from its article,
as an unmarked box, the other pages of the host can.  A page without such an element keeps its own container.

Pages meet the winners without a shuffle of their html: winners of up to BROADCAST bytes (checked) are broadcast; more are joined, each
host's pages dealt to SALTS tasks.

Defined results: null, empty and text-less pages have empty text; a null or odd url belongs to the host ''; of paths with equal
votes the last in order wins; very long pages are read whole; repeated rows vote and are extracted like others; an empty table
gives an empty result; other columns pass if named in `keep`.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, table, written

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
#: Elements without content, of raw content, that part blocks, and that may be containers.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINER = frozenset("article body center dd div dl main ol section table tbody td ul".split())
#: What is no part of an article, as elements, roles and words of class names and ids.
NOISE = frozenset("nav header footer aside form button select option menu dialog svg canvas object audio video figure-nav head".split())
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NOISE_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-nav comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
)
#: An open element that a new one of the kind closes, up to the element that bounds the search.
CLOSES = {"p": "p", "li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}
SHARE = 0.6
#: Bytes of winning paths that are broadcast at most, and tasks that a host's pages are dealt to beyond.
BROADCAST, SALTS = 16 << 20, 64
SPLIT = re.compile(r"[^a-z0-9]+")


class Element:
    __slots__ = ("tag", "path", "noise", "link", "up", "mass", "container")

    def __init__(self, tag: str, path: str, noise: bool, link: bool, up: Element | None):
        self.tag, self.path, self.noise, self.link, self.up = tag, path, noise, link, up
        self.mass = 0
        self.container = self if tag in CONTAINER or up is None else up.container


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def _opened(tag: str, raw: str, up: Element) -> Element:
    at = _attributes(raw) if raw and not raw.isspace() else {}
    names = f"{at.get('class', '')} {at.get('id', '')}".lower()
    noise = (
        up.noise
        or tag in NOISE
        or "hidden" in at
        or at.get("aria-hidden") == "true"
        or at.get("role", "").lower() in NOISE_ROLE
        or "display:none" in at.get("style", "").replace(" ", "").lower()
        or (tag not in ("body", "html", "article", "main") and not NOISE_WORD.isdisjoint(SPLIT.split(names)))
    )
    classes = ".".join(sorted(re.sub(r"\d+", "#", c) for c in at.get("class", "").lower().split()))
    path = f"{up.path}>{tag}.{classes}" if classes else f"{up.path}>{tag}"
    return Element(tag, path, noise, up.link or tag == "a", up)


def blocks(page: str) -> list[tuple[str, Element]]:
    """(text, element) of each piece of text outside of raw elements, and ("", element) where a block ends, in page order."""
    root = Element("", "", False, False, None)
    top, out, at = root, [], 0
    while at < len(page):
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            out.append((text, top))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            one = top
            while one.up is not None and one.tag != tag:
                one = one.up
            if one.up is not None:
                top = one.up
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            if tag in CLOSES or tag not in INLINE:
                one = top
                wanted = (tag, CLOSES.get(tag, "p")) if tag in CLOSES else ("p",)
                while one.up is not None and one.tag not in wanted and (one.tag in INLINE or one.tag == "p"):
                    one = one.up
                if one.up is not None and one.tag in wanted:
                    top = one.up
            top = _opened(tag, m[3] if m[2] else m[6], top)
        if tag not in INLINE:
            out.append(("", top))
    return out


def joined(pieces: Iterator[str]) -> str:
    """Pieces of blocks ("": a block ends), white space as one space, blocks joined by one."""
    return " ".join("".join(p or " " for p in pieces).split())


def main_text(found: list[tuple[str, Element]], path: str | None) -> str:
    def inside(e: Element | None) -> bool:
        while e is not None:
            if e.path == path:
                return True
            e = e.up
        return False

    known: dict[int, bool] = {}
    out = []
    for text, e in found:
        k = id(e)
        if k not in known:
            known[k] = not e.noise and inside(e)
        if known[k] or not text:
            out.append(entities.unescape(text) if text else "")
    return joined(out)


def best(found: list[tuple[str, Element]]) -> tuple[str, int]:
    """Path and text of the container that the search ends at; the text as a number of characters."""
    below: dict[int, list[Element]] = {}
    seen: set[int] = set()
    root = None
    for text, e in found:
        size = 0 if e.noise or not text else len("".join(text.split())) * (0 if e.link else 1)
        c = e.container
        while c is not None:
            c.mass += size
            up = c.up.container if c.up is not None else None
            if id(c) not in seen:
                seen.add(id(c))
                if up is not None:
                    below.setdefault(id(up), []).append(c)
                else:
                    root = c
            c = up
    if root is None:
        return "", 0
    one = root
    while one.tag != "article":
        child = max(below.get(id(one), ()), key=lambda c: c.mass, default=None)
        if child is None or child.mass == 0 or child.tag in ("ul", "ol", "dl", "tbody"):
            break
        if child.mass < one.mass and not (child.tag in ("article", "main") and child.mass >= SHARE * one.mass):
            break
        one = child
    return one.path, one.mass


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: dict[tuple[str, str], int] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            path, mass = best(blocks(page.as_py() or ""))
            if mass:
                held[host, path] = held.get((host, path), 0) + mass
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.string()), pa.array([p for _, p in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["host", "path", "votes"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, path in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = blocks(page.as_py() or "")
            text = main_text(found, path) if path is not None else ""
            texts.append(text or main_text(found, best(found)[0]))
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())], [*batch.schema.names[2:], "text"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def consensus(pages: DataFrame) -> DataFrame:
    """(host, path): the path that most characters of a host's pages vote for."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, votes long")
    return votes.groupBy("host", "path").agg(F.sum("votes").alias("votes")).groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extracted(pages: DataFrame, keep: list[str] | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """pages' columns `keep` with text."""
    kept = Kept(pages, keep or ["page_id", "url"], ("text",))
    rows = pages.select(F.col("html").alias("__html"), host_of(F.col("url")).alias("__host"), F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).alias("__salt"), *kept.columns)
    won = written(consensus(pages), "paths").select(F.col("host").alias("__host"), F.col("path").alias("__path"))
    size = won.agg(F.sum(F.octet_length("__host") + F.octet_length("__path") + 64)).first()[0] or 0
    if size <= broadcast:
        met = rows.join(F.broadcast(won), "__host", "left")
    else:
        met = rows.join(won.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["__host", "__salt"], "left")
    return met.select("__html", "__path", *kept.hidden).mapInArrow(_extracted, f"{kept.kinds}text string").select(*kept.back, "text")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op7_main_text": op7_main_text}
