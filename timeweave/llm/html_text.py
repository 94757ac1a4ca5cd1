"""Main text of web pages: site templates and page furniture go, the article stays.

Pages are read as trees of elements (scripts, styles and comments skipped, open paragraphs and list
items closed as browsers do).  Two rules delete a subtree:

* furniture: elements whose tag, role, class or id says navigation, header, footer, sidebar, notice,
  advert, form or comment;
* site template: containers whose whole subtree (tags, classes and text) hashes to a value that
  occurs on at least ``LEAST_PAGES`` pages and ``LEAST_SHARE`` of the pages of the host.  Subtrees
  are hashed inside one pass over the pages and counted in Spark by (host, hash) with partial
  sums.  Paragraphs, headings and other text elements, and what holds the article, are never
  templates: copies of an article on one host stay whole.

If a page has an article (or main) element that is not furniture, only text inside such elements counts.
The recurring hashes are broadcast if there are at most ``MOST_BROADCAST``; beyond that each page's
own ones are joined to it.

Defined results: a null html is empty; white space is what Python's ``str.split`` takes; an
unfinished tag at the end of a page is dropped; references are decoded as in HTML 5.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.llm.registry import query
from timeweave.llm.tables import read
from timeweave.llm.url_rules import host_of
from timeweave.llm.words import slices

LEAST_PAGES = 10
LEAST_SHARE = 0.05
MOST_BROADCAST = 500_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe"))
DROPPED = RAW | frozenset("head nav header footer aside form button select dialog svg canvas object video audio menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt li td th tr figcaption br img hr".split()) | INLINE
HOLDERS = frozenset(("html", "body", "article", "main"))
CLOSED_BY_BLOCK = frozenset(("p",))
SELF_CLOSING = {"li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}
# Words of a class, id or role that mark furniture.
FURNITURE = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside ad ads adsense adslot advert adverts advertisement advertising sponsor sponsored promo "
    "banner cookie cookies consent notice notices alert popup modal newsletter subscribe signup share sharing social breadcrumb breadcrumbs "
    "comment comments reply replies respond disqus related widget contentinfo complementary search pagination pager toolbar".split()
)
NOT_ARTICLES = frozenset("comment comments reply replies ad ads advert advertisement sponsored related promo".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HAS_ARTICLE = re.compile(r"<(?:article|main)\b", re.I)
PARTS = re.compile(r"[^a-z0-9]+")


class Element:
    __slots__ = ("tag", "gone", "main", "start", "mark", "eligible")

    def __init__(self, tag: str, gone: bool, main: bool, start: int, mark: int, eligible: bool):
        self.tag, self.gone, self.main, self.start, self.mark, self.eligible = tag, gone, main, start, mark, eligible


def read_page(page: str, named_outside: bool = True) -> tuple[list[tuple[str, bool]], list[tuple[int, int, int]]]:
    """Pieces of text outside furniture with whether they are in an article, and hashed containers.

    Without ``named_outside`` classes and ids outside articles say nothing.

    A piece is a text, or a line break where a block begins or ends.  A container is the hash of its
    subtree and the range of pieces it covers.
    """
    pieces: list[tuple[str, bool]] = []
    shapes: list[str] = []  # what subtree hashes are made of: tags, classes and pieces in order
    containers: list[tuple[int, int, int]] = []
    stack: list[Element] = []

    def close(upto: int) -> None:
        while len(stack) > upto:
            element = stack.pop()
            if element.eligible and not element.gone and len(pieces) > element.start:
                containers.append((hash_text("".join(shapes[element.mark:])), element.start, len(pieces)))
            shapes.append(f"</{element.tag}>")
            if element.tag not in INLINE and not element.gone:
                pieces.append(("\n", element.main))

    def text(part: str) -> None:
        gone, main = (stack[-1].gone, stack[-1].main) if stack else (False, False)
        if part and not gone:
            part = references.unescape(part) if "&" in part else part
            pieces.append((part, main))
            shapes.append(part)

    at, raw = 0, None
    for token in TOKEN.finditer(page):
        if token.start() < at:
            continue
        closing, tag = token[1], (token[2] or "").lower()
        if raw and not (closing and tag == raw):
            continue
        text(page[at:token.start()] if not raw else "")
        at = token.end()
        if not tag:
            continue
        if closing:
            raw = None
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if depth is not None:
                close(depth)
            continue
        if tag not in INLINE:
            # A block ends an open paragraph, an item ends the item before it.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in CLOSED_BY_BLOCK or SELF_CLOSING.get(tag) == stack[i].tag:
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        named = "".join(f" {x[2] or x[3] or x[4] or ''}".lower() for x in NAMED.finditer(token[3])) if token[3] else ""
        words = frozenset(PARTS.split(named)) if named else frozenset()
        gone, main = (stack[-1].gone, stack[-1].main) if stack else (False, False)
        if tag in ("article", "main"):
            gone = gone or not words.isdisjoint(NOT_ARTICLES)
            main = True
        elif tag not in HOLDERS:
            gone = gone or tag in DROPPED or (named_outside or main) and not words.isdisjoint(FURNITURE)
        if tag not in INLINE and not gone:
            pieces.append(("\n", main))
        if tag in VOID:
            shapes.append(f"<{tag}>")
            continue
        stack.append(Element(tag, gone, main, len(pieces), len(shapes), tag not in TEXTUAL and tag not in HOLDERS))
        shapes.append(f"<{tag}{named}>")
        if tag in RAW:
            if token[3] and token[3].rstrip().endswith("/"):
                close(len(stack) - 1)
            else:
                raw = tag
    if not raw:
        text(page[at:])
    close(0)
    return pieces, containers


def hash_text(value: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def main_text(page: str | None, recurring) -> str:
    """The text of a page without containers whose hash ``recurring`` holds."""
    pieces, containers = read_page(page or "")
    inside = any(main and part != "\n" and part.strip() for part, main in pieces)
    if not inside and HAS_ARTICLE.search(page or ""):
        # The article may stand in a frame whose class names a sidebar or the like.
        again = read_page(page, named_outside=False)
        inside = any(main and part != "\n" and part.strip() for part, main in again[0])
        pieces, containers = again if inside else (pieces, containers)
    gone = np.zeros(len(pieces) + 1, np.int32)
    for value, start, stop in containers:
        if value in recurring:
            gone[start] += 1
            gone[stop] -= 1
    deleted = np.cumsum(gone) > 0
    return " ".join("".join([part for (part, main), out in zip(pieces, deleted) if (main or not inside) and not out]).split())


def with_host_hash(host: str, value: int) -> int:
    return hash_text(f"{host}\0{value}")


def subtree_hashes(pages: DataFrame) -> DataFrame:
    """(key, hash): for each page its distinct hashed containers, each mixed with the host."""
    def find(batches):
        for batch in slices(batches, "html"):
            keys, hashes = [], []
            for key, host, page in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "html"))):
                own = {with_host_hash(host, value) for value, _, _ in read_page(page or "")[1]}
                keys += [key] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], names=["key", "hash"])

    return pages.select("key", "host", "html").mapInArrow(find, "key long, hash long")


def recurring_hashes(pages: DataFrame) -> DataFrame:
    """(hash): containers that many pages of their host share."""
    def find(batches):
        for batch in slices(batches, "html"):
            hosts, hashes = [], []
            for host, page in zip(*(batch.column(c).to_pylist() for c in ("host", "html"))):
                own = {with_host_hash(host, value) for value, _, _ in read_page(page or "")[1]}
                hosts += [host] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], names=["host", "hash"])

    counts = pages.select("host", "html").mapInArrow(find, "host string, hash long").groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_PAGES)
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(sizes, "host").filter(F.col("n") >= LEAST_SHARE * F.col("pages")).select("hash").distinct()


def extract(pages: DataFrame, url: str = "url", html: str = "html", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """All rows and columns but the html, with ``text``, the main text; a column of that name is replaced."""
    given = pages.drop(*({"text"} - {url, html}))
    work = given.withColumns({"__host": host_of(F.col(url)), "__html": F.col(html)})
    recurring = recurring_hashes(work.select(F.col("__host").alias("host"), F.col("__html").alias("html")))
    found = recurring.limit(most_broadcast + 1).toArrow().column("hash").to_numpy()
    keep = [f for f in given.schema.fields if f.name != html]
    schema = T.StructType([*keep, T.StructField("text", T.StringType())])
    if len(found) <= most_broadcast:
        shared = pages.sparkSession.sparkContext.broadcast(frozenset(found.tolist()))
        work = work.withColumn("__own", F.lit(None).cast("array<long>"))
    else:
        shared = None
        key = F.xxhash64("__host", "__html").alias("key")
        keyed = subtree_hashes(work.select(key, F.col("__host").alias("host"), F.col("__html").alias("html")).distinct())
        own = keyed.join(recurring_hashes(work.select(F.col("__host").alias("host"), F.col("__html").alias("html"))), "hash").groupBy("key").agg(F.collect_set("hash").alias("__own"))
        work = work.withColumn("__key", F.xxhash64("__host", "__html")).join(own, F.col("__key") == F.col("key"), "left").drop("__key", "key")

    class Recurring:
        """Membership of a plain hash of one host."""

        def __init__(self, host: str, hashes):
            self.host, self.hashes = host, hashes

        def __contains__(self, value: int) -> bool:
            return bool(self.hashes) and with_host_hash(self.host, value) in self.hashes

    def run(batches):
        for batch in slices(batches, "__html"):
            texts = []
            for host, page, own in zip(*(batch.column(c).to_pylist() for c in ("__host", "__html", "__own"))):
                texts.append(main_text(page, Recurring(host, shared.value if shared else frozenset(own or ()))))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(texts, pa.string())], names=[*(f.name for f in keep), "text"])

    return work.mapInArrow(run, schema)


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    done = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
