"""Main text of web pages by consensus of each host's pages.

Every page scores its containers (text of the paragraphs in them, links counted against, half of it passed on to the
container around). A container's path is the generalised chain of tags and classes that leads to it, digits left out. In
Spark the pages of a host vote with their scores for paths; then each page is extracted again from its containers on the
host's winning path, or from its own best one where it has none there. Boilerplate inside the winner (``DROP_TAGS``,
``DROP_NAMES``) is left out.

Defined cases: null and empty html give an empty text; a null url is a host of its own, the empty name; broken markup is
read as far as it goes, an unfinished tag at the end is dropped; repeated rows are extracted row by row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Hosts whose winners are broadcast; with more, they are joined by a shuffle, each host's pages in so many parts.
BROADCAST_HOSTS, PARTS = 10_000, 64

MARKUP = re.compile(r"<!--(?:.*?--!?>|.*)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*$", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: HTML element sets.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dd dt td th figcaption div article main section body".split())
#: Elements that are never an article's text.
DROP_TAGS = frozenset("nav footer aside form button select option menu dialog svg object applet audio video canvas head script style noscript template iframe textarea".split())
#: Parts of class names and ids by which this operator knows boilerplate: anywhere, and only outside an article (inside one, a
#: ``post-header`` holds the headline and a ``legal`` paragraph is text).
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar aside widget comment comments disqus respond reply replies "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall subscribe subscription newsletter menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager share sharing related recommended recommendations hidden sr-only".split()
)
OUTSIDE_NAMES = frozenset("banner side notification signup login footer header masthead topbar toolbar social search form skip copyright legal disclaimer".split())
ARTICLE_NAMES = frozenset("article post entry story".split())
LIKELY = frozenset("article content post entry story main body text page".split())
WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    up: int
    names: str
    drop: bool
    #: Number of its generalised path.
    path: int = 0
    #: Inside an article, by element or name.
    article: bool = False
    #: The nearest element that isn't inline, and whether a link lies between.
    block: int = 0
    linked: bool = False
    #: The nearest container, the element itself included.
    box: int = 0
    score: float = 0.0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("#document", -1, "", False)])
    #: (node, text) and (node, None) for a block's edge, in page order
    runs: list[tuple[int, str | None]] = field(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def name_parts(names: str) -> set[str]:
    words = set()
    for one in names.lower().split():
        words.add(one)
        words.update(WORD.findall(one))
    return words


def is_boilerplate(tag: str, names: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in DROP_TAGS or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display:\s*none", attrs.get("style", "")):
        return True
    if attrs.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog"):
        return True
    if tag == "header" and not in_article:
        return True
    if not names or tag in ("html", "body", "article", "main"):
        return tag == "article" and bool(name_parts(names) & {"comment", "comments", "reply", "ad", "related"})
    parts = name_parts(names)
    return bool(parts & DROP_NAMES) or (not in_article and bool(parts & OUTSIDE_NAMES))


@functools.lru_cache(maxsize=10_000)
def step_of(tag: str, names: str) -> str:
    """A step of a generalised path: the tag and its sorted classes and id, digits left out."""
    return ".".join([tag, *sorted({re.sub(r"\d+", "", x) for x in names.lower().split()} - {""})])


def below(path: int, step: str) -> int:
    """Number of the path that goes on from another one by a step."""
    n = xxhash.xxh64_intdigest(f"{path}>{step}")
    return n - (1 << 64) if n >> 63 else n


def path_of(page: Page, i: int) -> str:
    """The generalised path from the root down to a node."""
    steps = []
    while i > 0:
        steps.append(step_of(page.nodes[i].tag, page.nodes[i].names))
        i = page.nodes[i].up
    return ">".join(reversed(steps))


def parse(html: str) -> Page:
    """A lenient tree: unclosed paragraphs and items end where HTML ends them, stray end tags are ignored."""
    page = Page()
    nodes, runs = page.nodes, page.runs
    stack = [0]
    open_tags: Counter = Counter()
    at, end = 0, len(html)

    def close(k: int) -> None:
        open_tags.subtract(nodes[i].tag for i in stack[k:])
        del stack[k:]

    while at < end:
        m = MARKUP.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            runs.append((stack[-1], text))
        if not m:
            break
        at = m.end()
        closing, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if not open_tags[tag]:
                if tag == "p":
                    runs.append((stack[-1], None))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    if tag not in INLINE:
                        runs.append((stack[k], None))
                    close(k)
                    break
                if tag in INLINE and nodes[stack[k]].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                own = nodes[stack[k]].tag
                if own == "p" or (own == tag == "li") or (own in ("dd", "dt") and tag in ("dd", "dt")):
                    close(k)
                    break
                if own not in INLINE:
                    break
        elif tag in ("tr", "td", "th", "option"):
            for k in range(len(stack) - 1, 0, -1):
                own = nodes[stack[k]].tag
                if own == tag or (tag in ("td", "th") and own in ("td", "th")):
                    close(k)
                    break
                if own in ("table", "select") or (own == "tr" and tag != "tr"):
                    break
        attrs = attributes(raw) if raw else {}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        up = stack[-1]
        above = nodes[up]
        if tag not in INLINE or tag == "br":
            runs.append((up, None))
        if tag in VOID:
            continue
        own = len(nodes)
        inline = tag in INLINE
        nodes.append(Node(
            tag, up, names, above.drop or is_boilerplate(tag, names, attrs, above.article), below(above.path, step_of(tag, names)), above.article or tag in ("article", "main") or bool(tag in CONTAINERS and names and name_parts(names) & ARTICLE_NAMES),
            above.block if inline else own, (above.linked or tag == "a") if inline else False, own if tag in CONTAINERS else above.box,
        ))
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = found.end() if found else end
            continue
        if not raw or not raw.rstrip().endswith("/") or tag not in ("svg", "path", "use"):
            stack.append(own)
            open_tags[tag] += 1
    return page


def score(page: Page) -> dict[int, float]:
    """Score of each container outside boilerplate."""
    nodes = page.nodes
    for i, text in page.runs:
        if text is None or nodes[i].drop:
            continue
        n = len(text.strip())
        j = nodes[i].block
        if nodes[j].tag in PARAGRAPHS and n:
            holder, gain = nodes[j].box, -float(n) if nodes[i].linked else float(n)
            share = 1.0
            while holder > 0 and share > 0.01:
                nodes[holder].score += gain * share
                share /= 2
                holder = nodes[nodes[holder].up].box
    out = {}
    for i, n in enumerate(nodes):
        if n.score > 0 and not n.drop:
            good = n.tag in ("article", "main") or bool(name_parts(n.names) & LIKELY)
            out[i] = n.score * (1.25 if good else 1.0)
    return out


def text_of(page: Page, roots: set[int]) -> str:
    """Blocks under these nodes in page order, boilerplate left out."""
    nodes = page.nodes
    inside = [False] * len(nodes)
    for i, n in enumerate(nodes):
        inside[i] = i in roots or (n.up >= 0 and inside[n.up])
    out, block = [], []
    for i, text in [*page.runs, (0, None)]:
        if text is None:
            if block:
                if words := entities.unescape("".join(block)).split():
                    out.append(" ".join(words))
                block = []
        elif inside[i] and not nodes[i].drop:
            block.append(text)
    return " ".join(out)


def votes(html: str) -> list[tuple[int, float]]:
    """This page's paths, by number, with their scores; equal paths add up."""
    page = parse(html)
    total: dict[int, float] = {}
    for i, s in score(page).items():
        p = page.nodes[i].path
        total[p] = total.get(p, 0.0) + s
    best = max(total.values(), default=0.0)
    return [(p, s / best) for p, s in total.items()] if best > 0 else []


def extract(html: str, path: int | None) -> tuple[str, str | None]:
    """(main text, generalised path of the container it is from)."""
    page = parse(html)
    roots = {i for i, n in enumerate(page.nodes) if n.path == path and n.tag in CONTAINERS and not n.drop} if path is not None else set()
    if not roots and (scored := score(page)):
        roots = {max(scored, key=lambda i: (scored[i], -i))}
    if not roots and not any(n.tag in ("html", "body") for n in page.nodes):
        roots = {0}
    return text_of(page, roots), path_of(page, min(roots)) if roots else None


def host_of(url):
    """Lower-case host without a port; empty where there is none."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")), F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path``: the number of the path with most votes of each host (the smallest on ties)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            total: Counter = Counter()
            for host, h in zip(batch.column(0).to_pylist(), batch.column(1)):
                for path, s in votes(h.as_py() or ""):
                    total[host, path] += round(s * 1e6)  # whole numbers: the sum doesn't depend on how rows are batched
            rows = [(h, p, n) for (h, p), n in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["host", "path", "votes"])

    counted = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(vote, "host string, path long, votes long")
    paths = counted.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return paths.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, path, text`` for every page; ``path`` is the generalised path of the container the text is from."""
    winners = cut(host_paths(pages, url, html))
    side = winners.select(F.col("host").alias("of_host"), "path")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"), F.pmod(F.xxhash64(url, html), F.lit(PARTS)).alias("part"))
    if winners.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(side), rows["host"] == side["of_host"], "left")
    else:  # a host's row goes to each part of its pages
        each = side.withColumn("of_part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(PARTS)])))
        joined = rows.join(each, (rows["host"] == each["of_host"]) & (rows["part"] == each["of_part"]), "left")
    kind = dict(rows.dtypes)["page_id"]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            found = [extract(h.as_py() or "", p) for h, p in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p for _, p in found], pa.string()), pa.array([t for t, _ in found], pa.string())], names=["page_id", "url", "path", "text"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(again, f"page_id {kind}, url string, path string, text string")
